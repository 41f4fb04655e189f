"""Serving sequences: the newest N events per user, left padded.

Top-N per user is a partial WindowGroupLimit (at most N rows per user leave a
task), so collecting N structs per user is bounded whatever the user's size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwise.functions.constants import (
    SERVING_SESSION_CONST, SERVING_TIME_DELTA_CONST, SERVING_UNIQUE_TYPES_DIVISOR,
    UNIQUE_TYPES_DIVISOR, WINDOW_SIZE,
)
from seqwise.functions.columns import epoch_us
from seqwise.operators.aggregates import newest_events
from seqwise.operators.vocab import encode_dynamic

SERVING_FEATURES = ["event_name", "device_os", "channel", "traffic_source", "category"]


def _field(name: str):
    return lambda x: x[name]


def serving_windows(events: DataFrame, vocab: DataFrame, n: int = WINDOW_SIZE) -> DataFrame:
    """Per user: 5 dynamic-ID arrays of length n (0-padded on the left), the
    padding mask (true on padding), the event count and the raw tail
    (names, times, sessions) used by the serving-side features."""
    last = newest_events(events, n)
    enc = encode_dynamic(last, vocab, SERVING_FEATURES)
    enc = enc.withColumn("_t", epoch_us(enc, "event_time"))
    g = enc.groupBy("muid").agg(F.sort_array(F.collect_list(F.struct(
        "_t", "event_id", *[F.col(f + "_id").alias(f) for f in SERVING_FEATURES],
        F.col("event_name").alias("raw_name"), F.col("session_id").alias("raw_session")))).alias("_ev"))
    size = F.size("_ev")
    pad = F.array_repeat(F.lit(0), F.lit(n) - size)
    cols = [F.concat(pad, F.transform("_ev", _field(f))).alias(f"seq_{f}") for f in SERVING_FEATURES]
    return g.select(
        "muid", *cols,
        F.concat(F.array_repeat(F.lit(True), F.lit(n) - size),
                 F.array_repeat(F.lit(False), size)).alias("padding_mask"),
        size.cast("int").alias("n_events"),
        F.transform("_ev", lambda x: x["raw_name"]).alias("tail_names"),
        F.transform("_ev", lambda x: x["_t"]).alias("tail_t"),
        F.transform("_ev", lambda x: x["raw_session"]).alias("tail_sessions"),
    )


def _count_name(arr, name):
    return F.size(F.filter(arr, lambda x: x == F.lit(name)))


def _serving_exprs(size: int = WINDOW_SIZE) -> list:
    """Serving-side features (ratios over the actual count, distinct/10,
    constants for time and sessions, zeros when empty), in FEATURE order."""
    n = F.col("n_events")
    names = F.col("tail_names")

    def ratio(name):
        return F.when(n > 0, _count_name(names, name) / n).otherwise(F.lit(0.0))

    return [ratio("purchase"), ratio("add_to_cart"), ratio("scroll"),
            F.when(n > 0, F.size(F.array_distinct(names)) / F.lit(float(SERVING_UNIQUE_TYPES_DIVISOR)))
            .otherwise(F.lit(0.0)),
            F.when(n > 0, F.lit(SERVING_TIME_DELTA_CONST)).otherwise(F.lit(0.0)),
            F.when(n > 0, F.lit(SERVING_SESSION_CONST)).otherwise(F.lit(0.0))]


def _training_exprs(size: int = WINDOW_SIZE) -> list:
    """The training formulas applied to the same tail events, in FEATURE order."""
    names = F.col("tail_names")
    t = F.col("tail_t")
    n = F.col("n_events")
    span_s = (F.element_at(t, -1) - F.element_at(t, 1)) / F.lit(1e6)
    mean_gap = F.when(n > 1, span_s / (n - 1)).otherwise(F.lit(0.0))
    return [_count_name(names, "purchase") / F.lit(float(size)),
            _count_name(names, "add_to_cart") / F.lit(float(size)),
            _count_name(names, "scroll") / F.lit(float(size)),
            F.size(F.array_distinct(names)) / F.lit(float(UNIQUE_TYPES_DIVISOR)),
            F.least(F.log1p(mean_gap) / F.lit(15.0), F.lit(1.0)),
            F.least(F.size(F.array_distinct("tail_sessions")) / F.lit(5.0), F.lit(1.0))]


FEATURES = ["purchase_ratio", "atc_ratio", "scroll_ratio", "unique_types", "avg_time_delta",
            "session_count_norm"]


MODEL_INPUTS = [*[f"seq_{f}" for f in SERVING_FEATURES], "padding_mask"]


def serving_features(sw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Serving-side window features per user (with ``n_events``); ``keep``
    names columns of ``sw`` that stay, such as ``MODEL_INPUTS``."""
    return sw.select("muid", "n_events", *keep, *[e.alias(f) for e, f in zip(_serving_exprs(), FEATURES)])


def training_features_of_tail(sw: DataFrame, size: int = WINDOW_SIZE) -> DataFrame:
    """The training formulas applied to the same tail events."""
    return sw.select("muid", *[e.alias(f) for e, f in zip(_training_exprs(size), FEATURES)])


def skew_report(sw: DataFrame) -> DataFrame:
    """Mean absolute difference serving vs training, per feature (one row each)."""
    feats = ["purchase_ratio", "atc_ratio", "scroll_ratio", "unique_types", "avg_time_delta",
             "session_count_norm"]
    # both variants are projections of the same rows: one select, no self-join
    sv = dict(zip(FEATURES, _serving_exprs()))
    tv = dict(zip(FEATURES, _training_exprs()))
    j = sw.select(*[sv[f].alias(f"s_{f}") for f in feats], *[tv[f].alias(f"t_{f}") for f in feats])
    one = j.agg(*[F.avg(F.abs(F.col(f"s_{f}") - F.col(f"t_{f}"))).alias(f) for f in feats],
                F.count(F.lit(1)).alias("users"))
    stack = ", ".join(f"'{f}', `{f}`" for f in feats)
    return one.selectExpr("users", f"stack({len(feats)}, {stack}) AS (feature, mean_abs_diff)")
