"""Registered queries: windows, window features and labels (WIN-*, LBL-1..7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqwise.functions.columns import r9
from seqwise.operators.windows import NUMERIC_FEATURES, event_gaps, sliding_windows
from seqwise.plans.registry import query
from seqwise.sources import TRAIN_COLUMNS, load_events

FEATURE_AND_TARGET = NUMERIC_FEATURES + [
    "target_purchase", "target_churn", "target_next_event", "target_channel",
    "target_engagement", "target_inactivity", "target_recommended_action", "target_active_period"]
DOUBLE_COLS = set(NUMERIC_FEATURES) | {"target_purchase", "target_churn", "target_engagement",
                                       "target_inactivity"}


def _events(spark, sf_dir):
    return load_events(spark, sf_dir, TRAIN_COLUMNS + ["event_id"])


def _windows(spark, sf_dir, **kw):
    return sliding_windows(_events(spark, sf_dir), **kw)


def _pick(df, cols):
    return df.select("muid", "event_id", *[r9(c).alias(c) if c in DOUBLE_COLS else F.col(c) for c in cols])


@query("window_features")
def window_features(spark, sf_dir):
    """Flagship: windows of 20 with 6 features and 8 labels."""
    return _pick(_windows(spark, sf_dir), FEATURE_AND_TARGET)


@query("window_features_churn24")
def window_features_churn24(spark, sf_dir):
    return _pick(_windows(spark, sf_dir, churn_hours=24), ["target_churn"])


@query("WIN-1")
def win_1(spark, sf_dir):
    w = _windows(spark, sf_dir)
    return w.groupBy("muid").agg(F.count(F.lit(1)).alias("n_windows"),
                                 F.min("event_id").alias("first_target_event_id"),
                                 F.max("event_id").alias("last_target_event_id"))


@query("WIN-2")
def win_2(spark, sf_dir):
    w = _windows(spark, sf_dir, sequences=True)
    seqs = ["seq_event_name", "seq_device_os", "seq_channel", "seq_category", "seq_hour",
            "seq_traffic_source"]
    return w.select("muid", "event_id",
                    *[F.array_join(F.col(c), ",").alias(c) for c in seqs],
                    F.size(F.filter("padding_mask", lambda x: x)).cast("long").alias("mask_true"),
                    F.size("padding_mask").cast("long").alias("mask_len"))


@query("WIN-3")
def win_3(spark, sf_dir):
    return _pick(_windows(spark, sf_dir), ["purchase_ratio", "atc_ratio", "scroll_ratio"])


@query("WIN-4")
def win_4(spark, sf_dir):
    return _pick(_windows(spark, sf_dir), ["unique_types"])


@query("WIN-5")
def win_5(spark, sf_dir):
    return _pick(_windows(spark, sf_dir), ["avg_time_delta"])


@query("WIN-6")
def win_6(spark, sf_dir):
    return _pick(_windows(spark, sf_dir), ["session_count_norm"])


@query("WIN-7")
def win_7(spark, sf_dir):
    g = event_gaps(load_events(spark, sf_dir, ["event_id", "muid", "event_time"]))
    return g.select("muid", "event_id", r9("gap_seconds").alias("gap_seconds"))


for _i, _cols in {1: ["target_purchase"], 2: ["target_churn"],
                  3: ["target_next_event", "target_channel"], 4: ["target_engagement"],
                  5: ["target_inactivity"], 6: ["target_recommended_action"],
                  7: ["target_active_period"]}.items():
    def _mk(cols):
        return lambda spark, sf_dir: _pick(_windows(spark, sf_dir), cols)
    query(f"LBL-{_i}")(_mk(_cols))
