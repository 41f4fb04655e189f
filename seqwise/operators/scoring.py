"""Scoring: decode raw model outputs, rule-based scorer, distributed batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqwise.functions.columns import argmax0, epoch_us, sigmoid
from seqwise.operators.frames import DEFAULT_ROWS_PER_SPLIT, bounded_window
from seqwise.operators.windows import NUMERIC_FEATURES

OUTPUTS = ["p_purchase", "p_churn", "p_next_event", "p_channel", "p_engagement",
           "p_inactivity", "p_action", "p_active_period"]
OUTPUT_SCHEMA = ("p_purchase double, p_churn double, p_next_event array<double>, "
                 "p_channel array<double>, p_engagement double, p_inactivity double, "
                 "p_action array<double>, p_active_period array<double>")


def decode_predictions(df: DataFrame, event_names: list[str], channels: list[str]) -> DataFrame:
    """8 raw outputs -> prediction fields. Sigmoid for the two binary heads,
    first-max argmax for the four class heads, regressions unchanged; IDs
    decode through the given vocabularies (miss -> 'unknown')."""
    def lookup(values, idx):
        arr = F.array(*[F.lit(v) for v in values])
        return F.when((idx >= 0) & (idx < len(values)), F.element_at(arr, idx + 1)).otherwise(F.lit("unknown"))

    return df.select(
        "*",
        sigmoid("p_purchase").alias("purchase_probability"),
        sigmoid("p_churn").alias("churn_risk"),
        lookup(event_names, argmax0("p_next_event")).alias("next_event"),
        lookup(channels, argmax0("p_channel")).alias("preferred_channel"),
        F.col("p_engagement").alias("engagement_score"),
        F.col("p_inactivity").alias("inactivity_risk"),
        F.concat(F.lit("action_"), argmax0("p_action").cast("string")).alias("recommended_action"),
        F.concat(F.lit("period_"), argmax0("p_active_period").cast("string")).alias("active_time"),
    )


def heuristic_columns(n, has_cart, last_is_purchase) -> dict:
    """Rule-based scores of a window with ``n`` events (values in percent)."""
    purchase = F.least(F.lit(95.0), n * 5.0 + F.when(has_cart, 40.0).otherwise(0.0))
    churn = F.greatest(F.lit(5.0), F.lit(80.0) - n * 10.0)
    nxt = F.when(has_cart, "purchase").when(n > 2, "add_to_cart").otherwise("viewcontent")
    lp = F.coalesce(last_is_purchase, F.lit(False))
    return {
        "purchase_probability": F.when(lp, F.lit(2.0)).otherwise(purchase),
        "churn_risk": F.when(lp, F.lit(60.0)).otherwise(churn),
        "predicted_next_event": F.when(lp, F.lit("pageview")).otherwise(nxt),
        "preferred_channel": F.lit("browser"),
        "engagement_score": n * 0.15,
        "inactivity_risk": (F.lit(10) - n).cast("double"),
        "active_time": F.lit("Evening"),
    }


def heuristic_score(serving: DataFrame) -> DataFrame:
    """Rule-based scorer over serving windows (``tail_names`` arrays)."""
    names = F.col("tail_names")
    n = F.size(names)
    has_cart = F.exists(names, lambda x: x == F.lit("add_to_cart"))
    last_p = F.element_at(names, -1) == F.lit("purchase")
    cols = heuristic_columns(n, has_cart, F.when(n > 0, last_p))
    return serving.select("muid", *[c.alias(k) for k, c in cols.items()])


def version_of(df: DataFrame, key: str = "muid") -> Column:
    """Model version serving a user: 'v' || (id % 2), text ids by their crc32."""
    number = F.crc32(F.col(key)) if dict(df.dtypes)[key] == "string" else F.col(key)
    return F.concat(F.lit("v"), (number % 2).cast("string"))


def prediction_log(events: DataFrame, size: int = 20, rows_per_split: int = DEFAULT_ROWS_PER_SPLIT,
                   hot="auto") -> DataFrame:
    """One rule-based prediction per arriving event over the newest ``size``
    events up to it (batch twin of the streaming buffer). prediction_id =
    event_id of the triggering event, created_at = its time, model_version as
    in ``version_of``."""
    events = events.where(F.col("muid").isNotNull() & F.col("event_time").isNotNull())
    df = events.withColumn("_t", epoch_us(events, "event_time"))

    def make(w):
        f = w.rowsBetween(-(size - 1), 0)
        return {"_n": F.count(F.lit(1)).over(f),
                "_cart": F.max((F.col("event_name") == "add_to_cart").cast("int")).over(f)}

    win = bounded_window(df, "muid", ["event_time", "event_id"], "_t", size - 1, 0, make,
                         rows_per_split=rows_per_split, hot=hot)
    cols = heuristic_columns(F.col("_n"), F.col("_cart") == 1, F.col("event_name") == "purchase")
    return win.select(
        F.col("event_id").alias("prediction_id"), F.col("muid").alias("user_id"),
        version_of(win).alias("model_version"),
        F.col("event_time").alias("created_at"), F.col("_n").cast("int").alias("window_events"),
        *[c.alias(k) for k, c in cols.items()])


# ---------------------------------------------------------------- batch scoring

def feature_scorer() -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Default scorer: fixed arithmetic of the 6 window features into the 8
    raw outputs (deterministic stand-in for a trained network; forced argmax
    ties exercise the first-max rule)."""
    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pr, ar, sr = pdf["purchase_ratio"].to_numpy(), pdf["atc_ratio"].to_numpy(), pdf["scroll_ratio"].to_numpy()
        ut, td, sc = pdf["unique_types"].to_numpy(), pdf["avg_time_delta"].to_numpy(), pdf["session_count_norm"].to_numpy()
        n = len(pdf)
        z = np.zeros(n)
        nxt = np.stack([z, sr, ar, ut, z + 0.1, z + 0.1, pr], axis=1)
        chan = np.stack([z, sc, 1.0 - sc], axis=1)
        act = np.concatenate([nxt, np.zeros((n, 13))], axis=1)
        per = np.stack([td, z + 0.5, ut, z + 0.5], axis=1)
        return pd.DataFrame({
            "p_purchase": pr * 10.0 - 1.0,
            "p_churn": sr * 4.0 - 2.0,
            "p_next_event": list(nxt), "p_channel": list(chan),
            "p_engagement": 1.0 - sr, "p_inactivity": td,
            "p_action": list(act), "p_active_period": list(per),
        })
    return score


def score_features(windows: DataFrame) -> DataFrame:
    """``windows`` plus the outputs of ``feature_scorer``, as column expressions
    (no Python workers); for scorers that are not expressions see ``score_windows``."""
    pr, ar, sr = F.col("purchase_ratio"), F.col("atc_ratio"), F.col("scroll_ratio")
    ut, td, sc = F.col("unique_types"), F.col("avg_time_delta"), F.col("session_count_norm")
    zero, tie = F.lit(0.0), F.lit(0.1)
    nxt = [zero, sr, ar, ut, tie, tie, pr]
    return windows.select(
        *[c for c in windows.columns if c not in NUMERIC_FEATURES],
        (pr * 10.0 - 1.0).alias("p_purchase"), (sr * 4.0 - 2.0).alias("p_churn"),
        F.array(*nxt).alias("p_next_event"), F.array(zero, sc, F.lit(1.0) - sc).alias("p_channel"),
        (F.lit(1.0) - sr).alias("p_engagement"), td.alias("p_inactivity"),
        F.array(*nxt, *[zero] * 13).alias("p_action"),
        F.array(td, F.lit(0.5), ut, F.lit(0.5)).alias("p_active_period"))


def score_windows(windows: DataFrame, scorer_factory: Callable[[], Callable] = feature_scorer,
                  keep: list[str] | None = None, inputs: list[str] | None = None) -> DataFrame:
    """Distributed batch scoring with a user-supplied scorer (Arrow batches via
    mapInPandas). The scorer is created once per partition, so an expensive
    model session (e.g. ONNX) loads once per task, not per row. It receives the
    numeric features and the columns ``inputs`` (id sequences, padding mask)."""
    inputs = [*(inputs or []), *NUMERIC_FEATURES]
    keep = keep or [c for c in windows.columns if c not in inputs]
    inp = windows.select(*keep, *[c for c in inputs if c not in keep])
    keep_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inp.schema.fields
                            if f.name in keep)
    schema = f"{keep_schema}, {OUTPUT_SCHEMA}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_factory()
        for pdf in batches:
            out = scorer(pdf[inputs])
            yield pd.concat([pdf[keep].reset_index(drop=True), out.reset_index(drop=True)], axis=1)

    return inp.mapInPandas(run, schema)


def onnx_scorer_factory(model_path: str, input_map: dict[str, str] | None = None):
    """Scorer factory around an ONNX model (onnxruntime imported lazily in the task)."""
    def factory():
        import onnxruntime as ort
        sess = ort.InferenceSession(model_path)
        names = [o.name for o in sess.get_outputs()]

        def score(pdf: pd.DataFrame) -> pd.DataFrame:
            feeds = {"numeric_features": pdf[NUMERIC_FEATURES].to_numpy(np.float32)}
            outs = {k: np.asarray(v, dtype="float64") for k, v in zip(names, sess.run(None, feeds))}
            return pd.DataFrame({k: (list(v) if v.ndim > 1 and v.shape[1] > 1 else v.reshape(-1))
                                 for k, v in outs.items()})[OUTPUTS]
        return score
    return factory


def predict_batch(history: DataFrame, recent: DataFrame, vocab: DataFrame, event_names: list[str],
                  channels: list[str], scorer_factory: Callable[[], Callable] = feature_scorer,
                  model_version: str = "v1") -> DataFrame:
    """Batch prediction for every user: request-time events merged with the
    stored history (one row per event id), the newest 20 as the serving
    window, serving-side features, the scorer (which gets the id sequences and
    the padding mask as well), decoded fields, one log row per user."""
    from seqwise.operators.sampling import merge_recent
    from seqwise.operators.sequences import MODEL_INPUTS, serving_features, serving_windows
    merged = merge_recent(history, recent)
    sw = serving_windows(merged, vocab)
    scored = score_windows(serving_features(sw, MODEL_INPUTS), scorer_factory, keep=["muid", "n_events"],
                           inputs=MODEL_INPUTS)
    d = decode_predictions(scored, event_names, channels)
    return d.select(F.col("muid").alias("user_id"), F.lit(model_version).alias("model_version"),
                    F.col("n_events").alias("window_events"), "purchase_probability", "churn_risk",
                    "next_event", "preferred_channel", "engagement_score", "inactivity_risk",
                    "recommended_action", "active_time")
