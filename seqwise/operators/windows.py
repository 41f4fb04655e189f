"""Sliding windows of the last N events per user, window features and labels.

For every event i of a user that has at least ``size`` earlier events, the
window is the ``size`` events before it and the target is event i itself. All
features are frame aggregates over ``rowsBetween(-size, -1)`` and all labels are
expressions on the current row, so the whole operator is one hash exchange on
the user, one sort and one Window node (hot users: see ``frames``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from seqwise.functions.columns import encode_static, epoch_us, hour_enc, norm_text, period_of_hour
from seqwise.functions.constants import (
    ACTION_CLASSES, CHURN_HOURS, UNIQUE_TYPES_DIVISOR, WINDOW_SIZE,
)
from seqwise.operators.frames import DEFAULT_ROWS_PER_SPLIT, bounded_window

ORDER = ["event_time", "event_id"]
US_PER_HOUR = 3_600_000_000
SEQ_FEATURES = ["event_name", "device_os", "channel", "category", "hour", "traffic_source"]
NUMERIC_FEATURES = ["purchase_ratio", "atc_ratio", "scroll_ratio", "unique_types",
                    "avg_time_delta", "session_count_norm"]
LAST_EVENT_FEATURES = ["last_event_name_id", "last_channel_id", "last_hour_id"]
TARGETS = ["target_purchase", "target_churn", "target_next_event", "target_channel",
           "target_engagement", "target_inactivity", "target_recommended_action",
           "target_active_period"]


def encode_events(df: DataFrame) -> DataFrame:
    """Static-vocabulary IDs (unknown/null -> 0). event_name, device_os and
    channel match exactly; category and traffic_source are trimmed/lowered."""
    return df.select(
        "*",
        encode_static("event_name", "event_name").alias("event_name_id"),
        encode_static("device_os", "device_os").alias("device_os_id"),
        encode_static("channel", "channel").alias("channel_id"),
        encode_static("category", norm_text("category")).alias("category_id"),
        encode_static("traffic_source", norm_text("traffic_source")).alias("traffic_source_id"),
        hour_enc("event_time").cast("int").alias("hour_id"),
    )


def _window_columns(size: int, sequences: bool):
    """Frame aggregates over the previous ``size`` rows, each computed once."""
    def make(w: WindowSpec) -> dict[str, Column]:
        wb = w.rowsBetween(-size, -1)
        en = F.col("event_name")

        def n_of(cond: Column) -> Column:
            return F.sum(F.when(cond, 1).otherwise(0)).over(wb)

        cols = {
            "_n_prev": F.count(F.lit(1)).over(wb),
            "_n_purchase": n_of(en == "purchase"),
            "_n_atc": n_of(en == "add_to_cart"),
            "_n_scroll": n_of(en == "scroll"),
            "_n_types": F.size(F.collect_set(en).over(wb)),
            "_n_sessions": (F.size(F.collect_set("session_id").over(wb))
                            + F.max(F.col("session_id").isNull().cast("int")).over(wb)),
            "_t_first": F.min("_t").over(wb),
            "_t_last": F.max("_t").over(wb),
            "last_event_name_id": F.lag("event_name_id", 1).over(w),
            "last_channel_id": F.lag("channel_id", 1).over(w),
            "last_hour_id": F.lag("hour_id", 1).over(w),
        }
        if sequences:
            cols["_seq"] = F.collect_list(F.struct(
                "event_name_id", "device_os_id", "channel_id", "category_id", "hour_id",
                "traffic_source_id")).over(wb)
        return cols

    return make


def _features(size: int, churn_hours: float) -> list[Column]:
    """Window features and frame-based labels from the frame aggregates."""
    churn_us = int(round(churn_hours * US_PER_HOUR))
    span_us = F.col("_t_last") - F.col("_t_first")
    mean_gap_s = (span_us / F.lit(1e6) / F.lit(size - 1)) if size > 1 else F.lit(0.0)
    fsize = F.lit(float(size))
    return [
        (F.col("_n_purchase") / fsize).alias("purchase_ratio"),
        (F.col("_n_atc") / fsize).alias("atc_ratio"),
        (F.col("_n_scroll") / fsize).alias("scroll_ratio"),
        (F.col("_n_types") / F.lit(float(UNIQUE_TYPES_DIVISOR))).alias("unique_types"),
        F.least(F.log1p(mean_gap_s) / F.lit(15.0), F.lit(1.0)).alias("avg_time_delta"),
        F.least(F.col("_n_sessions") / F.lit(5.0), F.lit(1.0)).alias("session_count_norm"),
        F.when(F.col("_t") - F.col("_t_last") > F.lit(churn_us), 1.0).otherwise(0.0).alias("target_churn"),
        ((F.lit(size) - F.col("_n_scroll")) / fsize).alias("target_engagement"),
        F.least(F.greatest(span_us / F.lit(float(US_PER_HOUR)), F.lit(0.01)) / fsize,
                F.lit(1.0)).alias("target_inactivity"),
    ]


def sliding_windows(events: DataFrame, size: int = WINDOW_SIZE, churn_hours: float = CHURN_HOURS,
                    sequences: bool = False, rows_per_split: int = DEFAULT_ROWS_PER_SPLIT,
                    hot="auto") -> DataFrame:
    """One row per window: muid, event_id (of the target), event_time (of the
    target), the 6 numeric features, the 8 targets and optionally the 6 ID
    sequences plus the all-false padding mask.

    Users with fewer than ``size + 1`` events give no window."""
    df = encode_events(events.where(F.col("muid").isNotNull() & F.col("event_time").isNotNull()))
    df = df.withColumn("_t", epoch_us(df, "event_time"))
    out = bounded_window(df, "muid", ORDER, "_t", size, 0, _window_columns(size, sequences),
                         rows_per_split=rows_per_split, hot=hot)
    out = out.where(F.col("_n_prev") == size).select("*", *_features(size, churn_hours))
    labels = [
        F.when(F.col("event_name") == "purchase", 1.0).otherwise(0.0).alias("target_purchase"),
        F.col("target_churn"),
        F.col("event_name_id").alias("target_next_event"),
        F.col("channel_id").alias("target_channel"),
        F.col("target_engagement"),
        F.col("target_inactivity"),
        F.least(F.col("event_name_id"), F.lit(ACTION_CLASSES - 1)).alias("target_recommended_action"),
        period_of_hour(F.hour("event_time")).alias("target_active_period"),
    ]
    seq_cols = []
    if sequences:
        s = F.col("_seq")
        seq_cols = [
            F.transform(s, lambda x: x["event_name_id"]).alias("seq_event_name"),
            F.transform(s, lambda x: x["device_os_id"]).alias("seq_device_os"),
            F.transform(s, lambda x: x["channel_id"]).alias("seq_channel"),
            F.transform(s, lambda x: x["category_id"]).alias("seq_category"),
            F.transform(s, lambda x: x["hour_id"]).alias("seq_hour"),
            F.transform(s, lambda x: x["traffic_source_id"]).alias("seq_traffic_source"),
            F.array_repeat(F.lit(False), size).alias("padding_mask"),
        ]
    return out.select("muid", "event_id", "event_time", *NUMERIC_FEATURES, *LAST_EVENT_FEATURES,
                      *labels, *seq_cols)


def event_gaps(events: DataFrame, rows_per_split: int = DEFAULT_ROWS_PER_SPLIT, hot="auto") -> DataFrame:
    """Gap in seconds to the previous event of the same user (null for the first)."""
    events = events.where(F.col("muid").isNotNull() & F.col("event_time").isNotNull())
    df = events.withColumn("_t", epoch_us(events, "event_time"))

    def make(w):
        return {"prev_event_time": F.lag("event_time", 1).over(w),
                "gap_seconds": (F.col("_t") - F.lag("_t", 1).over(w)) / F.lit(1e6)}

    return bounded_window(df, "muid", ORDER, "_t", 1, 0, make,
                          rows_per_split=rows_per_split, hot=hot).drop("_t")
