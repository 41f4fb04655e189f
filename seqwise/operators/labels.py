"""Alternate label set from a history frame and a multi-event future frame.

For every event (the last event of the history), the future is the next
``horizon`` events of the same user. Bounded frame, so hot users split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwise.functions.columns import epoch_us, floor_days, period_of_hour
from seqwise.operators.frames import DEFAULT_ROWS_PER_SPLIT, bounded_window
from seqwise.operators.vocab import encode_dynamic

ORDER = ["event_time", "event_id"]


def future_labels(events: DataFrame, vocab: DataFrame, horizon: int = 5,
                  rows_per_split: int = DEFAULT_ROWS_PER_SPLIT, hot="auto") -> DataFrame:
    events = events.where(F.col("muid").isNotNull() & F.col("event_time").isNotNull())
    df = events.withColumn("_t", epoch_us(events, "event_time"))

    def make(w):
        fut = w.rowsBetween(1, horizon)
        return {
            "_n_future": F.count(F.lit(1)).over(fut),
            "_any_purchase": F.max((F.col("event_name") == "purchase").cast("int")).over(fut),
            "_next_name": F.lead("event_name", 1).over(w),
            "_next_t": F.lead("_t", 1).over(w),
            "_next_hour": F.hour(F.lead("event_time", 1).over(w)),
            "_mode_channel": F.mode("channel", True).over(fut),
        }

    lab = bounded_window(df, "muid", ORDER, "_t", 0, horizon, make,
                         rows_per_split=rows_per_split, hot=hot)
    lab = encode_dynamic(lab.withColumnRenamed("_next_name", "event_name_next")
                         .withColumnRenamed("_mode_channel", "channel_mode"),
                         vocab.where(F.col("feature").isin("event_name", "channel"))
                         .withColumn("feature", F.concat("feature", F.when(
                             F.col("feature") == "event_name", F.lit("_next")).otherwise(F.lit("_mode")))),
                         ["event_name_next", "channel_mode"])
    has = F.col("_n_future") > 0
    return lab.select(
        "muid", "event_id",
        F.when(has & (F.col("_any_purchase") == 1), 1.0).otherwise(0.0).alias("target_purchase"),
        F.when(~has, 1.0).otherwise(0.0).alias("target_churn"),
        F.when(has, F.col("event_name_next_id")).otherwise(F.lit(0)).alias("target_next_event"),
        F.when(has & F.col("channel_mode").isNotNull(), F.col("channel_mode_id"))
        .otherwise(F.lit(0)).alias("target_channel"),
        F.col("_n_future").cast("double").alias("target_engagement"),
        F.when(has, floor_days(F.col("_next_t") - F.col("_t")).cast("double"))
        .otherwise(F.lit(0.0)).alias("target_inactivity"),
        F.lit(0).alias("target_recommended_action"),
        F.when(has, period_of_hour(F.col("_next_hour"))).otherwise(F.lit(0)).alias("target_active_period"),
    )
