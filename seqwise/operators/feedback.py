"""As-of forward join and prediction feedback (rewards)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqwise.functions.columns import epoch_us
from seqwise.functions.constants import CHURN_HOURS
from seqwise.operators.frames import (DEFAULT_ROWS_PER_SPLIT, assign_splits, configured_rows_per_split,
                                      hot_key_splits)

US_PER_HOUR = 3_600_000_000


def common_id_type(a: DataFrame, a_col: str, b: DataFrame, b_col: str) -> str:
    """bigint if both id columns are whole numbers, else string."""
    whole = ("tinyint", "smallint", "int", "bigint")
    return "bigint" if dict(a.dtypes)[a_col] in whole and dict(b.dtypes)[b_col] in whole else "string"


def next_event_after(preds: DataFrame, events: DataFrame, key: str = "user_id",
                     time_col: str = "created_at", rows_per_split: int = DEFAULT_ROWS_PER_SPLIT,
                     hot="auto") -> DataFrame:
    """``preds`` plus the user's first event strictly after each prediction.

    Both sides are tagged and unioned, the predictions' columns travelling
    along, then one window per user takes the first non-null event struct over
    the following rows; at equal times events sort before predictions so
    "after" is strict. Ids are whole numbers or text (compared as text unless
    both sides have whole numbers). Predictions without user or time have no
    event. Hot users: the union is cut into time splits; predictions without
    an answer inside their split take the first event of the next non-empty
    split (a small per-split table)."""
    events = events.where(F.col("muid").isNotNull() & F.col("event_time").isNotNull())
    id_type = common_id_type(events, "event_id", preds, "prediction_id")
    key_type = common_id_type(events, "muid", preds, key)
    # flat columns, so that those nobody reads are pruned before the shuffle
    carried = {f"_p{i}": c for i, c in enumerate(preds.columns)}
    nothing = [F.lit(None).cast(preds.schema[c].dataType).alias(n) for n, c in carried.items()]
    ev = events.select(F.col("muid").cast(key_type).alias("_k"), epoch_us(events, "event_time").alias("_t"),
                       F.lit(0).alias("_tag"),
                       F.struct(F.col("event_id").alias("actual_event_id"),
                                F.col("event_name").alias("actual_event_name"),
                                epoch_us(events, "event_time").alias("actual_t")).alias("_ev"),
                       F.col("event_id").cast(id_type).alias("_oid"), *nothing)
    at = epoch_us(preds, time_col)
    pr = preds.select(F.when(at.isNotNull(), F.col(key).cast(key_type)).alias("_k"), at.alias("_t"),
                      F.lit(1).alias("_tag"), F.lit(None).cast(ev.schema["_ev"].dataType).alias("_ev"),
                      F.col("prediction_id").cast(id_type).alias("_oid"),
                      *[F.col(c).alias(n) for n, c in carried.items()])
    u = ev.unionByName(pr)
    order = ["_t", "_tag", "_oid"]
    if isinstance(hot, str):
        # the split plan covers every row that gets a split: events and predictions
        hot = hot_key_splits(u.select("_k", "_t").where(F.col("_k").isNotNull()), "_k", "_t",
                             configured_rows_per_split(u, rows_per_split))
    # "Nearest event after" is evaluated as a running frame over the reversed
    # order (last non-null over all preceding rows), which Spark computes
    # incrementally; a frame reaching to unbounded following would be
    # recomputed for every row (quadratic in the user's size).
    sp = u if hot is None else assign_splits(u, "_k", "_t", hot)
    # predictions without user or time meet no event: spread, not one group
    spread = F.when(F.col("_k").isNull(), F.xxhash64("_oid")).otherwise(F.lit(0) if hot is None else F.col("_s"))
    w = (Window.partitionBy("_k", "_s").orderBy(*[F.col(c).desc() for c in order])
         .rowsBetween(Window.unboundedPreceding, -1))
    local = sp.withColumn("_s", spread).withColumn("_nx", F.last("_ev", ignorenulls=True).over(w))
    ans = local.where(F.col("_tag") == 1)
    if hot is not None:
        firsts = (sp.where(F.col("_tag") == 0).groupBy("_k", "_s")
                  .agg(F.min_by("_ev", F.struct("_t", "_oid")).alias("_f")))
        nxt = firsts.select("_k", "_s", F.last("_f", ignorenulls=True).over(
            Window.partitionBy("_k").orderBy(F.col("_s").desc())
            .rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
        ans = ans.join(nxt, ["_k", "_s"], "left").withColumn("_nx", F.coalesce("_nx", "_later"))
    return ans.select(*[F.col(n).alias(c) for n, c in carried.items()],
                      "_nx.actual_event_id", "_nx.actual_event_name", "_nx.actual_t")


def actual_outcome(joined: DataFrame, data_end_us, time_col: str = "created_at",
                   churn_hours: float = CHURN_HOURS) -> DataFrame:
    """actual = next event name within ``churn_hours``; 'churn' when there is
    none that soon and the data cover the whole period; null (unresolved) when
    the data end earlier."""
    p = epoch_us(joined, time_col)
    lim = int(round(churn_hours * US_PER_HOUR))
    within = F.col("actual_t").isNotNull() & (F.col("actual_t") - p <= F.lit(lim))
    covered = F.col("actual_t").isNotNull() | (data_end_us - p >= F.lit(lim))
    return joined.withColumn("actual", F.when(within, F.col("actual_event_name"))
                             .when(covered, F.lit("churn")))


def reward(df: DataFrame, predicted: str = "predicted_next_event", actual: str = "actual") -> DataFrame:
    """+1 match; -2 churn; +0.5 purchase/checkout; else -0.1 (in that order)."""
    a, p = F.col(actual), F.col(predicted)
    return df.withColumn("reward", F.when(a.isNull(), F.lit(None).cast("double"))
                         .when(p == a, 1.0).when(a == "churn", -2.0)
                         .when(a.isin("purchase", "checkout"), 0.5).otherwise(-0.1))


def reward_by_action(df: DataFrame, predicted: str = "predicted_next_event") -> DataFrame:
    """Per predicted action (bandit arm): resolved count, total and mean reward."""
    r = df.where(F.col("reward").isNotNull())
    return r.groupBy(F.col(predicted).alias("predicted_action")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("reward").alias("reward_sum"),
        F.avg("reward").alias("reward_mean"))
