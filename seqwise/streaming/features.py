"""Continuously maintained user features, by two streams over the events.

* Activity: counts and the newest time per (user, channel).
* Distinct values: every event names its session and its category; a value that
  its user has shown before is dropped by a first stateful operator, keyed by
  (user, kind, value), and a second one counts what is left per (user, kind).

So every state row is a few numbers. A user's sessions are rows spread over all
tasks, never a set in one row, and no row grows with a user's history. All
operators are Spark's own (RocksDB state, incremental checkpoints).

Update mode emits the rows that a micro-batch changed; the sink writes them into
the batch's own folder of a changelog (rewritten on a retry, so exactly once).
Readers take the newest row a key (a partial-aggregated ``max_by``) and add up
each user's channels: the upsert of STO-1 applied at read time. The two streams
commit on their own; a reader between their commits sees one a batch ahead.
Values that must stay distinct are remembered for good; give ``forget_after`` to
let both streams' memory of a value end that long behind the newest event, where
sessions do not return later than that."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwise.functions.columns import epoch_us, floor_days
from seqwise.sources.sinks import batch_folder
from seqwise.streaming.stateful import use_rocksdb_state

ACTIVITY = ["total_events", "purchase_count", "last_event_time"]


def channel_activity(events: DataFrame) -> DataFrame:
    """Running counts and newest time per user and channel (null is one, too)."""
    return events.groupBy("muid", "channel").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("event_name") == "purchase").alias("purchase_count"),
        F.max("event_time").alias("last_event_time"))


def distinct_values(events: DataFrame, forget_after: str | None = None) -> DataFrame:
    """Running numbers of distinct sessions and categories per user."""
    kinds = [F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value"))
             for k, c in (("session", "session_id"), ("category", "category"))]
    keys = ["muid", "kind", "value"]
    if forget_after is None:
        shown = events.select("muid", F.explode(F.array(*kinds)).alias("v")).select("muid", "v.*")
        first = shown.where("value is not null").dropDuplicates(keys)
    else:
        seen = events.select("muid", F.col("event_time").cast("timestamp").alias("seen"),
                             F.explode(F.array(*kinds)).alias("v")).select("muid", "seen", "v.*")
        first = (seen.where("value is not null").withWatermark("seen", forget_after)
                 .dropDuplicatesWithinWatermark(keys))
    return first.groupBy("muid", "kind").agg(F.count(F.lit(1)).alias("n"))


def feature_upkeep_stream(spark: SparkSession, events_stream: DataFrame, table: str, checkpoint: str,
                          forget_after: str | None = None) -> None:
    use_rocksdb_state(spark)
    started = []
    for part, rows in (("activity", channel_activity(events_stream)),
                       ("distinct", distinct_values(events_stream, forget_after))):
        def sink(batch: DataFrame, batch_id: int, part: str = part) -> None:
            batch.write.mode("overwrite").parquet(batch_folder(f"{table}/{part}", batch_id, "batch_id"))
        started.append(rows.writeStream.outputMode("update").foreachBatch(sink)
                       .option("checkpointLocation", f"{checkpoint}/{part}").trigger(availableNow=True).start())
    for query in started:
        query.awaitTermination()


def read_features(spark: SparkSession, table: str, as_of: str) -> DataFrame:
    """Features per user from the newest rows of the changelogs, with days since
    last activity. The preferred channel is the most frequent one that is not
    null, the smallest of equals."""
    log = spark.read.parquet(f"{table}/activity")
    newest = log.groupBy("muid", "channel").agg(F.max_by(F.struct(*ACTIVITY), "batch_id").alias("r"))
    newest = newest.select("muid", "channel", *[F.col(f"r.{c}").alias(c) for c in ACTIVITY])
    by_count = F.when(F.col("channel").isNotNull(), F.struct((-F.col("total_events")).alias("n"), "channel"))
    users = newest.groupBy("muid").agg(
        *[F.sum(c).alias(c) for c in ACTIVITY[:2]], F.max("last_event_time").alias("last_event_time"),
        F.min(by_count)["channel"].alias("preferred_channel"))
    values = (spark.read.parquet(f"{table}/distinct").groupBy("muid", "kind").agg(F.max_by("n", "batch_id").alias("n"))
              .groupBy(F.col("muid").alias("user"))
              .agg(*[F.max(F.when(F.col("kind") == k, F.col("n"))).alias(k) for k in ("session", "category")]))
    cur = users.join(values, F.col("muid").eqNullSafe(F.col("user")), "left")
    cur = cur.withColumn("_asof", F.lit(as_of).cast(cur.schema["last_event_time"].dataType))
    return cur.select("muid", "total_events", "purchase_count",
                      F.coalesce("category", F.lit(0)).cast("long").alias("unique_categories"),
                      F.coalesce("session", F.lit(0)).cast("long").alias("session_count"),
                      floor_days(epoch_us(cur, "_asof") - epoch_us(cur, "last_event_time")).alias("days_since_active"),
                      "preferred_channel")
