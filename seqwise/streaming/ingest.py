"""Streaming ingest: decode, validate, dedup, append; ingest counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqwise.operators.quality import split_valid
from seqwise.sources.sinks import append_events, batch_folder, from_stream_records
from seqwise.streaming.seen import unseen, write_index

STREAM_TIME = "_stream_ts"
DEDUP_KEY = "_dedup_key"
RAW = "raw_value"
THROUGH = "_through"


def decode(records: DataFrame, event_schema: T.StructType, keep: list[str] | None = None) -> DataFrame:
    return from_stream_records(records, event_schema, keep)


def ingest_stream(spark: SparkSession, records: DataFrame, event_schema: T.StructType, table: str,
                  rejects: str, checkpoint: str, dedup_delay: str | None = None, index: str | None = None) -> dict:
    """Decode -> validate -> append valid rows to the month-partitioned table,
    rejects (with reason and the record as it came; a record without a single
    readable field is 'malformed') to a side table. Exactly-once per micro-batch through
    the checkpoint; ``availableNow`` drains what is there and stops.

    With ``dedup_delay`` the stream is idempotent on event_id: duplicates within
    the watermark are dropped by state, rows older than the watermark are late
    and dropped (their number is reported).

    With ``index`` too, a folder of Bloom filters beside the table (see
    ``streaming.seen``), late rows are not dropped but compared with what is
    stored: rows that the state did not let through are tested against the
    filters of their month, and those that no batch has stored are kept
    (``late_kept`` of them). Late events without an id stay dropped: nothing
    tells them from events seen before."""
    ev = decode(records.withColumn(RAW, F.col("value")), event_schema, [RAW])
    empty = F.coalesce(*[F.col(c).cast("string") for c in event_schema.names]).isNull()
    if index and not dedup_delay:
        raise ValueError("index needs dedup_delay")
    every = ev.where(F.col("event_id").isNotNull()).withColumn(THROUGH, F.lit(False))
    if dedup_delay:
        ev = (ev.withColumn(STREAM_TIME, F.col("event_time").cast("timestamp"))
              .withWatermark(STREAM_TIME, dedup_delay)
              # events without an id are no duplicates of each other
              .withColumn(DEDUP_KEY, F.coalesce(F.col("event_id").cast("string"), F.expr("uuid()")))
              .dropDuplicatesWithinWatermark([DEDUP_KEY]).drop(STREAM_TIME, DEDUP_KEY))
    if index:
        ev = ev.withColumn(THROUGH, F.lit(True)).unionByName(every)
    stats = {"batches": 0, "late_kept": 0}
    kept: dict[int, int] = {}
    late: dict[int, int] = {}
    running: list = []

    def note_late() -> None:
        # progress is kept for the last 100 batches only: read it in time
        for p in running[0].recentProgress:
            late[p["batchId"]] = sum(op.get("numRowsDroppedByWatermark", 0) for op in p.get("stateOperators", []))

    def sink(batch: DataFrame, batch_id: int) -> None:
        # foreachBatch may re-run a batch after a failure: each batch owns one
        # folder and overwrites it, so a retry never duplicates rows.
        batch = batch.persist()  # read the micro-batch once for both outputs
        try:
            rows = batch
            if index:
                through = batch.where(THROUGH).drop(THROUGH)
                held = (batch.where(~F.col(THROUGH)).drop(THROUGH)
                        .join(through.select("event_id").where("event_id is not null").distinct(), "event_id", "left_anti"))
                # only valid rows are stored, so only these can have been
                late_rows, broken = split_valid(held.select(*through.columns))
                late_rows = unseen(late_rows, table, index, batch_id)
                kept[batch_id] = late_rows.count()
                rows = through.unionByName(late_rows).unionByName(broken.select(*through.columns))
            valid, bad = split_valid(rows)
            if index:
                write_index(valid, index, batch_id)
            append_events(valid.drop(RAW), batch_folder(table, batch_id), mode="overwrite")
            bad = bad.withColumn("reject_reason", F.when(empty, "malformed").otherwise(F.col("reject_reason")))
            bad.write.mode("overwrite").parquet(batch_folder(rejects, batch_id))
        finally:
            batch.unpersist()
        stats["batches"] += 1
        if running and stats["batches"] % 25 == 0:
            note_late()

    q = (ev.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    running.append(q)
    q.awaitTermination()
    note_late()
    stats["late_kept"] = sum(kept.values())
    stats["late_dropped"] = sum(late.values()) - stats["late_kept"]
    return stats


def hourly_counts_stream(records: DataFrame, event_schema: T.StructType, table: str, checkpoint: str,
                         delay: str = "1 day") -> None:
    """Events per tumbling hour (state bounded by the watermark). Update mode;
    each micro-batch writes the changed hours with its batch id, and readers
    take the newest batch per hour (``read_hourly_counts``)."""
    ev = decode(records, event_schema).withColumn(STREAM_TIME, F.col("event_time").cast("timestamp"))
    counts = (ev.withWatermark(STREAM_TIME, delay)
              .groupBy(F.window(STREAM_TIME, "1 hour").alias("w"))
              .agg(F.count(F.lit(1)).alias("n_events")))

    def sink(batch: DataFrame, batch_id: int) -> None:
        (batch.select(F.col("w.start").alias("hour_start"), "n_events")
         .write.mode("overwrite").parquet(batch_folder(table, batch_id, "batch_id")))

    q = (counts.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def read_hourly_counts(spark: SparkSession, table: str) -> DataFrame:
    t = spark.read.parquet(table)
    return t.groupBy("hour_start").agg(F.max_by("n_events", "batch_id").alias("n_events"))


def total_count_stream(records: DataFrame, event_schema: T.StructType, table: str, checkpoint: str) -> None:
    """Global ingest counter: one row of state, rewritten per micro-batch."""
    counts = decode(records, event_schema).agg(F.count(F.lit(1)).alias("events_ingested_total"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(table, batch_id, "batch_id"))

    q = (counts.writeStream.outputMode("complete").foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def read_total_count(spark: SparkSession, table: str) -> DataFrame:
    t = spark.read.parquet(table)
    return t.agg(F.max_by("events_ingested_total", "batch_id").alias("events_ingested_total"))
