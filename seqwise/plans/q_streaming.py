"""Registered streaming queries. Each feeds the events (or data derived from
them) through a file-backed record stream, drains it with ``availableNow`` and
returns the sink table; the batch twins are the oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqwise.functions.columns import epoch_us, r9
from seqwise.operators.scoring import prediction_log
from seqwise.operators.store import features_to_json
from seqwise.plans.q_serving import _store_table
from seqwise.plans.registry import query
from seqwise.sources import load_events
from seqwise.sources.compaction import BatchTable, committed_through
from seqwise.sources.events import EVENT_COLUMNS
from seqwise.sources.sinks import scratch_path
from seqwise.streaming import features as SF
from seqwise.streaming import ingest as SI
from seqwise.streaming import stateful as SS
from seqwise.streaming.feed import read_record_stream, write_chunked, write_record_feed
from seqwise.streaming.lookup import lookup_stream

AS_OF = "2024-02-01 00:00:00"


def _feed(spark, sf_dir, chunks=6, extra=None):
    e = load_events(spark, sf_dir)
    folder = scratch_path(spark, "feed")
    files = write_record_feed(e, folder, chunks)
    if extra is not None:
        write_record_feed(extra(e), folder, 1)
    return e.schema, read_record_stream(spark, folder, files_per_trigger=files)


@query("STR-1")
def str_1(spark, sf_dir):
    schema, rec = _feed(spark, sf_dir)
    table, rejects = scratch_path(spark, "ingested"), scratch_path(spark, "rejects")
    SI.ingest_stream(spark, rec, schema, table, rejects, scratch_path(spark, "ckpt"))
    return spark.read.parquet(table).select(*EVENT_COLUMNS)


@query("STR-1-compacted")
def str_1_compacted(spark, sf_dir):
    """The table between two compactions: the first half of the stream compacted
    and its batch folders deleted, the second half in batch folders."""
    e = load_events(spark, sf_dir)
    half = F.col("event_time") < F.lit("2024-01-16").cast("timestamp_ntz")
    folder, table, ckpt = (scratch_path(spark, n) for n in ("feed", "ingested", "ckpt"))
    for part in (half, F.coalesce(~half, F.lit(True))):
        files = write_record_feed(e.where(part), folder, 3)
        SI.ingest_stream(spark, read_record_stream(spark, folder, files_per_trigger=files), e.schema, table,
                         scratch_path(spark, "rejects"), ckpt)
        if part is half:
            batches = BatchTable(spark, table, e.schema)
            batches.compact(committed_through(spark, ckpt))
            batches.vacuum(keep=1)
    return BatchTable(spark, table, e.schema).read().select(*EVENT_COLUMNS)


@query("STR-2")
def str_2(spark, sf_dir):
    """Re-delivered records (the newest 3 days again) are dropped: duplicates
    inside the watermark by state, older ones as late rows."""
    def redeliver(e):
        return e.where(F.col("event_time") >= F.lit("2024-01-27").cast("timestamp_ntz"))
    schema, rec = _feed(spark, sf_dir, extra=redeliver)
    table, rejects = scratch_path(spark, "ingested"), scratch_path(spark, "rejects")
    SI.ingest_stream(spark, rec, schema, table, rejects, scratch_path(spark, "ckpt"), dedup_delay="2 days")
    return spark.read.parquet(table).select(*EVENT_COLUMNS)


def _version(user) -> str:
    """The version that the derived prediction log gives a user."""
    return f"v{user % 2}"


@query("STR-2-late")
def str_2_late(spark, sf_dir):
    """Half of the first days' records come weeks late, among re-deliveries of
    the other half: compared with the stored table, each event is kept once."""
    e = load_events(spark, sf_dir)
    early = F.col("event_time") < F.lit("2024-01-05").cast("timestamp_ntz")
    folder = scratch_path(spark, "feed")
    files = write_record_feed(e.where(~(early & (F.col("event_id") % 2 == 1))), folder, 4)
    write_record_feed(e.where(early), folder, 1)
    table, rejects = scratch_path(spark, "ingested"), scratch_path(spark, "rejects")
    SI.ingest_stream(spark, read_record_stream(spark, folder, files_per_trigger=files), e.schema, table, rejects,
                     scratch_path(spark, "ckpt"), dedup_delay="2 days", index=scratch_path(spark, "seen"))
    return spark.read.parquet(table).select(*EVENT_COLUMNS)


@query("STR-3")
def str_3(spark, sf_dir):
    schema, rec = _feed(spark, sf_dir)
    events = SI.decode(rec, schema)
    out = scratch_path(spark, "buffer_predictions")
    q = (SS.buffer_predictions(events, version=_version).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", scratch_path(spark, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    p = spark.read.parquet(out)
    return p.select("prediction_id", "user_id", "model_version", "window_events", "purchase_probability",
                    "churn_risk", "predicted_next_event", r9("engagement_score").alias("engagement_score"),
                    "inactivity_risk", "window_event_ids")


@query("JOI-3-stream")
def joi_3_stream(spark, sf_dir):
    """Every event asks for its user's features: from the cache state for an hour
    after a store hit, else from the store."""
    schema, rec = _feed(spark, sf_dir)
    store = features_to_json(_store_table(spark, sf_dir))
    e = SI.decode(rec, schema)
    asked = e.select(F.col("event_id").alias("request_id"), F.col("muid").alias("user_id"),
                     F.col("event_time").alias("requested_at"))
    out = scratch_path(spark, "lookups")
    q = (lookup_stream(asked, store).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", scratch_path(spark, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    total = F.get_json_object("features", "$.total_events").cast("long").alias("total_events")
    return spark.read.parquet(out).select("request_id", "user_id", "source", total, "write_back")


@query("STR-4")
def str_4(spark, sf_dir):
    schema, rec = _feed(spark, sf_dir)
    table = scratch_path(spark, "feature_changelog")
    SF.feature_upkeep_stream(spark, SI.decode(rec, schema), table, scratch_path(spark, "ckpt"))
    return SF.read_features(spark, table, AS_OF)


@query("STR-5")
def str_5(spark, sf_dir):
    schema, rec = _feed(spark, sf_dir)
    table = scratch_path(spark, "hourly")
    SI.hourly_counts_stream(rec, schema, table, scratch_path(spark, "ckpt"))
    h = SI.read_hourly_counts(spark, table)
    return h.select(epoch_us(h, "hour_start").alias("hour_start_us"), "n_events")


@query("STR-6")
def str_6(spark, sf_dir):
    e = load_events(spark, sf_dir, ["event_id", "muid", "event_name", "event_time"])
    preds = prediction_log(e)
    feed = (e.select(F.lit("event").alias("kind"), "muid", epoch_us(e, "event_time").alias("t"),
                     F.col("event_id").alias("id"), F.col("event_name").alias("name"), "event_time")
            .unionByName(preds.select(F.lit("prediction").alias("kind"), F.col("user_id").alias("muid"),
                                      epoch_us(preds, "created_at").alias("t"), F.col("prediction_id").alias("id"),
                                      F.col("predicted_next_event").alias("name"),
                                      F.col("created_at").alias("event_time"))))
    folder = scratch_path(spark, "feedback_feed")
    files = write_chunked(feed, folder, "event_time", 6)
    stream = spark.readStream.schema(SS.feedback_input()).option("maxFilesPerTrigger", files).json(folder)
    out = scratch_path(spark, "feedback")
    q = (SS.feedback_stream(stream).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", scratch_path(spark, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


@query("STR-6-resolved")
def str_6_resolved(spark, sf_dir):
    """The feedback that an event of the user brought. What silence brings
    depends on how far the watermark has come, and is left to STR-6."""
    return str_6(spark, sf_dir).where(F.col("actual") != "churn")


@query("STR-5-total")
def str_5_total(spark, sf_dir):
    schema, rec = _feed(spark, sf_dir)
    table = scratch_path(spark, "ingest_total")
    SI.total_count_stream(rec, schema, table, scratch_path(spark, "ckpt"))
    return SI.read_total_count(spark, table)
