"""Record feeds for streams.

In production the records come from a message bus (Kafka source, keyed by
user). Locally the same JSON records are written as files, chunk by chunk in time
order, each chunk as as many files as its rows need, and read with as many
files a trigger, so that micro-batches follow the chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqwise.functions.columns import epoch_us
from seqwise.sources.sinks import EVENT_TOPIC, JSON_TIME_OPTIONS

ROWS_PER_FILE = 500_000

RECORD_SCHEMA = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType()),
                              T.StructField("topic", T.StringType())])


def write_chunked(df: DataFrame, folder: str, time_col: str, chunks: int) -> int:
    """Write ``df`` (minus ``time_col``) as ``chunks`` groups of JSON files in
    time order, rows without a time with the last one; the files of a chunk
    (one per ROWS_PER_FILE rows of the largest chunk) are written in parallel.
    The source is read once. Returns the files of a chunk."""
    df = df.persist()
    try:
        t = epoch_us(df, time_col)
        lo, hi = df.agg(F.min(t), F.max(t)).first()
        width = 1 if lo is None else (hi - lo) // chunks + 1
        place = F.floor((t - F.lit(lo or 0)) / F.lit(width)).cast("int")
        keyed = df.withColumn("_chunk", F.coalesce(place, F.lit(chunks - 1))).drop(time_col)
        most = keyed.groupBy("_chunk").count().agg(F.max("count")).first()[0] or 0
        files = max(1, -(-most // ROWS_PER_FILE))
        for i in range(chunks):
            (keyed.where(F.col("_chunk") == i).drop("_chunk").repartition(files)
             .write.mode("append").options(**JSON_TIME_OPTIONS).json(folder))
        return files
    finally:
        df.unpersist()


def event_records(events: DataFrame, topic: str = EVENT_TOPIC) -> DataFrame:
    """Keyed records plus the event time (kept for chunking)."""
    return events.select(F.col("event_time").alias("_feed_time"),
                         F.col("muid").cast("string").alias("key"),
                         F.to_json(F.struct(*[F.col(c) for c in events.columns]), JSON_TIME_OPTIONS).alias("value"),
                         F.lit(topic).alias("topic"))


def write_record_feed(events: DataFrame, folder: str, chunks: int = 6) -> int:
    return write_chunked(event_records(events), folder, "_feed_time", chunks)


def read_record_stream(spark: SparkSession, folder: str | None = None, files_per_trigger: int = 1,
                       kafka_servers: str | None = None, topic: str = EVENT_TOPIC) -> DataFrame:
    """Keyed records as a stream: from Kafka when servers are given (the
    connector must be on the classpath), else from JSON record files."""
    if kafka_servers:
        return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", kafka_servers)
                .option("subscribe", topic).load()
                .select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
                        F.col("topic")))
    return (spark.readStream.schema(RECORD_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
            .json(folder).select("key", "value", "topic"))
