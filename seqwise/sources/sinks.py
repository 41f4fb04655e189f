"""Sinks: partitioned appends, bounded-file overwrites, stream-record encoding."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqwise.session import ensure_checkpoint_dir
from seqwise.sources.events import month_of

# Rows per output file for appends (bounded batches; a task commits its files
# atomically, a failed task is retried alone).
DATA_CHUNK_ROWS = 50_000
EVENT_TOPIC = "raw_behavioral_events"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder of the session."""
    return os.path.join(ensure_checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex[:12]}")


def with_month(df: DataFrame, time_col: str = "event_time") -> DataFrame:
    return df.withColumn("event_month", month_of(time_col))


def append_events(df: DataFrame, path: str, chunk_rows: int = DATA_CHUNK_ROWS, mode: str = "append") -> None:
    """Append into a month-partitioned table; files hold at most ``chunk_rows``.

    No repartition by month: that would send a whole month to one task. Each
    task writes the months present in its own rows (the writer sorts by the
    partition column inside the task), and file size stays bounded."""
    (with_month(df).write.mode(mode).option("maxRecordsPerFile", chunk_rows)
     .partitionBy("event_month").parquet(path))


def batch_folder(table: str, batch_id: int, name: str = "ingest_batch") -> str:
    """Folder of one micro-batch: rewriting it on a retry keeps the sink exactly-once."""
    return f"{table.rstrip('/')}/{name}={batch_id:012d}"


def append_rows(df: DataFrame, path: str, chunk_rows: int = DATA_CHUNK_ROWS) -> None:
    df.write.mode("append").option("maxRecordsPerFile", chunk_rows).parquet(path)


def write_bounded(df: DataFrame, path: str, files: int = 10) -> None:
    """Overwrite with at most ``files`` files. A round-robin repartition of the
    (already aggregated) rows keeps the upstream stage fully parallel, unlike
    coalesce, which would shrink the aggregation itself to ``files`` tasks."""
    df.repartition(files).write.mode("overwrite").parquet(path)


def write_clustered(df: DataFrame, path: str, key: str) -> str:
    """Write ``df`` range-partitioned and sorted by ``key``, with a Bloom filter
    on it: a filter on the key opens few files and, in these, few row groups.
    A key that holds many rows may fill a file of its own."""
    (df.repartitionByRange(F.col(key)).sortWithinPartitions(key).write
     .option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path))
    return path


# Microsecond timestamps in JSON (the default keeps milliseconds only).
JSON_TIME_OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
                     "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def to_stream_records(df: DataFrame, key_col: str = "muid", topic: str = EVENT_TOPIC) -> DataFrame:
    """Keyed records: key = user id string, value = JSON of the row, topic."""
    return df.select(F.col(key_col).cast("string").alias("key"),
                     F.to_json(F.struct(*[F.col(c) for c in df.columns]), JSON_TIME_OPTIONS).alias("value"),
                     F.lit(topic).alias("topic"))


def from_stream_records(records: DataFrame, schema: T.StructType, keep: list[str] | None = None) -> DataFrame:
    """Decode JSON record values back into typed rows, with the columns ``keep``."""
    keep = keep or []
    parsed = records.select(F.from_json("value", schema, JSON_TIME_OPTIONS).alias("r"), *keep)
    return parsed.select("r.*", *keep)


def write_stream_records(records: DataFrame, path: str | None = None, kafka_servers: str | None = None,
                         topic: str = EVENT_TOPIC) -> None:
    """Publish keyed records: to Kafka when servers are given (the connector must
    be on the classpath), else as JSON files under ``path``."""
    if kafka_servers:
        (records.select("key", "value").write.format("kafka")
         .option("kafka.bootstrap.servers", kafka_servers).option("topic", topic).save())
    else:
        records.write.mode("append").json(path)


def overwrite_partitions(df: DataFrame, path: str, partition_col: str) -> None:
    """Rewrite only the partitions present in ``df`` (dynamic partition overwrite)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition_col).parquet(path))
