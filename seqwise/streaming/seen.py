"""Which ids a month-partitioned table holds: Bloom filters beside it.

Every micro-batch that appends rows also writes, into its own folder, one filter
for every month and bucket of ids that it touched. To tell whether rows are
stored already, each is tested against the filters of its month and bucket only;
what no filter knows is new, and only the rest is compared with the ids of the
table itself, in the months it falls into.

Filters are built and tested in tasks of one (month, bucket); a batch is spread
over ``BUCKETS`` of them a month. Bits are set by double hashing of a 64-bit
hash; about 1 in 100 new ids is compared exactly for nothing, none is lost."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqwise.operators.util import broadcast_checked
from seqwise.sources.compaction import BatchTable
from seqwise.sources.events import month_of
from seqwise.sources.sinks import batch_folder

BUCKETS = 256
BITS_PER_ID, HASHES = 10, 7

_INDEX = "event_month string, id_bucket int, bits binary"


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    """Bit numbers of every hash: HASHES rows."""
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) % np.uint64(size) for i in range(HASHES)]).astype(np.int64)


def bloom_bits(hashes: np.ndarray) -> bytes:
    size = max(64, -(-len(hashes) * BITS_PER_ID // 64) * 64)
    bits = np.zeros(size, dtype=np.uint8)
    bits[_places(hashes, size).ravel()] = 1
    return np.packbits(bits).tobytes()


def in_bloom(hashes: np.ndarray, raw: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(raw, np.uint8))
    return bits[_places(hashes, len(bits))].all(axis=0)


def _keyed(rows: DataFrame, id_col: str, time_col: str) -> DataFrame:
    h = F.xxhash64(F.col(id_col).cast("string"))
    return rows.select("*", F.coalesce(month_of(time_col), F.lit("")).alias("event_month"),
                       F.pmod(F.shiftright(h, 40), F.lit(BUCKETS)).cast("int").alias("id_bucket"), h.alias("id_hash"))


def write_index(rows: DataFrame, index: str, batch_id: int, id_col: str = "event_id",
                time_col: str = "event_time") -> None:
    """Filters of the ids of ``rows``, in the batch's own folder (a retry
    overwrites it)."""
    def build(table: pa.Table) -> pa.Table:
        return pa.table({"event_month": table["event_month"][:1], "id_bucket": table["id_bucket"][:1],
                         "bits": pa.array([bloom_bits(table["id_hash"].to_numpy())], pa.binary())})
    ids = _keyed(rows.where(F.col(id_col).isNotNull()), id_col, time_col)
    (ids.select("event_month", "id_bucket", "id_hash").groupBy("event_month", "id_bucket").applyInArrow(build, _INDEX)
     .write.mode("overwrite").partitionBy("event_month").parquet(batch_folder(index, batch_id)))


def unseen(rows: DataFrame, table: str, index: str, before_batch: int, id_col: str = "event_id",
           time_col: str = "event_time") -> DataFrame:
    """``rows`` (ids not null) whose id no batch before this one has stored in
    the month of the row; of rows that repeat an id in the month one stays."""
    spark: SparkSession = rows.sparkSession
    columns = rows.columns
    try:
        filters = spark.read.parquet(index).where(F.col("ingest_batch") < before_batch)
    except AnalysisException as exc:
        if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return rows.dropDuplicates([id_col])  # nothing is stored yet
    keyed = _keyed(rows, id_col, time_col).dropDuplicates(["event_month", id_col]).persist()
    try:
        # Months of the rows: filters of others, and their files, are not read.
        months = [r[0] for r in keyed.select("event_month").distinct().collect()]
        filters = filters.select(F.col("event_month").cast("string").alias("event_month"), "id_bucket", "bits")
        filters = filters.where(F.col("event_month").isin(months))

        def test(left: pa.Table, right: pa.Table) -> pa.Table:
            hashes = left["id_hash"].to_numpy()
            known = np.zeros(len(hashes), dtype=bool)
            for raw in right["bits"]:
                known |= in_bloom(hashes, raw.as_py())
            return left.filter(pa.array(known))
        probe = keyed.select("event_month", "id_bucket", "id_hash")
        maybe = (probe.groupBy("event_month", "id_bucket").cogroup(filters.groupBy("event_month", "id_bucket"))
                 .applyInArrow(test, "event_month string, id_bucket int, id_hash long").distinct().persist())
        try:
            if maybe.isEmpty():
                return _settled(keyed, columns)
            kept = T.StructType([rows.schema[id_col], rows.schema[time_col]])
            stored = BatchTable(spark, table, kept, time_col, id_col).read(months, before=before_batch)
            stored = _keyed(stored.select(id_col, time_col), id_col, time_col)
            hits = stored.join(broadcast_checked(maybe.select("event_month", "id_hash")), ["event_month", "id_hash"],
                               "left_semi").select("event_month", id_col).distinct()
            return _settled(keyed.join(broadcast_checked(hits), ["event_month", id_col], "left_anti"), columns)
        finally:
            maybe.unpersist()
    finally:
        keyed.unpersist()


def _settled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows, computed now: what they are compared with is about to change."""
    from seqwise.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.select(*columns).checkpoint()
