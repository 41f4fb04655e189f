"""A deterministic, sharded WARC writer, and its reader.

Records are range-sorted by (page id, payload digest), across files too: the
bytes before each record, summed range by range over narrow rows, say where every
shard of ``shard_bytes`` begins, whatever the ids look like. The cuts, one a
shard, go to the driver and back as a broadcast: total bytes / ``shard_bytes``
rows of about 100 bytes. Only rows equal in id and payload are never parted. Every
shard is written by one task that streams its sorted records into files and
rolls to the next file when the compressed size passes ``roll_bytes``; each
record is a gzip member of its own with headers and digests made anew.

Files get temporary names that no other attempt uses. Each task returns one
manifest row per file; the manifest is written, and only then a second job
moves the files it names to their final names, so a lost or repeated task
leaves at most stray temporary files. Equal input gives equal bytes. Files are
written through ``pyarrow.fs`` into the shared folder, never to local disks.

Payload rule: of records with equal payloads of ``min_revisit_bytes`` bytes or
more, the one with the largest page id is a response and the others revisit
it. Payloads are compared by SHA-1 and length; a payload that a third of the
pages share is one row of partial maxima a task. What each record becomes is
settled on narrow rows; these meet the payloads in the writer, sorted before
them, so payloads are shuffled once.

Defined results: a null payload is empty; a null url is written as an empty
target; null page ids sort first and are smaller than any other; among rows of
equal page id and payload the first by url is the response; an empty table
writes no file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqwise.llm.common import materialize, shared_folder, small_batches, write_once

_NO_ID = -(1 << 63) - 1     # records without an id come first
WRITER_TASKS = 100_000      # beyond as many shards, a task writes several
SHARD_BYTES = 64 << 20      # payload bytes of a shard (one writer task)
ROLL_BYTES = 16 << 20       # compressed bytes after which a file is closed
MIN_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"  # WARC-Date: the input carries no crawl time

_MANIFEST = "shard long, file string, temporary string, records long, bytes long, sha256 string"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _payload(col: str):
    return F.coalesce(F.encode(F.col(col), "UTF-8"), F.lit(b""))


def plan_records(pages: DataFrame, id_col: str, payload_col: str, min_revisit_bytes: int) -> DataFrame:
    """Per distinct (page id, payload): page_id, sha (hex), size, n (rows),
    kept (page id of the payload's response) and free (needs no revisits)."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha1(_payload(payload_col)).alias("sha"),
                        F.length(_payload(payload_col)).cast("long").alias("size"))
    rows = materialize(rows.groupBy("page_id", "sha", "size").agg(F.count(F.lit(1)).alias("n")))
    kept = rows.groupBy("sha", "size").agg(F.max("page_id").alias("kept"))
    return rows.join(kept, ["sha", "size"]).withColumn("free", F.col("size") < min_revisit_bytes)


def shard_cuts(plan: DataFrame, shard_bytes: int) -> list[tuple[int, str]]:
    """Least (page id, sha) of every shard, in order: a new shard begins where the
    bytes before a record pass a multiple of ``shard_bytes``. The running sum is
    made range by range, so the cuts depend on the records only, not on how
    the ranges fell. There are at most total bytes / ``shard_bytes`` + 1 cuts."""
    parts = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["page_id", "sha"]
    rows = plan.select(*keys, ((F.col("size") + 512) * F.col("n")).alias("w"))
    rows = write_once(rows.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()), "warc-order")
    until = (Window.unboundedPreceding, -1)
    starts = rows.groupBy("part").agg(F.sum("w").alias("w")).select(  # a row a range
        "part", F.coalesce(F.sum("w").over(Window.orderBy("part").rowsBetween(*until)), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum("w").over(Window.partitionBy("part").orderBy(*keys).rowsBetween(*until)), F.lit(0))
    placed = rows.withColumn("inside", inside).join(F.broadcast(starts), "part")
    shard = F.expr(f"(start + inside) div {shard_bytes}")
    first = placed.groupBy(shard.alias("shard")).agg(F.min(F.struct(*keys)).alias("k")).select("k.*")
    return sorted((_NO_ID if r.page_id is None else r.page_id, r.sha) for r in first.collect())


def _shard_of(cuts):
    """The shard of (page id as text, sha); the cuts are broadcast."""
    @F.pandas_udf("long")
    def shard(page_id: pd.Series, sha: pd.Series) -> pd.Series:
        ids = [_NO_ID if i is None else int(i) for i in page_id]
        return pd.Series([bisect_right(cuts.value, k) - 1 for k in zip(ids, sha)], dtype="int64")
    return shard


def record_bytes(page_id, url, payload: bytes, digest: str, size: int, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record, gzipped as a member of its own."""
    def record_id(i):
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page/{i}')}>"
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    if kind == "response":
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + \
                f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}",
            f"WARC-Block-Digest: sha1:{payload_digest(block)}", "Content-Type: application/http; msgtype=response",
            f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_id(refers_to)}",
                 f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}"]
    head += [f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + pack.flush()


class _File:
    """One archive being written under a temporary name."""

    def __init__(self, store, folder: str, shard: int, number: int) -> None:
        self.shard, self.name = shard, f"part-{shard:08d}-{number:05d}.warc.gz"
        self.temporary = f"_temporary/{self.name}.{uuid.uuid4().hex}"
        self.out = store.open_output_stream(f"{folder}/{self.temporary}", compression=None)
        self.sha, self.records, self.bytes = hashlib.sha256(), 0, 0

    def add(self, record: bytes) -> None:
        self.out.write(record)
        self.sha.update(record)
        self.records, self.bytes = self.records + 1, self.bytes + len(record)

    def close(self) -> dict:
        self.out.close()
        return {"shard": self.shard, "file": self.name, "temporary": self.temporary,
                "records": self.records, "bytes": self.bytes, "sha256": self.sha.hexdigest()}


def _writer(folder_uri: str, roll_bytes: int):
    """Streams rows sorted by (shard, page id, sha, decision first, url)."""
    def run(batches):
        store, folder = fs.FileSystem.from_uri(folder_uri)
        store.create_dir(f"{folder}/_temporary")
        file, number, kept, free, met = None, 0, None, True, False
        for b in batches:
            done = []
            for i in range(b.num_rows):
                row = {c: b.column(c)[i] for c in b.schema.names}
                shard, page_id, size = row["_shard"].as_py(), row["page_id"].as_py(), row["size"].as_py()
                if row["_decision"].as_py():
                    kept, free, met = row["kept"].as_py(), row["free"].as_py(), False
                    continue
                if file and (file.shard != shard or file.bytes >= roll_bytes):
                    number = number + 1 if file.shard == shard else 0
                    done.append(file.close())
                    file = None
                elif file is None:
                    number = 0
                file = file or _File(store, folder, shard, number)
                response = free or (kept == page_id and not met)
                met = met or response
                digest = base64.b32encode(bytes.fromhex(row["sha"].as_py())).decode()
                file.add(record_bytes(page_id, row["url"].as_py(), row["_payload"].as_py() if response else b"",
                                      digest, size, "response" if response else "revisit", kept))
            if done:
                yield pa.RecordBatch.from_pylist(done)
        if file:
            yield pa.RecordBatch.from_pylist([file.close()])
    return run


def _committer(folder_uri: str):
    def run(batches):
        store, folder = fs.FileSystem.from_uri(folder_uri)
        for b in batches:
            for name, temporary, size in zip(*[b.column(c).to_pylist() for c in ("file", "temporary", "bytes")], strict=True):
                here = store.get_file_info(f"{folder}/{temporary}")
                if here.type == fs.FileType.File:  # else an earlier attempt has moved it
                    store.move(f"{folder}/{temporary}", f"{folder}/{name}")
                there = store.get_file_info(f"{folder}/{name}")
                if there.type != fs.FileType.File or there.size != size:
                    raise OSError(f"{name} was lost or is not the file that was written")
            yield b
    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES,
                   shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` into ``folder`` (a URI that all executors reach) and
    return the manifest: shard, file, records, bytes, sha256."""
    folder = re.sub(r"^file:/+", "file:///", folder)
    small_batches(pages)
    plan = materialize(plan_records(pages, id_col, payload_col, min_revisit_bytes))
    spark = pages.sparkSession
    cuts = shard_cuts(plan, shard_bytes)
    shard_of = _shard_of(spark.sparkContext.broadcast(cuts))
    shards = max(len(cuts), 1)
    tasks = min(shards, WRITER_TASKS)
    records = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        _payload(payload_col).alias("_payload")).select(
        "*", F.sha1("_payload").alias("sha"), F.length("_payload").cast("long").alias("size"),
        F.lit(False).alias("_decision"))
    rows = records.unionByName(plan.drop("n").withColumn("_decision", F.lit(True)), allowMissingColumns=True)
    # Neighbouring shards share a task, and no task is left without one.
    rows = (rows.withColumn("_shard", shard_of(F.col("page_id").cast("string"), F.col("sha")))
            .repartitionById(tasks, F.expr(f"cast(_shard * {tasks} div {shards} as int)"))
            .sortWithinPartitions("_shard", "page_id", "sha", F.col("_decision").desc(), "url"))
    written = write_once(rows.mapInArrow(_writer(folder, roll_bytes), _MANIFEST), "warc-manifest")
    manifest = written.repartition(spark.sparkContext.defaultParallelism, "file").mapInArrow(
        _committer(folder), _MANIFEST).drop("temporary")
    manifest.write.parquet(f"{folder}/_manifest")
    return spark.read.parquet(f"{folder}/_manifest")


def members(stream, chunk: int = 1 << 20):
    """The gzip members of a file, one after the other."""
    unpack, parts = zlib.decompressobj(31), []
    data = stream.read(chunk)
    while data:
        parts.append(unpack.decompress(data))
        data = unpack.unused_data if unpack.eof else stream.read(chunk)
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
            data = data or stream.read(chunk)
    if parts:
        raise ValueError("the file ends within a record")


def parse_record(raw: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    if payload_digest(block) != fields["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError(f"block digest differs in {fields['WARC-Record-ID']}")
    kind = fields["WARC-Type"]
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if (payload_digest(payload), len(payload)) != (digest, size):
            raise ValueError(f"payload digest differs in {fields['WARC-Record-ID']}")
    number = fields["X-Page-ID"]
    refers = fields.get("X-Refers-To-Page-ID") or None
    return int(number) if number else None, size, digest, kind, int(refers) if refers else None


_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _reader(folder_uri: str, rows_a_batch: int = 2000):
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64())])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types,
                                                                          strict=True)], schema=schema)

    def run(batches):
        store, folder = fs.FileSystem.from_uri(folder_uri)
        for b in batches:
            for name in b.column("file").to_pylist():
                rows = []
                with store.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for raw in members(stream):
                        rows.append(parse_record(raw))
                        if len(rows) == rows_a_batch:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)
    return run


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the files that the manifest in ``folder`` names, digests
    checked; files are read record by record, many tasks at a time."""
    folder = re.sub(r"^file:/+", "file:///", folder)
    files = spark.read.parquet(f"{folder}/_manifest").select("file")
    return files.repartition(spark.sparkContext.defaultParallelism * 4, "file").mapInArrow(_reader(folder), _RECORD)


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to a new shared folder and read the archives back."""
    folder = shared_folder(pages.sparkSession, "warc")
    write_archives(pages, folder, **options)
    return read_archives(pages.sparkSession, folder)
