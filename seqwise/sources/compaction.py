"""A table of micro-batch folders, compacted into larger files behind a manifest.

A stream appends a folder a micro-batch and month (``ingest_batch=<n>/event_month=<m>``):
many small files. ``compact`` rewrites the batches that are final, as one generation:
``_compact/rows/generation=<n>/event_month=<m>``, range-partitioned and sorted by month, time
and id, so files hold about ``ROWS_PER_TASK`` rows and a stretch of time each (a
filter on the time skips files by their statistics). Then it commits a manifest
that names the generations of every month and the last batch in them. So

* a reader of the table sees the generations of one manifest and the batch folders
  after its last batch: every row once, before, during and after a compaction;
* a compaction that dies leaves no manifest, and what it wrote is not read; the
  next one takes another folder and the same batches;
* a compaction reads the new batches only. A month with more than ``MAX_GENERATIONS``
  is merged into one, so a row is rewritten a few times in its life;
* a batch is final when the stream's checkpoint lists it as committed: until then
  a retry may write its folder again (``committed_through``);
* ``vacuum`` deletes what the newest ``keep`` manifests do not need.

Folders with a leading underscore are unseen by plain readers of the table, which
see the batch folders as long as they are there. Rows that are equal in month,
time and id lie in one task, which sorts and writes them with bounded memory; files
hold at most ``ROWS_PER_FILE`` rows in any case. A task sorts about ``ROWS_PER_TASK``
rows, however many a compaction has. The driver holds the manifest: some
numbers a month, and the numbers of the batches not yet compacted."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqwise.sources.manifest import Manifests
from seqwise.sources.sinks import batch_folder

ROWS_PER_FILE = 5_000_000
ROWS_PER_TASK = 1_000_000  # a row of events takes about 240 bytes in a task's sort
MAX_GENERATIONS = 8
BATCH, MONTH, GENERATION = "ingest_batch", "event_month", "generation"


class BatchTable:
    """The table at ``path`` as of the newest manifest when this is made."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, time_col: str = "event_time",
                 id_col: str = "event_id") -> None:
        """``schema``: of the table's rows, without batch and month."""
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.time_col, self.id_col = time_col, id_col
        self.rows, self._jvm = f"{self.path}/_compact/rows", spark.sparkContext._jvm
        self.manifests = Manifests(spark, f"{self.path}/_compact/manifests")
        self.number, self.state = self.manifests.newest() or (0, {"through": -1, "months": {}})

    # --- reading

    def read(self, months: list[str] | None = None, before: int | None = None) -> DataFrame:
        """All rows, with the column ``event_month`` (null without a time), or
        those of some months: then only these are listed among the generations.
        Batches from ``before`` on are left out."""
        wanted = self.state["months"] if months is None else {m: self.state["months"].get(m, []) for m in months}
        batches = [b for b in self._batches() if b > self.state["through"] and (before is None or b < before)]
        out = self._rows(wanted, batches)
        return out if months is None else out.where(F.col(MONTH).isin(months))

    def _rows(self, months: dict[str, list[str]], batches: list[int]) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(MONTH, T.StringType())])
        out = self.spark.createDataFrame([], schema)
        compacted = [f"{self.rows}/{GENERATION}={g}/{MONTH}={m}" for m, gs in sorted(months.items()) for g in gs]
        for base, paths in ((self.rows, compacted), (self.path, [batch_folder(self.path, b, BATCH) for b in batches])):
            if paths:
                files = self.spark.read.schema(schema).option("basePath", base).parquet(*paths)
                out = out.unionByName(files.select(*[F.col(f"`{c}`") for c in schema.names]))
        return out

    def _batches(self) -> list[int]:
        return sorted(int(n) for n in self._folders(self.path, BATCH) if n.isdigit())

    def _folders(self, at: str, column: str) -> list[str]:
        """Values of the partition column ``column`` below ``at``."""
        path = self._jvm.org.apache.hadoop.fs.Path(at)
        fs = path.getFileSystem(self.manifests.conf)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return [n.split("=", 1)[1] for n in names if n.startswith(f"{column}=")]

    # --- writing

    def compact(self, through: int) -> dict[str, int]:
        """Compact the batches up to number ``through``, which must be final.
        Returns how many batches went in and how many months were merged."""
        batches = [b for b in self._batches() if self.state["through"] < b <= through]
        if not batches:
            return {"batches": 0, "merged": 0}
        number = self.number + 1
        new = self._write(self._rows({}, batches), number)
        months = {m: list(gs) for m, gs in self.state["months"].items()}
        for m in self._folders(f"{self.rows}/{GENERATION}={new}", MONTH):
            months.setdefault(m, []).append(new)
        full = {m: gs for m, gs in months.items() if len(gs) > MAX_GENERATIONS}
        if full:
            merged = self._write(self._rows(full, []), number)
            months.update({m: [merged] for m in full})
        state = {"through": through, "months": months}
        self.manifests.commit(number, state)
        self.number, self.state = number, state
        return {"batches": len(batches), "merged": len(full)}

    def _write(self, rows: DataFrame, number: int) -> str:
        """Write a generation under a name of its own: nobody else's attempt."""
        generation = f"{number:012d}-{uuid.uuid4().hex[:8]}"
        files = max(1, -(-rows.count() // min(ROWS_PER_FILE, ROWS_PER_TASK)))
        order = [F.col(c) for c in (MONTH, self.time_col, self.id_col)]
        (rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
         .write.option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy(MONTH).parquet(f"{self.rows}/{GENERATION}={generation}"))
        return generation

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the newest ``keep`` manifests needs; what a
        compaction is just writing stays. Returns how many folders went. From then
        on the table is read through this class, not from its batch folders."""
        numbers = self.manifests.numbers()
        if not numbers or keep < 1:
            return 0
        states = [self.manifests.read(n) for n in numbers[-keep:]]
        needed = {(g, m) for s in states for m, gs in s["months"].items() for g in gs}
        done = min(s["through"] for s in states)
        gone = [batch_folder(self.path, b, BATCH) for b in self._batches() if b <= done]
        for g in self._folders(self.rows, GENERATION):
            if int(g.split("-")[0]) <= numbers[-1]:
                at = f"{self.rows}/{GENERATION}={g}"
                held = self._folders(at, MONTH)
                unused = [m for m in held if (g, m) not in needed]
                gone += [at] if len(unused) == len(held) else [f"{at}/{MONTH}={m}" for m in unused]
        for folder in gone:
            path = self._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.manifests.conf).delete(path, True)
        return len(gone)


def committed_through(spark: SparkSession, checkpoint: str) -> int:
    """The last micro-batch that a stream's checkpoint lists as committed; -1 if
    there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/commits")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return max((int(n) for n in names if n.isdigit()), default=-1)
