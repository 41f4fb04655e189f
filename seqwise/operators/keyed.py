"""A table with a primary key, kept in hash buckets, for upserts and lookups.

A key's bucket is ``pmod(xxhash64(key), buckets)``. A commit writes one folder,
``data/kt_commit=<n>/kt_bucket=<b>``, sorted by key and with a Bloom filter on it, and
then a manifest that lists for every bucket the commits it consists of, oldest
first: a base and the deltas laid over it. So

* an upsert writes a delta for the buckets of its own rows and reads none, until
  a bucket has ``MAX_DELTAS``: then that bucket alone is merged into a new base;
* a reader sees the commits of one manifest. What a crashed job left without a
  manifest is not read, and its folder is overwritten by the next attempt;
* a lookup of a key opens the folders of one bucket, and there the row groups
  that the pushed filter, the sorted order and the Bloom filter leave.

The driver holds the manifest (a few numbers a bucket, of ``ROWS_PER_BUCKET``
rows each) and the numbers of the touched buckets. Rows without a key have no
place in the table and are left out. Rows that an upsert repeats are reduced by
a partial aggregate first, so one key repeated often costs no skew; keys are
unique from there on and buckets even."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqwise.sources.manifest import Manifests

ROWS_PER_BUCKET = 1_000_000
MIN_BUCKETS = 16
MAX_DELTAS = 8


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Manifests(spark, f"{self.path}/_manifest")
        found = self.manifests.newest()
        if found is None:
            raise FileNotFoundError(f"no committed table at {self.path}")
        self.number, self.state = found
        self.key: str = self.state["key"]
        self.schema = T.StructType.fromJson(self.state["schema"])

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, newest: list[str] | None = None,
               buckets: int | None = None) -> KeyedTable:
        """A new table of ``rows``; of rows with one key the greatest by the
        columns ``newest`` stays (any of them, if none are named)."""
        spark = rows.sparkSession
        manifests = Manifests(spark, f"{path.rstrip('/')}/_manifest")
        if {"kt_commit", "kt_bucket"} & set(rows.columns):
            raise ValueError("kt_commit and kt_bucket are names of the table's folders")
        if manifests.newest() is not None:
            raise FileExistsError(f"{path} holds a table")
        kept = rows.persist()  # counted and written: computed once
        if buckets is None:
            buckets = max(MIN_BUCKETS, -(-kept.count() // ROWS_PER_BUCKET))
        state = {"key": key, "buckets": buckets, "schema": _nullable(rows.schema.jsonValue()), "commits": {}}
        manifests.commit(0, state)
        table = cls(spark, path)
        table.upsert(kept, newest)
        kept.unpersist()
        return table

    # --- reading

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.state["buckets"])).cast("int")

    def _folder(self, commit: int, bucket: str | int) -> str:
        return f"{self.path}/data/kt_commit={commit}/kt_bucket={bucket}"

    def _scan(self, buckets: dict[str, list[int]], where: Column | None = None) -> DataFrame:
        """The current rows of ``buckets`` (number -> commits): plain scans where
        there is a base only, else the newest version of every key."""
        def files(chosen: dict[str, list[int]]) -> DataFrame:
            paths = [self._folder(c, b) for b, commits in chosen.items() for c in commits]
            schema = T.StructType([*self.schema.fields, T.StructField("kt_commit", T.LongType())])
            df = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths)
            return df if where is None else df.where(where)
        plain = {b: c for b, c in buckets.items() if len(c) == 1}
        layered = {b: c for b, c in buckets.items() if len(c) > 1}
        out = [files(plain).select(*[F.col(f"`{n}`") for n in self.schema.names])] if plain else []
        if layered:
            out.append(_newest(files(layered), self.key, self.schema.names, F.col("kt_commit")))
        if not out:
            return self.spark.createDataFrame([], self.schema)
        return out[0] if len(out) == 1 else out[0].unionByName(out[1])

    def read(self) -> DataFrame:
        return self._scan(self.state["commits"])

    def get(self, value) -> DataFrame:
        """The row of one key: one bucket, filtered in the scan."""
        kind = self.schema[self.key].dataType
        one = self.spark.range(1).select(self._bucket(F.lit(value).cast(kind)).alias("b")).first()[0]
        mine = {b: c for b, c in self.state["commits"].items() if int(b) == one}
        return self._scan(mine, F.col(f"`{self.key}`") == F.lit(value).cast(kind))

    def get_all(self, keys: DataFrame) -> DataFrame:
        """The rows of a table of keys (one column): only their buckets are read."""
        name = keys.columns[0]
        keys = keys.select(F.col(f"`{name}`").cast(self.schema[self.key].dataType).alias(self.key)).distinct()
        touched = {str(r.b) for r in keys.select(self._bucket(F.col(f"`{self.key}`")).alias("b")).distinct().collect()}
        rows = self._scan({b: c for b, c in self.state["commits"].items() if b in touched})
        return rows.join(keys, self.key, "left_semi")

    # --- writing

    def upsert(self, rows: DataFrame, newest: list[str] | None = None) -> dict[str, int]:
        """Replace or insert ``rows`` by key, as one commit. Returns how many
        buckets were touched, how many of them merged, and how many there are."""
        key = F.col(f"`{self.key}`")
        names = self.schema.names
        rows = rows.select(*[F.col(f"`{n}`").cast(self.schema[n].dataType).alias(n) for n in names]).where(key.isNotNull())
        order = F.struct(*[F.col(f"`{c}`") for c in newest]) if newest else F.lit(0)
        number = self.number + 1
        self._write(_newest(rows, self.key, names, order), number)
        here = self._written(number)
        commits = {b: list(c) for b, c in self.state["commits"].items()}
        full = {b: [*commits[b], number] for b in here if len(commits.get(b, [])) > MAX_DELTAS}
        for b in here:
            commits.setdefault(b, []).append(number)
        if full:
            # Only these are read. Their deltas of this commit are part of the merge.
            merged = number + 1
            self._write(self._scan(full), merged)
            commits.update({b: [merged] for b in full})
            number = merged
        state = {**self.state, "commits": commits}
        self.manifests.commit(number, state)
        self.number, self.state = number, state
        return {"touched": len(here), "merged": len(full), "buckets": self.state["buckets"]}

    def _write(self, rows: DataFrame, number: int) -> None:
        key = f"`{self.key}`"
        parts = self.state["buckets"]
        (rows.withColumn("kt_bucket", self._bucket(F.col(key))).repartition(parts, "kt_bucket")
         .sortWithinPartitions("kt_bucket", F.col(key)).write.mode("overwrite")
         .option(f"parquet.bloom.filter.enabled#{self.key}", "true")
         .option(f"parquet.bloom.filter.expected.ndv#{self.key}", str(ROWS_PER_BUCKET // 10))
         .partitionBy("kt_bucket").parquet(f"{self.path}/data/kt_commit={number}"))

    def _written(self, number: int) -> list[str]:
        jvm, conf = self.manifests.jvm, self.manifests.conf
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/kt_commit={number}")
        names = [s.getPath().getName() for s in folder.getFileSystem(conf).listStatus(folder)]
        return sorted((n.split("=")[1] for n in names if n.startswith("kt_bucket=")), key=int)


def _nullable(schema):
    """A schema (as JSON) in which every field may be null: later rows may be."""
    if isinstance(schema, list):
        return [_nullable(x) for x in schema]
    if isinstance(schema, dict):
        return {k: True if k in ("nullable", "containsNull", "valueContainsNull") else _nullable(v)
                for k, v in schema.items()}
    return schema


def _newest(rows: DataFrame, key: str, names: list[str], order: Column) -> DataFrame:
    """One row a key, the greatest by ``order`` (a partial aggregate)."""
    whole = F.struct(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)])
    best = rows.groupBy(F.col(f"`{key}`").alias("k")).agg(F.max_by(whole, order).alias("r"))
    return best.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
