"""Row numbers and pages of a sorted table, without one task that sorts it all.

The rows are range-partitioned by their order and written once, a folder a
range, with the number of rows of every range (and group). A row's number is its
place in its range plus the rows of the ranges before: many small sorts and a
table of counts. A page, however deep, opens only the ranges that it lies in.

Rows that are equal in all order columns share a range; name a column that tells
them apart last. Nulls come first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqwise.operators.util import broadcast_checked
from seqwise.sources.sinks import scratch_path

RANGE = "kt_range"


class RankedTable:
    def __init__(self, df: DataFrame, order: list[str], group: str | None = None, ranges: int | None = None) -> None:
        """Write ``df`` sorted by ``group`` (if any) and ``order``."""
        self.spark, self.order, self.group, self.columns = df.sparkSession, order, group, df.columns
        keys = ([group] if group else []) + order
        n = ranges or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = scratch_path(self.spark, "ranked")
        sorted_ = df.repartitionByRange(n, *[F.col(f"`{c}`") for c in keys]).withColumn(RANGE, F.spark_partition_id())
        (sorted_.sortWithinPartitions(RANGE, *[F.col(f"`{c}`") for c in keys])
         .write.partitionBy(RANGE).parquet(self.path))
        self.schema = T.StructType([*df.schema.fields, T.StructField(RANGE, T.IntegerType())])
        self.table = self.spark.read.schema(self.schema).parquet(self.path)
        by = [F.col(f"`{group}`").alias("g")] if group else [F.lit(0).alias("g")]
        counts = self.table.groupBy(*by, RANGE).agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("g").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        # a row a range and group that meet: few groups, or few ranges a group
        self.starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))

    def _numbered(self, rows: DataFrame, starts: DataFrame, name: str) -> DataFrame:
        g = F.col(f"`{self.group}`") if self.group else F.lit(0)
        w = Window.partitionBy(RANGE, *([g] if self.group else [])).orderBy(*[F.col(f"`{c}`") for c in self.order])
        placed = rows.withColumn("kt_place", F.row_number().over(w)).withColumn("kt_g", g)
        starts = starts.select(F.col("g").alias("kt_sg"), F.col(RANGE).alias("kt_sr"), F.col("start").alias("kt_start"))
        j = placed.join(starts, F.col("kt_g").eqNullSafe(F.col("kt_sg")) & (F.col(RANGE) == F.col("kt_sr")))
        return j.select(*[F.col(f"`{c}`") for c in self.columns],
                        (F.col("kt_start") + F.col("kt_place")).cast("long").alias(name))

    def ranks(self, name: str = "rank") -> DataFrame:
        """Every row with its number, from 1 in each group."""
        return self._numbered(self.table, broadcast_checked(self.starts), name)

    def page(self, offset: int, limit: int) -> DataFrame:
        """The rows number offset + 1 to offset + limit, in order, of a table
        without groups."""
        if self.group:
            raise ValueError("pages are of a table without groups")
        # one row a range: as many as shuffle partitions
        hit = [r for r in self.starts.collect() if r.start < offset + limit and r.start + r.n > offset]
        if not hit or limit < 1:
            return self.spark.createDataFrame([], T.StructType(self.schema.fields[:-1]))
        rows = (self.spark.read.schema(self.schema).option("basePath", self.path)
                .parquet(*[f"{self.path}/{RANGE}={r[RANGE]}" for r in hit]))
        starts = self.spark.createDataFrame([(0, r[RANGE], r.start) for r in hit], f"g int, {RANGE} int, start long")
        at = self._numbered(rows, F.broadcast(starts), "kt_rank")
        page = at.where((F.col("kt_rank") > offset) & (F.col("kt_rank") <= offset + limit))
        return page.orderBy("kt_rank").drop("kt_rank")
