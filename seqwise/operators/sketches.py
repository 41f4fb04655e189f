"""Distinct counts kept as mergeable sketches, a month and batch each.

Counting distinct values of all months again for every new batch reads the whole
table. Here a batch is reduced once to one HyperLogLog sketch a column, month and
group (at most 2^``LG_K`` bytes each, partial sketches before the shuffle) and
written into the batch's own folder, so a retry replaces it. A count over any
months merges the sketches that lie there and reads no event again. A value in
many batches or months counts once: merging is a union.

The estimate's relative standard error is 1.04 / sqrt(2^LG_K), about 0.8 % at 14
bits; counts up to some hundred are practically exact. Nulls are not counted;
rows without a time are of the month ``none``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwise.sources.events import month_of
from seqwise.sources.sinks import batch_folder

LG_K = 14
NO_MONTH = "none"


def write_sketches(batch: DataFrame, path: str, batch_id: int, columns: list[str], group: list[str] | None = None,
                   time_col: str = "event_time", lg_k: int = LG_K) -> None:
    """Sketches of ``columns`` a month (and ``group``) of one batch of rows."""
    month = F.coalesce(month_of(time_col), F.lit(NO_MONTH)).alias("event_month")
    # a column without any value has no sketch
    sketches = [F.when(F.count(F.col(f"`{c}`")) > 0, F.hll_sketch_agg(F.col(f"`{c}`").cast("string"), lg_k)).alias(f"s{i}")
                for i, c in enumerate(columns)]
    groups = [F.col(f"`{g}`").alias(f"g{i}") for i, g in enumerate(group or [])]
    (batch.groupBy(month, *groups).agg(*sketches).write.mode("overwrite").partitionBy("event_month")
     .parquet(batch_folder(path, batch_id)))


def distinct_counts(spark: SparkSession, path: str, columns: list[str], group: list[str] | None = None,
                    months: list[str] | None = None) -> DataFrame:
    """Estimated distinct values of ``columns`` over all months, or some, from
    the sketches that were written with the same columns and group."""
    table = spark.read.parquet(path)
    if months is not None:
        table = table.where(F.col("event_month").cast("string").isin(months))
    groups = [F.col(f"g{i}") for i in range(len(group or []))]
    merged = table.groupBy(*groups).agg(*[
        F.coalesce(F.hll_sketch_estimate(F.when(F.count(f"s{i}") > 0, F.hll_union_agg(f"s{i}"))), F.lit(0)).alias(c)
        for i, c in enumerate(columns)])
    return merged.select(*[F.col(f"g{i}").alias(g) for i, g in enumerate(group or [])],
                         *[F.col(f"`{c}`").cast("long").alias(c) for c in columns])
