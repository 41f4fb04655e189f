"""Distinct counts from stored sketches."""

from pyspark.sql import functions as F

from seqwise.operators.sketches import distinct_counts, write_sketches
from seqwise.sources.sinks import scratch_path


def _events(spark, lo, hi):
    i = F.col("id")
    return spark.range(lo, hi).select(
        F.when(i % 10 != 3, F.timestamp_seconds(1_704_067_200 + i * 60)).cast("timestamp_ntz").alias("event_time"),
        (i % 40_000).alias("a.b"), (i % 3).cast("string").alias("g"), F.when(i % 7 == 0, i % 50).alias("few"),
        F.lit(None).cast("string").alias("none"))


def test_merged_sketches_count_as_one(spark):
    path, cols = scratch_path(spark, "sketches"), ["a.b", "few", "none"]
    every = _events(spark, 0, 120_000)
    for b in range(4):
        write_sketches(_events(spark, b * 30_000, b * 30_000 + 30_000), path, b, cols)
    write_sketches(_events(spark, 60_000, 90_000), path, 2, cols)  # a retry
    got = distinct_counts(spark, path, cols).first()
    assert abs(got["a.b"] - 40_000) <= 0.03 * 40_000 and got["few"] == 50 and got["none"] == 0
    exact = every.where(F.date_format("event_time", "yyyy-MM") == "2024-02").agg(F.count_distinct("`a.b`")).first()[0]
    some = distinct_counts(spark, path, cols, months=["2024-02"]).first()
    assert abs(some["a.b"] - exact) <= 0.03 * exact
    assert distinct_counts(spark, path, cols, months=["1999-01"]).first()["few"] == 0


def test_a_sketch_a_group(spark):
    path = scratch_path(spark, "sketches")
    write_sketches(_events(spark, 0, 900), path, 0, ["few", "a.b"], ["g"])
    write_sketches(_events(spark, 900, 1_500), path, 1, ["few", "a.b"], ["g"])
    want = {r[0]: (r[1], r[2]) for r in _events(spark, 0, 1_500).groupBy("g").agg(
        F.count_distinct("few"), F.count_distinct("`a.b`")).collect()}
    got = {r[0]: (r[1], r[2]) for r in distinct_counts(spark, path, ["few", "a.b"], ["g"]).collect()}
    assert got == want
