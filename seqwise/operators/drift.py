"""Drift of a prediction log: how far two groups' distributions lie apart.

Predictions are counted once per group, metric and bin; these counts can be kept
and added up, day by day, and every comparison is made from them. Bins of a
number are equal widths of a fixed range, its ends included (the first and last
bin take what lies beyond); texts are their own bins; nulls are a bin, too.

PSI is the sum over bins of (p - q) ln(p / q), shares below ``LEAST`` counting as
``LEAST``; ``distance`` is the largest difference of the cumulative shares in
the order of the bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqwise.operators.util import broadcast_checked

LEAST = 1e-4
# metric -> (lowest, highest, bins) of numbers, None of texts
PREDICTION_METRICS = {"purchase_probability": (0.0, 100.0, 20), "churn_risk": (0.0, 100.0, 20),
                      "engagement_score": (0.0, 3.0, 20), "predicted_next_event": None}


def bin_of(column: str, span: tuple[float, float, int] | None) -> Column:
    """Name of the bin of a value; names sort as the bins do."""
    c = F.col(column)
    if span is None:
        return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    lo, hi, bins = span
    at = F.floor((c - F.lit(lo)) * F.lit(bins) / F.lit(hi - lo))
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)).cast("int")
    return F.coalesce(F.lpad(F.when(c.isNotNull(), at).cast("string"), 6, "0"), F.lit(""))


def binned_counts(log: DataFrame, group: Column, metrics: dict = PREDICTION_METRICS) -> DataFrame:
    """(group, metric, bin, n): one pass, a partial aggregate per metric."""
    rows = log.select(group.alias("group"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), bin_of(m, span).alias("bin")) for m, span in metrics.items()])).alias("x"))
    return rows.groupBy("group", "x.metric", "x.bin").agg(F.count(F.lit(1)).alias("n"))


def merged_counts(*counts: DataFrame) -> DataFrame:
    """Counts of parts of a log as those of the whole."""
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy("group", "metric", "bin").agg(F.sum("n").alias("n"))


def against(counts: DataFrame, reference) -> DataFrame:
    """(group, reference) of every other group against one."""
    return (counts.select("group").distinct().where(F.col("group") != F.lit(reference))
            .withColumn("reference", F.lit(reference)))


def against_previous(counts: DataFrame) -> DataFrame:
    """(group, reference) of every group against the one before it, in order."""
    groups = counts.select("group").distinct()  # a row a day or version
    return (groups.withColumn("reference", F.lag("group").over(Window.orderBy("group")))
            .where("reference is not null"))


def drift(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """group, reference, metric, n, n_reference, psi and distance of each pair."""
    pairs = broadcast_checked(pairs)
    zero = F.lit(0).cast("long")
    own = counts.join(pairs, "group").select("group", "reference", "metric", "bin", F.col("n").alias("a"), zero.alias("b"))
    other = counts.withColumnRenamed("group", "reference").join(pairs, "reference").select(
        "group", "reference", "metric", "bin", zero.alias("a"), F.col("n").alias("b"))
    both = (own.unionByName(other).groupBy("group", "reference", "metric", "bin")
            .agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    of = Window.partitionBy("group", "reference", "metric")
    upto = of.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    shares = both.select("group", "reference", "metric", "a", "b", F.sum("a").over(of).alias("n"),
                         F.sum("b").over(of).alias("m"), F.sum("a").over(upto).alias("ca"), F.sum("b").over(upto).alias("cb"))
    p, q = (F.greatest(F.try_divide(F.col(x), F.col(t)), F.lit(LEAST)) for x, t in (("a", "n"), ("b", "m")))
    return shares.groupBy("group", "reference", "metric").agg(
        F.max("n").alias("n"), F.max("m").alias("n_reference"), F.sum((p - q) * F.log(p / q)).alias("psi"),
        F.max(F.abs(F.try_divide("ca", "n") - F.try_divide("cb", "m"))).alias("distance"))
