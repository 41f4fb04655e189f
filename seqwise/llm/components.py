"""Connected components of a table of links, by alternating star contraction.

Large star: every node links its larger neighbours to its least neighbour.
Small star: every node links itself and its smaller neighbours to the least of
them. After O(log^2 n) rounds every node points at the least of its component.
Minima are partial aggregates; nothing is collected; each round is cut off into
the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwise.llm.common import materialize


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy(F.col("hi").alias("_u")).agg(F.min("lo").alias("_m"))
    j = both.where(F.col("lo") > F.col("hi")).join(least, F.col("hi") == F.col("_u"))
    return j.select(F.col("lo").alias("hi"), F.least("_m", "_u").alias("lo")).where("hi <> lo").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy(F.col("hi").alias("_u")).agg(F.min("lo").alias("_m"))
    j = e.join(least, F.col("hi") == F.col("_u"))
    return (j.select(F.explode(F.array(F.struct("hi", F.col("_m").alias("lo")),
                                       F.struct(F.col("lo").alias("hi"), F.col("_m").alias("lo")))).alias("e"))
            .select("e.*").where("hi <> lo").distinct())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of a link; the component is its least
    node. Links are undirected and may repeat; a link of a node with itself
    makes it a node only if it has others."""
    e = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct()
    e = materialize(e)

    def state(x):
        return x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    before = state(e)
    while before[0]:
        e = materialize(_small_star(_large_star(e)))
        after = state(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
