"""Exact quantiles at any number of distinct values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqwise.operators import aggregates as A
from seqwise.operators.quantiles import exact_quantiles, order_statistics, stored_column

PROBABILITIES = [0.0, 0.003, 0.25, 0.5, 0.75, 0.99, 1.0]


def _check(spark, data, kind, **sizes):
    values = stored_column(spark.createDataFrame([(x,) for x in data], f"`a.b` {kind}").repartition(4), "a.b")
    known = sorted((x for x in data if x is not None), key=lambda x: (x != x, x))
    ranks = sorted(random.Random(1).sample(range(len(known)), min(5, len(known))))
    got = order_statistics(values, ranks, **sizes)
    assert [str(x) for x in got] == [str(known[k]) for k in ranks]
    return values, known


@pytest.mark.parametrize("kind", ["double", "long"])
def test_several_passes_over_distinct_values(spark, kind):
    r = random.Random(2)
    draw = (lambda: r.lognormvariate(0, 30)) if kind == "double" else (lambda: r.randrange(-2**62, 2**62))
    data = [draw() for _ in range(6_000)] + [None] * 50
    values, known = _check(spark, data, kind, keep=20, accuracy=50)
    if kind == "double":
        got = exact_quantiles(values, PROBABILITIES, keep=20, accuracy=50)
        assert np.allclose(got, np.quantile(known, PROBABILITIES), rtol=1e-9)
        assert got == pytest.approx(values.agg(F.percentile("v", F.array(*map(F.lit, PROBABILITIES)))).first()[0])


def test_ties_nan_and_outliers(spark):
    r = random.Random(3)
    tied = [5.0] * 3_000 + [r.random() for _ in range(1_000)] + [1e300, -1e300, float("nan"), float("nan"), float("inf")]
    _check(spark, tied, "double", keep=10, accuracy=20)
    _check(spark, [float(i % 3) for i in range(500)], "double", keep=5, accuracy=10)
    _check(spark, [7] * 400, "int", keep=5, accuracy=10)
    _check(spark, [float("nan")] * 30, "double", keep=5, accuracy=10)


def test_no_values(spark):
    empty = spark.createDataFrame([(None,)], "v long")
    assert exact_quantiles(stored_column(empty, "v"), [0.5]) == [None]
    d = A.describe(empty, "v").first()
    assert d["count"] == 0 and d["p50"] is None and A.histogram(empty, "v").first()["crop_value"] is None
    with pytest.raises(ValueError):
        order_statistics(stored_column(empty, "v"), [0])


def test_passes_move_no_rows_between_tasks(spark):
    """Each pass is an aggregate of one row: nothing is grouped by value."""
    d = A.describe(spark.range(300_000).select(F.hash("id").alias("x")), "x")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "percentile" not in plan
    want = np.quantile(spark.range(300_000).select(F.hash("id").alias("x")).toPandas()["x"], [0.25, 0.5, 0.75])
    got = d.first()
    assert [got["p25"], got["p50"], got["p75"]] == pytest.approx(list(want))
