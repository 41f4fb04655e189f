"""Drift figures against plain Python, on nulls, one-sided bins and merged counts."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqwise.operators import drift as D

METRICS = {"score": (0.0, 1.0, 4), "name": None}


def plain(rows, a, b, metric):
    def bin_of(r):
        if metric == "name":
            return "" if r[2] is None else "=" + r[2]
        return "" if r[1] is None else f"{max(0, min(3, math.floor(r[1] * 4))):06d}"
    p, q = (Counter(bin_of(r) for r in rows if r[0] == g) for g in (a, b))
    n, m = sum(p.values()), sum(q.values())
    psi = far = ca = cb = 0.0
    for k in sorted({*p, *q}):
        x, y = max(p[k] / n, 1e-4), max(q[k] / m, 1e-4)
        psi += (x - y) * math.log(x / y)
        ca, cb = ca + p[k], cb + q[k]
        far = max(far, abs(ca / n - cb / m))
    return n, m, psi, far


def test_drift_equals_plain_python(spark):
    r = random.Random(6)
    rows = [(g, r.choice([None, -1.0, 0.0, 1.0, 7.0, r.random() ** (1 + i % 3)]), r.choice(["x", "y", None, "z"][: 2 + i % 3]))
            for i, g in enumerate(["d1", "d2", "d3"]) for _ in range(200)]
    log = spark.createDataFrame(rows, "day string, score double, name string")
    counts = D.binned_counts(log, F.col("day"), METRICS)
    parts = [D.binned_counts(log.where(F.col("score") > 0.3), F.col("day"), METRICS),
             D.binned_counts(log.where("score <= 0.3 or score is null"), F.col("day"), METRICS)]
    assert D.merged_counts(*parts).exceptAll(counts).count() == 0
    for pairs in (D.against(counts, "d1"), D.against_previous(counts)):
        got = D.drift(counts, pairs).collect()
        assert len(got) == 4
        for x in got:
            n, m, psi, far = plain(rows, x["group"], x.reference, x.metric)
            assert (x.n, x.n_reference) == (n, m)
            assert x.psi == pytest.approx(psi) and x.distance == pytest.approx(far)
    same = D.drift(counts, spark.createDataFrame([("d1", "d1")], "group string, reference string")).collect()
    assert all(x.psi == 0 and x.distance == 0 for x in same)


def test_drift_of_nothing(spark):
    log = spark.createDataFrame([], "day string, score double, name string")
    counts = D.binned_counts(log, F.col("day"), METRICS)
    assert D.drift(counts, D.against_previous(counts)).count() == 0
