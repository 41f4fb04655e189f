"""Distributed numbering and deep pages; vocabularies that grow."""

import random

from pyspark.sql import functions as F

from seqwise.operators import vocab as V
from seqwise.operators.ranking import RANGE, RankedTable


def test_ranks_and_pages_equal_a_sort(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), r.randrange(50) if r.random() > 0.1 else None, i) for i in range(3_000)]
    df = spark.createDataFrame(rows, "g string, `x.y` int, i int").repartition(5)
    key = lambda t: (t[1] is not None, t[1] or 0, t[2])
    got = {tuple(x)[:3]: x["rank"] for x in RankedTable(df, ["x.y", "i"], group="g", ranges=6).ranks().collect()}
    for g in ("a", "b", None):
        assert [got[t] for t in sorted((t for t in rows if t[0] == g), key=key)] == \
            list(range(1, sum(t[0] == g for t in rows) + 1))
    table = RankedTable(df, ["x.y", "i"], ranges=6)
    every = sorted(rows, key=key)
    for offset, limit in ((0, 5), (1_700, 40), (2_990, 100), (3_000, 10), (10**9, 1), (3, 0)):
        assert [tuple(x) for x in table.page(offset, limit).collect()] == every[offset:offset + limit]
    assert RankedTable(df.limit(0), ["i"]).page(0, 3).count() == 0


def test_a_deep_page_opens_its_ranges_only(spark):
    table = RankedTable(spark.range(20_000).select("id"), ["id"], ranges=8)
    page = table.page(15_000, 10)
    assert {f.split(f"{RANGE}=")[1].split("/")[0] for f in page.inputFiles()} < {str(i) for i in range(8)}
    assert len(page.inputFiles()) <= 2 and [x.id for x in page.collect()] == list(range(15_000, 15_010))


def test_a_large_vocabulary_is_numbered_by_many_tasks(spark):
    e = spark.range(0, 200_000, 1, 8).select(
        F.timestamp_micros(F.col("id") * 1_000).cast("timestamp_ntz").alias("event_time"), F.col("id").alias("event_id"),
        F.concat(F.lit("v"), F.col("id") * 7919 % 120_000).alias("category"))
    one = V.build_vocab(e, ["category"], rank_in_one_task=10**7)
    many = V.build_vocab(e, ["category"])
    assert one.exceptAll(many).count() == 0 == many.exceptAll(one).count() and many.count() > 120_000
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert RANGE in plan.split("Window")[1]  # the window's groups are ranges of a feature, not the feature


def test_new_values_follow_and_old_ids_stay(spark):
    schema = "event_time timestamp_ntz, event_id long, category string, channel string"
    import datetime as dt
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    first = spark.createDataFrame([(t(1), 1, "b", "x"), (t(2), 2, "a", None)], schema)
    second = spark.createDataFrame([(t(3), 3, "c", "y"), (t(3), 4, "b", "x"), (t(4), 5, "0", None)], schema)
    old = V.build_vocab(first, ["category", "channel"])
    for rank_in_one_task in (0, 100):
        new = V.extend_vocab(old, second, ["category", "channel"], rank_in_one_task)
        ids = {(r.feature, r.value): r.id for r in new.collect()}
        assert {k: ids[k] for k in ((r.feature, r.value) for r in old.collect())} == \
            {(r.feature, r.value): r.id for r in old.collect()}
        assert [ids["category", v] for v in ("b", "a", "c", "0")] == [2, 3, 4, 5] and ids["channel", "y"] == 3
        assert V.extend_vocab(new, second, ["category", "channel"], rank_in_one_task).exceptAll(new).count() == 0
    empty = V.extend_vocab(old.limit(0), second, ["category"])
    assert {r.value: r.id for r in empty.collect() if r.id > 1} == {"c": 2, "b": 3, "0": 4}
