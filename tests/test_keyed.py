"""The bucketed table: upserts equal a plain dictionary, work follows the batch,
a crash before the manifest changes nothing, lookups open one bucket."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from seqwise.operators import keyed
from seqwise.operators.keyed import KeyedTable

SCHEMA = "id long, `a.b` string, at long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def folders(path):
    return set(glob.glob(f"{path}/data/kt_commit=*/kt_bucket=*"))


def content(table):
    return sorted((tuple(r) for r in table.read().collect()))


def test_upserts_equal_a_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "MAX_DELTAS", 2)
    r, want = random.Random(3), {i: (i, "first", 0) for i in range(60)}
    path = str(tmp_path / "t")
    table = KeyedTable.create(frame(spark, list(want.values()) + [(None, "no key", 0)]), path, "id", buckets=8)
    merged = 0
    for step in range(1, 6):
        rows = [(r.randrange(80), f"s{step}", 100 * step + k) for k in range(12)] * 2 + [(None, "x", 1)]
        for row in sorted((x for x in rows if x[0] is not None), key=lambda x: x[2]):
            want[row[0]] = row
        before = folders(path)
        done = table.upsert(frame(spark, rows), newest=["at"])
        merged += done["merged"]
        touched = {int(b) for b in (f.split("kt_bucket=")[1] for f in folders(path) - before)}
        assert len(touched) == done["touched"] <= 8
        assert len(folders(path) - before) == done["touched"] + done["merged"]
        assert content(table) == content(KeyedTable(spark, path)) == sorted(want.values())
    assert merged > 0
    assert max(len(c) for c in table.state["commits"].values()) <= 3


def test_small_batch_touches_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable.create(frame(spark, [(i, "v", 0) for i in range(500)]), path, "id", buckets=16)
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}
    assert table.upsert(frame(spark, [(7, "new", 1), (7, "old", 0)]), newest=["at"]) == \
        {"touched": 1, "merged": 0, "buckets": 16}
    after = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}
    assert len(after) == len(before) + 1 and all(after[f] == t for f, t in before.items())
    assert table.get(7).collect() == [(7, "new", 1)] and table.read().count() == 500


def test_crash_before_the_manifest_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    table = KeyedTable.create(frame(spark, [(i, "v", 0) for i in range(50)]), path, "id", buckets=4)
    old = content(table)

    def crash(*_):
        raise RuntimeError("lost driver")
    monkeypatch.setattr(table.manifests, "commit", crash)
    with pytest.raises(RuntimeError):
        table.upsert(frame(spark, [(i, "lost", 9) for i in range(80)]))
    again = KeyedTable(spark, path)
    assert content(again) == old
    again.upsert(frame(spark, [(3, "kept", 1)]))  # takes the orphan's number and overwrites its folder
    assert content(KeyedTable(spark, path)) == sorted([x for x in old if x[0] != 3] + [(3, "kept", 1)])


def test_two_writers_cannot_both_commit(spark, tmp_path):
    path = str(tmp_path / "t")
    KeyedTable.create(frame(spark, [(1, "v", 0)]), path, "id", buckets=2)
    a, b = KeyedTable(spark, path), KeyedTable(spark, path)
    a.upsert(frame(spark, [(1, "a", 1)]))
    with pytest.raises(Exception, match="(?i)exist"):
        b.manifests.commit(a.number, b.state)
    with pytest.raises(FileExistsError):
        KeyedTable.create(frame(spark, []), path, "id")


def test_lookup_reads_one_bucket_with_a_pushed_filter(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable.create(frame(spark, [(i, "v", i) for i in range(2_000)]), path, "id", buckets=16)
    one = table.get(1234)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,1234)" in plan and len(one.inputFiles()) == 1
    assert one.collect() == [(1234, "v", 1234)]
    assert table.get(-5).count() == 0 and table.get(None).count() == 0
    keys = spark.createDataFrame([(5,), (5,), (9,), (None,), (10**9,)], "k long")
    some = table.get_all(keys)
    assert sorted(r.id for r in some.collect()) == [5, 9] and len(some.inputFiles()) <= 4


def test_empty_table_and_text_keys(spark, tmp_path):
    table = KeyedTable.create(spark.createDataFrame([], "u string, x int"), str(tmp_path / "e"), "u", buckets=3)
    assert table.read().count() == 0 and table.get("x").count() == 0
    table.upsert(spark.createDataFrame([("a-1", 1), ("", 2), ("a-1", 3)], "u string, x int"), newest=["x"])
    assert sorted(map(tuple, table.read().collect())) == [("", 2), ("a-1", 3)]
    assert table.read().where(F.col("u") == "").count() == 1


def test_rows_never_null_at_first_may_be_later(spark, tmp_path):
    first = spark.range(4).select(F.col("id"), F.struct(F.lit(1).alias("n"), F.array(F.lit("x")).alias("a")).alias("s"))
    table = KeyedTable.create(first, str(tmp_path / "n"), "id", buckets=2)
    table.upsert(spark.createDataFrame([(1, None), (2, (None, [None]))], "id long, s struct<n:int,a:array<string>>"))
    assert {r.id: r.s and (r.s.n, r.s.a) for r in table.read().collect()} == \
        {0: (1, ["x"]), 1: None, 2: (None, [None]), 3: (1, ["x"])}


def test_clustered_files_are_sorted_by_key_and_filtered_in_the_scan(spark, tmp_path):
    import pyarrow.parquet as pq
    from seqwise.sources.sinks import write_clustered
    rows = spark.range(5_000).select((F.col("id") * 7919 % 5_000).alias("id"), F.lit("x").alias("v"))
    path = write_clustered(rows, str(tmp_path / "c"), "id")
    spans = []
    for f in glob.glob(f"{path}/*.parquet"):
        ids = pq.read_table(f)["id"].to_pylist()
        assert ids == sorted(ids)
        spans.append((ids[0], ids[-1]))
    spans.sort()
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    hit = spark.read.parquet(path).where(F.col("id") == 77)
    assert "EqualTo(id,77)" in hit._jdf.queryExecution().executedPlan().toString() and hit.count() == 1
