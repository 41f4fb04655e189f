"""Micro-batch folders compacted behind a manifest."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from seqwise.sources import compaction as C
from seqwise.sources.sinks import append_events, batch_folder, scratch_path

SCHEMA = "event_id long, event_time timestamp_ntz, `a.b` string"


def _batch(spark, table, number, ids, month=1):
    rows = [(i, None if i % 50 == 7 else dt.datetime(2024, month, 1 + i % 28, i % 24), f"x{i}") for i in ids]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    append_events(df, batch_folder(table, number), mode="overwrite")
    return [tuple(r) for r in rows]


def _rows(table):
    return sorted(((r[0], r[1], r[2]) for r in table.read().collect()))


def _open(spark, path):
    return C.BatchTable(spark, path, spark.createDataFrame([], SCHEMA).schema)


def _files(folder):
    return sum(f.endswith(".parquet") for _, _, fs in os.walk(folder) for f in fs)


def test_every_row_once_before_during_and_after(spark, monkeypatch):
    path = scratch_path(spark, "t")
    assert _open(spark, path).read().count() == 0 and _open(spark, path).compact(5) == {"batches": 0, "merged": 0}
    want = []
    for b in range(4):
        want += _batch(spark, path, b, range(b * 100, b * 100 + 100), 1 + b % 2)
    before = _open(spark, path)
    assert _rows(before) == sorted(want, key=lambda r: r[0])
    assert _open(spark, path).compact(2) == {"batches": 3, "merged": 0}
    # a reader opened before, and one opened after, with the last batch not compacted
    assert _rows(before) == _rows(_open(spark, path)) == sorted(want, key=lambda r: r[0])
    # a retry writes the batch that was not final again
    _batch(spark, path, 3, range(300, 400), 2)
    want += _batch(spark, path, 4, range(400, 410), 3)
    assert _rows(_open(spark, path)) == sorted(want, key=lambda r: r[0])

    # a crash between the files and the manifest leaves the old state
    def crash(*_):
        raise OSError("lost")
    with monkeypatch.context() as m:
        m.setattr(C.Manifests, "commit", crash)
        with pytest.raises(OSError):
            _open(spark, path).compact(4)
    assert _rows(_open(spark, path)) == sorted(want, key=lambda r: r[0])
    table = _open(spark, path)
    assert table.compact(4) == {"batches": 2, "merged": 0} and table.compact(4)["batches"] == 0
    assert _rows(table) == sorted(want, key=lambda r: r[0])

    # of two compactions that run at once one fails and the table stays right
    _batch(spark, path, 5, [])
    want += _batch(spark, path, 6, range(500, 600))
    a, b = _open(spark, path), _open(spark, path)
    a.compact(6)
    with pytest.raises(Exception):
        b.compact(6)
    assert _rows(_open(spark, path)) == sorted(want, key=lambda r: r[0])

    # batch folders go, and what no kept manifest names
    assert a.vacuum(keep=1) >= 7 and a._batches() == []
    assert _rows(_open(spark, path)) == sorted(want, key=lambda r: r[0])
    want += _batch(spark, path, 7, range(600, 650))
    assert _rows(_open(spark, path)) == sorted(want, key=lambda r: r[0])


def test_months_merge_and_are_read_alone(spark, monkeypatch):
    monkeypatch.setattr(C, "MAX_GENERATIONS", 2)
    monkeypatch.setattr(C, "ROWS_PER_FILE", 60)
    path, want = scratch_path(spark, "t"), []
    merged = []
    for b in range(4):
        want += _batch(spark, path, b, range(b * 100, b * 100 + 100), 1 if b else 2)
        merged.append(_open(spark, path).compact(b)["merged"])
    table = _open(spark, path)
    # the month null has a third generation with batch 2, January with batch 3
    assert merged == [0, 0, 1, 1]
    assert _rows(table) == sorted(want, key=lambda r: r[0])
    assert all(len(g) <= 2 for g in table.state["months"].values())
    jan = table.read(["2024-01"])
    assert jan.count() == sum(r[1] is not None and r[1].month == 1 for r in want)
    assert all("event_month=2024-01" in f for f in jan.inputFiles())
    table.vacuum(keep=1)
    assert _rows(table) == sorted(want, key=lambda r: r[0])
    # files are stretches of time: their times do not overlap
    stretches = (jan.groupBy(F.input_file_name().alias("f")).agg(F.min("event_time").alias("lo"), F.max("event_time").alias("hi"))
                 .orderBy("lo").collect())
    assert len(stretches) > 3 and all(x.hi <= y.lo for x, y in zip(stretches, stretches[1:]))


def test_a_streams_batches_after_its_checkpoint_says_so(spark):
    """Compacted and vacuumed between two runs of a stream that compares late rows
    with the stored table: each event is kept once, in fewer files."""
    from conftest import SF001
    from seqwise.sources import load_events
    from seqwise.sources.events import EVENT_COLUMNS
    from seqwise.streaming import ingest as SI
    from seqwise.streaming.feed import read_record_stream, write_record_feed
    e = load_events(spark, SF001)
    folder, path, ckpt, seen = (scratch_path(spark, n) for n in ("feed", "t", "c", "seen"))
    assert C.committed_through(spark, ckpt) == -1

    def drain(rows, chunks):
        files = write_record_feed(rows, folder, chunks)
        return SI.ingest_stream(spark, read_record_stream(spark, folder, files_per_trigger=files), e.schema, path,
                                scratch_path(spark, "r"), ckpt, dedup_delay="2 days", index=seen)
    drain(e, 5)
    table = C.BatchTable(spark, path, e.schema)
    files = _files(path)
    assert table.compact(C.committed_through(spark, ckpt))["batches"] >= 5
    table.vacuum(keep=1)
    assert _files(path) < files
    early = e.where(F.col("event_time") < F.lit("2024-01-04").cast("timestamp_ntz"))
    new = early.withColumn("event_id", -1 - F.col("event_id"))
    stats = drain(early.unionByName(new), 1)
    assert stats["late_kept"] == new.count()
    got = C.BatchTable(spark, path, e.schema).read().select(*EVENT_COLUMNS)
    want = e.unionByName(new).select(*EVENT_COLUMNS)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_a_task_sorts_a_bounded_number_of_rows(spark, monkeypatch):
    """Files are as many as the rows need, though each would fit one file."""
    monkeypatch.setattr(C, "ROWS_PER_TASK", 100, raising=False)
    path, want = scratch_path(spark, "t"), []
    for b in range(3):
        want += _batch(spark, path, b, range(b * 400, b * 400 + 400))
    table = _open(spark, path)
    assert table.compact(2)["batches"] == 3 and table._batches() == [0, 1, 2]
    sizes = [r["count"] for r in table.read().groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) <= 200 and sum(sizes) == len(want)
    assert _rows(table) == sorted(want, key=lambda r: r[0])
