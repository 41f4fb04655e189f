import tempfile

import pytest

from conftest import SF001
from seqwise.sources import read_events, read_users
from seqwise.sources.sinks import overwrite_partitions


def test_missing_event_files_raise(spark):
    with pytest.raises(FileNotFoundError):
        read_events(spark, "/tmp/definitely-not-here-seqwise/*.parquet")


def test_first_n_users_is_deterministic(spark):
    ids = [r.id for r in read_users(spark, SF001, limit=5).collect()]
    assert ids == sorted(ids) and len(ids) == 5 and ids[0] == 0


def test_overwrite_only_touched_partitions(spark):
    path = tempfile.mkdtemp(prefix="parts-", dir="/tmp") + "/t"
    spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string").write.partitionBy("p").parquet(path)
    overwrite_partitions(spark.createDataFrame([(9, "b")], "v int, p string"), path, "p")
    got = {(r.v, r.p) for r in spark.read.parquet(path).collect()}
    assert got == {(1, "a"), (9, "b")}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static").lower() == "static"
