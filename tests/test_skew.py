"""One user holding a third of all rows (derived from the given events)."""

from pyspark.sql import functions as F

from conftest import SF01
from seqwise.functions.columns import epoch_us
from seqwise.operators.frames import hot_key_splits
from seqwise.operators.labels import future_labels
from seqwise.operators.vocab import build_vocab
from seqwise.operators.windows import sliding_windows
from seqwise.sources import load_events


def _skewed(spark):
    e = load_events(spark, SF01)
    return e.withColumn("muid", F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("muid")))


def _same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_hot_user_is_split_and_exact(spark):
    e = _skewed(spark)
    hot = hot_key_splits(e.withColumn("_t", epoch_us(e, "event_time")), "muid", "_t", 500)
    rows = {r.muid: r._nb for r in hot.users.collect()}
    assert rows == {0: 7}  # ~3,334 rows of user 0 -> 7 splits of <= 500 on average
    assert _same(sliding_windows(e, hot=None), sliding_windows(e, rows_per_split=500))
    v = build_vocab(e)
    assert _same(future_labels(e, v, 5, hot=None), future_labels(e, v, 5, rows_per_split=500))


def _bursty(spark):
    """User 0 holds a third of the events; half of them fall into one hour."""
    e = _skewed(spark)
    burst = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz") + F.make_interval(
        secs=(F.col("event_id") % 3600).cast("int"))
    return e.withColumn("event_time", F.when((F.col("muid") == 0) & (F.col("event_id") % 2 == 0), burst)
                        .otherwise(F.col("event_time")))


def test_bursty_hot_user_gets_balanced_splits(spark):
    from seqwise.operators.frames import assign_splits
    e = _bursty(spark).withColumn("_t", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', event_time)"))
    hot = hot_key_splits(e, "muid", "_t", 500)
    sizes = [r["count"] for r in assign_splits(e, "muid", "_t", hot).where("muid = 0").groupBy("_s").count().collect()]
    assert len(sizes) >= 6 and max(sizes) <= 2 * 500  # equal-width time splits would put ~1,700 in one
    b = _bursty(spark)
    assert _same(sliding_windows(b, hot=None), sliding_windows(b, rows_per_split=500))


def test_unbroadcast_bucket_map_path(spark, monkeypatch):
    import seqwise.operators.frames as FR
    monkeypatch.setattr(FR, "BUCKET_BROADCAST_MAX_ROWS", 0)
    e = _skewed(spark)
    assert _same(sliding_windows(e, hot=None), sliding_windows(e, rows_per_split=500))


def test_stray_timestamp_does_not_hide_a_burst(spark):
    """One event in 2014, all others of the hot user within one second of 2024."""
    from seqwise.operators.frames import assign_splits
    far, sec = 1_400_000_000_000_000, 1_706_000_000_000_000
    e = spark.range(10_001).select(F.lit(0).alias("muid"), F.when(F.col("id") == 0, F.lit(far)).otherwise(
        F.lit(sec) + F.col("id") * 100).alias("_t"))
    for target in (500, 7):
        hot = hot_key_splits(e, "muid", "_t", target)
        sizes = [r["count"] for r in assign_splits(e, "muid", "_t", hot).groupBy("_s").count().collect()]
        assert max(sizes) <= 2 * target and sum(sizes) == 10_001
    same = e.withColumn("_t", F.lit(sec))  # equal times cannot be separated, but must not loop
    assert assign_splits(same, "muid", "_t", hot_key_splits(same, "muid", "_t", 500)).count() == 10_001
