"""The helpers that cut a job into written steps."""

import os
import time

import pytest
from pyspark.sql import functions as F

from seqwise.llm import common


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {os.path.join(at, f) for d in manager.localDirs() for at, _, files in os.walk(str(d))
            for f in files if f.startswith("shuffle_")}


@pytest.mark.parametrize("keep", [common.materialize, lambda df: common.write_once(df, "kept")])
def test_written_steps_leave_no_shuffle_files(spark, keep):
    keys = spark.range(20_000).select((F.col("id") % 700).alias("k"), "id")
    df = keys.groupBy("k").agg(F.sum("id").alias("s")).join(keys.groupBy("k").count().hint("merge"), "k")
    rows = sorted(map(tuple, keys.groupBy("k").agg(F.sum("id"), F.count("id")).collect()))
    setting, before = spark.conf.get(common.DROP_SHUFFLES, None), shuffle_files(spark)
    kept = keep(df)
    until = time.time() + 30  # they are removed in the background
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(common.DROP_SHUFFLES, None) == setting
    # what was written and the caller's table both can be run again
    for _ in range(2):
        assert sorted(map(tuple, kept.collect())) == rows == sorted(map(tuple, df.collect()))


def test_setting_is_restored_after_an_error(spark):
    before = spark.conf.get(common.DROP_SHUFFLES, None)
    with pytest.raises(Exception, match="no"):
        common.materialize(spark.range(3).select(F.raise_error(F.lit("no"))))
    assert spark.conf.get(common.DROP_SHUFFLES, None) == before
