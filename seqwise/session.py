"""Session helpers: a tuned local session for tests/bench, and shared-folder lookup."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "seqwise", extra: dict | None = None) -> SparkSession:
    """Session used by tests and bench. On a cluster, use the cluster's own session."""
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    extra = dict(extra or {})
    if "spark.checkpoint.dir" not in extra and master.startswith("local"):
        # Local runs only: a cluster names its shared folder itself.
        extra["spark.checkpoint.dir"] = tempfile.mkdtemp(
            prefix="seqwise-ckpt-", dir=os.environ.get("SEQWISE_SCRATCH", "/tmp"))
    for k, v in extra.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def pin_utc(spark: SparkSession) -> None:
    """Hours and days are UTC in this engine; pin the session time zone."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only when the session names none (local tests) is a scratch folder created
    and registered; on a cluster the setting must point at shared storage.
    """
    sc = spark.sparkContext
    current = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        # A machine-local folder is not shared by the executors of a cluster.
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS or an object store)")
    path = tempfile.mkdtemp(prefix="seqwise-ckpt-", dir=os.environ.get("SEQWISE_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def cluster_conf(input_bytes: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a cluster run over ``input_bytes`` of input.

    Shuffle partitions are sized so a partition holds about ``partition_bytes``
    (AQE coalesces small ones and splits skewed join partitions at run time);
    scan splits use the same size. Hot users in windows are handled by the
    operators themselves (see operators.frames)."""
    shuffle = max(200, int(input_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
