"""Event and user sources.

The event model has ``event_id, muid, session_id, event_name, event_time,
device_os, channel, traffic_source, category, product_id, page_url``.
``adapt_events`` derives that model from the driver's generic ``events`` table
(``event_id, ts, user_id, event_type, value, props``); ``read_users`` derives
the user dimension from ``customer`` and ``nation``.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwise.session import pin_utc

EVENT_COLUMNS = ["event_id", "muid", "session_id", "event_name", "event_time", "device_os",
                 "channel", "traffic_source", "category", "product_id", "page_url"]
# The 8 columns the training path reads.
TRAIN_COLUMNS = ["muid", "event_name", "event_time", "device_os", "channel", "category",
                 "traffic_source", "session_id"]


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def _case(k: Column, mapping: list[tuple[int, str]], mod: int) -> Column:
    """CASE k % mod WHEN a THEN x ... END (else null)."""
    expr = None
    for key, val in mapping:
        cond = (k % mod) == key
        expr = F.when(cond, F.lit(val)) if expr is None else expr.when(cond, F.lit(val))
    return expr


def adapt_events(raw: DataFrame) -> DataFrame:
    """Map the generic event table onto the event model (pure projection, no shuffle).

    FIXED VALUES: the derivation rules of the test-data adapter (k = props.k).
    """
    k = F.get_json_object("props", "$.k").cast("int")
    raw = raw.select("event_id", "ts", "user_id", "event_type", k.alias("_k"))
    k = F.col("_k")
    et = F.col("event_type")
    event_name = (
        F.when(et == "click", F.when(k % 3 == 0, "add_to_cart").otherwise("scroll"))
        .when(et == "view", F.when(k % 2 == 0, "pageview").otherwise("viewcontent"))
        .when(et == "signup", "search")
        .otherwise(et)
    )
    session_id = F.when(k % 20 == 19, F.lit(None).cast("string")).otherwise(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")))
    device_os = _case(k, [(0, "android"), (1, "ios"), (2, "desktop")], 4)
    channel = (F.when(k % 10 == 9, F.lit(None).cast("string"))
               .when(F.col("user_id") % 3 == 0, "app").otherwise("browser"))
    traffic = _case(k, [(0, "direct"), (1, "organic"), (2, " Paid "), (3, "REFERRAL"), (4, "social")], 6)
    category = _case(k, [(0, "books"), (1, "Beauty"), (2, " electronics"), (3, "fashion"),
                         (4, "toys"), (5, "unknown-cat"), (6, "other")], 8)
    return raw.select(
        F.col("event_id"),
        F.col("user_id").alias("muid"),
        session_id.alias("session_id"),
        event_name.alias("event_name"),
        F.col("ts").alias("event_time"),
        device_os.alias("device_os"),
        channel.alias("channel"),
        traffic.alias("traffic_source"),
        category.alias("category"),
        k.cast("string").alias("product_id"),
        F.lit(None).cast("string").alias("page_url"),
    )


def load_events(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """Events of a test-data folder in the event model. Column pruning and
    filters above this projection reach the Parquet scan."""
    pin_utc(spark)
    df = adapt_events(spark.read.parquet(table_path(sf_dir, "events")))
    return df.select(*columns) if columns else df


def read_events(spark: SparkSession, path: str, columns: list[str] | None = None,
                schema=None) -> DataFrame:
    """Scan event Parquet files (a file, folder or glob). Fails when nothing matches."""
    pin_utc(spark)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    try:
        df = reader.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        raise FileNotFoundError(f"No parquet files found in {path}") from exc
    return df.select(*columns) if columns else df


def month_of(ts) -> Column:
    """Month partition key 'yyyy-MM' of an event time."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(ts, "yyyy-MM")


def read_events_range(df: DataFrame, start: str | None, end: str | None,
                      time_col: str = "event_time", month_col: str = "event_month") -> DataFrame:
    """Half-open time range [start, end). When the table is partitioned by
    ``event_month`` the derived month predicate is added too, so the scan prunes
    partitions (a predicate on the time column alone prunes none)."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(time_col) >= F.lit(start).cast(df.schema[time_col].dataType))
    if end is not None:
        cond = cond & (F.col(time_col) < F.lit(end).cast(df.schema[time_col].dataType))
    if month_col in df.columns:
        if start is not None:
            cond = cond & (F.col(month_col) >= F.lit(start[:7]))
        if end is not None:
            cond = cond & (F.col(month_col) <= F.lit(end[:7]))
    return df.where(cond)


def read_users(spark: SparkSession, sf_dir: str, events: DataFrame | None = None,
               limit: int | None = None) -> DataFrame:
    """User dimension: id, email, phone, name, location, last_active_at.

    ``last_active_at`` is the newest event time of the user (null without events);
    ``limit`` keeps the first N users by id (deterministic subset)."""
    pin_utc(spark)
    cust = spark.read.parquet(table_path(sf_dir, "customer")).select("c_custkey", "c_name", "c_nationkey")
    nation = spark.read.parquet(table_path(sf_dir, "nation")).select("n_nationkey", "n_name")
    # nation is a fixed 25-row dimension: broadcasting it is bounded.
    users = cust.join(F.broadcast(nation), cust.c_nationkey == nation.n_nationkey, "left").select(
        F.col("c_custkey").alias("id"),
        F.lit(None).cast("string").alias("email"),
        F.lit(None).cast("string").alias("phone"),
        F.col("c_name").alias("name"),
        F.col("n_name").alias("location"),
    )
    if events is None:
        events = load_events(spark, sf_dir, ["muid", "event_time"])
    last = events.groupBy("muid").agg(F.max("event_time").alias("last_active_at"))
    users = users.join(last, users.id == last.muid, "left").drop("muid")
    if limit is not None:
        users = users.orderBy("id").limit(limit)
    return users
