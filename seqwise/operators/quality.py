"""Data quality: validation with reject reasons, batch rules, null profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqwise.functions.constants import BATCH_MAX, BATCH_MIN, EVENT_MAX_LEN, USER_MAX_LEN

# FIXED VALUE: e-mail shape accepted by the user schema (local@domain.tld).
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def _first_reason(checks: list[tuple[Column, str]]) -> Column:
    expr = None
    for cond, reason in checks:
        expr = F.when(cond, F.lit(reason)) if expr is None else expr.when(cond, F.lit(reason))
    return expr


def event_checks(df: DataFrame) -> Column:
    checks = [(F.col("muid").isNull(), "missing_muid"),
              (F.col("event_name").isNull(), "missing_event_name"),
              (F.col("event_time").isNull(), "missing_event_time")]
    for c, n in EVENT_MAX_LEN.items():
        if c in df.columns:
            checks.append((F.length(F.col(c)) > n, f"too_long_{c}"))
    return _first_reason(checks)


def validate_events(df: DataFrame) -> DataFrame:
    """Adds ``reject_reason`` (null when the event is accepted)."""
    return df.withColumn("reject_reason", event_checks(df))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    v = validate_events(df)
    return (v.where(F.col("reject_reason").isNull()).drop("reject_reason"),
            v.where(F.col("reject_reason").isNotNull()))


def validate_batches(df: DataFrame, batch_col: str) -> DataFrame:
    """A batch must carry BATCH_MIN..BATCH_MAX events."""
    return df.groupBy(batch_col).agg(F.count(F.lit(1)).alias("n_events")).select(
        batch_col, "n_events",
        F.col("n_events").between(BATCH_MIN, BATCH_MAX).alias("valid"))


def validate_users(df: DataFrame) -> DataFrame:
    checks = [(F.col("id").isNull(), "missing_id")]
    for c, n in USER_MAX_LEN.items():
        checks.append((F.length(F.col(c)) > n, f"too_long_{c}"))
    checks.append((F.col("email").isNotNull() & ~F.col("email").rlike(EMAIL_PATTERN), "bad_email"))
    return df.withColumn("reject_reason", _first_reason(checks))


def apply_defaults(df: DataFrame, ingest_ts: str) -> DataFrame:
    """Missing event_id -> new UUID string; missing event_time -> ingest time."""
    ts_type = df.schema["event_time"].dataType.simpleString()
    return df.withColumn("event_id", F.coalesce(F.col("event_id").cast("string"), F.expr("uuid()"))) \
             .withColumn("event_time", F.coalesce(F.col("event_time"), F.lit(ingest_ts).cast(ts_type)))


def null_profile(df: DataFrame) -> DataFrame:
    """Per column: type, null count and null % (one pass, then unpivot)."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"_null_{i}") for i, c in enumerate(df.columns)]
    one = df.agg(*aggs)
    stack = ", ".join(f"'{c}', '{df.schema[c].dataType.simpleString()}', `_null_{i}`"
                      for i, c in enumerate(df.columns))
    long = one.selectExpr("_n", f"stack({len(df.columns)}, {stack}) AS (column_name, data_type, null_count)")
    return long.select("column_name", "data_type", F.col("null_count").cast("long").alias("null_count"),
                       (F.col("null_count") * F.lit(100.0) / F.greatest(F.col("_n"), F.lit(1))).alias("null_pct"))


def not_null_violations(df: DataFrame, col: str = "muid") -> DataFrame:
    return df.agg(F.count_if(F.col(col).isNull()).alias(f"null_{col}"), F.count(F.lit(1)).alias("n"))


def assert_not_null(df: DataFrame, col: str = "muid") -> DataFrame:
    """Pass-through that fails the job on a null ``col`` (checked inside tasks)."""
    return df.withColumn(col, F.when(F.col(col).isNull(),
                                     F.raise_error(F.lit(f"null {col} found"))).otherwise(F.col(col)))


def range_check(df: DataFrame, cols: list[str], lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    bad = None
    for c in cols:
        cond = F.col(c).isNull() | (F.col(c) < lo) | (F.col(c) > hi)
        bad = cond if bad is None else (bad | cond)
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("out_of_range"))
