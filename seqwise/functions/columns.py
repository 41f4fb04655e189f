"""Column expressions (all JVM built-ins, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqwise.functions.constants import STATIC_VOCABS

_EPOCH_NTZ = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def epoch_us(df: DataFrame, name: str) -> Column:
    """Microseconds since the epoch. TIMESTAMP_NTZ wall clock is read as UTC:
    the difference is taken under the session time zone, which the engine pins
    to UTC (``session.pin_utc``), so no daylight-saving shift can enter.
    TIMESTAMP values are exact."""
    dt = df.schema[name].dataType
    if isinstance(dt, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH_NTZ}, `{name}`)")
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(F.col(name))
    raise TypeError(f"{name} is {dt}, expected a timestamp")


def norm_text(c) -> Column:
    """null -> '', strip all white space at both ends, lower (category and
    traffic_source only)."""
    text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def hour_enc(ts) -> Column:
    """Hour of day (UTC) + 1; 0 is padding."""
    return F.hour(ts) + F.lit(1)


def period_of_hour(h) -> Column:
    h = F.col(h) if isinstance(h, str) else h
    return (F.when(h < 6, 0).when(h < 12, 1).when(h < 18, 2).otherwise(3)).cast("int")


def _vocab_map(feature: str) -> Column:
    pairs = []
    for i, v in enumerate(STATIC_VOCABS[feature]):
        pairs += [F.lit(v), F.lit(i)]
    return F.create_map(*pairs)


def encode_static(feature: str, value) -> Column:
    """Static vocabulary lookup; unknown or null -> 0."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.element_at(_vocab_map(feature), value), F.lit(0)).cast("int")


def sigmoid(x) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def argmax0(arr) -> Column:
    """0-based index of the first maximum of an array."""
    arr = F.col(arr) if isinstance(arr, str) else arr
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def floor_days(us_diff) -> Column:
    """Whole days of a microsecond difference, floored (also for negatives)."""
    return F.floor(us_diff / F.lit(86_400_000_000)).cast("long")


def r9(c) -> Column:
    """Round to 9 decimals: last-bit float noise of window sums must not leak."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 9)
