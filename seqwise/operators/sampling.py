"""Sorting, top-k, sampling, splitting and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqwise.operators.frames import (DEFAULT_ROWS_PER_SPLIT, assign_splits, configured_rows_per_split,
                                      hot_key_splits)


def md5_bucket(key, seed: int, buckets: int = 100):
    """Deterministic bucket of a key: first 32 bits of md5('seed:key') mod buckets."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10)
    return (h.cast("long") % F.lit(buckets)).cast("int")


def md5_order_key(key, seed: int):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def sample_users(events: DataFrame, n: int, seed: int = 42, key: str = "muid") -> DataFrame:
    """Exactly min(n, #users) users chosen by md5 order; all of their events.

    Distinct users is a partial aggregate; the top-n is TakeOrderedAndProject
    (each task keeps n); the chosen set has at most n rows, so it is broadcast."""
    from seqwise.operators.util import BROADCAST_MAX_ROWS
    users = events.select(key).distinct()
    chosen = users.orderBy(md5_order_key(key, seed), key).limit(n)
    # the chosen set has at most n rows: broadcast when n is within the limit
    return events.join(F.broadcast(chosen) if n <= BROADCAST_MAX_ROWS else chosen, key, "left_semi")


def _split(df: DataFrame, key: str, val_pct: int, seed: int) -> DataFrame:
    """'val' for md5 bucket < val_pct, else 'train'; the validation side is never
    empty: when no key falls below the threshold, the key(s) with the smallest
    bucket go to validation (global minimum as a scalar subquery, no join)."""
    from seqwise.operators.aggregates import with_stats_row
    b = df.withColumn("_bucket", md5_bucket(key, seed))
    b = with_stats_row(b, b.agg(F.min("_bucket").alias("_min_bucket")))
    val = (F.col("_bucket") < val_pct) | ((F.col("_min_bucket") >= val_pct) & (F.col("_bucket") == F.col("_min_bucket")))
    return b.withColumn("split", F.when(val, "val").otherwise("train")).drop("_bucket", "_min_bucket")


def split_by_user(df: DataFrame, val_pct: int = 15, seed: int = 42, key: str = "muid") -> DataFrame:
    """Adds ``split`` ('train' / 'val', about val_pct % of users in 'val'). User
    level, so overlapping windows of one user never straddle the split."""
    return _split(df, key, val_pct, seed)


def split_by_row(df: DataFrame, val_pct: int = 15, seed: int = 42, row_key: str = "event_id") -> DataFrame:
    """Row-level variant (the original per-row split)."""
    return _split(df, row_key, val_pct, seed)


def user_positions(events: DataFrame, key: str = "muid", order=("event_time", "event_id"),
                   t_col: str = "_t", rows_per_split: int = DEFAULT_ROWS_PER_SPLIT, hot="auto") -> DataFrame:
    """1-based position of every event in its user's (time, id) order. Events
    without user or time have none and are left out, whatever the users' sizes.

    Hot users are ranked per time split; split offsets come from a small
    per-(user, split) count table, so no task holds a whole hot user."""
    from seqwise.functions.columns import epoch_us
    events = events.where(F.col(key).isNotNull() & F.col(order[0]).isNotNull())
    df = events.withColumn(t_col, epoch_us(events, order[0]))
    if isinstance(hot, str):
        rows_per_split = configured_rows_per_split(df, rows_per_split)
        hot = hot_key_splits(df, key, t_col, rows_per_split)
    if hot is None:
        w = Window.partitionBy(key).orderBy(*order)
        return df.withColumn("position", F.row_number().over(w).cast("long")).drop(t_col)
    sp = assign_splits(df, key, t_col, hot)
    counts = sp.groupBy(key, "_s").agg(F.count(F.lit(1)).alias("_cnt"))
    offs = counts.select(key, "_s", F.coalesce(F.sum("_cnt").over(
        Window.partitionBy(key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))
    w = Window.partitionBy(key, "_s").orderBy(*order)
    return (sp.join(offs, [key, "_s"])
            .withColumn("position", (F.row_number().over(w) + F.col("_off")).cast("long"))
            .select(*events.columns, "position"))


def paginate(df: DataFrame, order: str, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(order).offset(offset).limit(limit)


def merge_recent(history: DataFrame, recent: DataFrame, key: str = "event_id",
                 time_col: str = "event_time") -> DataFrame:
    """Union request-time events with stored history, one row per event id
    (the request copy wins; of several the latest by ``time_col``, if there is
    one). Events without an id are all kept. The stored history is keyed already, so only the
    recent rows are deduplicated (a small partial aggregate) and the history
    loses the ids they replace through an anti join against the recent ids,
    broadcast after a size check: the history itself is never shuffled."""
    from seqwise.operators.util import broadcast_checked
    cols = [c for c in history.columns if c != key]
    first = [time_col] if time_col in cols else []
    rec = (recent.where(F.col(key).isNotNull()).groupBy(key)
           .agg(F.max(F.struct(*first, *[c for c in cols if c not in first])).alias("_r"))
           .select(key, *[F.col(f"_r.{c}").alias(c) for c in cols]))
    kept = history.join(broadcast_checked(rec.select(key)), key, "left_anti")
    nameless = recent.where(F.col(key).isNull())
    return kept.select(key, *cols).unionByName(rec).unionByName(nameless.select(key, *cols))
