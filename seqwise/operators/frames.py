"""Bounded-frame window evaluation that survives hot keys.

A window partitioned by user puts every event of a user into one task. With one
user holding a large share of all rows that task would never finish, so users
above ``rows_per_split`` rows are cut into consecutive time ranges ("splits")
holding about that many rows each — balanced by counting, from a histogram of
the user's events over fine time buckets, so bursts are split as well — and the
window runs per (user, split).

Rows near a split boundary need neighbours from the next split over. Those
neighbours ("halo rows") are found before the window, from a small pre-pass:
per split only the last ``before`` and first ``after`` rows can ever be needed
(a partial top-k before any shuffle), and one boundary marker per split picks,
over that small candidate table, exactly the ``before`` rows preceding and the
``after`` rows following the boundary. The halo rows are added to the input of
their target split and dropped after the window, so every row's frame is
complete and the events are shuffled once, on (user, split).

Users at or below the threshold keep the plain plan: one hash exchange on the
user key, one sort, one Window node.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

# Rows of one user evaluated by one window task before the user is split.
DEFAULT_ROWS_PER_SPLIT = 2_000_000
# Hot-user statistics are broadcast only up to this many users (a few MB);
# beyond it they are joined with a shuffle (AQE splits skewed join partitions).
HOT_BROADCAST_MAX_ROWS = 200_000
# Time resolution used to balance splits: fine buckets per expected split, and
# a cap on buckets per user. The bucket -> split map is broadcast up to
# BUCKET_BROADCAST_MAX_ROWS rows.
FINE_BUCKETS_PER_SPLIT = 64
MAX_FINE_BUCKETS = 1 << 20
BUCKET_BROADCAST_MAX_ROWS = 1_000_000


SUB_BUCKETS = 1024  # a heavy bucket is cut into this many, until none is heavy


@dataclass
class HotSplits:
    """Split plan of the hot keys. ``users`` (key, _t0, _fw, _nb); ``levels``:
    per level the heavy buckets (key, _sb, _slo, _sw), by start, that are cut
    from time _slo on into buckets of width _sw; ``buckets`` (key, _sb, _s):
    start of an uncut bucket -> split, count balanced."""
    users: DataFrame
    levels: list[DataFrame]
    buckets: DataFrame
    broadcast: bool


def configured_rows_per_split(df: DataFrame, default: int) -> int:
    """``seqwise.rowsPerSplit`` from the session overrides the code default
    (only when the caller kept the default)."""
    if default != DEFAULT_ROWS_PER_SPLIT:
        return default
    return int(df.sparkSession.conf.get("seqwise.rowsPerSplit", str(default)))


def _count_persisted(df: DataFrame) -> tuple[DataFrame, int]:
    df = df.persist()  # shared by the size check and the join; lineage if lost
    return df, df.count()


def _maybe_broadcast(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _bucket(t_col: str) -> Column:
    """Start of a time's bucket at the first level."""
    return F.expr(f"_t0 + ((`{t_col}` - _t0) div _fw) * _fw")


def _sub_bucket(t_col: str) -> Column:
    """Start of its bucket one level further (unchanged where that is not cut)."""
    return F.coalesce(F.expr(f"_slo + ((`{t_col}` - _slo) div _sw) * _sw"), F.col("_sb"))


def hot_key_splits(df: DataFrame, key: str, t_col: str, rows_per_split: int,
                   broadcast_max_rows: int = HOT_BROADCAST_MAX_ROWS) -> HotSplits | None:
    """Split plan for keys with more than ``rows_per_split`` rows, or None.

    1. Per key count and time range: a partial (map-side) aggregate, so a hot
       key costs no skew; one small action decides whether splitting is needed.
    2. For hot keys only, a histogram over fine time buckets. Buckets holding
       more than a quarter of a split are cut over the times that really occur
       in them, and again until none is that heavy (only rows with the very
       same timestamp can never be separated); a burst, or a stray timestamp
       years away, costs one more level. All are partial aggregates. A running
       count over the buckets starts a new split every ``rows_per_split``
       rows."""
    stats = (df.groupBy(key)
             .agg(F.count(F.lit(1)).alias("_n"), F.min(t_col).alias("_t0"), F.max(t_col).alias("_t1"))
             .where(F.col("_n") > rows_per_split))
    n_fine = F.least(F.ceil(F.col("_n") / F.lit(rows_per_split)) * FINE_BUCKETS_PER_SPLIT,
                     F.lit(MAX_FINE_BUCKETS)).cast("long")
    stats = stats.select(key, "_t0", ((F.expr("(_t1 - _t0)") / n_fine).cast("long") + 1).alias("_fw"))
    stats, n_hot = _count_persisted(stats)
    if n_hot == 0:
        stats.unpersist()
        return None
    hs = _maybe_broadcast(stats, n_hot <= broadcast_max_rows)
    rows = df.select(key, t_col).join(hs, key).select(key, t_col, _bucket(t_col).alias("_sb"))
    levels, leaves = [], None
    while True:
        # small (at most one row per bucket); persisted, the check for heavy
        # buckets and the split assignment read it without a rescan
        counts = rows.groupBy(key, "_sb").agg(
            F.count(F.lit(1)).alias("_c"), F.min(t_col).alias("_slo"), F.max(t_col).alias("_shi")).persist()
        heavy, n_heavy = _count_persisted(
            counts.where((F.col("_c") > max(rows_per_split // 4, 1)) & (F.col("_shi") > F.col("_slo")))
            .select(key, "_sb", "_slo", F.expr(f"(_shi - _slo) div {SUB_BUCKETS} + 1").alias("_sw")))
        light = counts.select(key, "_sb", "_c") if n_heavy == 0 else counts.join(
            heavy.select(key, "_sb"), [key, "_sb"], "left_anti").select(key, "_sb", "_c")
        leaves = light if leaves is None else leaves.unionByName(light)
        if n_heavy == 0:
            break
        levels.append(_maybe_broadcast(heavy, n_heavy <= BUCKET_BROADCAST_MAX_ROWS))
        rows = rows.join(levels[-1], [key, "_sb"]).select(key, t_col, _sub_bucket(t_col).alias("_sb"))
    w = Window.partitionBy(key).orderBy("_sb")
    before = F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    b = leaves.join(hs, key).select(key, "_t0", "_fw", "_sb", (before / F.lit(rows_per_split)).cast("long").alias("_s"))
    b = b.withColumn("_nb", F.max("_s").over(Window.partitionBy(key)) + 1)
    b, n_b = _count_persisted(b)
    small = n_b <= BUCKET_BROADCAST_MAX_ROWS
    # one row per hot user: broadcast on the hot-user count checked above, so
    # the join on the user key never sends a hot user's rows to one task
    users = _maybe_broadcast(b.select(key, "_t0", "_fw", "_nb").distinct(), n_hot <= broadcast_max_rows)
    return HotSplits(users=users, levels=levels, buckets=_maybe_broadcast(b.select(key, "_sb", "_s"), small),
                     broadcast=small)


def assign_splits(df: DataFrame, key: str, t_col: str, hot: HotSplits | None) -> DataFrame:
    """Add ``_s`` (split number, monotone in time) and ``_nb`` (splits of the
    key); 0 and 1 for keys that are not hot. ``hot`` must come from
    ``hot_key_splits`` over the same rows (every row's bucket is in the plan)."""
    if hot is None:
        return df.withColumn("_s", F.lit(0).cast("long")).withColumn("_nb", F.lit(1).cast("long"))
    j = df.join(hot.users, key, "left")

    def locate(x: DataFrame, how: str) -> DataFrame:
        x = x.withColumn("_sb", _bucket(t_col))
        for heavy in hot.levels:
            x = x.join(heavy, [key, "_sb"], "left").withColumn("_sb", _sub_bucket(t_col)).drop("_slo", "_sw")
        return x.join(hot.buckets, [key, "_sb"], how)

    # A hot row must find its bucket: the plan has to be built from the same
    # rows. Fail loudly rather than put the row into a wrong split or drop it.
    covered = F.when(F.col("_t0").isNotNull() & F.col("_s").isNull(), F.raise_error(
        F.lit("split plan does not cover a row of a hot key"))).otherwise(F.col("_s"))
    if hot.broadcast:
        j = locate(j, "left").withColumn("_s", covered)
        return (j.withColumn("_s", F.coalesce(F.col("_s"), F.lit(0)).cast("long"))
                 .withColumn("_nb", F.coalesce(F.col("_nb"), F.lit(1)).cast("long"))
                 .drop("_sb", "_t0", "_fw"))
    # Large maps: only hot rows take the shuffled joins on (key, bucket), which
    # spread a hot key over many partitions.
    cold = (j.where(F.col("_t0").isNull()).drop("_t0", "_fw", "_nb")
            .withColumn("_s", F.lit(0).cast("long")).withColumn("_nb", F.lit(1).cast("long")))
    warm = (locate(j.where(F.col("_t0").isNotNull()), "left").withColumn("_s", covered)
            .drop("_sb", "_t0", "_fw")
            .withColumn("_s", F.col("_s").cast("long")).withColumn("_nb", F.col("_nb").cast("long")))
    return cold.unionByName(warm)


def split_starts(hot: HotSplits, key: str) -> DataFrame:
    """Start time of every split after the first: (key, _b, _mt)."""
    return (hot.buckets.where(F.col("_s") > 0).groupBy(key, "_s").agg(F.min("_sb").alias("_mt"))
            .select(key, F.col("_s").alias("_b"), "_mt"))


def bounded_window(df: DataFrame, key: str, order: list, t_col: str, before: int, after: int,
                   make_cols: Callable[[WindowSpec], dict[str, Column]],
                   rows_per_split: int = DEFAULT_ROWS_PER_SPLIT,
                   hot: HotSplits | None | str = "auto") -> DataFrame:
    """Return ``df`` plus the columns of ``make_cols(window)``.

    ``make_cols`` gets a WindowSpec partitioned by the key and ordered by
    ``order`` (whose first column must be monotone with ``t_col``, a long epoch
    column) and must only use frames / offsets within ``[-before, +after]``."""
    base_cols = df.columns
    if isinstance(hot, str):
        rows_per_split = configured_rows_per_split(df, rows_per_split)
        hot = hot_key_splits(df, key, t_col, rows_per_split)
    if hot is None:
        w = Window.partitionBy(key).orderBy(*order)
        cols = make_cols(w)
        return df.select(*base_cols, *[c.alias(n) for n, c in cols.items()])

    names = list(make_cols(Window.partitionBy(key).orderBy(*order)).keys())
    order_names = [c for c in order]
    if not all(isinstance(c, str) for c in order_names):
        raise TypeError("order must be column names")
    sp = assign_splits(df, key, t_col, hot)
    halo = _halo_rows(sp, hot, key, order_names, t_col, base_cols, before, after)
    sp = sp.select(*base_cols, "_s", F.lit(False).alias("_halo"))
    u = sp.unionByName(halo) if halo is not None else sp
    wk = Window.partitionBy(key, "_s").orderBy(*order)
    cols = make_cols(wk)
    out = u.select(*base_cols, "_halo", *[c.alias(n) for n, c in cols.items()])
    return out.where(~F.col("_halo")).select(*base_cols, *names)


def _halo_rows(sp: DataFrame, hot: DataFrame, key: str, order: list[str], t_col: str,
               base_cols: list[str], before: int, after: int) -> DataFrame | None:
    """Rows each split of a hot key needs from other splits, tagged with the
    target split. Small: at most ``before + after`` rows per split boundary."""
    if before <= 0 and after <= 0:
        return None
    hot_rows = sp.where(F.col("_nb") > 1)
    cands = []
    if before > 0:  # last `before` rows of every split but the last
        wd = Window.partitionBy(key, "_s").orderBy(*[F.col(c).desc() for c in order])
        cands.append(hot_rows.withColumn("_rk", F.row_number().over(wd)).where(F.col("_rk") <= before)
                     .where(F.col("_s") < F.col("_nb") - 1).drop("_rk"))
    if after > 0:  # first `after` rows of every split but the first
        wa = Window.partitionBy(key, "_s").orderBy(*order)
        cands.append(hot_rows.withColumn("_rk", F.row_number().over(wa)).where(F.col("_rk") <= after)
                     .where(F.col("_s") > 0).drop("_rk"))
    cand = cands[0] if len(cands) == 1 else cands[0].unionByName(cands[1]).dropDuplicates([key, *order])
    cand = cand.select(key, F.col(t_col).alias("_mt"), F.lit(1).alias("_tag"),
                       *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                       F.struct(*base_cols).alias("_row"), F.lit(None).cast("long").alias("_b"))
    # One marker per boundary b (start of split b), sorting before rows at that time.
    marks = split_starts(hot, key)
    marks = marks.select(key, "_mt", F.lit(0).alias("_tag"),
                         *[F.lit(None).cast(cand.schema[f"_o{i}"].dataType).alias(f"_o{i}")
                           for i in range(len(order))],
                         F.lit(None).cast(cand.schema["_row"].dataType).alias("_row"), "_b")
    seq = Window.partitionBy(key).orderBy("_mt", "_tag", *[f"_o{i}" for i in range(len(order))])
    # Position key: candidate number k -> 2k, a marker after k candidates ->
    # 2k + 1, so range frames over it count candidates only, never markers.
    m = cand.unionByName(marks).withColumn(
        "_k", F.sum("_tag").over(seq.rowsBetween(Window.unboundedPreceding, 0)))
    m = m.withColumn("_pos", F.when(F.col("_tag") == 1, F.col("_k") * 2).otherwise(F.col("_k") * 2 + 1))
    by_pos = Window.partitionBy(key).orderBy("_pos")
    picks = []
    if before > 0:
        picks.append(F.struct(F.col("_b").alias("_target"), F.collect_list("_row").over(
            by_pos.rangeBetween(-(2 * before - 1), -1)).alias("_rows")))
    if after > 0:
        picks.append(F.struct((F.col("_b") - 1).alias("_target"), F.collect_list("_row").over(
            by_pos.rangeBetween(1, 2 * after - 1)).alias("_rows")))
    per_mark = m.select("_tag", F.array(*picks).alias("_p")).where(F.col("_tag") == 0)
    flat = per_mark.select(F.explode("_p").alias("_p")).select(
        F.col("_p._target").alias("_s"), F.explode("_p._rows").alias("_r"))
    return flat.select(*[F.col(f"_r.{c}").alias(c) for c in base_cols], "_s", F.lit(True).alias("_halo"))
