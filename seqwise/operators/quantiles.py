"""Exact quantiles of a column with any number of distinct values.

The value of a wanted rank is enclosed between two values, and the enclosure is
narrowed pass by pass. A pass takes two cut points near the wanted rank from a
quantile sketch of the enclosed values (an equi-depth histogram of bounded
size), counts the rows below and at each cut exactly, and keeps the side, or the
cut itself, that holds the rank. The sketch only says how fast this goes: the
counts decide, and every pass leaves at least its cut values behind. An
enclosure of at most ``KEEP`` rows is sorted as one array.

Of n rows about 4 n / ``ACCURACY`` remain after a pass, so 10^13 values take
three. A pass is a plain aggregate with a partial phase: no shuffle of rows, no
group, no map of values. All wanted ranks share the passes.

Nulls are left out; NaN counts as the greatest value; of no values every
quantile is null. Equal values are no trouble: a cut that many rows share is one
of the outcomes."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqwise.sources.sinks import scratch_path

KEEP = 100_000
ACCURACY = 10_000


def stored_column(df: DataFrame, col: str) -> DataFrame:
    """The column alone, not null, as a written table: it is read once a pass."""
    path = scratch_path(df.sparkSession, "column")
    kept = df.select(F.col(f"`{col}`").alias("v")).where(F.col("v").isNotNull())
    kept.write.parquet(path)
    return df.sparkSession.read.schema(kept.schema).parquet(path)


def order_statistics(values: DataFrame, ranks: list[int], keep: int = KEEP, accuracy: int = ACCURACY) -> list:
    """The values number ``ranks`` (from 0) of the sorted column ``v``, which
    holds no nulls; ranks must be below the number of rows."""
    kind = values.schema["v"].dataType
    v = F.col("v")

    def lit(x) -> Column:
        return F.lit(x).cast(kind)

    first = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if any(not 0 <= k < first[2] for k in ranks):
        raise ValueError(f"ranks must be from 0 to {first[2] - 1}")
    found: dict[int, object] = {}
    # rank -> least value, greatest value, rows below the least, rows enclosed
    open_ = {k: (first[0], first[1], 0, first[2]) for k in ranks}
    while open_:
        for k, (lo, hi, _, _) in list(open_.items()):
            if _same(lo, hi):
                found[k] = lo
                del open_[k]
        boxes = sorted(set(open_.values()), key=lambda b: b[2])
        if not boxes:
            break
        inside = {b: v.between(lit(b[0]), lit(b[1])) for b in boxes}
        rows = values.where(_any(inside.values()))

        small = [b for b in boxes if b[3] <= keep]
        large = {k: b for k, b in open_.items() if b[3] > keep}
        if small:
            arrays = rows.agg(*[F.array_sort(F.collect_list(F.when(inside[b], v))).alias(f"a{i}")
                                for i, b in enumerate(small)])
            picks = [(k, i) for i, b in enumerate(small) for k in open_ if open_[k] == b]
            got = arrays.select(*[F.col(f"a{i}")[k - open_[k][2]] for k, i in picks]).first()
            found.update({k: x for (k, _), x in zip(picks, got)})
        open_ = _narrowed(rows, large, inside, lit, accuracy, found)
    return [found[k] for k in ranks]


def _narrowed(rows: DataFrame, boxes: dict, inside: dict, lit, accuracy: int, found: dict) -> dict:
    """One pass over the enclosures: smaller ones, or the values themselves."""
    if not boxes:
        return {}
    v = F.col("v")
    margin = 2 / accuracy
    near = []
    for k, b in boxes.items():
        at = (k - b[2] + 0.5) / b[3]
        near.append(F.percentile_approx(F.when(inside[b], v), [max(0.0, at - margin), min(1.0, at + margin)], accuracy))
    cuts = rows.agg(*near).first()
    figures = []
    for (k, b), (c, d) in zip(boxes.items(), cuts):
        here, c, d = inside[b], lit(c), lit(d)
        mid = here & (v > c) & (v < d)
        figures += [F.count_if(here & (v < c)), F.count_if(here & (v <= c)), F.count_if(here & (v < d)),
                    F.count_if(here & (v <= d)), F.max(F.when(here & (v < c), v)),
                    F.min(F.when(mid, v)), F.max(F.when(mid, v)), F.min(F.when(here & (v > d), v))]
    got = rows.agg(*[f.alias(f"f{i}") for i, f in enumerate(figures)]).first()
    left = {}
    for i, ((k, (lo, hi, before, n)), (c, d)) in enumerate(zip(boxes.items(), cuts)):
        under_c, to_c, under_d, to_d, last_under, mid_lo, mid_hi, next_over = got[8 * i:8 * i + 8]
        place = k - before
        if place < under_c:
            left[k] = (lo, last_under, before, under_c)
        elif place < to_c:
            found[k] = c
        elif place < under_d:
            left[k] = (mid_lo, mid_hi, before + to_c, under_d - to_c)
        elif place < to_d:
            found[k] = d
        else:
            left[k] = (next_over, hi, before + to_d, n - to_d)
    return left


def _any(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out | c
    return out


def _same(a, b) -> bool:
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))


def exact_quantiles(values: DataFrame, probabilities: list[float], keep: int = KEEP,
                    accuracy: int = ACCURACY) -> list[float | None]:
    """Quantiles of the numeric column ``v`` (see ``stored_column``), between
    two values by linear interpolation, as ``percentile`` gives them."""
    n = values.count()
    if not n:
        return [None] * len(probabilities)
    at = [p * (n - 1) for p in probabilities]
    ranks = sorted({r for a in at for r in (math.floor(a), math.ceil(a))})
    value = dict(zip(ranks, order_statistics(values, ranks, keep, accuracy)))
    out = []
    for a in at:
        lo, hi = (_number(value[r]) for r in (math.floor(a), math.ceil(a)))
        out.append(lo if lo == hi else (math.ceil(a) - a) * lo + (a - math.floor(a)) * hi)
    return out


def _number(x) -> float:
    return float(x) if isinstance(x, (int, float, Decimal)) else x
