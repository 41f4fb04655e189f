"""Exact top-k inner products by columnar branch-and-bound.

Vectors become integers, floor(1024 * x). Queries and candidates are dealt to
the cells of a grid: a cell holds at most about ``CELL_QUERIES`` queries and
``CELL_VECTORS`` candidates of one dimension count, so its memory is bounded
and the stated query set meets all rows in blocks. Within a cell candidates lie
in vertical layout, one row per dimension. A query adds up its products
dimension block by dimension block, largest query mass first; after each block
the Cauchy-Schwarz bound of what remains tells which candidates can still reach
the query's current k-th score, and only those are kept (compacted). Each cell
returns its k best per query, and a window over those picks the final ones.

Scores are exact: sums stay integers below 2**53 in float64, otherwise the cell
uses Python integers. Bounds are widened by more than their rounding error.

Defined results: vectors that are null or hold null or non-finite components
take no part; empty vectors score 0 among themselves; vectors of different
length never meet; null ids are candidates (last in ties) but no queries; of
repeated rows each is a candidate and, if its id says so, a query of its own;
components beyond a long stop at its range and a score beyond a long fails
loudly; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqwise.llm.common import write_once

SCALE = 1024
QUERY_EVERY = 100
CELL_VECTORS, CELL_QUERIES = 16_384, 2_048
FIRST = 512       # candidates that set the first bound of a query
DIM_BLOCK = 16

_OUT = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()),
                  ("row", pa.int64()), ("score", pa.int64())])


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(row, vec_id, v): usable vectors as arrays of longs."""
    v = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * SCALE))
    usable = F.col(vec_col).isNotNull() & ~F.exists(
        vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    clean = df.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col))
    return clean.select(F.monotonically_increasing_id().alias("row"), "vec_id", v.alias("v"))


def _exact(total: float) -> bool:
    return total < 2.0 ** 52


def best_of_cell(q: np.ndarray, c: np.ndarray, q_row: np.ndarray, c_row: np.ndarray, c_rank: np.ndarray, k: int):
    """Yields, per query, (its index, candidate indices, scores) of the k best
    (score high to low, then ``c_rank``). ``c`` is vertical: dims x candidates."""
    d, n = c.shape
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(d, 1)
    if not _exact(largest):
        q, c = q.astype(object), c.astype(object)
        for i in range(len(q)):
            scores = np.array([sum(int(a) * int(b) for a, b in zip(q[i], c[:, j], strict=True)) for j in range(n)],
                              dtype=object)
            free = np.flatnonzero(c_row != q_row[i])
            order = sorted(free, key=lambda j: (-scores[j], c_rank[j]))[:k]
            yield i, np.array(order, dtype=int), [int(scores[j]) for j in order]
        return
    # Dimensions by the mass of the candidates, largest first, in blocks; the
    # norm of what lies beyond each block bounds what it can still add.
    q, c = q.astype(np.float64), c.astype(np.float64)
    order = np.argsort(-(c * c).sum(axis=1), kind="stable")
    c, q = np.ascontiguousarray(c[order]), np.ascontiguousarray(q[:, order])
    cuts = list(range(0, d, DIM_BLOCK)) + [d]
    c_rest = [np.sqrt((c[b:] ** 2).sum(axis=0)) for b in cuts]
    q_rest = [np.sqrt((q[:, b:] ** 2).sum(axis=1)) for b in cuts]
    first = min(n, max(FIRST, 2 * k))
    for i in range(len(q)):
        scores = q[i] @ c[:, :first]
        scores[c_row[:first] == q_row[i]] = -np.inf
        alive = np.arange(first, n)
        if len(alive):
            bound = np.partition(scores, first - k)[first - k] if first > k else -np.inf
            part = np.zeros(len(alive))
            for s, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                part += q[i, lo:hi] @ (c[lo:hi, first:] if len(alive) == n - first else c[lo:hi, alive])
                reach = part + q_rest[s + 1][i] * c_rest[s + 1][alive] * (1 + 1e-9) + 1e-3
                keep = reach >= bound
                if not keep.all():
                    alive, part = alive[keep], part[keep]
                if not len(alive):
                    break
            part[c_row[alive] == q_row[i]] = -np.inf
            scores = np.concatenate([scores, part])
        where = np.concatenate([np.arange(first), alive])
        if len(scores) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            near = scores >= least  # ties at the border go by rank
            scores, where = scores[near], where[near]
        best = np.lexsort((c_rank[where], -scores))[:k]
        best = best[scores[best] > -np.inf]
        yield i, where[best], scores[best].astype(np.int64)


def _cell(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _OUT.empty_table()
        q_row, c_row = left["row"].to_numpy(), right["row"].to_numpy()
        q_id = left["vec_id"].to_numpy()
        ids = right["vec_id"].combine_chunks()
        # rank by id, nulls last, then by row: the order of ties
        c_rank = np.empty(len(ids), dtype=np.int64)
        c_rank[np.lexsort((c_row, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))] = \
            np.arange(len(ids))
        q = _matrix(left["v"])
        c = np.ascontiguousarray(_matrix(right["v"]).T)
        out = [[], [], [], []]
        for i, where, scores in best_of_cell(q, c, q_row, c_row, c_rank, k):
            out[0].append(np.full(len(where), q_row[i]))
            out[1].append(np.full(len(where), q_id[i]))
            out[2].append(where)
            out[3].extend(scores)
        where = np.concatenate(out[2]).astype(np.int64)
        return pa.Table.from_arrays(
            [pa.array(np.concatenate(out[0]), pa.int64()), pa.array(np.concatenate(out[1]), pa.int64()),
             ids.take(pa.array(where)), pa.array(c_row[where], pa.int64()), pa.array(out[3], pa.int64())],
            schema=_OUT)
    return run


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy()
    return values.reshape(len(flat), len(values) // max(len(flat), 1))


def top_k(df: DataFrame, k: int = 10, query_every: int = QUERY_EVERY, id_col: str = "vec_id",
          vec_col: str = "embedding", cell_vectors: int = CELL_VECTORS,
          cell_queries: int = CELL_QUERIES) -> DataFrame:
    """Each query's k best candidates: query_id, rank, vec_id, score."""
    vectors = write_once(integer_vectors(df, id_col, vec_col), "vectors")
    is_query = F.col("vec_id") % query_every == 0
    n, m = vectors.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    columns, lanes = max(1, -(-n // cell_vectors)), max(1, -(-m // cell_queries))
    dims = F.size("v").alias("_d")

    def spread(cells):
        return F.pmod(F.xxhash64("row"), F.lit(cells)).cast("int")
    candidates = vectors.select("row", "vec_id", "v", dims, spread(columns).alias("_c"),
                                F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("_q"))
    queries = vectors.where(is_query).select("row", "vec_id", "v", dims, spread(lanes).alias("_q"),
                                             F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("_c"))
    cell = ["_d", "_c", "_q"]
    best = queries.groupBy(*cell).cogroup(candidates.groupBy(*cell)).applyInArrow(
        _cell(k), "query_row long, query_id long, vec_id long, row long, score long")
    by = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return (best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
