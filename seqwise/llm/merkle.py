"""A Merkle manifest of a table: per-group trees under one root, and row proofs.

Every row is a leaf; the leaves of a group, in order of id, form a tree in which
every ``FANOUT`` consecutive nodes become their parent (the last run may be
shorter, even one node); a lone node is the group's root. The group roots, in
order of their group (null first, bytewise), form one more tree of that kind.

Leaves are numbered without a global window: a range sort, counts a partition
and running offsets. ``FANOUT ** height`` consecutive leaves are a block, an
aligned subtree that one task hashes. The levels above are a butterfly: in round
r the blocks whose numbers differ in digit r only (base ``FANOUT``) swap the
roots of their level-r ancestors, and each hashes the common parent itself. So a
block gathers the siblings of its whole path on the way up and nothing is sent
down again. The last ancestor of a level may hold too few blocks to face every
partner: its blocks then send their root to several partner groups. A round
moves fewer than two rows a block; groups hold at most ``FANOUT`` rows.

Texts are hashed where they are scanned and never shuffled; a leaf takes some
80 bytes in two exchanges. Rows that are equal in id and leaf share an order by
row number, which no result can tell apart. Null columns hash as ``-``; null ids
come first; an empty table gives an empty manifest. Only the named columns are
read, so other columns may have any name. Lost tasks are recomputed: the sorted
leaves and the blocks are written tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from seqwise.llm.common import ascii_lower, broadcast_up_to, write_once

FANOUT = 8
HEIGHT = 4  # levels hashed inside a block: FANOUT ** HEIGHT leaves
GROUPS_BROADCAST = 100_000  # a row a group: key, root and a few hundred bytes of siblings


def h(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(column: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    s = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(*columns: Column) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in columns]), 256)


def _levels(leaves: list[str], height: int | None) -> list[list[str]]:
    """The levels from the leaves to one node; ``height`` levels above them, or
    as many as it takes."""
    out = [leaves]
    while len(out[-1]) > 1 if height is None else len(out) <= height:
        out.append([h(out[-1][i:i + FANOUT]) for i in range(0, len(out[-1]), FANOUT)])
    return out


def _path(levels: list[list[str]], at: int) -> list[tuple[int, list[str]]]:
    """Of leaf ``at``, level by level: its place in its run, and its siblings."""
    out = []
    for level in levels[:-1]:
        first = at - at % FANOUT
        run = level[first:first + FANOUT]
        out.append((at - first, run[:at - first] + run[at - first + 1:]))
        at //= FANOUT
    return out


def fold(node: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for at, others in path:
        node = h(others[:at] + [node] + others[at:])
    return node


def numbered(leaves: DataFrame) -> DataFrame:
    """``leaves`` (g, id, leaf, other) with ``idx``, the place in its group by
    (id, leaf), from 0."""
    rows = leaves.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["g", "id", "leaf", "tie"]
    rows = write_once(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
                      .withColumn("pid", F.spark_partition_id()), "merkle-leaves")
    before = Window.partitionBy("g").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy("g", "pid").agg(F.count(F.lit(1)).alias("n"))
              .select("g", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    place = F.row_number().over(Window.partitionBy("g", "pid").orderBy("id", "leaf", "tie"))
    return (rows.withColumn("place", place).join(starts, ["g", "pid"])
            .select("g", "id", "leaf", "other", (F.col("start") + F.col("place") - 1).alias("idx")))


def blocks(leaves: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(g, b, nb, leaves): blocks of at most ``FANOUT ** height`` numbered
    leaves; ``nb`` is the number of blocks of the group."""
    size = FANOUT ** height
    packed = (numbered(leaves).groupBy("g", F.expr(f"idx div {size}").alias("b"))
              .agg(F.array_sort(F.collect_list(F.struct("idx", "id", "leaf", "other"))).alias("leaves")))
    packed = write_once(packed, "merkle-blocks")
    count = packed.groupBy("g").agg((F.max("b") + 1).alias("nb"))
    return packed.join(broadcast_up_to(count, GROUPS_BROADCAST), "g")


_UP = "array<struct<at:int,others:array<string>>>"


def climb(packed: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(g, b, node, up): for every block the root of its group and the path from
    the block's own root to it, by the butterfly."""
    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [_levels([x["leaf"].hex() for x in leaves.as_py()], None if nb.as_py() == 1 else height)[-1][0]
                     for nb, leaves in zip(batch["nb"], batch["leaves"])]
            yield pa.RecordBatch.from_arrays([batch["g"], batch["b"], batch["nb"], pa.array(nodes, pa.string())],
                                             names=["g", "b", "nb", "node"])
    nodes = packed.select("g", "b", "nb", "leaves").mapInArrow(roots, "g string, b long, nb long, node string")
    nodes = write_once(nodes.withColumn("up", F.array().cast(_UP)), "merkle-nodes")
    most = nodes.agg(F.max("nb")).first()[0] or 0
    span = 1  # blocks below a node of this level
    while span < most:
        nodes, span = _swap(nodes, span), span * FANOUT
    return nodes.select("g", "b", "node", "up")


def _swap(nodes: DataFrame, span: int) -> DataFrame:
    """One round: nodes of ``span`` blocks become their parent's."""
    done = nodes.where(F.col("nb") <= span)
    x = (nodes.where(F.col("nb") > span)
         .withColumn("node_no", F.expr(f"b div {span}")).withColumn("low", F.expr(f"b % {span}"))
         .withColumn("last_no", F.expr(f"(nb - 1) div {span}"))
         .withColumn("digit", F.expr(f"cast(node_no % {FANOUT} as int)")))
    # Blocks of a short last node stand in for the partners that it lacks.
    short = F.expr(f"sequence(low, {span - 1}L, nb - last_no * {span})")
    sent = x.withColumn("to", F.explode(F.when((F.col("node_no") == F.col("last_no")) & (F.col("digit") > 0), short)
                                        .otherwise(F.array("low"))))
    own = F.col("to") == F.col("low")
    member = F.struct("digit", "node", own.alias("own"), "b", F.when(own, F.col("up")).alias("up"))
    met = (sent.groupBy("g", "nb", F.expr(f"node_no div {FANOUT}").alias("parent"), "to")
           .agg(F.array_sort(F.collect_list(member)).alias("run"))
           .withColumn("parent_node", F.sha2(F.expr("concat_ws('', run.node)"), 256)))
    mine = met.select("g", "nb", "parent_node", "run", F.explode("run").alias("me")).where("me.own")
    others = F.expr("transform(filter(run, x -> x.digit <> me.digit), x -> x.node)")
    return (mine.select("g", F.col("me.b").alias("b"), "nb", F.col("parent_node").alias("node"),
                        F.concat("me.up", F.array(F.struct(F.col("me.digit").alias("at"), others.alias("others"))))
                        .cast(_UP).alias("up"))
            .unionByName(done))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):  # one block of leaves as Python objects at a time
        yield batch.slice(i, 1).to_pylist()[0]


def _paths(row: dict, height: int) -> Iterator[tuple[dict, list[tuple[int, list[str]]]]]:
    """Every leaf of a block row with its path to the root of its group."""
    levels = _levels([x["leaf"].hex() for x in row["leaves"]], None if row["nb"] == 1 else height)
    above = [(u["at"], u["others"]) for u in row["up"]]
    for at, leaf in enumerate(row["leaves"]):
        yield leaf, _path(levels, at) + above


def manifest(rows: DataFrame, group: str, row_id: str, columns: list[str], changed: dict[str, Column] | None = None,
             where_changed: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """A leaf of ``columns`` for every row: ``group``, ``row_id``, leaf, subroot,
    root, proof (the siblings, level by level), folded_root and verified.

    With ``changed``, proofs are tried on a tampered table: in rows where
    ``where_changed`` holds those columns have other values, the leaf that is
    folded is theirs, and ``verified`` tells whether the root is still reached."""
    quoted = {c: F.col(f"`{c}`") for c in columns}
    leaf = F.unhex(leaf_hash(*quoted.values()))
    other = F.unhex(leaf_hash(*[(changed or {}).get(c, quoted[c]) for c in columns]))
    hit = F.coalesce(where_changed, F.lit(False)) if where_changed is not None else F.lit(False)
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    leaves = rows.select(key.alias("g"), F.col(f"`{row_id}`").alias("id"), leaf.alias("leaf"),
                         F.when(hit, other).alias("other"))
    packed = blocks(leaves, height)
    climbed = write_once(climb(packed, height), "merkle-climbed")
    tops = _top(climbed.where("b = 0").select("g", "node"), height)
    id_type = leaves.schema["id"].dataType.simpleString()
    full = (packed.join(climbed, ["g", "b"]).join(broadcast_up_to(tops, GROUPS_BROADCAST), "g")
            .select("g", "nb", "leaves", "up", "node", "top", "root"))
    arrow_id = pa.int64() if id_type in ("bigint", "int", "smallint", "tinyint") else pa.string()

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", "id", "leaf", "subroot", "root", "proof", "folded_root"]
        types = [pa.string(), arrow_id, pa.string(), pa.string(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for row in _rows(batch):
                top, out = [(u["at"], u["others"]) for u in row["top"]], []
                for x, path in _paths(row, height):
                    path = path + top
                    out.append((row["g"], x["id"], x["leaf"].hex(), row["node"], row["root"],
                                "".join(s for _, others in path for s in others),
                                fold((x["other"] or x["leaf"]).hex(), path)))
                    if len(out) == 512:  # proofs are long
                        yield _batch(out, names, types)
                        out = []
                if out:
                    yield _batch(out, names, types)
    proved = full.mapInArrow(prove, f"g string, id {'bigint' if arrow_id == pa.int64() else 'string'}, leaf string, "
                                    "subroot string, root string, proof string, folded_root string")
    return proved.select(F.expr("case when g <> '' then substr(g, 2) end").alias(group), F.col("id").alias(row_id),
                         "leaf", "subroot", "root", "proof", "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _top(subroots: DataFrame, height: int) -> DataFrame:
    """(g, top, root): the path of every group root to the root of all."""
    leaves = subroots.select(F.lit("").alias("g"), F.col("g").alias("id"), F.unhex("node").alias("leaf"),
                             F.lit(None).cast("binary").alias("other"))
    packed = blocks(leaves, height)
    full = packed.join(climb(packed, height), ["g", "b"]).select("nb", "leaves", "up", "node")
    kind = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))]))

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                out = [(x["id"], [{"at": a, "others": o} for a, o in path], row["node"])
                       for x, path in _paths(row, height)]
                yield _batch(out, ["g", "top", "root"], [pa.string(), kind, pa.string()])
    return write_once(full.mapInArrow(paths, f"g string, top {_UP}, root string"), "merkle-top")


def tampered_documents(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The manifest of ``documents`` per lang, tried on a copy whose texts are
    lower-cased (A-Z) where 3 divides the crc32 of the decimal doc_id (null ids
    are left alone)."""
    return manifest(docs, "lang", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"],
                    {"text": ascii_lower(F.col("text"))}, F.crc32(F.col("doc_id").cast("string")) % 3 == 0, height)
