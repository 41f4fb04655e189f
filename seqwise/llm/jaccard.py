"""N-gram Jaccard join with a token-group matrix.

Texts are sets of word shingles; two link when
100 * |intersection| >= percent * |union|. Exact, in these steps:

1. Candidates. A set links with nothing if more than 1 - t of its shingles
   occur in no other set. One pass over whole texts gives every document its
   set's size, a key of the set (copies share it) and those of its shingles
   that fall into a fixed share of the hash range (``RANGE`` times 1 - t);
   minima and maxima of set keys per shingle tell the unique ones of these.
   Most texts of a corpus are settled by that count alone; the rest are the
   candidates, and only their shingles are computed again and kept.
2. Tokens. The hash range is cut into m parts and the content of each part is
   one token of a candidate. Linked sets of at most M shingles differ in at
   most d = (1-t)/(1+t) * 2M shingles, hence in at most d parts. m is larger
   than d, so they share a token; if a set has fewer than m - d empty parts it
   even shares one with content, and gives only those. m is fixed per size
   class (ratio 1/t); a set has tokens of its own class and of the next, which
   covers all sizes it can link with. Frequent lines or words hardly make
   texts share a token, as it holds several shingles from all over the text.
3. Families. Candidates get the least of their shared tokens, passed on twice
   along shared tokens so that sets with common tokens meet, and families are
   dealt into lanes of at most about ``LANE`` shingles.
4. Comparison. A task has a lane, its sets partitioned into groups of ``GROUP``
   similar sets (neighbours by least token), and the query sets that share a
   token with the lane. The token-group matrix says which group's union holds
   which shingle; one look-up bounds a query's overlap with every group. Only
   groups that can hold a link are opened, and compared exactly, and only if
   they hold a set that the query is not linked with yet. A task returns a
   spanning forest of its links, not all pairs.
5. First each lane meets itself and, per token, its sets query the token's
   least lane. Pairs that share a token but not a component after that are the
   unsettled ones: the set of the smaller component queries the lane of the
   other. All of them are compared, whatever their number: no cap on
   candidates, partners or queries.

Memory of a task: a lane and at most about ``QUERIES`` queries. Groups of
copies and near copies of any size are spread over lanes, and the queries grow
with what the first round leaves unlinked, not with a group's square.

Defined results: null, empty and wordless texts are empty sets, size 0, linked
with nothing; texts with fewer words than a shingle are one shingle; null ids
are documents of their own, never the smallest id (a component of null ids
alone has a null id); repeated rows are copies; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwise.llm.common import broadcast_up_to, materialize, own_names, small_batches, write_once
from seqwise.llm.components import components
from seqwise.llm.words import mix64, shingle_set

RANGE = 1.6               # times 1 - t: share of the shingles tested for being unique
GROUP = 64
LANE = 1 << 19            # shingles of a lane; a set counts as 128 at least
QUERIES = 2_048           # query sets that meet one lane in one task
BROADCAST_ROWS = 500_000  # narrow lookup tables up to this many rows are broadcast


def size_class(n: int, t: float) -> int:
    """Class c holds the sizes up to ``class_limit(c)``, above that of c - 1."""
    c = int(np.log(n) / -np.log(t))
    while n > class_limit(c, t):
        c += 1
    while c and n <= class_limit(c - 1, t):
        c -= 1
    return c


def class_limit(c: int, t: float) -> int:
    return int(t ** -(c + 1) + 1e-9)


def set_tokens(s: np.ndarray, percent: int) -> np.ndarray:
    """Tokens of a sorted set of hashes, for its size class and the next."""
    t = percent / 100
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(s ^ np.uint64(0x5851F42D4C957F2D)))])
    own, out = size_class(len(s), t), []
    for c in (own, own + 1):
        limit = max(class_limit(c, t), len(s))
        differ = 2 * limit * (100 - percent) // (100 + percent)
        parts = differ + 2 + differ // 10
        edges = (np.arange(1, parts, dtype=np.float64) * (2.0 ** 64 / parts)).astype(np.uint64)
        at = np.concatenate([[0], np.searchsorted(s, edges), [len(s)]])
        tokens = mix64(sums[at[1:]] - sums[at[:-1]] + mix64(np.arange(parts, dtype=np.uint64) + np.uint64(c << 32)))
        full = at[1:] > at[:-1]
        out.append(tokens[full] if (~full).sum() < parts - differ else tokens)
    return np.concatenate(out)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).view(np.int64), pa.int64()))


def _sets(shingle: int, percent: int):
    limit = np.uint64(int(min(RANGE * (100 - percent) / 100, 0.999) * 2.0 ** 64))
    none = np.empty(0, np.uint64)

    def run(batches):
        seen = set()  # copies within a task give their shingles once
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                n, k1, k2, some = [], [], [], []
                for text in part.column("_text"):
                    s = shingle_set(text.as_py(), shingle)
                    n.append(len(s))
                    k1.append(int(mix64(s).sum().view(np.int64)) if len(s) else None)
                    k2.append(int(mix64(s + np.uint64(77)).sum().view(np.int64)) if len(s) else None)
                    some.append(none if (k1[-1], k2[-1]) in seen else s[:np.searchsorted(s, limit)])
                    seen.add((k1[-1], k2[-1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("rk"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()),
                     pa.array(k2, pa.int64()), _lists(some)], names=["doc_id", "rk", "n", "k1", "k2", "some"])
    return run


def _shingled(shingle: int, percent: int):
    def run(batches):
        seen = set()  # repeated rows of a task are wanted once
        for b in batches:
            rk, sets, tokens = [], [], []
            for key, text in zip(b.column("rk").to_pylist(), b.column("_text"), strict=True):
                if key not in seen:
                    seen.add(key)
                    s = shingle_set(text.as_py(), shingle)
                    rk.append(key)
                    sets.append(s.tobytes())
                    tokens.append(set_tokens(s, percent))
                if len(rk) == 500:
                    yield pa.RecordBatch.from_arrays([pa.array(rk, pa.int64()), pa.array(sets, pa.binary()),
                                                      _lists(tokens)], names=["rk", "shingles", "tokens"])
                    rk, sets, tokens = [], [], []
            if rk:
                yield pa.RecordBatch.from_arrays([pa.array(rk, pa.int64()), pa.array(sets, pa.binary()),
                                                  _lists(tokens)], names=["rk", "shingles", "tokens"])
    return run


class Lane:
    """Sets in groups of ``GROUP``, with their token-group matrix."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(x) for x in sets])
        flat = np.concatenate(sets)
        self.tokens, self.places = np.unique(flat, return_inverse=True)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.groups = -(-len(sets) // GROUP)
        # the matrix by rows: for each token the groups whose union has it
        of = np.repeat(np.arange(len(sets)) // GROUP, self.sizes)
        cells = np.unique(self.places.astype(np.int64) * self.groups + of)
        self.row = np.searchsorted(cells, np.arange(len(self.tokens) + 1) * self.groups)
        self.group = cells % self.groups

    def overlaps(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the query's shingles, and how many each group's union has."""
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        inside = at[self.tokens[at] == query]
        lengths = self.row[inside + 1] - self.row[inside]
        ends = np.cumsum(lengths)
        every = np.repeat(self.row[inside] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
        return inside, np.bincount(self.group[every], minlength=self.groups)

    def links(self, query: np.ndarray, percent: int, wanted):
        """Members that link with the query, group by group; a group is opened
        if its union overlaps enough of the query and ``wanted`` says so."""
        inside, overlap = self.overlaps(query)
        mark = None
        for g in np.flatnonzero(100 * overlap >= percent * len(query)):
            lo, hi = g * GROUP, min((g + 1) * GROUP, len(self.sizes))
            if not wanted(lo, hi):
                continue
            if mark is None:
                mark = np.zeros(len(self.tokens), dtype=np.int64)
                mark[inside] = 1
            first = self.starts[lo]
            common = np.add.reduceat(mark[self.places[first:self.starts[hi]]], self.starts[lo:hi] - first)
            yield lo + np.flatnonzero(100 * common >= percent * (self.sizes[lo:hi] + len(query) - common))


class Trees:
    """Union-find over 0..n-1 that keeps the links joining two trees."""

    def __init__(self, n: int) -> None:
        self.root, self.kept = list(range(n)), []

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.root[max(x, y)] = min(x, y)
            self.kept.append((a, b))


def _compare(percent: int, own: bool):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def read(t: pa.Table):  # columns: lane, part, first, rk, shingles
        found = {k: (f, s) for f, k, s in zip(*[t.column(i).to_pylist() for i in (2, 3, 4)], strict=True)}
        keys = sorted(found, key=lambda k: (found[k][0], k))
        return keys, [np.frombuffer(found[k][1], dtype=np.uint64) for k in keys]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return schema.empty_table()
        (lk, ls), (rk, rs) = read(left), read(right)
        lane = Lane(rs)
        place = {k: i for i, k in enumerate(dict.fromkeys(rk + lk))}
        trees = Trees(len(place))

        def meet(me: int, s: np.ndarray, after: int):
            def wanted(lo: int, hi: int) -> bool:
                mine = trees.find(me)
                return hi > after and any(trees.find(j) != mine for j in range(max(lo, after), hi))
            for found in lane.links(s, percent, wanted):
                for j in found:
                    trees.join(me, int(j))
        if own and right.column(1)[0].as_py() == 0:  # the lane's own sets, each pair once
            for i, s in enumerate(rs):
                meet(i, s, i + 1)
        for k, s in zip(lk, ls, strict=True):
            meet(place[k], s, 0)
        keys = list(place)
        return pa.table({"a": pa.array([keys[a] for a, _ in trees.kept], pa.int64()),
                         "b": pa.array([keys[b] for _, b in trees.kept], pa.int64())})
    return run


def _linked(queries: DataFrame, members: DataFrame, percent: int, own: bool) -> DataFrame:
    """Spanning links (a, b) of query sets (rk) with the members of lanes (g);
    with ``own`` also of each lane's members among themselves."""
    parts = materialize(queries.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERIES)).alias("_parts")))
    parts = broadcast_up_to(parts, BROADCAST_ROWS)
    q = materialize(queries.join(parts, "g").select(
        F.col("g").alias("q_g"), F.pmod(F.xxhash64("rk"), F.col("_parts")).alias("q_part"), F.col("rk").alias("q_rk")))
    left = members.join(broadcast_up_to(q, BROADCAST_ROWS), F.col("q_rk") == F.col("rk")).select(
        "q_g", "q_part", F.col("first").alias("q_first"), "q_rk", F.col("shingles").alias("q_shingles"))
    last = F.coalesce(F.col("_parts"), F.lit(1)) - 1
    right = members.join(parts, "g", "left" if own else "inner").select(
        "g", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"), "first", "rk", "shingles")
    return left.groupBy("q_g", "q_part").cogroup(right.groupBy("g", "part")).applyInArrow(
        _compare(percent, own), "a long, b long")


def _families(posts: DataFrame, hops: int = 2) -> DataFrame:
    """(rk, first, family): a set's least token, and the least that reaches it
    over shared tokens in ``hops`` steps."""
    least = materialize(posts.groupBy("rk").agg(F.min("token").alias("first")))
    label = least.withColumn("family", F.col("first"))
    for _ in range(hops):
        passed = posts.join(label, "rk").groupBy("token").agg(F.min("family").alias("family"))
        label = materialize(posts.join(passed, "token").groupBy("rk").agg(F.min("family").alias("family")))
    return least.join(label.select("rk", "family"), "rk")


def _lanes(shingles: str):
    return F.ceil(F.col(shingles) / F.lit(LANE))


def linked_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 5,
                     percent: int = 80) -> DataFrame:
    """Per document: doc_id, rk (hash of id and text), n (size of its set),
    component (a key; null for empty sets) and component_id (least id of it)."""
    kind = dict(docs.dtypes)[id_col]
    slim = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("rk"),
                       F.col(text_col).alias("_text"))
    sets = write_once(slim.mapInArrow(
        _sets(shingle, percent), f"doc_id {kind}, rk long, n long, k1 long, k2 long, some array<long>"), "sets")

    # One row per set, by a document that has it; those with few unique shingles
    # are the candidates.
    posts = sets.select("k1", F.explode("some").alias("x"))
    unique = (posts.groupBy("x").agg(F.min("k1").alias("k1"), F.max("k1").alias("_hi")).where("k1 = _hi")
              .groupBy("k1").agg(F.count(F.lit(1)).alias("_unique")))
    every = sets.where("k1 is not null").groupBy("k1", "k2").agg(F.min("rk").alias("rk"), F.first("n").alias("n"))
    nodes = materialize(every.join(unique, "k1", "left")
                        .where(100 * F.coalesce("_unique", F.lit(0)) <= (100 - percent) * F.col("n")).select("rk", "n"))

    wanted = broadcast_up_to(nodes.select("rk"), BROADCAST_ROWS)
    texts = slim.select("rk", "_text").join(wanted, "rk", "left_semi")
    shingled = write_once(texts.mapInArrow(
        _shingled(shingle, percent), "rk long, shingles binary, tokens array<long>"), "candidates")
    posts = shingled.select("rk", F.explode("tokens").alias("token"))
    shared = (posts.groupBy("token").agg(F.min("rk").alias("_lo"), F.max("rk").alias("_hi")).where("_lo < _hi")
              .select("token"))
    posts = materialize(posts.join(shared, "token").distinct())

    # Lanes. Sets with equal first tokens stay together unless they are too many.
    nodes = materialize(_families(posts).join(nodes.withColumn("_n", F.greatest("n", F.lit(128))), "rk"))
    by_family = nodes.groupBy("family").agg(F.sum("_n").alias("_nf"))
    by_first = nodes.groupBy("family", "first").agg(F.sum("_n").alias("_n1"))
    lane = F.xxhash64("family", F.pmod(F.xxhash64("first"), _lanes("_nf")), F.pmod(F.xxhash64("rk"), _lanes("_n1")))
    nodes = materialize(nodes.join(by_family, "family").join(by_first, ["family", "first"])
                        .select("rk", "first", lane.alias("g")))
    where = broadcast_up_to(nodes.select("rk", "first", "g"), BROADCAST_ROWS)
    members = write_once(shingled.select("rk", "shingles").join(where, "rk"), "members")

    matrix = materialize(posts.join(nodes, "rk").select("token", "g", "rk"))
    heads = matrix.groupBy("token").agg(F.min("g").alias("_head"), F.max("g").alias("_last")).where("_head < _last")
    first = materialize(matrix.join(heads, "token").where("g <> _head")
                        .select("rk", F.col("_head").alias("g")).distinct())
    links = materialize(_linked(first, members, percent, own=True))

    known = materialize(components(links, "a", "b"))
    sizes = known.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    weight = F.struct(F.coalesce("_n", F.lit(1)).alias("n"), F.coalesce("component", "rk").alias("c"))
    placed = nodes.select("rk").join(known, F.col("rk") == F.col("node"), "left").join(
        sizes, "component", "left").select("rk", weight.alias("of"))
    placed = materialize(matrix.join(placed, "rk"))
    tokens = placed.groupBy("token").agg(F.min("of").alias("_lo"), F.max("of").alias("_hi")).where("_lo < _hi")
    open_ = placed.join(tokens, "token").where("of < _hi").select("token", F.col("g").alias("_own"), "rk", "of")
    cells = placed.groupBy("token", F.col("g").alias("g")).agg(F.max("of").alias("_top"))
    rest = (open_.join(cells, "token").where((F.col("of") < F.col("_top")) & (F.col("g") != F.col("_own")))
            .select("rk", "g").distinct().join(first, ["rk", "g"], "left_anti"))
    more = _linked(materialize(rest), members, percent, own=False)
    known = components(links.unionByName(more), "a", "b")

    # set -> its component and the smallest id in it -> documents
    ids = (sets.where("k1 is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("_least"), F.min("rk").alias("rk"))
           .join(known, F.col("rk") == F.col("node"), "left"))
    ids = materialize(ids.select("k1", "k2", "_least", F.coalesce("component", "rk").alias("component")))
    joint = ids.groupBy("component").agg(F.min("_least").alias("component_id"))
    ids = ids.join(joint, "component").select("k1", "k2", "component", "component_id")
    return sets.select("doc_id", "rk", "n", "k1", "k2").join(ids, ["k1", "k2"], "left").select(
        "doc_id", "rk", "n", "component",
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_copies(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the smallest id that
    links reach from it, itself included."""
    return linked_documents(docs, **options).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without all but one document of each component: the one with
    the smallest id (nulls last). Documents without words all stay; repeated
    rows are one document."""
    docs, at, back = own_names(docs)
    text_col, id_col = at[text_col], at[id_col]
    linked = write_once(linked_documents(docs, text_col, id_col, **options), "linked")
    best = linked.where("n > 0").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rk")).alias("_best"))
    kept = best.select(F.col("_best.rk").alias("_rk")).unionByName(
        linked.where("n = 0").select(F.col("rk").alias("_rk")).distinct())
    kept = broadcast_up_to(materialize(kept), BROADCAST_ROWS)
    keyed = docs.withColumn("_row_key", F.xxhash64(id_col, text_col))
    one = keyed.join(kept, F.col("_row_key") == F.col("_rk"), "left_semi")
    # only rows that repeat, id and text, need to be compared with each other
    twice = materialize(linked.groupBy("rk").count().where("count > 1").select(F.col("rk").alias("_rk")))
    if twice.isEmpty():
        return back(one)
    twice = broadcast_up_to(twice, BROADCAST_ROWS)
    single = one.join(twice, F.col("_row_key") == F.col("_rk"), "left_anti")
    repeated = one.join(twice, F.col("_row_key") == F.col("_rk"), "left_semi").dropDuplicates(["_row_key"])
    return back(single.unionByName(repeated))
