"""Repeated word windows of a corpus, by level-wise doubling, and their removal.

A window of ``width`` words whose word sequence also starts anywhere else (in
another text or in its own) is repeated; every word that such a window covers
goes. Exact; all texts are read whole, no window is sampled away.

The levels are ``start`` words (a quarter of the width, rounded up), twice that,
and so on, the last one being ``width`` itself. Only what repeats at one level
is extended to the next, and a level without survivors ends the search:

1. Every window has an anchor: of its grams of ``start`` words the one with the
   least hash, the leftmost of equals. Equal windows have equal anchors at equal
   places, so a window can only repeat if its anchor gram does. About one
   position in ``width * 3 / 8`` is an anchor, and only anchors are shuffled.
   The windows with one anchor are neighbours; the text that they cover is the
   anchor's span. An anchor gram that occurs once drops its windows. One that
   occurs in a single distinct span settles them: they all repeat. What is left
   are grams with several distinct spans (edges of passages, edited copies);
   from here on one text of each distinct span stands for all of them.
2. Blocks of twice the length around those anchors, to their right and left. A
   window stays if the blocks within it are repeated.
3. At ``width``, the windows that stayed are counted themselves.

Spans and windows are told apart by two 64-bit hashes, of the gram and of the
whole; words by one. Counting is by partial aggregates. Rows of a key that holds
a large share of all rows do not meet in one task: results come back to them
through a broadcast of the heaviest keys (``HEAVY_KEYS`` at most, by their
counts) and a shuffled join for the rest. A text's own anchors are the largest
group that is ever collected. Texts are shuffled once; those with undecided
windows, once more.

Nulls, empty texts and texts under ``width`` words have no window and stay as
they are; a very long text costs a few times its own size in one task; repeated
rows repeat each other's windows, and rows equal in id and text share one set
of marks. An empty table gives an empty table. Columns of ``docs`` are carried
in a struct under names of their own, so they may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwise.llm.common import small_batches, write_once
from seqwise.llm.words import Tables, mix64, text_words

HEAVY_ROWS = 2_000    # a key with fewer rows is never heavy
HEAVY_KEYS = 20_000   # keys that can each hold more than 1/HEAVY_KEYS of all rows: the broadcast's bound

_SPAN = 0x94D049BB133111EB
_INFO = "k1 long, k2 long, pos array<long>, g array<long>, s array<long>"
_FOUND = "array<struct<pos:long,g:long,s:long,places:int,blocks:array<struct<x:int,h:long>>,windows:array<long>>>"


class Sums:
    """Prefix sums of a batch of words; the hash of any run of words is two of
    them. ``power`` of the word tables is extended to the batch's length."""

    def __init__(self, words: np.ndarray) -> None:
        n, t = len(words), Tables.get()
        self.inverse = t.inverse if n < len(t.inverse) else _long_powers(int(t.inverse[1]), n + 1)
        power = t.power if n <= len(t.power) else _long_powers(int(t.power[1]), n)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(words * power[:n], out=self.sums[1:])

    def run(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix64((self.sums[hi] - self.sums[lo]) * self.inverse[lo])


def _long_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def levels(width: int, start: int) -> list[int]:
    out = [start]
    while out[-1] * 2 < width:
        out.append(out[-1] * 2)
    return out


def anchors(words: np.ndarray, first: np.ndarray, width: int, start: int):
    """Of texts laid end to end (text t: words first[t] to first[t + 1]): per
    anchor its text, place, the first and last window that it is the anchor of,
    and the hashes of its gram and of its span."""
    n = len(words)
    none = np.empty(0, dtype=np.int64)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    starts = np.flatnonzero(left >= width)
    if not len(starts):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64), None
    sums = Sums(words)
    i = np.arange(n - start + 1)
    grams = sums.run(i, i + start)
    least, at, have, need = grams, i, 1, width - start + 1
    while have < need:  # the least of ``have`` grams from each place on
        step = min(have, need - have)
        a, b = least[:len(least) - step], least[step:]
        later = b < a
        least, at = np.where(later, b, a), np.where(later, at[step:], at[:len(at) - step])
        have += step
    at = at[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    lo, place = starts[new], at[new]
    hi = starts[np.append(np.flatnonzero(new)[1:], len(starts)) - 1]
    text = np.searchsorted(first, lo, side="right") - 1
    span = mix64(sums.run(lo, hi + width) ^ ((hi - lo).astype(np.uint64) * np.uint64(_SPAN) + np.uint64(1)))
    return text, place, lo, hi, grams[place], span, sums


def _packed(lo: np.ndarray, hi: np.ndarray, place: np.ndarray, base: np.ndarray) -> np.ndarray:
    """First window, number of windows and the anchor's distance in one long."""
    return ((lo - base) << 32) | ((hi - lo + 1) << 16) | (place - lo)


def _lists(values: np.ndarray, text: np.ndarray, texts: int) -> pa.ListArray:
    ends = np.searchsorted(text, np.arange(texts + 1))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.view(np.int64)))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> list:
    """128 bits that tell rows apart by id and text."""
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return [F.xxhash64(F.lit(salt), i.isNull(), i, t).alias(name) for salt, name in ((1, "k1"), (2, "k2"))]


def heavy_join(big: DataFrame, small: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """Inner join on ``keys`` with a written table that has one row a key and
    the number ``rows`` of rows in ``big``: heavy keys by a broadcast whose size
    that sum bounds, the others by a shuffle."""
    total = small.agg(F.sum(rows)).first()[0] or 0
    limit = max(HEAVY_ROWS, total // HEAVY_KEYS)
    heavy = small.where(F.col(rows) > limit)
    if not heavy.limit(1).count():
        return big.join(small, keys)
    hit = heavy.withColumn("heavy", F.lit(True))
    marked = big.join(F.broadcast(hit), keys, "left")
    columns = big.columns + [c for c in small.columns if c not in keys]
    light = marked.where("heavy is null").select(*big.columns).join(small.where(F.col(rows) <= limit), keys)
    return marked.where("heavy").select(*columns).unionByName(light.select(*columns))


def _repeated(rows: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Keys whose weights sum to two or more, with the number of their rows."""
    return (rows.groupBy(*keys).agg(F.sum(weight).alias("copies"), F.count(F.lit(1)).alias("rows"))
            .where("copies > 1").select(*keys, "rows"))


class Repeats:
    """The search: ``info`` has one row for every distinct (id, text) with a
    repeated anchor: its settled anchors, its undecided ones and its copies."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, start: int | None) -> None:
        self.width = width
        self.start = start or -(-width // 4)
        if not 1 <= self.start <= width:
            raise ValueError("start must lie between one word and the width")
        self.id_col, self.text_col, self.docs = id_col, text_col, small_batches(docs)

    def first_level(self) -> DataFrame:
        width, start = self.width, self.start

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words, first = text_words(batch["text"], lower=False)
                text, place, lo, hi, gram, span, _ = anchors(words, first, width, start)
                n = batch.num_rows
                columns = [batch["k1"], batch["k2"], _lists(_packed(lo, hi, place, first[text]), text, n),
                           _lists(gram, text, n), _lists(span, text, n)]
                out = pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "pos", "g", "s"])
                has = np.zeros(n, dtype=bool)
                has[text] = True
                yield out.filter(pa.array(has))
        slim = self.docs.select(*_keyed(self.docs, self.id_col, self.text_col),
                                F.col(f"`{self.text_col}`").alias("text"))
        found = slim.mapInArrow(scan, _INFO).withColumn("row", F.monotonically_increasing_id())
        found = write_once(found, "repeat-anchors")
        each = found.select("row", F.explode(F.arrays_zip("pos", "g", "s")).alias("a")).select("row", "a.*")
        grams = (each.groupBy("g").agg(F.count(F.lit(1)).alias("rows"), F.min("s").alias("s0"), F.max("s").alias("s1"))
                 .where("rows > 1").select("g", "rows", (F.col("s0") == F.col("s1")).alias("settled")))
        grams = write_once(grams, "repeat-grams")
        kept = heavy_join(each, grams, ["g"], "rows")
        # s of a settled anchor is not needed again
        marks = F.collect_list(F.struct("pos", "settled", F.when(~F.col("settled"), F.col("g")).alias("g"),
                                        F.when(~F.col("settled"), F.col("s")).alias("s")))
        info = (kept.groupBy("row").agg(marks.alias("marks")).join(found.select("row", "k1", "k2"), "row")
                .groupBy("k1", "k2").agg(F.first("marks").alias("marks"), F.count(F.lit(1)).alias("copies")))
        return write_once(info.select(
            "k1", "k2", "copies", F.expr("transform(filter(marks, m -> m.settled), m -> m.pos)").alias("settled"),
            F.expr("transform(filter(marks, m -> not m.settled), m -> struct(m.pos, m.g, m.s))").alias("open")),
            "repeat-info")

    def run(self, keep: list[str] | None, digest: bool) -> DataFrame:
        width, start, id_col, text_col = self.width, self.start, self.id_col, self.text_col
        docs = self.docs
        info = self.first_level()
        # One text stands for every distinct span that is undecided.
        spans = (info.select("k1", "k2", "copies", F.explode("open").alias("o"))
                 .groupBy("o.g", "o.s").agg(F.sum("copies").alias("c"), F.count(F.lit(1)).alias("rows"),
                                            F.min(F.struct("k1", "k2", "o.pos")).alias("at")))
        spans = write_once(spans.select("g", "s", "c", "rows", "at.*"), "repeat-spans")
        stand_in = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "g", "s")).alias("ask"))
        asked = info.select("k1", "k2", "settled", (F.size("open") > 0).alias("undecided")).join(
            stand_in, ["k1", "k2"], "left")
        carried = [c for c in docs.columns if c != text_col] if keep is None else keep
        carry = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)], F.lit(0).alias("z"))
        texts = docs.select(*_keyed(docs, id_col, text_col), carry.alias("d"),
                            F.col(f"`{text_col}`").alias("text"))
        joined = texts.join(asked, ["k1", "k2"], "left").select("k1", "k2", "d", "text", "settled", "undecided", "ask")

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _visit(batch, width, start, digest)
        d_type = texts.schema["d"].dataType.simpleString()
        visited = write_once(joined.mapInArrow(visit, f"k1 long, k2 long, d {d_type}, undecided boolean, "
                                               "n_words long, n_removed long, kept string, text string, "
                                               f"settled array<long>, found {_FOUND}"), "repeat-texts")
        marks = self.marks(spans, visited)
        each = info.select("k1", "k2", F.explode("open").alias("o")).select("k1", "k2", "o.*")
        marked = (heavy_join(each, marks, ["g", "s"], "rows").groupBy("k1", "k2")
                  .agg(F.collect_list(F.struct("pos", "places")).alias("more")))
        open_ = (visited.where("undecided").select("k1", "k2", "d", "text", "settled")
                 .join(marked, ["k1", "k2"], "left"))

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _finish(batch, width, digest)
        ended = open_.select("d", "text", "settled", "more").mapInArrow(
            finish, f"d {d_type}, n_words long, n_removed long, kept string")
        rows = visited.where("not undecided").select("d", "n_words", "n_removed", "kept").unionByName(ended)
        own = [F.col(f"d.c{i}").alias(c) for i, c in enumerate(carried)]
        out = "kept_sha256" if digest else text_col
        return rows.select(*[c for c, name in zip(own, carried) if name not in ("n_words", "n_removed", out)],
                           F.col("kept").alias(out), "n_words", "n_removed")

    def marks(self, spans: DataFrame, visited: DataFrame) -> DataFrame:
        """(g, s, rows, places): of every undecided span, the windows (by their
        place in it) that repeat."""
        width = self.width
        asked = (visited.where("found is not null").select(F.explode("found").alias("f")).select("f.*")
                 .dropDuplicates(["g", "s"]).join(spans.select("g", "s", "c", "rows"), ["g", "s"]))
        asked = write_once(asked, "repeat-asked")
        open_ = asked.select("g", "s", "c", "rows", "windows", "blocks",
                             F.expr("transform(sequence(0, places - 1), "
                                    "j -> struct(j as j, cast(pos & 65535 as int) - j as o))").alias("left"))
        for length in levels(width, self.start)[1:]:
            each = (asked.select("g", "s", "c", F.explode("blocks").alias("b"))
                    .select("g", "s", "c", F.col("b.x").alias("x"), F.col("b.h").alias("h"))
                    .where(F.col("x") >= length * 2 ** 10).where(F.col("x") < (length + 1) * 2 ** 10))
            again = write_once(_repeated(each, ["g", "x", "h"], "c"), f"repeat-level-{length}")
            if not again.limit(1).count():
                good = each.select("g", "s").limit(0).withColumn("ok", F.array().cast("array<int>"))
            else:
                good = (heavy_join(each, again, ["g", "x", "h"], "rows").groupBy("g", "s")
                        .agg(F.collect_list((F.col("x") - length * 2 ** 10).cast("int")).alias("ok")))
            # Of window o (words before the anchor), every block within it has to repeat.
            fits = f"x <= l.o and {length} - x <= {width} - l.o"
            blocks = f"sequence(0, {length - self.start}, {self.start})"
            open_ = write_once(open_.join(good, ["g", "s"]).withColumn("left", F.expr(
                f"filter(left, l -> forall({blocks}, x -> not ({fits}) or array_contains(ok, x)))"))
                .where("size(left) > 0").drop("ok"), f"repeat-left-{length}")
            if not open_.limit(1).count():
                break
        each = open_.select("g", "s", "c", "rows", "windows", F.explode("left.j").alias("j")).select(
            "g", "s", "c", F.col("rows").alias("span_rows"), "j", F.expr("windows[j]").alias("h"))
        again = write_once(_repeated(each, ["g", "h"], "c"), "repeat-windows")
        return write_once(heavy_join(each, again, ["g", "h"], "rows").groupBy("g", "s")
                          .agg(F.max("span_rows").alias("rows"), F.collect_list("j").alias("places")), "repeat-marks")


def _cut(text: bytes, firsts: np.ndarray, width: int, digest: bool) -> tuple[int, int, str]:
    """Words, removed words, and what is kept of a text whose repeated windows
    start at ``firsts``."""
    words = text.split()  # ASCII white space is the separator class
    kept, n = words, len(words)
    if len(firsts):
        covered = np.zeros(n + 1, dtype=np.int64)
        np.add.at(covered, firsts, 1)
        np.add.at(covered, firsts + width, -1)
        kept = [words[i] for i in np.flatnonzero(np.cumsum(covered)[:n] == 0).tolist()]
    out = b" ".join(kept)
    return n, n - len(kept), hashlib.sha256(out).hexdigest() if digest else out.decode()


def _settled(pos: np.ndarray) -> np.ndarray:
    """All windows of packed anchors."""
    lo, many = pos >> 32, (pos >> 16) & 0xFFFF
    return np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def _array(scalar: pa.Scalar) -> np.ndarray:
    return scalar.values.to_numpy(zero_copy_only=False) if scalar.is_valid else np.empty(0, dtype=np.int64)


def _visit(batch: pa.RecordBatch, width: int, start: int, digest: bool) -> pa.RecordBatch:
    """Finishes texts without undecided windows; hashes the blocks and windows of
    the spans that a text stands for."""
    n_words, n_removed, kept, found = [], [], [], []
    undecided = [bool(x) for x in batch["undecided"].to_pylist()]
    for i, waits in enumerate(undecided):
        text = (batch["text"][i].as_py() or "").encode()
        found.append(_hashed(text, batch["ask"][i], width, start) if batch["ask"][i].is_valid else None)
        cut = (None, None, None) if waits else _cut(text, _settled(_array(batch["settled"][i])), width, digest)
        for column, value in zip((n_words, n_removed, kept), cut):
            column.append(value)
    text = pa.array([t if w else None for t, w in zip(batch["text"], undecided)], batch["text"].type)
    kind = pa.list_(pa.struct([
        ("pos", pa.int64()), ("g", pa.int64()), ("s", pa.int64()), ("places", pa.int32()),
        ("blocks", pa.list_(pa.struct([("x", pa.int32()), ("h", pa.int64())]))), ("windows", pa.list_(pa.int64()))]))
    return pa.RecordBatch.from_arrays(
        [batch["k1"], batch["k2"], batch["d"], pa.array(undecided), pa.array(n_words, pa.int64()),
         pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), text, batch["settled"], pa.array(found, kind)],
        names=["k1", "k2", "d", "undecided", "n_words", "n_removed", "kept", "text", "settled", "found"])


def _hashed(text: bytes, ask: pa.Scalar, width: int, start: int) -> list[dict]:
    words, _ = text_words(pa.array([text], pa.binary()), lower=False)
    sums, n = Sums(words), len(words)
    asked = ask.values
    pos = asked.field("pos").to_numpy(zero_copy_only=False)
    lo, many = pos >> 32, (pos >> 16) & 0xFFFF
    place = lo + (pos & 0xFFFF)
    firsts = _settled(pos)
    windows = np.split(sums.run(firsts, firsts + width).view(np.int64), np.cumsum(many)[:-1])
    blocks: list[list[dict]] = [[] for _ in pos]
    for length in levels(width, start)[1:]:
        for x in range(0, length - start + 1, start):
            a = place - x
            fits = (a >= lo) & (a + length <= lo + many - 1 + width)
            hashes = sums.run(np.clip(a, 0, n), np.clip(a + length, 0, n)).view(np.int64)
            for i in np.flatnonzero(fits).tolist():
                blocks[i].append({"x": (length << 10) + x, "h": int(hashes[i])})
    return [{"pos": int(p), "g": g, "s": s, "places": int(m), "blocks": b, "windows": w} for p, g, s, m, b, w in
            zip(pos, asked.field("g").to_pylist(), asked.field("s").to_pylist(), many, blocks, windows)]


def _finish(batch: pa.RecordBatch, width: int, digest: bool) -> pa.RecordBatch:
    rows = []
    for i in range(batch.num_rows):
        firsts = [_settled(_array(batch["settled"][i]))]
        if batch["more"][i].is_valid:
            more = batch["more"][i].values
            lo = more.field("pos").to_numpy(zero_copy_only=False) >> 32
            places = more.field("places")
            many = pc.list_value_length(places).to_numpy(zero_copy_only=False)
            firsts.append(np.repeat(lo, many) + places.flatten().to_numpy(zero_copy_only=False))
        rows.append(_cut((batch["text"][i].as_py() or "").encode(), np.concatenate(firsts), width, digest))
    n, removed, kept = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [batch["d"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
        names=["d", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, width: int = 50, start: int | None = None, id_col: str = "doc_id",
                   text_col: str = "text", keep: list[str] | None = None, digest: bool = False) -> DataFrame:
    """``docs`` with their texts less every word that a repeated window of
    ``width`` words covers (words joined by one space; null and empty texts
    become empty), and ``n_words`` and ``n_removed`` (these replace columns of
    the same name). ``keep`` names the columns to carry (all, if None); with
    ``digest`` the texts are left out for ``kept_sha256``, their hash."""
    return Repeats(docs, id_col, text_col, width, start).run(keep, digest)
