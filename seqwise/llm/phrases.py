"""Collocations: phrases of a few words that occur oftener than their parts do.

Texts are lower-cased (A-Z) and split into pieces at ``.,;:!?`` and line ends,
pieces into words at blanks and tabs. Phrases are counted per language, within
pieces, overlaps included, and exactly.

Counting goes level by level, from words to phrases of ``max_words``, over
shards of some megabytes of text (pieces are never cut):

* A phrase of m + 1 words is a pair (id of the frequent phrase of its first m
  words, id of its last word), and is counted only where the phrases of its
  first m and of its last m words are both frequent.
* A shard packs each such pair into one integer, permutes it with an invertible
  Feistel network and keeps its distinct values in counting quotient filters:
  the top bits choose the filter, the next ones are the quotient, kept as run
  lengths in unary, and the whole remainder follows with the count. As no bit is
  dropped, the filter is lossless: pairs are read back by the inverse network.
* Filters of equal top bits meet in one task, which merges them as sorted runs
  and adds their counts. The permutation spreads pairs evenly, and their number
  sets the number of filters, so a merge has a bounded size; a pair that makes up
  a third of all words is one entry a shard.
* Each shard gets back the ids of its own frequent entries, replaces its phrases
  by them and forgets positions that no longer matter.

A task holds one shard or one merge. Nothing is broadcast unless Spark's own
size estimate allows it. All intermediate results are written tables.

Scores, drops and ranks are DataFrame work on the frequent phrases. Products are
decimals of 38 digits. Null and empty texts have no words; null languages count
as ``und``; repeated rows count as often as they occur; a very long text is cut
into shards at line ends and stops. Only the two named columns are read, so
others may have any name. An empty table has no phrases.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqwise.llm.common import broadcast_up_to, shared_folder
from seqwise.llm.words import mix64, span_hashes

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
COVERED_PERCENT = 100      # of a phrase's occurrences inside one longer phrase: dropped
SHARD_BYTES = 8 << 20
HELD_BYTES = 64 << 20      # of all languages in one task
FILTER_ENTRIES = 1 << 19   # entries, over all shards, that meet in one merge
LANGS = 100_000            # languages whose totals are broadcast

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _raw(ids: np.ndarray) -> bytes:
    """Numbers as compressed byte planes, behind their width and how many."""
    width = 4 if not len(ids) or ids.max() < 1 << 32 else 8
    planes = ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return struct.pack("<BQ", width, len(ids)) + pa.compress(planes, codec="zstd", asbytes=True)


def _ids(raw: bytes) -> np.ndarray:
    width, n = struct.unpack_from("<BQ", raw)
    if not n:
        return np.empty(0, dtype=np.uint64)
    planes = pa.decompress(raw[9:], decompressed_size=n * width, codec="zstd", asbytes=True)
    rows = np.frombuffer(planes, np.uint8).reshape(width, n).T.copy()
    return rows.view(f"<u{width}").reshape(n).astype(np.uint64)


# --- shards -----------------------------------------------------------------

def shard_of(text: bytes) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Word numbers in order (from 1; 0 between pieces), the distinct words and
    their counts."""
    kind = np.zeros(256, dtype=np.int8)
    kind[list(b" \t")], kind[list(_BREAKS)] = 1, 2
    raw = np.frombuffer(text, dtype=np.uint8)
    k = kind[raw]
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = k == 0
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), [], np.empty(0, dtype=np.int64)
    _, first, number, counts = np.unique(span_hashes(raw, starts, ends, lower=True), return_index=True,
                                         return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")  # small numbers for frequent words pack better
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    first, number, counts = first[order], rank[number], counts[order]
    piece = np.cumsum(k == 2)[starts]
    new = np.diff(piece, prepend=piece[0]) > 0
    out = np.zeros(len(starts) + int(new.sum()), dtype=np.uint64)
    out[np.arange(len(starts)) + np.cumsum(new)] = number + 1
    words = [text[starts[i]:ends[i]].lower() for i in first.tolist()]  # bytes.lower: A-Z only
    return out, words, counts


def _cut(text: bytes) -> Iterator[bytes]:
    """Parts of about ``SHARD_BYTES``, cut behind a piece only."""
    at = 0
    while len(text) - at > 2 * SHARD_BYTES:
        ends = [i for i in (text.find(b, at + SHARD_BYTES) for b in _BREAKS) if i >= 0]
        if not ends:
            break
        end = min(ends) + 1
        yield text[at:end]
        at = end
    yield text[at:]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[bytes]] = defaultdict(list)
    size: dict[str, int] = defaultdict(int)

    def flush(lang: str) -> Iterator[pa.RecordBatch]:
        for part in _cut(b"\n".join(held.pop(lang))):
            ids, words, counts = shard_of(part)
            if len(ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([int(counts.sum())], pa.int64()), pa.array([len(words)], pa.int64()),
                     *[pa.array([x], pa.binary()) for x in (_raw(ids), b"\n".join(words), _raw(counts))]],
                    names=["lang", "n", "distinct", "ids", "words", "counts"])
        size.pop(lang)
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            if text.is_valid:
                lang = lang.as_py()
                raw = text.as_buffer().to_pybytes()
                held[lang].append(raw)
                size[lang] += len(raw)
                if size[lang] >= SHARD_BYTES:
                    yield from flush(lang)
        if sum(size.values()) >= HELD_BYTES:
            for lang in list(held):
                yield from flush(lang)
    for lang in list(held):
        yield from flush(lang)


# --- packed pairs and their filters ------------------------------------------

def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def pack(prefix: np.ndarray, word: np.ndarray, word_bits: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """prefix * 2**word_bits + word, as its high and low ``half`` bits."""
    if word_bits <= half:
        low = ((prefix & _mask(half - word_bits)) << np.uint64(word_bits)) | word
        return prefix >> np.uint64(half - word_bits), low
    return (prefix << np.uint64(word_bits - half)) | (word >> np.uint64(half)), word & _mask(half)


def unpack(high: np.ndarray, low: np.ndarray, word_bits: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    if word_bits <= half:
        return (high << np.uint64(half - word_bits)) | (low >> np.uint64(word_bits)), low & _mask(word_bits)
    return high >> np.uint64(word_bits - half), ((high & _mask(word_bits - half)) << np.uint64(half)) | low


def permute(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    for c in _ROUNDS:
        high = high ^ (mix64(low + np.uint64(c)) & _mask(half))
        low = low ^ (mix64(high + np.uint64(c >> 1)) & _mask(half))
    return high, low


def restore(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    for c in reversed(_ROUNDS):
        low = low ^ (mix64(high + np.uint64(c >> 1)) & _mask(half))
        high = high ^ (mix64(low + np.uint64(c)) & _mask(half))
    return high, low


def distinct(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, ...]:
    """Sorted distinct values, and of every value given its place among them."""
    if 2 * half <= 64:
        value, place = np.unique((high << np.uint64(half)) | low, return_inverse=True)
        return value >> np.uint64(half), value & _mask(half), place
    order = np.lexsort((low, high))
    h, l = high[order], low[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (l[1:] != l[:-1])
    place = np.empty(len(h), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return h[new], l[new], place


def _bytes_of(values: np.ndarray, bits: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :-(-bits // 8)].tobytes()


def _values_of(raw: bytes, at: int, n: int, bits: int) -> tuple[np.ndarray, int]:
    width = -(-bits // 8)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(n, width)
    return out.view("<u8").reshape(n).astype(np.uint64), at + n * width


def write_filter(high: np.ndarray, low: np.ndarray, counts: np.ndarray, half: int, top: int) -> bytes:
    """A counting quotient filter of sorted distinct values that share the
    ``top`` first bits: run length of every quotient in unary, whole remainders,
    counts (a byte each, larger ones behind)."""
    n = len(high)
    q = min(max(n.bit_length() - 1, 0), half - top)
    rest = half - top - q
    runs = np.bincount(((high >> np.uint64(rest)) & _mask(q)).astype(np.int64), minlength=1 << q)
    unary = np.ones(n + len(runs), dtype=np.uint8)
    unary[np.cumsum(runs) + np.arange(len(runs))] = 0
    large = counts >= 255
    return b"".join([struct.pack("<QB", n, q), np.packbits(unary).tobytes(), _bytes_of(high & _mask(rest), rest),
                     _bytes_of(low, half), np.where(large, 255, counts).astype(np.uint8).tobytes(),
                     counts[large].astype("<u8").tobytes()])


def read_filter(raw: bytes, half: int, top: int, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, q = struct.unpack_from("<QB", raw)
    rest, at = half - top - q, 9
    bits = n + (1 << q)
    unary = np.unpackbits(np.frombuffer(raw, np.uint8, -(-bits // 8), at), count=bits)
    at += -(-bits // 8)
    quotient = (np.cumsum(unary == 0) - (unary == 0))[unary == 1].astype(np.uint64)
    high, at = _values_of(raw, at, n, rest)
    high = (np.uint64(bucket) << np.uint64(half - top)) | (quotient << np.uint64(rest)) | high
    low, at = _values_of(raw, at, n, half)
    counts = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, "<u8", -1, at + n).astype(np.int64)
    return high, low, counts


# --- levels -------------------------------------------------------------------

def _candidates(words: np.ndarray, grams: np.ndarray, m: int) -> np.ndarray:
    """Places whose phrases of m words and that of the next place are frequent."""
    return np.flatnonzero((grams[:-1] > 0) & (grams[1:] > 0)) if len(grams) > m else np.empty(0, dtype=np.int64)


_STATE = "shard long, lang string, words binary, grams binary, n long"


def _state(shard, lang, words: np.ndarray, grams: np.ndarray, m: int) -> tuple:
    """What a shard keeps for the next level: the words of candidates and a break
    between their stretches."""
    at = _candidates(words, grams, m)
    cover = np.zeros(len(words) + 2, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + m + 1, -1)
    inside = np.cumsum(cover)[:-1] > 0
    kept = inside.copy()
    kept[1:] |= inside[:-1]
    kept = np.flatnonzero(kept)
    # A gram is kept where a candidate starts or continues into.
    w = np.append(words, 0).astype(np.uint64)
    g = np.zeros(len(w), dtype=np.uint64)
    g[at], g[at + 1] = grams[at], grams[at + 1]
    w[~inside], g[~inside] = 0, 0
    # One word is its own gram.
    return shard, lang, _raw(w[kept]), _raw(g[kept]) if m > 1 else None, len(at)


def _read_state(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    words = _ids(batch["words"][i].as_py())
    return words, _ids(batch["grams"][i].as_py()) if batch["grams"][i].is_valid else words


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      names=["shard", "lang", "words", "grams", "n"])


def _word_order(words: bytes, top: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Words of a shard, their order by hash, where in it each filter begins and
    the filters' numbers (the first ``top`` bits of the hash)."""
    raw = np.frombuffer(words + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(raw == 10)
    hashes = span_hashes(raw, np.append(0, ends[:-1] + 1), ends, lower=False)
    order = np.argsort(hashes)
    bucket = (hashes[order] >> np.uint64(64 - top)).astype(np.int64) if top else np.zeros(len(order), dtype=np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    return words.split(b"\n"), order, edges, bucket[edges]


class Words:
    """The first level: as ``Level``, but what is counted are the words."""

    def __init__(self, entries: int, min_count: int) -> None:
        self.min_count = min_count
        self.top = max(0, (-(-entries // FILTER_ENTRIES) - 1).bit_length())

    def filters(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                counts = _ids(batch["counts"][i].as_py())
                words, order, edges, buckets = _word_order(batch["words"][i].as_py(), self.top)
                parts = np.split(order, edges[1:])
                lang, shard = batch["lang"][i].as_py(), batch["shard"][i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(parts)), pa.array(buckets), pa.array([shard] * len(parts), pa.int64()),
                     pa.array([b"\n".join([words[j] for j in p.tolist()]) for p in parts], pa.binary()),
                     pa.array([_raw(counts[p]) for p in parts], pa.binary())],
                    names=["lang", "bucket", "shard", "words", "counts"])

    MERGED = "lang string, word string, id long, f long, shard long, bucket long, ids binary"

    def merge(self, table: pa.Table) -> pa.Table:
        lang, bucket = table["lang"][0].as_py(), table["bucket"][0].as_py()
        read = [raw.as_py().split(b"\n") for raw in table["words"]]
        every = pa.array([w for words in read for w in words], pa.string()).dictionary_encode()
        place, distinct_words = every.indices.to_numpy(), every.dictionary
        total = np.zeros(len(distinct_words), dtype=np.int64)
        np.add.at(total, place, np.concatenate([_ids(raw.as_py()) for raw in table["counts"]]).astype(np.int64))
        frequent = np.flatnonzero(total >= self.min_count)
        ids = np.zeros(len(total), dtype=np.uint64)
        ids[frequent] = 1 + (np.arange(len(frequent)) << self.top) + bucket
        answers = np.split(ids[place], np.cumsum([len(x) for x in read])[:-1])
        return _merged(lang, bucket, {"word": distinct_words.take(pa.array(frequent)),
                                      "id": pa.array(ids[frequent], pa.uint64()).cast(pa.int64()),
                                      "f": pa.array(total[frequent], pa.int64())},
                       table["shard"].to_pylist(), answers)

    def number(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first state: word numbers of the shard become ids, or 0."""
        for batch in batches:
            for i in range(batch.num_rows):
                words, order, edges, buckets = _word_order(batch["words"][i].as_py(), self.top)
                answers = {x["bucket"]: x["ids"] for x in batch["answers"][i].as_py()}
                to = np.zeros(len(words) + 1, dtype=np.uint64)
                for b, part in zip(buckets.tolist(), np.split(order, edges[1:])):
                    if b in answers:
                        to[part + 1] = _ids(answers[b])
                ids = to[_ids(batch["ids"][i].as_py()).astype(np.int64)]
                yield _rows([_state(batch["shard"][i].as_py(), batch["lang"][i].as_py(), ids, ids, 1)])


def _merged(lang: str, bucket: int, found: dict[str, pa.Array], shards: list[int], answers: list) -> pa.Table:
    """Rows of what is frequent, then for every shard that has some the new ids
    of its entries, 0 for the others."""
    told = [(s, _raw(a)) for s, a in zip(shards, answers) if a.any()]
    n, k = len(found["id"]), len(told)
    columns = {"lang": pa.array([lang] * (n + k), pa.string())}
    for name, values in found.items():
        columns[name] = pa.concat_arrays([values, pa.nulls(k, values.type)])
    columns["shard"] = pa.array([None] * n + [s for s, _ in told], pa.int64())
    columns["bucket"] = pa.array([bucket] * (n + k), pa.int64())
    columns["ids"] = pa.array([None] * n + [a for _, a in told], pa.binary())
    return pa.table(columns)


class Level:
    """Counts phrases of m + 1 words. ``word_bits`` and ``half`` lay out a packed
    pair, the first ``top`` bits of its permuted value are its filter's number."""

    def __init__(self, m: int, entries: int, gram_max: int, word_max: int, min_count: int) -> None:
        self.m, self.min_count = m, min_count
        self.word_bits = int(word_max).bit_length()
        self.top = max(0, (-(-entries // FILTER_ENTRIES) - 1).bit_length())
        # Halves may be wider than needed, never narrower than the filters' numbers.
        self.half = max(16, -(-(self.word_bits + int(gram_max).bit_length()) // 2), self.top + 1)

    def keys(self, words: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, ...]:
        at = _candidates(words, grams, self.m)
        high, low = permute(*pack(grams[at], words[at + self.m], self.word_bits, self.half), self.half)
        return at, *distinct(high, low, self.half)

    def parts(self, high: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Filter numbers and their stretches of sorted values."""
        bucket = (high >> np.uint64(self.half - self.top)).astype(np.int64)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(bucket)]):
            yield int(bucket[lo]), slice(lo, hi)

    def filters(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, high, low, place = self.keys(*_read_state(batch, i))
                counts = np.bincount(place, minlength=len(high))
                out = [(batch["lang"][i].as_py(), b, batch["shard"][i].as_py(),
                        write_filter(high[s], low[s], counts[s], self.half, self.top)) for b, s in self.parts(high)]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.binary()))],
                        names=["lang", "bucket", "shard", "filter"])

    MERGED = "lang string, prefix long, word long, id long, f long, shard long, bucket long, ids binary"

    def merge(self, table: pa.Table) -> pa.Table:
        """The frequent pairs of all filters of one number (rows with f), and of
        every shard the new ids of its entries (rows with ids)."""
        lang, bucket = table["lang"][0].as_py(), table["bucket"][0].as_py()
        read = [read_filter(raw.as_py(), self.half, self.top, bucket) for raw in table["filter"]]
        high, low, counts = (np.concatenate(x) for x in zip(*read))
        high, low, place = distinct(high, low, self.half)
        total = np.zeros(len(high), dtype=np.int64)
        np.add.at(total, place, counts)
        frequent = np.flatnonzero(total >= self.min_count)
        ids = np.zeros(len(high), dtype=np.uint64)
        ids[frequent] = 1 + (np.arange(len(frequent)) << self.top) + bucket
        prefix, word = unpack(*restore(high[frequent], low[frequent], self.half), self.word_bits, self.half)
        answers = np.split(ids[place], np.cumsum([len(x[0]) for x in read])[:-1])
        found = {k: pa.array(v.astype(np.int64)) for k, v in
                 (("prefix", prefix), ("word", word), ("id", ids[frequent]), ("f", total[frequent]))}
        return _merged(lang, bucket, found, table["shard"].to_pylist(), answers)

    def number(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The next state: phrases of m + 1 words by the ids that came back."""
        for batch in batches:
            for i in range(batch.num_rows):
                words, grams = _read_state(batch, i)
                at, high, _, place = self.keys(words, grams)
                answers = {x["bucket"]: x["ids"] for x in batch["answers"][i].as_py()}
                ids = np.zeros(len(high), dtype=np.uint64)
                for b, s in self.parts(high):
                    if b in answers:
                        ids[s] = _ids(answers[b])
                new = np.zeros(len(grams), dtype=np.uint64)
                new[at] = ids[place]
                yield _rows([_state(batch["shard"][i].as_py(), batch["lang"][i].as_py(), words, new, self.m + 1)])


def _answers(merged: DataFrame) -> DataFrame:
    """What each shard gets back; without frequent entries, a shard ends here."""
    return (merged.where("ids is not null").groupBy("shard")
            .agg(F.collect_list(F.struct("bucket", "ids")).alias("answers")))


def _merger(level: Level | Words):
    def merge(table: pa.Table) -> pa.Table:  # Spark counts the arguments, self among them
        return level.merge(table)
    return merge


def _write(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, f"phrases-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(docs: DataFrame, min_count: int, max_words: int, text_col: str, lang_col: str):
    """(phrases, totals): (lang, words, f) of every phrase of 1 to ``max_words``
    words with f >= ``min_count``, and (lang, n) with all word occurrences."""
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                        F.col(f"`{text_col}`").alias("text"))
    shards = texts.mapInArrow(_shards, "lang string, n long, distinct long, ids binary, words binary, counts binary")
    shards = _write(shards.withColumn("shard", F.monotonically_increasing_id()), "shards")
    totals = _write(shards.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    first = Words(shards.agg(F.sum("distinct")).first()[0] or 0, min_count)
    filters = shards.select("shard", "lang", "words", "counts").mapInArrow(
        first.filters, "lang string, bucket long, shard long, words binary, counts binary")
    merged = _write(filters.groupBy("lang", "bucket").applyInArrow(_merger(first), Words.MERGED), "merged-1")
    words = _write(merged.where("f is not null").select("lang", "word", "id", "f"), "words")
    state = _write(shards.select("shard", "lang", "ids", "words").join(_answers(merged), "shard")
                   .mapInArrow(first.number, _STATE), "state-1")
    lookup = words.select("lang", F.col("id").alias("word"), F.col("word").alias("last"))
    level = words.select("lang", "id", F.array("word").alias("words"), "f")
    phrases = level.select("lang", "words", "f")
    word_max = words.agg(F.max("id")).first()[0] or 0
    gram_max = word_max
    for m in range(1, max_words):
        entries = state.agg(F.sum("n")).first()[0] or 0
        if not entries:
            break
        count = Level(m, entries, gram_max, word_max, min_count)
        filters = state.select("shard", "lang", "words", "grams").mapInArrow(
            count.filters, "lang string, bucket long, shard long, filter binary")
        merged = _write(filters.groupBy("lang", "bucket").applyInArrow(_merger(count), Level.MERGED), f"merged-{m + 1}")
        level = (merged.where("f is not null").select("lang", "prefix", "word", "id", "f")
                 .join(level.select("lang", F.col("id").alias("prefix"), "words"), ["lang", "prefix"])
                 .join(lookup, ["lang", "word"])
                 .select("lang", "id", F.concat("words", F.array("last")).alias("words"), "f"))
        level = _write(level, f"level-{m + 1}")
        phrases = phrases.unionByName(level.select("lang", "words", "f"))
        gram_max = level.agg(F.max("id")).first()[0] or 0
        if m + 1 == max_words or not gram_max:
            break
        state = _write(state.join(_answers(merged), "shard").select("shard", "lang", "words", "grams", "answers")
                       .mapInArrow(count.number, _STATE), f"state-{m + 1}")
    return phrases, totals


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top``
    phrases of 2 to ``max_words`` words with a = f(phrase) >= ``min_count``: score
    is the least floor(1000 a n / (l r)) over the cuts into two parts with
    frequencies l and r (ties: the shorter first part). Phrases that stand in a
    longer one nearly as often as alone (``COVERED_PERCENT``) are dropped."""
    phrases, totals = counted(docs, min_count, max_words, text_col, lang_col)
    every = phrases.select("lang", "words", F.array_join("words", " ").alias("phrase"), "f")
    long_ = every.where(F.size("words") > 1)
    cuts = (long_.select("lang", "phrase", F.col("f").alias("a"), "words",
                         F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
            .withColumn("left", F.expr("array_join(slice(words, 1, k), ' ')"))
            .withColumn("right", F.expr("array_join(slice(words, k + 1, size(words) - k), ' ')")).drop("words"))
    parts = every.select("lang", "phrase", "f")
    cuts = (cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
            .join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
            .join(broadcast_up_to(totals, LANGS), "lang"))
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div "
                   "(cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = (cuts.withColumn("score", score).groupBy("lang", "phrase")
            .agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("x")).select("lang", "phrase", "x.*"))
    # A longer phrase occurs no oftener than those between: one word more suffices.
    inside = (long_.where(F.size("words") > 2)
              .select("lang", "f", F.explode(F.expr("array(slice(words, 1, size(words) - 1), "
                                                    "slice(words, 2, size(words) - 1))")).alias("part"))
              .groupBy("lang", F.array_join("part", " ").alias("phrase")).agg(F.max("f").alias("longer")))
    left = (best.join(inside, ["lang", "phrase"], "left")
            .where(F.expr(f"longer is null or 100 * longer < {COVERED_PERCENT} * a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
