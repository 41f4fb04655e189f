"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Spaces become the mark U+2581; a word is a run of marks and the characters
after it, and no piece crosses a word's start, so the best segmentation of a
text is that of its words. Long words (texts without spaces are one) are cut
first wherever no piece of the vocabulary spans two neighbouring characters: every
segmentation ends a piece there, so the parts' best segmentations are the
word's. A part that is still long (a run of one letter) has no partners of its
length and advances alone, over the pieces found in it. Words and parts that a worker has not met yet are segmented in batches: words of equal length advance together, one end position at a time;
the hashes of the substrings ending there probe the sorted hashes of the
pieces, and the best predecessor is a vectorised maximum stored as a
backpointer. Equal scores take the longer last piece. A character that no piece
covers is spelled in byte pieces, at less than the least score; so is the mark
itself where the text has it, which makes decoding exact.

The model file is a parameter: its pieces, scores and normaliser settings are
read. ``add_dummy_prefix`` puts a space before every text that is not empty
(decoding takes one off again), ``remove_extra_whitespaces`` strips spaces and
makes runs of them one; a model with any other normaliser rule, without
``escape_whitespaces`` or with white space as a suffix is refused. Scores are
summed as given; for a merge-ranked model (scores 0, -1, -2, ...) the result is
the path of the largest sum, which need not be the one merging would give.

Per worker: a cache of at most ``CACHE_WORDS`` words, emptied when full, and
batches of at most ``BATCH_CELLS`` table cells, so memory does not grow with the
input. Texts are encoded in place, without a shuffle.

Defined results: null texts give null ids and decode to null; empty texts give
no ids; ids outside the vocabulary and byte pieces that form no valid UTF-8
decode to U+FFFD; control pieces decode to nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwise.llm.common import small_batches
from seqwise.llm.words import mix64

MARK = "▁"
CACHE_WORDS = 300_000
LONG_WORD = 24      # characters from which a word is cut
ALONE = 512         # characters from which a word advances alone
BLOCK = 1 << 16     # of its characters, looked up together
BATCH_CELLS = 1 << 20
_BAD = "\ufffd".encode()
_WORD = re.compile(" *[^ ]+| +")
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces, scores and byte ids; sorted hashes of the pieces for probing."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], control: set[int],
                 prefix: bool = False, squeeze: bool = False) -> None:
        self.pieces, self.byte_ids, self.control = pieces, byte_ids, control
        self.prefix, self.squeeze = prefix, squeeze
        skip = set(byte_ids.values()) | control
        # A piece with a mark after another character would cross a word's start.
        usable = [i for i, p in enumerate(pieces) if i not in skip and p and MARK not in p.lstrip(MARK)]
        self.longest = max((len(pieces[i]) for i in usable), default=1)
        hashes = np.array([self._hash(np.array([ord(c) for c in pieces[i]], dtype=np.uint64)) for i in usable],
                          dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.ids = hashes[order], np.array(usable, dtype=np.int32)[order]
        if len(np.unique(self.hashes)) != len(self.hashes):
            raise ValueError("two pieces have the same text")
        self.scores = np.array([scores[i] for i in usable], dtype=np.float64)[order]
        if not len(self.hashes):
            raise ValueError("the model has no usable piece")
        self.bitmap = np.zeros(1 << 20, dtype=bool)
        self.bitmap[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        self.spelled = self.scores.min() - 10  # of a character in bytes
        self.spelling = [b"" if i in control else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        for b, i in byte_ids.items():
            self.spelling[i] = bytes([b])

    @staticmethod
    def _hash(codes: np.ndarray) -> np.uint64:
        h = np.zeros(1, dtype=np.uint64)
        for c in codes:
            h = mix64(h * _BASE + c + np.uint64(1))
        return h[0]

    def normalise(self, text: str | None) -> str:
        """The text as the model's normaliser hands it on."""
        text = text or ""
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return " " + text if self.prefix and text else text

    @classmethod
    def read(cls, model_file: str) -> Vocabulary:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        rule = proto.normalizer_spec
        if (rule.name not in ("", "identity") or rule.precompiled_charsmap or rule.normalization_rule_tsv
                or not rule.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix):
            raise ValueError(f"the model's normaliser ({rule.name or 'unnamed'}) is not handled")
        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = m.get_piece_size()
        return cls([m.id_to_piece(i) for i in range(n)], [m.get_score(i) for i in range(n)],
                   {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)},
                   {i for i in range(n) if m.is_control(i) or m.is_unknown(i) or m.is_unused(i)},
                   rule.add_dummy_prefix, rule.remove_extra_whitespaces)


def _codes(text: str) -> np.ndarray:
    """Code points, spaces as the mark."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    codes[codes == ord(MARK)] = 0x110000   # the mark in the text itself: no piece has it
    codes[codes == 0x20] = ord(MARK)
    return codes


def _find(hashes: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the hashes that are a piece's, and the pieces' places."""
    # most substrings are no piece: a bitmap of hash prefixes spares their search
    maybe = np.flatnonzero(vocab.bitmap[(hashes >> np.uint64(44)).astype(np.int64)])
    at = np.minimum(np.searchsorted(vocab.hashes, hashes[maybe]), len(vocab.hashes) - 1)
    hit = vocab.hashes[at] == hashes[maybe]
    return maybe[hit], at[hit]


def cut_word(word: str, vocab: Vocabulary) -> list[str]:
    """The word in parts, cut between characters that no piece spans: the
    substrings of each length are looked up together."""
    codes = _codes(word)
    n = len(codes)
    spans = np.zeros(n + 1, dtype=np.int32)   # +1 where a found piece begins, -1 at its last character
    hashes = mix64(codes + np.uint64(1))      # of one character
    for size in range(2, min(vocab.longest, n) + 1):
        hashes = mix64(hashes[:-1] * _BASE + codes[size - 1:] + np.uint64(1))
        begin, _ = _find(hashes, vocab)
        spans[begin] += 1                     # begins are distinct, and so are their ends
        spans[begin + size - 1] -= 1
    # after character i a cut is safe if no piece that began by i goes on
    safe = np.flatnonzero(np.cumsum(spans[:n - 1]) == 0) + 1
    ends = [0, *safe.tolist(), n]
    return [word[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def split_text(text: str, vocab: Vocabulary) -> list[str]:
    """The words of a normalised text, long ones in their parts."""
    words = _WORD.findall(text)
    if all(len(w) < LONG_WORD for w in words):
        return words
    return [p for w in words for p in (cut_word(w, vocab) if len(w) >= LONG_WORD else (w,))]


def viterbi(words: list[str], vocab: Vocabulary) -> list[np.ndarray]:
    """Best segmentation of words of one length, as ids."""
    n, size = len(words), len(words[0])
    codes = _codes("".join(words)).reshape(n, size)
    best = np.full((size + 1, n), -np.inf)
    best[0] = 0
    back = np.zeros((size + 1, n), dtype=np.int32)
    piece = np.full((size + 1, n), -1, dtype=np.int32)
    rows = np.arange(n)
    hashes = np.zeros((vocab.longest, n), dtype=np.uint64)  # row j: substring of j + 1 characters
    for end in range(1, size + 1):
        top = min(end, vocab.longest)
        hashes[1:top] = hashes[:top - 1].copy()
        hashes[0] = 0
        hashes[:top] = mix64(hashes[:top] * _BASE + codes[:, end - 1] + np.uint64(1))
        total = np.full((top, n), -np.inf)
        found = np.full((top, n), -1, dtype=np.int32)
        # most substrings are no piece: a bitmap of hash prefixes spares their search
        maybe = np.nonzero(vocab.bitmap[(hashes[:top] >> np.uint64(44)).astype(np.int64)])
        keys = hashes[maybe]
        at = np.minimum(np.searchsorted(vocab.hashes, keys), len(vocab.hashes) - 1)
        hit = vocab.hashes[at] == keys
        length, word = maybe[0][hit], maybe[1][hit]
        total[length, word] = best[end - 1 - length, word] + vocab.scores[at[hit]]
        found[length, word] = vocab.ids[at[hit]]
        pick = top - 1 - np.argmax(total[::-1], axis=0)  # the longest of equal ones
        score, spelled = total[pick, rows], best[end - 1] + vocab.spelled
        use = score < spelled
        best[end] = np.where(use, spelled, score)
        back[end] = np.where(use, 1, pick + 1)
        piece[end] = np.where(use, -1, found[pick, rows])
    # All words go back together, last piece first; -2 marks a spelled character.
    end, steps, spelt = np.full(n, size), [], []
    while end.any():
        going = end > 0
        steps.append(np.where(going, piece[end, rows], -3))
        spelt.append(end - 1)
        end = np.where(going, end - back[end, rows], 0)
    ids, chars = np.array(steps[::-1], dtype=np.int32).T, np.array(spelt[::-1]).T
    plain = ids[ids != -3]
    cuts = np.concatenate([[0], np.cumsum((ids != -3).sum(axis=1))]).tolist()
    out = [plain[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    for i in np.flatnonzero((ids == -1).any(axis=1)):
        flat = []
        for p, c in zip(ids[i].tolist(), chars[i].tolist(), strict=True):
            if p >= 0:
                flat.append(p)
            elif p == -1:
                flat.extend(vocab.byte_ids[x] for x in words[i][c].encode("utf-8", "surrogatepass"))
        out[i] = np.array(flat, dtype=np.int32)
    return out


def viterbi_alone(word: str, vocab: Vocabulary) -> np.ndarray:
    """Best segmentation of one very long word: the pieces in it are looked up
    block by block, all lengths together; then only those found are walked."""
    codes = _codes(word)
    n = len(codes)
    best = [-np.inf] * (n + 1)
    best[0] = 0.0
    back, piece = np.zeros(n + 1, dtype=np.int32), np.full(n + 1, -1, dtype=np.int32)
    for lo in range(0, n, BLOCK):
        part = codes[lo:lo + BLOCK + vocab.longest - 1]
        starts = min(BLOCK, n - lo)
        hashes, found = mix64(part + np.uint64(1)), []
        for size in range(1, min(vocab.longest, len(part)) + 1):
            if size > 1:
                hashes = mix64(hashes[:-1] * _BASE + part[size - 1:] + np.uint64(1))
            begin, at = _find(hashes[:starts], vocab)
            found.append((begin, np.full(len(begin), size), at))
        begin, size, at = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(begin, kind="stable")
        upto = np.searchsorted(begin[order], np.arange(1, starts + 1)).tolist()
        size, score, ids = size[order].tolist(), vocab.scores[at[order]].tolist(), vocab.ids[at[order]].tolist()
        j = 0
        for i in range(starts):        # of equal scores the first start, the longest piece, stays
            here = best[lo + i]
            while j < upto[i]:
                end = lo + i + size[j]
                if here + score[j] > best[end]:
                    best[end], back[end], piece[end] = here + score[j], size[j], ids[j]
                j += 1
            if here + vocab.spelled > best[lo + i + 1]:
                best[lo + i + 1], back[lo + i + 1], piece[lo + i + 1] = here + vocab.spelled, 1, -1
    out, end = [], n
    while end:
        if piece[end] >= 0:
            out.append(int(piece[end]))
        else:
            out.extend(vocab.byte_ids[x] for x in reversed(word[end - 1].encode("utf-8", "surrogatepass")))
        end -= int(back[end])
    return np.array(out[::-1], dtype=np.int32)


class Encoder:
    """Encodes texts with one vocabulary, through a bounded cache of words."""

    _latest: Encoder | None = None

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab, self.cache = vocab, {}

    @classmethod
    def of(cls, vocab: Vocabulary) -> Encoder:
        """The worker's encoder of a vocabulary: its cache outlives a task, and
        goes with the first task of another vocabulary."""
        if cls._latest is None or cls._latest.vocab is not vocab:
            cls._latest = cls(vocab)
        return cls._latest

    def learn(self, words: set[str]) -> None:
        """Segment words, equal lengths together."""
        by_size: dict[int, list[str]] = {}
        for w in words:
            by_size.setdefault(len(w), []).append(w)
        for size, group in by_size.items():
            if size >= ALONE:
                self.cache.update((w, viterbi_alone(w, self.vocab).tobytes()) for w in group)
                continue
            step = max(1, BATCH_CELLS // (size + 8 * self.vocab.longest))
            for i in range(0, len(group), step):
                part = group[i:i + step]
                self.cache.update((w, ids.tobytes()) for w, ids in zip(part, viterbi(part, self.vocab), strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of each text; what the texts need is segmented together, unless
        that alone is more than the cache holds."""
        split = [split_text(self.vocab.normalise(t), self.vocab) for t in texts]
        missing = {w for words in split for w in words if w not in self.cache}
        if len(missing) > CACHE_WORDS and len(texts) > 1:
            return [self.encode([t])[0] for t in texts]
        if len(self.cache) + len(missing) > CACHE_WORDS:
            self.cache.clear()
            missing = {w for words in split for w in words}
        self.learn(missing)
        get = self.cache.__getitem__
        return [None if t is None else np.frombuffer(b"".join(map(get, words)), dtype=np.int32)
                for t, words in zip(texts, split, strict=True)]


def decode_ids(ids, vocab: Vocabulary) -> str:
    """The text of a sequence of ids."""
    n = len(vocab.pieces)
    text = b"".join([vocab.spelling[i] if i is not None and 0 <= i < n else _BAD for i in ids])
    return text.removeprefix(b" " if vocab.prefix else b"").decode("utf-8", "replace")


def _model(spark, model_file: str):
    """The vocabulary, read once and broadcast: its size is the model's."""
    return spark.sparkContext.broadcast(Vocabulary.read(model_file))


_TEXTS = 256  # texts prepared together


def _encode_batches(shared, verify: bool):
    def run(batches):
        encoder = Encoder.of(shared.value)
        for b in batches:
            names = [n for n in b.schema.names if n != "_text"]
            for i in range(0, b.num_rows, _TEXTS):
                part = b.slice(i, _TEXTS)
                texts = part.column("_text").to_pylist()
                ids = encoder.encode(texts)
                sizes = [0 if x is None else len(x) for x in ids]
                flat = np.concatenate([x for x in ids if x is not None]) if any(sizes) else np.empty(0, np.int32)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                null = pa.array([x is None for x in ids], pa.bool_())
                lists = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()), mask=null)
                arrays = [*[part.column(n) for n in names], lists]
                if verify:
                    arrays.append(pa.array([None if t is None else decode_ids(x.tolist(), shared.value) == t
                                            for t, x in zip(texts, ids, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "_ids", "_same"][:len(arrays)])
    return run


def encode(docs: DataFrame, model_file: str, text_col: str = "text", ids_col: str = "ids",
           keep: list[str] | None = None, verify_col: str | None = None) -> DataFrame:
    """The columns ``keep`` (default: all but the text) plus the ids of the
    text; with ``verify_col`` also whether decoding gives the text back."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    slim = small_batches(docs).select(*[F.col(f"`{c}`").alias(f"_doc_{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    kept = "".join(f"{n} {t}, " for n, t in slim.dtypes if n != "_text")
    same = ", _same boolean" if verify_col else ""
    out = slim.mapInArrow(_encode_batches(_model(docs.sparkSession, model_file), bool(verify_col)),
                          f"{kept}_ids array<int>{same}")
    checked = [F.col("_same").alias(verify_col)] if verify_col else []
    return out.select(*[F.col(f"_doc_{i}").alias(c) for i, c in enumerate(keep)], F.col("_ids").alias(ids_col), *checked)


def _decode_batches(shared):
    def run(batches):
        for b in batches:
            names = [n for n in b.schema.names if n != "_ids"]
            texts = [None if x is None else decode_ids(x, shared.value) for x in b.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(texts, pa.string())],
                                             names=[*names, "_text"])
    return run


def decode(df: DataFrame, model_file: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``df`` with its ids replaced by the text they stand for."""
    keep = [c for c in df.columns if c != ids_col]
    slim = small_batches(df).select(*[F.col(f"`{c}`").alias(f"_doc_{i}") for i, c in enumerate(keep)],
                     F.col(ids_col).cast("array<int>").alias("_ids"))
    kept = "".join(f"{n} {t}, " for n, t in slim.dtypes if n != "_ids")
    out = slim.mapInArrow(_decode_batches(_model(df.sparkSession, model_file)), f"{kept}_text string")
    return out.select(*[F.col(f"_doc_{i}").alias(c) for i, c in enumerate(keep)], F.col("_text").alias(text_col))
