"""Words, shingles and 64-bit hashes, per whole text, in numpy.

A word is a maximal run of characters outside space and ``\\x09-\\x0D``. All of
those are single bytes in UTF-8 and never part of a longer character, so texts
are handled as their UTF-8 bytes. One text is processed at a time: memory is a
few times the longest text, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Spark regex of a word separator (the complement of the contract's word class).
SEPARATORS = "[\\x20\\x09-\\x0D]+"

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so powers are invertible mod 2**64
_NONE = np.empty(0, dtype=np.uint64)
_STEP = 1 << 20             # power tables cover this many bytes


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64) of a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    out = np.full(_STEP, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Tables:
    """Byte values and powers of the polynomial word hash (built once a worker)."""

    _made: Tables | None = None

    def __init__(self) -> None:
        self.value = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
        self.lower = self.value.copy()
        self.lower[65:91] = self.value[97:123]  # A-Z only
        self.is_space = np.zeros(256, dtype=bool)
        self.is_space[[32, 9, 10, 11, 12, 13]] = True
        self.power = _powers(_BASE)
        self.inverse = _powers(pow(_BASE, -1, 1 << 64))

    @classmethod
    def get(cls) -> Tables:
        if cls._made is None:
            cls._made = cls()
        return cls._made


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of one text (uint8 array)."""
    t = Tables.get()
    inside = np.empty(len(raw) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~t.is_space[raw]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: bytes, lower: bool = True) -> np.ndarray:
    """64-bit hash of every word in order; A-Z count as a-z if ``lower``."""
    raw = np.frombuffer(text, dtype=np.uint8)
    return span_hashes(raw, *word_spans(raw), lower)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of the bytes of every span; A-Z count as a-z if ``lower``."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    t = Tables.get()
    values = (t.lower if lower else t.value)[raw]
    # The power tables repeat every _STEP bytes; a word is hashed relative to
    # its own start, so only words crossing that border need a second way.
    at = np.arange(len(raw)) % _STEP if len(raw) > _STEP else slice(0, len(raw))
    sums = np.empty(len(raw) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(values * t.power[at], out=sums[1:])
    out = (sums[ends] - sums[starts]) * t.inverse[starts % _STEP]
    for i in np.flatnonzero(starts // _STEP != (ends - 1) // _STEP):
        v = values[starts[i]:ends[i]]
        h = 0
        for k in range(0, len(v), _STEP):  # blocks, each with powers from 0, scaled
            part = v[k:k + _STEP]
            h = (h + int((part * t.power[:len(part)]).sum()) * pow(_BASE, k, 1 << 64)) & _MASK
        out[i] = np.uint64(h)
    return mix64(out + (ends - starts).astype(np.uint64))


def text_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of an Arrow column of texts, end to end, and where each text's
    begin: those of text t are words[first[t]:first[t + 1]]. Nulls have none."""
    parts = [word_hashes(t.as_buffer().to_pybytes(), lower) if t.is_valid else _NONE for t in texts]
    first = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=first[1:])
    return np.concatenate([_NONE, *parts]), first


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k-word window in order; with fewer words the whole
    sequence is one shingle; empty without words."""
    if not len(words):
        return words
    width = min(k, len(words))
    n = len(words) - width + 1
    out = np.full(n, np.uint64(width), dtype=np.uint64)
    for i in range(width):
        out = mix64(out * np.uint64(_BASE) + words[i:i + n])
    return out


def shingle_set(text: str | bytes | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text (null and empty: empty)."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    return np.unique(shingles(word_hashes(text.encode() if isinstance(text, str) else text), k))
