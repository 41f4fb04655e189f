"""Substrings, the Merkle manifest and phrases against plain Python, on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm.helpers import awkward, frame, words_of

from seqwise.llm import merkle, phrases, substrings

CLASH = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, k1 int, d int, n_words int, g int, id int"


def clashing(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], CLASH)


def plain_repeats(rows, width):
    texts = [words_of(r[1]) for r in rows]
    seen = Counter(tuple(w[i:i + width]) for w in texts for i in range(len(w) - width + 1))
    out = Counter()
    for r, w in zip(rows, texts):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i:i + width])] > 1:
                gone[i:i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[(r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


def patchwork(width, letters):
    """Texts over few words that share passages, edited copies and periods."""
    r = random.Random(width * letters)
    base = [f"w{r.randrange(letters)}" for _ in range(260)]
    rows = [(None, None), (1, ""), (2, " \n "), (3, "a " * 90), (4, "A b " * 80)]
    for i in range(40):
        text = [f"w{r.randrange(letters)}" for _ in range(r.randrange(100))]
        if i % 2:
            a = r.randrange(180)
            text[len(text) // 2:len(text) // 2] = base[a:a + r.randrange(3 * width)]
        if i % 7 == 0:
            text = list(base)
            text[r.randrange(260)] = "q"
        rows.append((i % 30, "\t".join(text)))
    return rows + rows[-5:]


@pytest.mark.parametrize("width,start,letters", [(35, None, 3), (7, 2, 3), (40, 4, 60)])
def test_repeats_equal_brute_force(spark, monkeypatch, width, start, letters):
    monkeypatch.setattr(substrings, "HEAVY_ROWS", 20)  # both ways of the join
    monkeypatch.setattr(substrings, "HEAVY_KEYS", 100)
    rows = patchwork(width, letters)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substrings.remove_repeats(df, width=width, start=start, digest=True).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_repeats(rows, width)


def test_repeats_carry_clashing_columns_and_texts(spark):
    rows = [(i, t, "en", None, 3) for i, t in patchwork(12, 3)[:25]]
    got = substrings.remove_repeats(clashing(spark, rows), width=12)
    assert set(got.columns) == set(clashing(spark, rows).columns) | {"n_removed"}
    got = got.collect()
    assert all((r["a.b"], r.k1, r.d, r.g, r.id) == (1, 2, 3, 5, 6) for r in got)
    want = plain_repeats([r[:2] for r in rows], 12)
    assert Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in got) == want
    assert substrings.remove_repeats(clashing(spark, [])).count() == 0


def test_long_batches_hash_like_short_ones():
    r = np.random.default_rng(1)
    words = r.integers(0, 2**63, (1 << 20) + 500).astype(np.uint64)
    long_, short = substrings.Sums(words), substrings.Sums(words[-400:])
    at = np.arange(300)
    assert (long_.run(at + len(words) - 400, at + len(words) - 350) == short.run(at, at + 50)).all()


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    def leaf(r, text):
        return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([digest(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, at):
        out = []
        for level in levels[:-1]:
            run = level[at - at % 8:at - at % 8 + 8]
            out.append((at % 8, run[:at % 8] + run[at % 8 + 1:]))
            at //= 8
        return out
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[g] = tree([leaf(r, r[1]) for r in groups[g]])
    top = tree([trees[g][-1][0] for g in order])
    out = Counter()
    for k, g in enumerate(order):
        for at, r in enumerate(groups[g]):
            way = path(trees[g], at) + path(top, k)
            low = r[1] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf(r, low if hit else r[1])
            for place, others in way:
                node = digest(*others[:place], node, *others[place:])
            proof = digest(*[s for _, others in way for s in others])
            out[(r[0], leaf(r, r[1]), trees[g][-1][0], top[-1][0], proof, node, node == top[-1][0])] += 1
    return out


@pytest.mark.parametrize("height", [1, 2])
def test_manifest_equals_plain_python(spark, height):
    rows = [(*r, "en", "s")[:4] for r in awkward()]
    rows = [(r[0], r[1], r[2], r[3], None if r[1] is None else len(r[1])) for r in rows]
    rows += [(1000 + i, f"Text {i}", ["de", "ü", "", "Z"][i % 4] if i < 60 else "de", None, i) for i in range(700)]
    rows += rows[-3:] * 4  # repeated rows
    got = merkle.tampered_documents(clashing(spark, rows), height).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, digest(r.proof), r.folded_root, r.verified)
                   for r in got) == plain_manifest(rows)


def test_manifest_of_nothing_and_of_one_row(spark):
    assert merkle.tampered_documents(clashing(spark, [])).count() == 0
    row = (None, None, None, None, None)
    one = merkle.tampered_documents(clashing(spark, [row])).first()
    assert one.root == one.leaf == one.subroot == digest("-----") and one.proof == "" and one.verified


def plain_phrases(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for r in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (r[1] or ""))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[r[2] or "und"] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[r[2] or "und"][tuple(w[i:i + k])] += 1
    out = []
    for lang in f:
        many = {g: c for g, c in f[lang].items() if c >= least}
        inside = {g[i:j] for g in many for i in range(len(g)) for j in range(i + 1, len(g) + 1)
                  if j - i < len(g) and many[g] >= many[g[i:j]]}
        found = []
        for g, a in many.items():
            if len(g) > 1 and g not in inside:
                score, k = min((1000 * a * n[lang] // (many[g[:k]] * many[g[k:]]), k) for k in range(1, len(g)))
                found.append((score, a, " ".join(g), many[g[:k]], many[g[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, x, y, n[lang], s) for i, (s, a, p, x, y) in enumerate(found[:top], 1)]
    return sorted(out)


def test_phrases_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 3_000)   # many shards, texts cut
    monkeypatch.setattr(phrases, "FILTER_ENTRIES", 200)  # many filters
    r = random.Random(5)
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, "..,\n", None, None, 4)]
    for i in range(150):
        text = "".join(r.choice(["a", "b", "C", "dé", "new york", "Up to date", "x　y"])
                       + r.choice([" ", " ", "  ", "\t", ". ", "\n", "!?"]) for _ in range(r.randrange(200)))
        rows.append((i, text, ["en", "en", "de", None][i % 4], None, 1))
    rows += rows[-3:] * 3
    rows.append((900, "one two three " * 3_000, "en", None, 1))
    got = phrases.collocations(clashing(spark, rows), min_count=6, top=150).collect()
    assert sorted(map(tuple, got)) == plain_phrases(rows, 6, 150)
    assert phrases.collocations(clashing(spark, [])).count() == 0
    assert phrases.collocations(clashing(spark, rows[:20]), min_count=10_000).count() == 0


def test_filters_are_lossless():
    r = np.random.default_rng(7)
    for word_bits, gram_bits, top in ((3, 2, 0), (17, 20, 4), (34, 40, 3), (30, 5, 15)):
        half = max(16, -(-(word_bits + gram_bits) // 2), top + 1)
        n = 3_000
        prefix = r.integers(0, 1 << gram_bits, n).astype(np.uint64)
        word = r.integers(0, 1 << word_bits, n).astype(np.uint64)
        high, low = phrases.permute(*phrases.pack(prefix, word, word_bits, half), half)
        back = phrases.unpack(*phrases.restore(high, low, half), word_bits, half)
        assert (back[0] == prefix).all() and (back[1] == word).all()
        h, l, place = phrases.distinct(high, low, half)
        assert (h[place] == high).all() and (l[place] == low).all()
        counts = r.integers(1, 600, len(h))
        for b in np.unique(h >> np.uint64(half - top)).tolist() if top else [0]:
            s = (h >> np.uint64(half - top)) == b if top else np.ones(len(h), dtype=bool)
            raw = phrases.write_filter(h[s], l[s], counts[s], half, top)
            x, y, c = phrases.read_filter(raw, half, top, b)
            assert (x == h[s]).all() and (y == l[s]).all() and (c == counts[s]).all()


def test_repeats_take_whole_texts_in_small_batches(spark):
    """A worker holds the hashes of few texts at a time, not of 10,000."""
    from seqwise.llm.common import TEXT_ROWS
    from seqwise.llm.substrings import remove_repeats
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    docs = spark.range(3 * TEXT_ROWS).selectExpr("id as doc_id", "concat('a b c d ', id % 7, ' e ', id) as text")
    out = remove_repeats(docs.coalesce(1), width=5)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= TEXT_ROWS
    assert {(r.n_words, r.n_removed) for r in out.collect()} == {(7, 6)} and out.count() == 3 * TEXT_ROWS
