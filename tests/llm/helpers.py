"""Small tables with awkward rows, and plain-Python versions of the operators."""

import itertools
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _row long, rk string, "
          "size string, g string, _text string, candidates string, score string, key string")


def row(doc_id, text, lang="en", source="s1"):
    """A document with extra columns whose names operators use themselves."""
    return (doc_id, text, lang, source, None if text is None else len(text), 7, "x", "y", "z", "t", "c", "s", "k")


def frame(spark, rows):
    return spark.createDataFrame([row(*r) for r in rows], SCHEMA)


def words_of(text):
    return WORD.findall(text or "")


def prose(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(400)}" for _ in range(n)]


def near(words, seed, changes):
    r, out = random.Random(seed), list(words)
    for i in r.sample(range(len(out)), changes):
        out[i] = f"x{r.randrange(10**6)}"
    return out


def awkward():
    """Nulls, empties, a very long text, ties, copies, near copies, repeats."""
    base, other = prose(1, 300), prose(2, 120)
    rows = [(1, " ".join(base)), (2, " ".join(base), "de", None), (3, " ".join(near(base, 5, 2))),
            (4, " ".join(near(base, 6, 6))), (5, None), (6, ""), (7, " \t\n "), (8, "two words"),
            (9, "Two WORDS", None, "s2"), (None, " ".join(other)), (10, " ".join(other)),
            (11, " ".join(near(other, 7, 1)), None, None), (12, " ".join(prose(3, 20_000))), (13, "z" * 70_000),
            (14, "a b\n" * 200), (14, "a b\n" * 200), (15, "ÀÉ é\u2581x \U0001F600 ſecret")]
    chain = base
    for i in range(12):  # each links with its neighbours, the ends do not link
        chain = near(chain, 100 + i, 3)
        rows.append((100 + i, " ".join(chain), "fr", "s3"))
    return rows


def shingle_sets(rows, k):
    out = []
    for r in rows:
        w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in (r[1] or "")))
        out.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def brute_components(rows, k, percent):
    sets, root = shingle_sets(rows, k), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids) if ids else None))
    return out
