"""The pipeline: its stages on the smallest tables, and as a whole against plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from llm.helpers import brute_components, near, prose, row, words_of

from seqwise.llm import pieces, quality
from seqwise.llm.queries import tokenizer_file


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.columns
    for _name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).persist()
        assert docs.columns == before and docs.count() > 0
    rows = docs.collect()
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in ids)
    assert all(len(r.ids) > 0 for r in ids) and all(words_of(r.text) for r in rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "secrets", "mixing", "pieces"]


FIELDS = ["doc_id", "text", "lang", "source", "n_chars"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SECRET, SHARED = "Zk3vQ9xLw2RtY8uB4nMpT7", "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8"


def corpus():
    """Good and bad documents, copies and near copies, secrets, awkward rows."""
    rows, labels = [], []
    for i in range(90):
        words = prose(1000 + i, 40 + i % 30)
        if i % 9 == 0:
            words[5:5] = [f'password="hunter{i:05d}"']
        if i % 10 == 0:
            words.append(SECRET + str(i))
        if i % 6 == 0:
            words.append(SHARED)
        rows.append((i, " ".join(words), ["en", "de", None][i % 3], ["a", "b", "c", None][i % 4]))
        labels.append((i, 1))
    for i in range(60):
        rows.append((500 + i, "%%% *** " * 20 + " ".join(prose(i, 10)), "en", "a"))
        labels.append((500 + i, 0))
    for i in range(20):
        words = rows[i][1].split(" ")
        rows.append((200 + i, " ".join(words if i % 2 else near(words, i, 1)), "en", "b"))
    rows += [(300, None, "en", "a"), (301, "", None, None), (302, " \n ", "en", "c"), (7, rows[7][1], "de", None)]
    return [row(*r)[:5] for r in rows], labels


def plain_score(model, text):
    """The factorisation machine with every pair of features written out."""
    slots, x = quality.features(text)
    z = model.flat[0] + sum(model.w[s] * v for s, v in zip(slots, x))
    for i in range(len(slots)):
        if i:
            z += float(((model.v[slots[:i]] @ model.v[slots[i]]) * x[:i] * x[i]).sum())
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def plain_dedupe(rows):
    out, kept = [], set()
    for r, (_, n, least) in zip(rows, brute_components(rows, 5, 80)):
        key = ("text", least) if n else ("none", r[0], r[1])
        if (not n or r[0] == least) and key not in kept:
            kept.add(key)
            out.append(r)
    return out


BASE = [(re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII), 2, 8), (re.compile(r"AKIA[A-Z0-9]+"), 0, 16), (re.compile("[0-9a-f]+"), 0, 32)]


def plain_spans(text):
    base = [(m.start(), m.end(), m.group(g)) for p, g, least in BASE for m in p.finditer(text or "")
            if len(m.group(g)) >= least]
    added = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text or ""):
        v = m.group()
        bits = -sum(c / len(v) * math.log2(c / len(v)) for c in Counter(v).values())
        if (all(re.search(p, v) for p in ("[0-9]", "[A-Z]", "[a-z]")) and bits >= 3.5
                and not any(a < m.end() and m.start() < b for a, b, _ in base)):
            added.append((m.start(), m.end(), v))
    return base, added


def plain_mask(rows):
    spans = [plain_spans(r[1]) for r in rows]
    owners, repos = defaultdict(set), defaultdict(set)
    for r, found in zip(rows, spans):
        for _, _, v in found[0] + found[1]:
            owners[v].add(r[3])
            repos[v].add((r[3], r[2]))
    out = []
    for r, (base, added) in zip(rows, spans):
        stay = base + [s for s in added if len(owners[s[2]]) <= 2 and len(repos[s[2]]) <= 4]
        inside = [any(a <= i < b for a, b, _ in stay) for i in range(len(r[1] or ""))]
        text = "".join("[SECRET]" if hit and (not i or not inside[i - 1]) else "" if hit else r[1][i]
                       for i, hit in enumerate(inside)) if r[1] is not None else None
        out.append((*r[:1], text, *r[2:4], len(text) if stay else r[4]))
    return out


def plain_mix(rows):
    """Documents served one by one, the queue with the least finish time first."""
    queues = defaultdict(list)
    for r in rows:
        if words_of(r[1]):
            queues[r[3]].append(r)
    order = sorted(queues, key=lambda s: (s is None, s or ""))
    size = {s: sum(len(words_of(r[1])) for r in queues[s]) for s in order}
    target, open_, left = {}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(size.values())
    while open_:
        level = left / sum(open_.values())
        full = [s for s in open_ if level * open_[s] >= 2 * size[s]]
        for s in full or list(open_):
            target[s] = 2 * size[s] if full else level * open_[s]
            left -= target[s]
            del open_[s]
    entries = []
    for s in order:
        queues[s].sort(key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0]))
        served = 0
        for r in queues[s] * 2:
            served += len(words_of(r[1]))
            entries.append((served / target[s], len(words_of(r[1])), r))
    out, spent = [], 0
    for _, n, r in sorted(entries, key=lambda e: e[0]):
        spent += n
        if spent > 1.5 * sum(size.values()):
            break
        out.append(r)
    return out


def plain_pieces(text, vocab, score):
    """Best segmentation of each word by the plain recurrence, behind the blank
    that the model puts before every text."""
    out = []
    for word in re.findall(" *[^ ]+| +", " " + text if text else ""):
        word, best = word.replace(" ", pieces.MARK), [(0.0, [])]
        for end in range(1, len(word) + 1):
            found = [(best[i][0] + score[word[i:end]][0], i, [score[word[i:end]][1]])
                     for i in range(max(0, end - vocab.longest), end) if word[i:end] in score]
            spelled = (best[end - 1][0] + vocab.spelled, end, [vocab.byte_ids[b] for b in word[end - 1].encode()])
            total, i, ids = max([*found, spelled], key=lambda f: (f[0], -f[1]))
            best.append((total, best[min(i, end - 1)][1] + ids))
        out += best[-1][1]
    return out


def test_pipeline_equals_plain_python(spark, tmp_path):
    rows, labels = corpus()
    sf = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    model = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    got = corpus_pipeline.run(spark, sf).collect()

    good = [r for r in rows if plain_score(model, r[1]) >= quality.THRESHOLD]
    assert {r[0] for r in good} >= set(range(90)) and not {r[0] for r in good} & set(range(500, 560))
    one = plain_dedupe(good)
    assert len(one) < len(good)
    masked = plain_mask(one)
    assert sum("[SECRET]" in (r[1] or "") for r in masked) > 9 and any(SHARED in (r[1] or "") for r in masked)
    mixed = plain_mix(masked)
    vocab = pieces.Vocabulary.read(tokenizer_file(spark))
    score = {vocab.pieces[i]: (s, i) for i, s in zip(vocab.ids.tolist(), vocab.scores.tolist())}
    want = Counter((r[0], r[3], tuple(plain_pieces(r[1], vocab, score))) for r in mixed)
    assert Counter((r.doc_id, r.source, tuple(r.ids)) for r in got) == want


@pytest.mark.parametrize("text", ["a" * 30 + " password=abcdefgh", "x token=" + SECRET + " " + SECRET, ""])
def test_added_spans_never_touch_base_spans(text):
    from seqwise.llm.secrets import scan
    base, added = plain_spans(text)
    assert sorted(s[1:] for s in scan(text)) == sorted(base + added)
