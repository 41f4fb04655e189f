"""Licence scans in several passes, and against brute-force containment."""

import random
import re

from llm.helpers import frame, prose

from seqwise.llm import licenses


def shingles(text):
    w = [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
    n = min(5, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def edited(text, seed, share):
    """A copy with a share of its words replaced, one here and one there."""
    r, w = random.Random(seed), text.split()
    for i in r.sample(range(len(w)), int(len(w) * share)):
        w[i] = f"changed{r.randrange(10**6)}"
    return " ".join(w)


def templates():
    """Invented licences of 20 to 400 words that share nothing, and a sibling."""
    out = [(f"L{i}", " ".join(f"t{i}w{j}" for j in prose(i, 20 + 38 * i))) for i in range(10)]
    return out + [("S", out[9][1] + " " + " ".join(f"s{x}" for x in prose(77, 200)))]


def documents(known):
    rows, n = [(0, None), (1, ""), (2, " ".join(prose(5, 400)))], 10
    for name, text in known[:10]:
        for seed, share in enumerate((0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.2)):
            rows.append((n, " ".join([*prose(n, 150), edited(text, n + seed, share), *prose(n + 1, 90)])))
            n += 1
    return rows + [(n, known[10][1]), (n + 1, known[3][1] + "\n" + known[4][1])]


def found(spark, rows, known):
    got = licenses.scan_licenses(frame(spark, rows), licenses.templates_table(spark, known)).collect()
    return {(r.doc_id, r.license_id): (round(r.containment, 9), r.n_templates) for r in got}


def test_groups_and_brute_force_agree(spark, monkeypatch):
    known = templates()
    rows = documents(known)
    one = found(spark, rows, known)
    want = {}
    for i, text in rows:
        held = shingles(text or "")
        for name, t in known:
            c = len(shingles(t) & held) / len(shingles(t))
            if c >= 0.8:
                want[i, name] = round(c, 9)
    sibling = rows[-2][0]
    want.pop((sibling, "L9"))  # inside the longer licence, which is there as a whole
    assert {k: c for k, (c, _) in one.items()} == want and len(want) > 40
    monkeypatch.setattr(licenses, "GROUP_SHINGLES", 700)  # several passes; the sibling in another than its rival
    assert len(licenses._groups(licenses.template_shingles(licenses.templates_table(spark, known)))) > 2
    assert found(spark, rows, known) == one
