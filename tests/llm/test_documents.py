"""Operators on documents against brute force, on awkward rows."""

import hashlib
import re
from collections import Counter

import pytest
from llm.helpers import awkward, brute_components, frame, words_of

from seqwise.llm import jaccard, licenses, mixing, pieces, quality, rules, secrets
from seqwise.llm.queries import tokenizer_file


def _sorted(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("k,percent,lane", [(3, 90, 1 << 19), (5, 80, 600)])
def test_near_copies_equal_brute_force(spark, monkeypatch, k, percent, lane):
    monkeypatch.setattr(jaccard, "LANE", lane)  # small lanes: links across lanes
    monkeypatch.setattr(jaccard, "GROUP", 2)
    monkeypatch.setattr(jaccard, "QUERIES", 3)
    got = jaccard.near_copies(frame(spark, awkward()), shingle=k, percent=percent).collect()
    assert _sorted(map(tuple, got)) == _sorted(brute_components(awkward(), k, percent))


def test_one_document_of_each_component_stays(spark):
    rows = awkward()
    got = [r.doc_id for r in jaccard.one_of_each(frame(spark, rows)).collect()]
    brute = brute_components(rows, 5, 80)
    empty = [i for i, n, _ in brute if n == 0]
    assert _sorted(got) == _sorted({c for _, n, c in brute if n} | set(empty))


def test_linked_sets_share_a_token():
    import numpy as np
    r = np.random.default_rng(3)
    for n in list(range(1, 60)) + [200, 900]:
        for percent in (80, 90):
            s = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            drop = int(len(s) * (100 - percent) / 100)
            t = s[r.permutation(len(s))[drop:]]
            t.sort()
            assert set(jaccard.set_tokens(s, percent)) & set(jaccard.set_tokens(t, percent))


def test_empty_tables(spark):
    none = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert jaccard.near_copies(none).count() == 0 == jaccard.one_of_each(none).count()
    assert mixing.mix(none).count() == 0 == mixing.mixed_documents(none).count()
    assert quality.score_documents(none, quality.fit(none, labels)).count() == 0
    assert secrets.scan_secrets(none).count() == 0 == secrets.mask_secrets(none).count()
    assert rules.apply_rules(none, labels).count() == 0
    assert licenses.scan_licenses(none, licenses.templates_table(spark)).count() == 0
    assert pieces.encode(none, tokenizer_file(spark)).count() == 0


def test_mix_spends_the_budget(spark):
    rows = [(i, "w " * (i % 7), "en", [None, "a", "b", "c"][i % 4]) for i in range(400)]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == 400 and all(r.taken <= 2 * r.size for r in got)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    for s in sizes:
        assert target[s] <= 2 * sizes[s] + 1e-9 and abs(taken[s] - target[s]) <= 6
    rows_out = mixing.mixed_documents(frame(spark, rows)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in rows_out} == {r.doc_id: r.copies for r in got if r.copies}


@pytest.mark.parametrize("ties", [100_000, 4])
def test_mix_cuts_inside_rows_of_one_id(spark, monkeypatch, ties):
    monkeypatch.setattr(mixing, "TIES", ties)   # 4: rows of one id get ranges of their own
    rows = [(i if i % 3 else None if i % 2 else 5, f"t{i} " + "w " * (i % 5), "en", "ab"[i % 4 == 0]) for i in range(300)]
    rows += [(7, "same text", "de", "c")] * 40 + [(900 + i, "a b", "de", "d") for i in range(30)]
    got = mixing.mix(frame(spark, rows)).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 5 for s in target)
    assert sum(taken.values()) <= 1.5 * sum(r.size for r in got)
    out = Counter((r.doc_id, r.source, len(words_of(r.text))) for r in mixing.mixed_documents(frame(spark, rows)).collect())
    want = Counter()
    for r in got:
        want[(r.doc_id, r.source, r.size)] += r.copies
    assert out == +want
    # rows of one id are shuffled, not served by size
    tied = [r.size for r in sorted((r for r in got if r.doc_id is None and r.source == "a"), key=lambda r: r.tie)]
    assert len(tied) > 20 and tied != sorted(tied)


def test_mix_of_awkward_rows(spark):
    got = mixing.mix(frame(spark, awkward())).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(words_of(r[1]))) for r in awkward())


def test_classifier_learns_and_scores_everything(spark):
    good = [(i, " ".join(f"w{(i * 7 + j) % 90}" for j in range(60))) for i in range(200)]
    bad = [(1000 + i, " ".join(f"w{(i * 5 + j) % 90}%%% ***" for j in range(60))) for i in range(200)]
    docs = frame(spark, good + bad + awkward())
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (1, 5), (77_777, 0)],
                                   "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.s for r in quality.score_documents(docs, model, score_col="s").collect()}
    held = {r.doc_id for r in docs.where(quality.held_out(docs.doc_id)).select("doc_id").collect()}
    right = [(got[i] >= quality.THRESHOLD) == (i < 1000) for i in held if i in range(200) or i in range(1000, 1200)]
    assert len(right) > 40 and sum(right) / len(right) > 0.95
    assert all(0 <= s <= 1 for s in got.values())
    again = quality.fit(docs, labels)
    assert (again.flat == model.flat).all()


def test_pair_term_by_the_sum_of_squares(spark):
    import numpy as np
    r = np.random.default_rng(1)
    m = quality.Model(r.normal(size=quality.PARAMS))
    slots, x = np.array([3, 9, 500]), np.array([0.2, 0.5, 1.0])
    direct = m.flat[0] + sum(m.w[s] * v for s, v in zip(slots, x)) + sum(
        m.v[slots[i]] @ m.v[slots[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    assert abs(m.margin(slots, x)[0] - direct) < 1e-9


BASE = [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)]


def base_spans(text):
    out = []
    for i, (kind, pattern, group, least) in enumerate(BASE):
        flags = (re.IGNORECASE | re.ASCII) if kind == "assign" else 0
        out += [(m.start(), i, m.end(), kind) for m in re.finditer(pattern, text, flags) if len(m.group(group)) >= least]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def test_secrets_keep_the_base_spans(spark):
    live, shared = "Zk3vQ9xLw2RtY8uB4nMpT7", "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8"
    rows = awkward() + [
        (50, 'é password = "abcdefgh1" token:"secret":"abcdefgh1" tOkEN==abcdefghi apikey: x AKIAAKIAABCDEFGHIJ'),
        (51, "secret= " + "0f" * 20 + " AKIASHORT " + "ab" * 16 + "x passwd:short api_key='A.B.C-D=E/F+G'"),
        (52, "key " + live + " end"), *[(60 + i, "see " + shared, "en", f"o{i}") for i in range(5)]]
    got = {r.doc_id: r for r in secrets.digest(secrets.scan_secrets(frame(spark, rows))).collect()}
    for doc_id, text, *_ in rows:
        want = base_spans(text or "")
        r = got[doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("mixed")] == want
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in want)
                                                          for k in ("assign", "access", "hex"))
    assert got[52].spans == f"mixed:4:{4 + len(live)}" and got[60].spans == ""
    masked = {r.doc_id: r for r in secrets.mask_secrets(frame(spark, rows)).collect()}
    assert masked[52].text == "key [SECRET] end" and masked[52].n_chars == 16 and masked[60].text == "see " + shared
    assert masked[5].text is None and masked[50].text.startswith('é [SECRET]" token:') and len(masked) == len({r[0] for r in rows})


def brute_rule_counts(text):
    w, t = words_of(text), text or ""
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if words_of(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_rules_count_as_brute_force(spark):
    rows = awkward() + [(70, "x y z\nx y z\n \nx y z #*$"), (71, " ".join(["a b c d e"] * 40)), (72, "a b c a b c a b")]
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = rules.apply_rules(frame(spark, rows), labels).collect()
    have = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert have == Counter((r[0], *brute_rule_counts(r[1])) for r in rows)
    assert all(r.kept == (not r.base_failed) for r in got)  # too few labels for any cutoff


def test_rules_cutoffs_are_proven(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text + (" #" if i < 3 else ""), "en") for i in range(4000)] + [(9000, text + " #" * 90, "en")]
    labels = spark.createDataFrame([(i, 1) for i in range(4000)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in rules.apply_rules(frame(spark, rows), labels).collect()}
    assert not got[9000] and sum(not got[i] for i in range(4000)) <= 4000 * rules.RISK
    n, risk, delta = 4000, rules.RISK / len(rules.RULES), rules.ERROR / len(rules.RULES)
    sizes = spark.createDataFrame([("en", n)], "stratum string, n long")
    k = rules.allowed_rejections(sizes, risk, rules.ERROR, len(rules.RULES)).first().k
    from math import comb
    cdf = [sum(comb(n, i) * risk**i * (1 - risk)**(n - i) for i in range(j + 1)) for j in (k, k + 1)]
    assert cdf[0] <= delta < cdf[1]


def test_licences_are_found_and_verified(spark):
    mit = licenses.TEMPLATES[1][1]
    rows = awkward() + [(80, "Released under the MIT License.\nand more"), (81, "x y " + mit.upper() + " tail"),
                        (82, "licensed under the apache license version 2 0"), (83, "under the MIT licence released"),
                        (84, " ".join(prose for prose in mit.split()[:12]))]
    got = {(r.doc_id, r.license_id): r.containment
           for r in licenses.scan_licenses(frame(spark, rows), licenses.templates_table(spark)).collect()}
    assert got == {(80, "MIT"): 1.0, (81, "MIT"): 1.0, (82, "Apache-2.0"): 1.0}


def test_sibling_licences_are_told_apart(spark):
    say = "This work is licensed under the GNU General Public License, version {}."
    rows = [(1, say.format(2)), (2, "x y " + say.format(3) + " tail"), (3, say.format(2) + " or: " + say.format(3)),
            (4, say.format(4))]
    got = {(r.doc_id, r.license_id) for r in licenses.scan_licenses(
        frame(spark, rows), licenses.templates_table(spark)).collect()}
    assert got == {(1, "GPL-2.0"), (2, "GPL-3.0"), (3, "GPL-2.0"), (3, "GPL-3.0")}


def test_whole_licences_and_notices_are_found(spark):
    texts = licenses.license_texts()
    wide = {name: text for name, text in texts if len(text.split()) > 84}      # width 64
    rows, want = [], set()
    for i, (name, text) in enumerate(texts):
        words = text.split()
        for j in range(50, len(words), 60):     # an edited word in every 60: 0.9 of the shingles stay
            words[j] = f"edited{j}"
        body = len(words) // 20 if name in wide else 0     # and no opening sentence
        rows.append((i, "Copyright (c) 2020 Some Body\n" + " ".join(words[body:]) + "\nint main() {}"))
        want.add((i, name))
    gpl = [t for n, t in texts if n == "GPL-3.0" and len(t.split()) > 1000][0]
    rows += [(900, gpl[:len(gpl) // 2]), (901, "This program is free software: you can redistribute it and/or modify")]
    got = {(r.doc_id, r.license_id) for r in licenses.scan_licenses(
        frame(spark, rows), licenses.templates_table(spark)).collect()}
    own = {(i, n) for i, n in got if n == texts[i][0]} if not {i for i, _ in got} & {900, 901} else set()
    assert own == want
    # a text holds no other licence, but for the notices that it quotes
    assert {(texts[i][0], n) for i, n in got - own} <= {("BSD-2-Clause", "BSD")}
    widths = {r.width for r in licenses.template_bands(licenses.template_shingles(licenses.templates_table(spark))).collect()}
    assert widths == {1, 4, 16, 64}


def test_pieces_round_trip_and_best_score(spark):
    import itertools
    path = tokenizer_file(spark)
    rows = awkward() + [(90, "  a  b \n\t c "), (91, "\u2581 \u2581\u2581x"), (92, "日本語 \x00\x7f ")]
    docs = frame(spark, rows)
    ids = pieces.encode(docs, path, keep=["doc_id", "key"], verify_col="same")
    back = pieces.decode(ids, path).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r[0], r[1]) for r in rows)
    assert all(r.same in (True, None) for r in ids.collect())
    vocab = pieces.Vocabulary(["\u2581", "a", "b", "ab", "\u2581a", "ba"], [-3.0, -2.0, -2.5, -3.0, -4.5, -1.0], {97: 0}, set())
    vocab = pieces.Vocabulary([*vocab.pieces, *[f"<{b}>" for b in range(256)]], [-3.0, -2.0, -2.5, -3.0, -4.5, -1.0] + [0.0] * 256,
                              {b: 6 + b for b in range(256)}, set())
    score = dict(zip(vocab.pieces[:6], [-3.0, -2.0, -2.5, -3.0, -4.5, -1.0]))

    def best(word):
        word, cuts = word.replace(" ", "\u2581"), []
        for n in range(len(word)):
            for c in itertools.combinations(range(1, len(word)), n):
                parts = [word[i:j] for i, j in zip((0, *c), (*c, len(word)))]
                if all(p in score for p in parts):
                    cuts.append(sum(score[p] for p in parts))
        return max(cuts)
    for size in range(1, 6):
        words = ["".join(w) for w in itertools.product("ab", repeat=size)] + [" " + "ab"[:size - 1] for _ in [0] if size < 4]
        for group in {len(w): [x for x in words if len(x) == len(w)] for w in words}.values():
            for w, found in zip(group, pieces.viterbi(group, vocab), strict=True):
                assert sum(score[vocab.pieces[i]] for i in found) == pytest.approx(best(w))


def test_long_words_are_cut_without_loss(spark, monkeypatch):
    """Parts and long words walked alone give what the word as a whole gives."""
    import random
    r = random.Random(8)
    vocab = pieces.Vocabulary.read(tokenizer_file(spark))
    texts = ["".join(chr(r.randrange(0x4e00, 0x9fa5)) for _ in range(1_500)), "z" * 3_000, "=" * 700 + "\u2581" * 600,
             "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2_000)), "the" * 900 + "\U0001F600" * 30,
             "".join(r.choice("ABCdef0123456789+/\xe9") for _ in range(2_000)), "\n" * 600, "x" * 24, "y" * 23, "a" * 511, "b" * 512]
    whole = [pieces.viterbi([t], vocab)[0].tolist() for t in texts]
    assert [pieces.viterbi_alone(t, vocab).tolist() for t in texts] == whole
    for t, w in zip(texts, whole, strict=True):
        parts = pieces.cut_word(t, vocab)
        assert "".join(parts) == t and [i for p in parts for i in pieces.viterbi([p], vocab)[0].tolist()] == w
    assert len(pieces.cut_word(texts[0], vocab)) > 1_000
    monkeypatch.setattr(pieces, "BLOCK", 100)
    assert [pieces.viterbi_alone(t, vocab).tolist() for t in texts] == whole
    bare = pieces.Vocabulary(vocab.pieces, [0.0] * len(vocab.pieces), vocab.byte_ids, vocab.control)
    got = pieces.Encoder(bare).encode(texts)
    assert [x.tolist() for x in got] == [pieces.viterbi([t], bare)[0].tolist() for t in texts]


def _small_model(tmp_path, **options):
    import random

    import sentencepiece
    r = random.Random(5)
    lines = [" ".join("".join(r.choice("abcde") for _ in range(r.randrange(1, 6))) for _ in range(8)) for _ in range(400)]
    (tmp_path / "lines.txt").write_text("\n".join(lines))
    sentencepiece.SentencePieceTrainer.train(
        input=str(tmp_path / "lines.txt"), model_prefix=str(tmp_path / "m"), model_type="unigram", vocab_size=360,
        byte_fallback=True, hard_vocab_limit=False, num_threads=1, minloglevel=2, **options)
    return str(tmp_path / "m.model")


@pytest.mark.parametrize("prefix,squeeze", [(True, False), (False, False), (True, True)])
def test_pieces_follow_the_normaliser(spark, tmp_path, prefix, squeeze):
    import sentencepiece
    path = _small_model(tmp_path, normalization_rule_name="identity", add_dummy_prefix=prefix,
                        remove_extra_whitespaces=squeeze)
    texts = ["abc de", "cab", " abc", "  a  bc ", " ", "", "a\tb e", "zé abc"]
    got = pieces.encode(frame(spark, list(enumerate(texts))), path, keep=["doc_id"], verify_col="same").collect()
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    assert {r.doc_id: r.ids for r in got} == {i: m.encode(t) for i, t in enumerate(texts)}
    assert squeeze or all(r.same for r in got)


def test_pieces_first_words_and_unknown_normalisers(spark, tmp_path):
    vocab = pieces.Vocabulary.read(tokenizer_file(spark))
    ids = pieces.Encoder(vocab).encode(["the the", "the"])
    assert vocab.pieces[ids[1][0]].startswith("\u2581") and ids[0].tolist() == ids[1].tolist() * 2
    with pytest.raises(ValueError, match="not handled"):
        pieces.Vocabulary.read(_small_model(tmp_path, normalization_rule_name="nmt_nfkc"))
