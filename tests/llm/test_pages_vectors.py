"""URL rules, archives and exact search against brute force."""

import base64
import hashlib
import math

import pyarrow as pa
import pytest

from seqwise.llm import topk, urls, warc

PAGES = "page_id long, url string, html string, _row long, host string, key string, sha string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "h", "k", "s") for r in rows], PAGES)


def test_url_rules_nested(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/en/x", "block"),
             ("org", "/fr/", "allow"), ("org", "/fr/", "block"), (None, "/", "block"), ("com", None, "block")]
    links = [None, "", "no scheme", "http://", "http://NET/", "https://a.Example.net/en/1?q", "x://example.net/en/#t",
             "http://b.example.net/de/", "http://a.example.net/en/xy", "http://z.a.example.net/en/x", "http://xexample.net/en/",
             "http://w.org/fr/1", "http://w.org", "http://com", "http://q.com?x", "http://example.net:80/en/", "a://b://c.net/en"]
    rows = [(i, u, None) for i, u in enumerate(links)] + [(3, "http://a.net/", None)] * 3 + [(None, "http://a.net/", "x")]
    table = urls.rules_table(spark, rules)

    def brute(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0] or [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:]
        path = path[:min([i for i in (path.find(c) for c in "?#") if i >= 0] or [len(path)])]
        fits = [(len(h + (p or "")), len(h), h + (p or ""), p or "", a) for h, p, a in rules if h
                and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
        return (host, path, max(fits)[2], max(fits)[4]) if fits else (host, path, None, "allow")
    for sweep in (1, 1_000_000):
        got = urls.judge_urls(pages(spark, rows), table, rows_per_sweep=sweep).collect()
        assert sorted(map(tuple, got), key=str) == sorted([(i, *brute(u)) for i, u, _ in rows], key=str)
    assert urls.judge_urls(pages(spark, []), table).count() == 0


def test_url_rules_with_many_paths_on_one_host(spark):
    """Nested, neighbouring and odd paths, beside the same paths on hosts around."""
    import itertools
    import random
    r = random.Random(3)
    some = ["".join(x) for n in range(6) for x in itertools.product("/ab", repeat=n)]
    odd = ["/\U0010FFFF", "/\U0010FFFFa", "/\xff", "/\xe9/", "/a\U0001F600"]
    rules = [("big.org", p, r.choice(["allow", "block"])) for p in r.sample(some, 150) + odd]
    rules += [("org", p, "block") for p in r.sample(some, 40)] + [("x.big.org", p, "allow") for p in r.sample(some, 40)]
    tails = ["/" + p for p in r.sample(some, 200)] + [o + t for o in odd for t in ("", "/", "a", "\U0010FFFF", "\x7f")] + [""]
    links = [f"http://{h}{t}" for t in tails for h in ("big.org", "y.big.org", "x.big.org", "z.x.big.org", "other.org", "big.net")]
    links = [x.replace("//x.big", "//X.big") for x in links]
    got = {r.page_id: (r.rule, r.verdict) for sweep in (97,) for r in urls.judge_urls(
        pages(spark, [(i, u, None) for i, u in enumerate(links)]), urls.rules_table(spark, rules), rows_per_sweep=sweep).collect()}
    by = {}
    for h, p, a in rules:
        by[h, p] = max(a, by.get((h, p), ""))
    for i, u in enumerate(links):
        host, _, path = u[7:].lower().partition("/")
        path = u[7 + len(host):]
        fits = [(len(h + p), len(h), h + p, a) for (h, p), a in by.items()
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (max(fits)[2:] if fits else (None, "allow")), u


def test_archives_round_trip(spark, tmp_path):
    long = "é" * 300_000
    rows = [(1, "http://a/", "same"), (2, None, "same"), (9, "http://c\r\n/", "same"), (3, "u", None), (4, "u", ""),
            (5, "u", long), (6, "v", "\r\n\r\nWARC/1.1"), (7, "w", "x"), (7, "x", "x"), (None, "n", "y"), (None, "m", "z"), (8, "n", "z")]
    want, kept = [], {}
    for i, _, html in rows:
        kept[html or ""] = max(kept.get(html or "", -1), -1 if i is None else i)
    met = set()
    for i, _, html in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        raw = (html or "").encode()
        best = None if kept[html or ""] < 0 else kept[html or ""]
        first = best == i and (html or "") not in met
        met |= {html or ""} if first else set()
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit",
                     None if first else best))
    files = {}
    for run in ("a", "b"):
        folder = f"file://{tmp_path}/{run}"
        manifest = warc.write_archives(pages(spark, rows), folder, shard_bytes=200_000, roll_bytes=600)
        got = warc.read_archives(spark, folder).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
        files[run] = {r.file: r.sha256 for r in manifest.collect()}
        for name, sha in files[run].items():
            assert hashlib.sha256((tmp_path / run / name).read_bytes()).hexdigest() == sha
        assert not list((tmp_path / run / "_temporary").iterdir())
    assert files["a"] == files["b"] and len(files["a"]) > 3
    assert warc.archive_round_trip(pages(spark, [])).count() == 0


def test_top_k_equals_brute_force(spark):
    import random
    r = random.Random(4)
    rows = [(i, [r.uniform(-1, 1) for _ in range(40)]) for i in range(700)]
    rows += [(800, rows[3][1]), (900, rows[3][1]), (900, rows[5][1]), (None, rows[3][1]), (901, None), (902, [1.0, None] * 20),
             (903, [float("nan")] * 40), (904, [float("inf")] * 40), (1000, [0.5]), (1001, [0.25]), (1002, []), (1100, []),
             (1200, [1e12] * 40)]
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "vec_id long, embedding array<double>, v string, row int")
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
          if v is not None and all(x is not None and math.isfinite(x) for x in v) and i != 1200]
    small = df.where("vec_id is null or vec_id <> 1200")
    want = []
    for a, (i, q) in enumerate(ok):
        if i is not None and i % 100 == 0:
            best = sorted(((-sum(x * y for x, y in zip(q, v)), j is None, j or 0) for b, (j, v) in enumerate(ok)
                           if b != a and len(v) == len(q)))[:10]
            want += [(i, n + 1, None if none else j, -s) for n, (s, none, j) in enumerate(best)]
    for cells in ((16_384, 2_048), (90, 2)):
        got = topk.top_k(small, cell_vectors=cells[0], cell_queries=cells[1]).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert topk.top_k(df.limit(0)).count() == 0


def test_files_are_in_global_order_at_any_size(spark, tmp_path):
    """An outlier id, a run of neighbours and one id with many payloads."""
    rows = [(i, f"u{i}", "x" * 300 + str(i)) for i in range(200)]
    rows += [(7, f"u{k}", f"payload {k} " * 40) for k in range(120)] + [(10**17, "far", "y"), (None, "none", "z"), (-5, "", "w")]
    seen = []
    for shard_bytes, order in ((2_000, 1), (2_000, 5), (10**9, 2)):
        folder = f"file://{tmp_path}/{shard_bytes}-{order}"
        manifest = warc.write_archives(pages(spark, rows).repartition(order), folder, shard_bytes=shard_bytes)
        files = sorted(manifest.collect(), key=lambda r: r.file)
        ids = []
        for f in files:
            with open(f"{tmp_path}/{shard_bytes}-{order}/{f.file}", "rb") as stream:
                records = [warc.parse_record(raw) for raw in warc.members(stream)]
            assert len(records) == f.records
            ids += [(r[0] is not None, r[0] or 0) for r in records]
        assert ids == sorted(ids) and len(ids) == len(rows)
        seen.append([(f.shard, f.file, f.sha256) for f in files])
    assert seen[0] == seen[1] and len({f.shard for f in manifest.collect()}) == 1
    assert len({shard for shard, _, _ in seen[0]}) > 40  # also the id with many payloads is cut


def test_a_lost_file_fails_the_commit(spark, tmp_path):
    row = {"shard": 0, "file": "part-0.warc.gz", "temporary": "_temporary/gone", "records": 1, "bytes": 9, "sha256": ""}
    with pytest.raises(OSError, match="lost"):
        list(warc._committer(f"file://{tmp_path}")([pa.RecordBatch.from_pylist([row])]))
