"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

_SEP = "'[\\x20\\x09-\\x0D]+'"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), {_SEP}), lambda x: x <> '')"


OP1 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_words("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[][] WHEN len(w) < 3 THEN [w]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) END) AS g FROM w),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY 1, 2),
link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT n.doc_id, n.n AS n_shingles, min(reach.b) AS component_id
FROM n JOIN reach ON reach.a = n.doc_id GROUP BY 1, 2
"""

# Weighted shares with caps by water filling, then the queue of each source.
OP2 = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len({_words('text')}) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][CAST((row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, source_size * 2 / weight AS full_at, sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS budget,
    sum(weight) OVER () AS weights FROM s),
l AS (
  SELECT *, (budget - coalesce(sum(source_size * 2) OVER o, 0)) / (weights - coalesce(sum(weight) OVER o, 0)) AS level
  FROM r WINDOW o AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, budget, CASE WHEN full_at <= level THEN CAST(source_size * 2 AS DOUBLE)
    ELSE weight * first_value(level) OVER (ORDER BY full_at <= level, full_at, source NULLS LAST) END AS target
  FROM l),
q AS (
  SELECT d.*, t.source_size, t.target, t.budget,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS served
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT size, budget, (served + k * source_size) / target AS finish FROM q, (SELECT unnest([0, 1]) AS k)
  WHERE size > 0),
c AS (
  SELECT finish, budget, sum(size) OVER (ORDER BY finish) AS spent FROM e),
stop AS (SELECT coalesce(max(finish), 0) AS stop FROM c WHERE spent <= budget)
SELECT doc_id, size, source_size, target, CAST(size * (
  CASE WHEN size > 0 AND served / target <= stop THEN 1 ELSE 0 END +
  CASE WHEN size > 0 AND (served + source_size) / target <= stop THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM q, stop
"""

OP5 = r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*(/[^?#]*)?', 1), '') AS path FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS t, {_words('text')} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: len({_words('x')}) > 0) AS lines FROM documents),
g AS (
  SELECT row, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS g
  FROM d WHERE len(w) > 2),
rep AS (
  SELECT row, count(DISTINCT p) AS n FROM (
    SELECT row, unnest([i, i + 1, i + 2]) AS p FROM (
      SELECT row, i, count(*) OVER (PARTITION BY row, g) AS c FROM g) WHERE c > 1) GROUP BY row),
b AS (
  SELECT d.row, doc_id, lang, t, len(lines) AS n_lines, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN rep ON rep.row = d.row),
m AS (
  SELECT row, doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    [least(1000, floor(n_symbols * 1000 / greatest(word_chars, 1))),
     least(1000, floor(n_dup_lines * 1000 / greatest(n_lines, 1))),
     least(1000, floor(n_repeat_words * 1000 / greatest(n_words, 1))),
     least(1000, floor(1000 / greatest(word_chars / greatest(n_words, 1), 1.0))),
     least(1000, floor(word_chars / greatest(n_words, 1) * 20)),
     least(1000, floor(length(regexp_replace(t, '[^A-Z]+', '', 'g')) * 1000 / greatest(length(t), 1)))] AS v FROM b),
good AS (
  SELECT lang, r, v[r] AS value FROM m JOIN labels USING (doc_id), (SELECT unnest(range(1, 7)) AS r)
  WHERE quality = 1 AND NOT base_failed),
size AS (SELECT lang, count(*) AS n, count(*) OVER () AS strata FROM good WHERE r = 1 GROUP BY lang),
term AS (
  SELECT lang, n, strata, i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.02 / 6)
    + (n - i) * ln(1 - 0.02 / 6)) AS p FROM (
    SELECT *, unnest(range(0, CAST(floor(n * (0.02 / 6)) AS BIGINT) + 1)) AS i FROM size)),
k AS (
  SELECT lang, max(i) AS k FROM (
    SELECT *, sum(p) OVER (PARTITION BY lang ORDER BY i) AS cdf FROM term) WHERE cdf <= 0.05 / (strata * 6)
  GROUP BY lang),
cut AS (
  SELECT h.lang, r, min(value) AS cutoff FROM (
    SELECT lang, r, value, sum(count(*)) OVER (PARTITION BY lang, r ORDER BY value DESC) - count(*) AS above
    FROM good GROUP BY lang, r, value) h JOIN k ON h.lang IS NOT DISTINCT FROM k.lang
  WHERE above <= k GROUP BY h.lang, r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (
    SELECT 1 FROM cut WHERE cut.lang IS NOT DISTINCT FROM m.lang AND m.v[cut.r] > cut.cutoff) AS kept
FROM m
"""

OP9 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
bits AS (
  SELECT page_id, payload_bytes, list_reduce(list_transform(range(1, 41), lambda i:
    ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101',
     '1110', '1111'][instr('0123456789abcdef', sha[i])]), lambda a, b: a || b) AS bits FROM p),
d AS (
  SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, list_reduce(list_transform(range(0, 32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT)
      + 4 * CAST(bits[5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT) + 1]),
    lambda a, b: a || b) AS payload_digest FROM bits),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS kept FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END
  AS record_type, CASE WHEN kept <> page_id THEN kept END AS refers_to FROM k
"""

OP10 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT)
    AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

OP11 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_words('text')} AS w FROM documents),
s AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
k AS (SELECT r, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + 34], ' ')) AS c FROM s),
g AS (SELECT DISTINCT r, i + o AS p FROM k, (SELECT unnest(range(0, 35)) AS o) WHERE c > 1),
u AS (SELECT r, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS p FROM d),
t AS (SELECT r, string_agg(v, ' ' ORDER BY p) AS t, count(*) AS n FROM u ANTI JOIN g USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN t USING (r)
"""

OP13 = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda k: list_transform(range(1, len(w) - k + 2),
    lambda i: w[i:i + k - 1])))) AS g FROM w),
f AS (SELECT lang, array_to_string(g, ' ') AS phrase, any_value(g) AS g, count(*) AS f FROM g GROUP BY 1, 2 HAVING f >= 100),
c AS (SELECT lang, phrase, g, f AS a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1),
s AS (
  SELECT c.lang, c.phrase, c.g, c.a, x.f AS l, y.f AS r, n.n,
    CAST(1000::HUGEINT * c.a * n.n // (x.f::HUGEINT * y.f) AS BIGINT) AS score, c.k
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.g[1:c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.g[c.k + 1:], ' ') JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (
  SELECT lang, array_to_string(g[q[1]:q[2]], ' ') AS phrase, max(f) AS longer
  FROM (SELECT lang, g, f, unnest(flatten(list_transform(range(2, len(g)), lambda k: list_transform(
    range(1, len(g) - k + 2), lambda i: [i, i + k - 1])))) AS q FROM f WHERE len(g) > 2) GROUP BY 1, 2),
k AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE C) AS rank FROM k)
SELECT lang, rank, phrase, a, l, r, n, score FROM t WHERE rank <= 2000
"""


def _merkle(levels: int = 9) -> str:
    """The trees level by level (groups of up to 8**levels leaves): every node
    with the run that it belongs to, then every leaf's way up."""
    def enc(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def tree(name: str, first: str) -> list[str]:
        out = [f"{name}0 AS ({first})"]
        for k in range(levels + 1):
            if k:
                out.append(f"""{name}{k} AS (
  SELECT g, i // 8 AS i, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS node
  FROM {name}{k - 1}r WHERE i % 8 = 0)""")
            out.append(f"""{name}{k}r AS (
  SELECT *, count(*) OVER (PARTITION BY g) AS n,
    list(node) OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS run
  FROM {name}{k})""")
        return out

    def climb(name: str, over: str, first: str) -> list[str]:
        out = [f"{name}0 AS ({first})"]
        for k in range(levels):
            before, after = "t.run[1:p.at % 8]", "t.run[p.at % 8 + 2:]"
            out.append(f"""{name}{k + 1} AS (
  SELECT p.doc_id, p.leaf, p.tg, p.at // 8 AS at,
    p.proof || CASE WHEN t.n > 1 THEN array_to_string({before} || {after}, '') ELSE '' END AS proof,
    CASE WHEN t.n > 1 THEN sha256(array_to_string({before} || [p.folded] || {after}, '')) ELSE p.folded END AS folded
  FROM {name}{k} p JOIN {over}{k}r t ON t.g = p.tg AND t.i = p.at - p.at % 8)""")
        return out
    crc = """list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, x: list_reduce([xor(c, x)] || range(8), lambda a, _: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)))"""
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return "WITH " + ",\n".join(
        [f"""d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf('text')} AS leaf,
    CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN {leaf(low)} END AS other FROM documents),
q AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)"""]
        + tree("a", "SELECT g, i, leaf AS node FROM q")
        + [f"s AS (SELECT g, node, row_number() OVER (ORDER BY g COLLATE C) - 1 AS i FROM a{levels})"]
        + tree("b", "SELECT 0 AS g, i, node FROM s")
        + climb("p", "a", "SELECT doc_id, leaf, g AS tg, i AS at, '' AS proof, coalesce(other, leaf) AS folded FROM q")
        + climb("r", "b", f"""SELECT p.doc_id, p.leaf || s.node AS leaf, 0 AS tg, s.i AS at, p.proof, p.folded
  FROM p{levels} p JOIN s ON s.g = p.tg""")) + f"""
SELECT r.doc_id, r.leaf[1:64] AS leaf, r.leaf[65:] AS subroot, b.node AS root, sha256(r.proof) AS proof_sha256,
  r.folded AS folded_root, r.folded = b.node AS verified FROM r{levels} r, b{levels} b
"""


def all_oracles() -> dict[str, str]:
    return {"op1_ngram_jaccard": OP1, "op2_mix_sources": OP2, "op5_url_rules": OP5, "op7_quality_rules": OP7,
            "op9_warc": OP9, "op10_top_k": OP10, "op11_substrings": OP11, "op12_merkle": _merkle(),
            "op13_phrases": OP13}
