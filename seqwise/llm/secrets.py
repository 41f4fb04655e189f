"""Secret scans with corpus-wide ownership frequency.

Three fixed rules (assign, access, hex) give the base spans of every whole
text. A fourth, ``mixed``, looks for long tokens of mixed characters and high
entropy. The hash of every candidate value is counted over the corpus by
distinct repositories and owners: values that many owners share are copied
examples, values of few owners look live. Base spans always stay and get that
verdict; ``mixed`` spans are added only where they look live and overlap no
base span.

At scale: texts are scanned once, in place, and only spans and hashes are
shuffled. Ownership is counted in steps (hash+owner+repository, hash+owner,
hash), each with partial sums before the shuffle, so an example in a third of
all documents costs one row a task. Hashes, not secrets, leave the scan. The
lookup back is a join whose hot hashes adaptive execution splits.

Defined results: null and empty texts have no spans; null owners and
repositories count as one more owner and repository; repeated rows are
separate documents of one owner; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwise.llm.common import small_batches, write_once

# The base rules, in order, and the least length of what they find.
KINDS = ["assign", "access", "hex", "mixed"]
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""",
                    re.IGNORECASE | re.ASCII)
ASSIGN_VALUE = re.compile(r"[A-Za-z0-9+/_.=-]+")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of [0-9a-f]+ is kept from 32 characters on
ASSIGN_MIN, ACCESS_MIN = 8, 16

# Added candidates and the ownership up to which a value looks live.
MIXED = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
MIXED_ENTROPY = 3.5
LIVE_OWNERS, LIVE_REPOSITORIES = 2, 4

_SPAN = "struct<kind:int,start:int,end:int,value:string>"


def assign_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost, non-overlapping matches; short values are dropped but use up
    their characters. Keyword and value are matched one after the other."""
    out, at = [], 0
    while m := ASSIGN.search(text, at):
        value = ASSIGN_VALUE.match(text, m.end())
        if value is None:
            # the optional quote or spaces may not be given back for a value:
            # none of them is a value character, so this keyword cannot match
            at = m.start() + 1
            continue
        if value.end() - value.start() >= ASSIGN_MIN:
            out.append((m.start(), value.end(), value.group()))
        at = value.end()
    return out


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def scan(text: str | None) -> list[tuple[int, int, int, str]]:
    """All candidate spans (kind, start, end, value) of a text, in code points."""
    if not text:
        return []
    spans = [(0, a, b, v) for a, b, v in assign_spans(text)]
    if "AKIA" in text:
        spans += [(1, m.start(), m.end(), m.group()) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= ACCESS_MIN]
    spans += [(2, m.start(), m.end(), m.group()) for m in HEX.finditer(text)]
    starts = sorted(a for _, a, _, _ in spans)
    reach = list(accumulate((b for _, b in sorted((a, b) for _, a, b, _ in spans)), max))  # furthest end so far

    def free(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return not before or reach[before - 1] <= start
    for m in MIXED.finditer(text):
        v = m.group()
        if (re.search(r"[0-9]", v) and re.search(r"[A-Z]", v) and re.search(r"[a-z]", v)
                and free(m.start(), m.end()) and entropy(v) >= MIXED_ENTROPY):
            spans.append((3, m.start(), m.end(), v))
    return sorted(spans, key=lambda s: (s[1], s[0]))


def _scanner(text_name: str, keep_text: bool):
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])

    def run(batches):
        for b in batches:
            rows, digests = [], []
            for text in b.column(text_name):
                found = scan(text.as_py())
                rows.append([{"kind": k, "start": s, "end": e, "value": hashlib.sha256(v.encode()).hexdigest()}
                             for k, s, e, v in found])
                base = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e, _ in found if k < 3)
                digests.append(hashlib.sha256(base.encode()).hexdigest())
            names = [c for c in b.schema.names if keep_text or c != text_name]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in names], pa.array(rows, pa.list_(span)), pa.array(digests, pa.string())],
                names=[*names, "candidates", "base_sha256"])
    return run


def candidates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", owner_col: str = "source",
               repo_col: str = "lang", carry: bool = False) -> DataFrame:
    """One row per document: _row, doc_id, _owner, _repo, candidates,
    base_sha256; with ``carry`` also its columns, as _doc_0, _doc_1, ..."""
    owner = F.coalesce(F.concat(F.lit("="), F.col(owner_col).cast("string")), F.lit(""))
    repo = F.coalesce(F.concat(F.lit("="), F.col(repo_col).cast("string")), F.lit(""))
    texts = ([F.col(f"`{c}`").alias(f"_doc_{i}") for i, c in enumerate(docs.columns)] if carry
             else [F.col(text_col).alias("_text")])
    slim = small_batches(docs).select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"),
                       owner.alias("_owner"), F.concat(owner, F.lit("/"), repo).alias("_repo"), *texts)
    text_name = f"_doc_{docs.columns.index(text_col)}" if carry else "_text"
    kept = ", ".join(f"{n} {t}" for n, t in slim.dtypes if carry or n != text_name)
    return slim.mapInArrow(_scanner(text_name, carry),
                           f"{kept}, candidates array<{_SPAN}>, base_sha256 string")


def ownership(found: DataFrame) -> DataFrame:
    """Per candidate value (hash): distinct owners and repositories."""
    flat = found.select("_owner", "_repo", F.explode("candidates.value").alias("value"))
    return (flat.groupBy("value", "_owner", "_repo").agg(F.lit(1).alias("_one"))
            .groupBy("value", "_owner").agg(F.count("_one").alias("_repos"))
            .groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("_repos").alias("repositories")))


def judge(rows: DataFrame, live_owners: int = LIVE_OWNERS,
          live_repositories: int = LIVE_REPOSITORIES) -> DataFrame:
    """``candidates`` (written) -> _row and ``found``, the spans that stay, by
    start: array of (start, kind, end, owners, repositories, live)."""
    flat = rows.select("_row", F.explode("candidates").alias("c")).select("_row", "c.*")
    live = (F.col("owners") <= live_owners) & (F.col("repositories") <= live_repositories)
    judged = (flat.join(ownership(rows), "value").withColumn("live", live)
              .where((F.col("kind") < 3) | F.col("live")))
    return judged.groupBy("_row").agg(F.sort_array(F.collect_list(
        F.struct("start", "kind", "end", "owners", "repositories", "live"))).alias("found"))


def scan_secrets(docs: DataFrame, live_owners: int = LIVE_OWNERS,
                 live_repositories: int = LIVE_REPOSITORIES, **columns) -> DataFrame:
    """Per document: doc_id, base_sha256 and ``found`` (see ``judge``)."""
    rows = write_once(candidates(docs, **columns), "secrets")
    spans = judge(rows, live_owners, live_repositories)
    none = F.array().cast(spans.schema["found"].dataType)
    return rows.join(spans, "_row", "left").select("doc_id", "base_sha256", F.coalesce("found", none).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and spans of ``scan_secrets`` as the flat result columns."""
    def count(k):
        return F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.array_join(F.transform("found", lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), "base_sha256",
        text.alias("spans"), count(3).alias("n_added"),
        F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"))


MASK = "[SECRET]"


def mask_secrets(docs: DataFrame, text_col: str = "text", n_chars_col: str | None = "n_chars",
                 live_owners: int = LIVE_OWNERS, live_repositories: int = LIVE_REPOSITORIES,
                 **columns) -> DataFrame:
    """``docs`` with every span found replaced by MASK and n_chars counted anew.

    Documents without candidates pass where they are; only the others meet
    their verdicts in a join."""
    rows = write_once(candidates(docs, text_col=text_col, carry=True, **columns), "secrets")
    at = {c: f"_doc_{i}" for i, c in enumerate(docs.columns)}
    text = F.col(at[text_col])
    # Spans may overlap (a hex value in an assignment): one joint mask for each
    # run of overlapping spans, and the text between the runs is kept.
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, s):
        kept = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK))
        return F.struct(F.when(s["start"] >= acc["at"], kept).otherwise(acc["out"]).alias("out"),
                        F.greatest(acc["at"], s["end"]).alias("at"))
    masked = F.aggregate("found", start, step,
                         lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    hit = (rows.where(F.size("candidates") > 0)
           .join(judge(rows, live_owners, live_repositories), "_row", "left")
           .withColumn("_new", F.when(F.col("found").isNull(), text).otherwise(masked)))
    size = F.length("_new").cast(docs.schema[n_chars_col].dataType) if n_chars_col in docs.columns else None
    changed = hit.select(*[(F.col("_new") if c == text_col else size if c == n_chars_col else F.col(at[c])).alias(c)
                           for c in docs.columns])
    clean = rows.where(F.size("candidates") == 0).select(*[F.col(at[c]).alias(c) for c in docs.columns])
    return clean.unionByName(changed)
