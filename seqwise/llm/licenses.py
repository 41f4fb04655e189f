"""Licence scans: MinHash bands over overlapping text windows find templates,
exact shingle containment verifies them.

Texts and templates are taken as runs of a-z and 0-9 (A-Z lower-cased) and cut
into 5-word shingles, a shorter template being one shingle of all its words. A
template of L shingles is filed under the widest window (1, 4, 16 or 64
shingles) that fits into it, at every offset. Texts are cut into overlapping
windows of the same widths, a quarter apart. Each window has ``BANDS`` bands of
one minimum each: windows of Jaccard similarity s meet in some band with
probability 1 - (1 - s) ** BANDS, 99.8 % at s = 0.65 for six bands, which is
what single windows of a text with containment 0.8 have when the changes are
spread evenly; a template of many windows has many chances.

A window that meets a template is verified exactly: the share of the
template's distinct shingles that occur in the text around the window (windows
within one template length are verified together). Windows without any
template shingle have similarity 0 to all templates and are passed over before
any minimum is taken.

Siblings: a text of one licence may contain 0.8 of another's template too (the
GPL sentences differ in their last word; GPL and AGPL in a few paragraphs). A
template is reported only if no verified template of another licence over the
same text beats it: it is beaten if the text has none of the shingles that tell
it from the rival, or less than half of them and a smaller share of them than
of the rival's own. A text with nothing that tells two licences apart has
neither; a template inside another licence's loses if the text has over half of
the rest.

Windows meet the templates' distinct bands in a broadcast join; what is
shuffled is one narrow row per document, template and place, and the shingles
of the documents met. What a pass looks for is written into its plan, so
templates are taken in groups of ``GROUP_SHINGLES`` shingles, a pass over the
tokens each (written once, if there are several groups): any number of templates
is scanned for exactly. Rivals are found by joining templates on the shingles
they share, over all groups. Plain DataFrame operations.

Defined results: null and empty texts have no licence; a template without
words is never found; templates with equal words are each reported; repeated
rows each get their rows; empty tables give no rows.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwise.llm.common import ascii_lower, materialize, write_once

SHINGLE = 5
WIDTHS = (1, 4, 16, 64)
BANDS = 6
CONTAINMENT = 0.8
SIBLING = 0.5              # a template with this share of another's shingles is its rival
GROUP_SHINGLES = 50_000    # shingles of the templates that one pass looks for

# Statements by which texts declare public licences.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def license_texts() -> list[tuple[str, str]]:
    """Whole licence texts and standard notices: the files of ``license_texts``,
    named by licence, with ``__notice`` (a standard notice) or ``__grant`` (its
    first paragraph) after it."""
    names = sorted(f for f in resources.files("seqwise.llm").joinpath("license_texts").iterdir() if f.name.endswith(".txt"))
    return [(f.name[:-4].split("__")[0], f.read_text(encoding="utf-8")) for f in names]


def templates_table(spark: SparkSession, templates=None) -> DataFrame:
    """The table of ``templates``; by default the statements and the texts."""
    templates = TEMPLATES + license_texts() if templates is None else templates
    rows = [(i, license_id, text) for i, (license_id, text) in enumerate(templates)]
    return spark.createDataFrame(rows, "template long, license_id string, text string")


def _tokens(text: Column) -> Column:
    low = F.btrim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))
    return F.when(low == "", F.array().cast("array<string>")).otherwise(F.split(low, " "))


def _windows_of_words(tokens: str, n: Column) -> Column:
    """Hashes of all n-word windows of a token array."""
    last = F.size(tokens) - n
    return F.when(last < 0, F.array().cast("array<long>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(
            *[F.when(F.lit(k) < n, F.get(tokens, i + k)) for k in range(SHINGLE)])))


def template_shingles(templates: DataFrame) -> DataFrame:
    """template, license_id, words (a shingle's), h (hashes in order)."""
    # materialized: else the plan puts the tokeniser inside the window expressions, once per word
    t = materialize(templates.select("template", "license_id", _tokens(F.col("text")).alias("_w"))).where(F.size("_w") > 0)
    n = F.least(F.size("_w"), F.lit(SHINGLE))
    return t.select("template", "license_id", n.alias("words"), _windows_of_words("_w", n).alias("h"))


def _band_keys(h: Column) -> Column:
    """The minima of a window: one per band, marked with the band."""
    def low(band: int) -> Column:
        return F.array_min(F.transform(h, lambda x: F.xxhash64(x, F.lit(band))))
    return F.array(*[F.struct(F.lit(b).alias("band"), low(b).alias("low")) for b in range(BANDS)])


def _known(hashes: list[int]) -> str:
    """SQL: whether the shingle ``x`` is one of ``hashes`` (a hash set look-up)."""
    return f"x IN ({', '.join(f'{h}L' for h in hashes)})".replace("-9223372036854775808L", "cast('-9223372036854775808' AS bigint)")


def _width(size: Column) -> Column:
    """The widest window that fits into a template of ``size`` shingles."""
    return F.element_at(F.filter(F.array(*[F.lit(w) for w in WIDTHS]), lambda w: (w == 1) | (w * 5 <= size * 4)), -1)


def template_bands(shingled: DataFrame) -> DataFrame:
    """Distinct bands of the templates' windows: template, words, t_n, width, band, low."""
    t = shingled.select("template", "words", "h", F.size("h").alias("t_n"), _width(F.size("h")).alias("width"))
    t = t.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("t_n") - F.col("width"))))
    t = t.select("template", "words", "t_n", "width", F.slice("h", F.col("_at") + 1, F.col("width")).alias("h"))
    return (t.select("template", "words", "t_n", "width", F.explode(_band_keys("h")).alias("_k"))
            .select("template", "words", "t_n", "width", "_k.band", "_k.low").distinct())


def template_rivals(shingled: DataFrame) -> DataFrame:
    """template, license_id, t_n, t_set, rivals (templates of other licences
    that hold at least ``SIBLING`` of its shingles: ``theirs`` is what only the
    rival has, ``mine`` what only the template has) and ``reach``, the length
    of the longest of them all."""
    t = shingled.select("template", "license_id", "words", F.size("h").alias("t_n"), F.array_distinct("h").alias("t_set"))
    each = t.select("template", "license_id", "words", F.explode("t_set").alias("x"))
    a, b = each.alias("a"), each.alias("b")
    shared = (a.join(b, (F.col("a.x") == F.col("b.x")) & (F.col("a.words") == F.col("b.words"))
                     & (F.col("a.license_id") != F.col("b.license_id")))
              .groupBy(F.col("a.template").alias("mine"), F.col("b.template").alias("theirs"))
              .agg(F.count(F.lit(1)).alias("shared")))
    a, b = t.alias("a"), t.alias("b")
    pairs = (shared.join(a, F.col("mine") == F.col("a.template")).where(F.col("shared") >= F.size("a.t_set") * SIBLING)
             .join(b, F.col("theirs") == F.col("b.template")))
    rivals = pairs.groupBy(F.col("a.template").alias("template")).agg(
        F.collect_list(F.struct(F.col("b.t_set").alias("all"), F.array_except("a.t_set", "b.t_set").alias("mine"),
                                F.array_except("b.t_set", "a.t_set").alias("theirs"))).alias("rivals"),
        F.max("b.t_n").alias("_r"))
    return (t.join(rivals, "template", "left")
            .withColumn("reach", F.greatest("t_n", F.coalesce("_r", F.lit(0)))).drop("words", "_r"))


def _share(part: Column, text: Column) -> Column:
    """The share of the shingles ``part`` in ``text``; 0 of none."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(part, text)), F.size(part)), F.lit(0.0))


def _beaten(rival: Column, near: Column, wide: Column, containment: float) -> Column:
    """Whether the text is the rival's rather than the template's: the text as
    far as the template reaches, and as far as the longest rival does."""
    theirs = _share(rival["theirs"], wide)
    mine = F.when(F.size(rival["mine"]) == 0, 1 - theirs).otherwise(_share(rival["mine"], near))
    return (_share(rival["all"], wide) >= containment) & ((mine == 0) | ((mine < theirs) & (mine < 0.5)))


def _around(reach: Column, width: Column) -> Column:
    """The shingles of ``h`` up to ``reach`` before and after the windows."""
    begin = F.greatest(F.col("lo") - reach, F.lit(0))
    return F.slice("h", begin + 1, F.col("hi") + reach + width - begin)


def scan_licenses(docs: DataFrame, templates: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                  containment: float = CONTAINMENT) -> DataFrame:
    """Per document and licence found: doc_id, license_id, containment (the
    best of its templates) and n_templates (verified templates)."""
    shingled = materialize(template_shingles(templates))
    whole = materialize(template_rivals(shingled))
    d = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").alias("doc_id"),
                    _tokens(F.col(f"`{text_col}`")).alias("_w"))
    found, groups = None, _groups(shingled)
    if len(groups) > 1:  # tokenised and numbered once
        d = write_once(d, "licence-tokens")
    for i, group in enumerate(groups):
        x = write_once(_matches(d, shingled.where(F.col("template").isin(group)), whole, containment), f"licences-{i}")
        found = x if found is None else found.unionByName(x)
    if found is None:
        return d.select("doc_id", F.lit("").alias("license_id"), F.lit(0.0).alias("containment"),
                        F.lit(0).cast("long").alias("n_templates")).limit(0)
    best = found.groupBy("_row", "doc_id", "license_id", "template").agg(F.max("c").alias("c"))
    return best.groupBy("_row", "doc_id", "license_id").agg(
        F.max("c").alias("containment"), F.count(F.lit(1)).alias("n_templates")).drop("_row")


def _groups(shingled: DataFrame) -> list[list[int]]:
    """Templates in groups of ``GROUP_SHINGLES`` shingles; one that has more is
    a group of its own. The driver holds a number a template."""
    out, held = [], 0
    for r in shingled.select("template", F.size("h").alias("n")).orderBy("template").collect():
        if not out or held + r.n > GROUP_SHINGLES:
            out, held = [*out, []], 0
        out[-1].append(r.template)
        held += r.n
    return out


def _matches(d: DataFrame, shingled: DataFrame, whole: DataFrame, containment: float) -> DataFrame:
    """_row, doc_id, license_id, template and c of the places where templates of
    one group are verified; rivals are those of all groups. Every group reads the
    texts once: what it looks for is part of the plan."""
    known = (shingled.select("words", _width(F.size("h")).alias("width"), F.explode("h").alias("x")).distinct().collect())
    bands = materialize(template_bands(shingled))
    sizes = sorted({k.words for k in known})
    # One pass over the texts; what goes on are documents with a known shingle.
    some = F.lit(False)
    for n in sizes:
        some = some | F.expr(f"exists(h{n}, x -> {_known(sorted({k.x for k in known if k.words == n}))})")
    held = write_once(d.select("_row", "doc_id", *[_windows_of_words("_w", F.lit(n)).alias(f"h{n}") for n in sizes])
                      .where(some), "licensed")
    met = None
    for n, width in sorted({(k.words, k.width) for k in known}):
        mine = sorted({k.x for k in known if (k.words, k.width) == (n, width)})
        at = F.expr(f"filter(transform(h{n}, (x, i) -> if({_known(mine)}, i, null)), i -> i is not null)")
        # windows that hold a known shingle, a quarter apart
        step = max(1, width // 4)
        starts = F.array_distinct(F.flatten(F.transform(at, lambda i: F.filter(
            F.array(*[i - i % step - k * step for k in range(width // step)]), lambda p: p >= 0))))
        w = held.select("_row", F.col(f"h{n}").alias("h"), F.explode(starts).alias("at"))
        w = w.select("_row", "at", F.slice("h", F.col("at") + 1, F.lit(width)).alias("h"))
        w = w.select("_row", "at", F.explode(_band_keys("h")).alias("_k"))
        found = w.join(F.broadcast(bands.where((F.col("width") == width) & (F.col("words") == n))),
                       (F.col("_k.band") == F.col("band")) & (F.col("_k.low") == F.col("low")))
        # windows nearer to each other than the template is long are verified together
        found = found.groupBy("_row", "template", F.floor(F.col("at") / F.col("t_n")).alias("_b")).agg(
            F.min("at").alias("lo"), F.max("at").alias("hi"), F.first("words").alias("words"), F.first("width").alias("width"))
        met = found if met is None else met.unionByName(found)
    h = F.col(f"h{sizes[0]}")
    for n in sizes[1:]:
        h = F.when(F.col("words") == n, F.col(f"h{n}")).otherwise(h)
    x = (met.drop("_b").join(held, "_row").select("_row", "doc_id", "template", "lo", "hi", "width", h.alias("h"))
         .join(F.broadcast(whole), "template"))
    x = x.withColumn("_near", _around(F.col("t_n"), F.col("width")))
    x = x.withColumn("c", _share(F.col("t_set"), F.col("_near"))).where(F.col("c") >= containment)
    x = x.withColumn("_wide", F.when(F.col("rivals").isNotNull(), _around(F.col("reach"), F.col("width"))))
    x = x.where(F.col("rivals").isNull() | ~F.exists("rivals", lambda r: _beaten(r, F.col("_near"), F.col("_wide"), containment)))
    return x.groupBy("_row", "doc_id", "license_id", "template").agg(F.max("c").alias("c"))
