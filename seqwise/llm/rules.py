"""Quality rules with risk-controlled thresholds.

Every rule is a measure of a text in thousandths, higher being worse. Cutoffs
are not given but learnt: labelled good documents are the holdout, and for
every stratum (language) and rule the strictest cutoff is taken that provably
rejects few good documents. With n good documents of a stratum of which k lie
above a cutoff, the exact binomial (Clopper-Pearson) upper bound of the
rejection rate is at most ``RISK / rules`` exactly when
P(Binomial(n, RISK / rules) <= k) <= delta; delta is ``ERROR`` divided by the
number of tests, strata times rules (Bonferroni). The sum of the rules'
rejection rates is thus at most ``RISK`` in every stratum, with probability
``1 - ERROR`` over all of them together. A stratum with too few good documents
for any proof gets no cutoff and loses nothing.

At scale: one pass over whole texts to narrow measures; labels meet them by
id; holdout counts are histograms of at most 1001 values per stratum and rule
(partial sums before the shuffle); the binomial sums run over 0..n * risk per
stratum, on rows of their own. All labelled rows count. Plain DataFrame
operations.

Defined results: null and empty texts have no words and fail the base rules;
a null stratum is one of its own; labels with null ids or other values than 1
are no holdout; repeated labels and repeated rows each count; without labels
nothing but the base rules rejects; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqwise.llm.common import words, write_once

MIN_WORDS = 50           # fixed values of the base rules
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"

RISK = 0.02              # good documents that may be rejected, per stratum
ERROR = 0.05             # chance that any stratum loses more
RULES = ["symbols", "dup_lines", "repeats", "short_words", "long_words", "upper"]


def measures(docs: DataFrame, text_col: str, id_col: str, stratum_col: str) -> DataFrame:
    """Base counts and rule values of every whole text.

    A word lies in a repeated 3-word window if the window's hash occurs at
    least twice: hashes with their positions are sorted, equal neighbours give
    the repeated positions, and these, sorted, the words they cover."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"),
                    text.alias("t"), words(text).alias("w"))
    d = d.withColumn("n_words", F.size("w").cast("long"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    hashes = F.when(F.col("n_words") > 2, F.transform(
        F.sequence(F.lit(0), F.col("n_words").cast("int") - 3),
        lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
    d = d.select(
        "doc_id", "stratum", "n_words",
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        F.length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("t", "[^A-Z]+", "")).cast("long").alias("_upper"),
        F.length("t").cast("long").alias("_chars"), lines.alias("lines"), hashes.alias("h"))
    d = d.withColumn("_any", F.coalesce(F.size(F.array_distinct("h")) < F.size("h"), F.lit(False)))
    placed = F.when(F.col("_any"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    d = d.withColumn("p", placed)
    d = d.withColumn("p", F.sort_array(F.transform(
        F.filter("p", lambda x, i: F.coalesce(x["h"] == F.get("p", i - 1)["h"], F.lit(False))
                 | F.coalesce(x["h"] == F.get("p", i + 1)["h"], F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(
        "p", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).cast("long").alias("n"), i.alias("last")),
        lambda a: a["n"])
    d = d.withColumn("n_repeat_words", F.when(F.col("_any"), covered).otherwise(F.lit(0).cast("long")))
    d = d.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))

    def share(part, whole):
        return F.least(F.lit(1000), F.greatest(F.lit(0), F.floor(part * 1000 / F.greatest(whole, F.lit(1))))).cast("int")
    mean = F.col("word_chars") / F.greatest("n_words", F.lit(1))
    values = {"symbols": share(F.col("n_symbols"), F.col("word_chars")),
              "dup_lines": share(F.col("n_dup_lines"), F.size("lines")),
              "repeats": share(F.col("n_repeat_words"), F.col("n_words")),
              "short_words": F.least(F.lit(1000), F.floor(1000 / F.greatest(mean, F.lit(1.0)))).cast("int"),
              "long_words": F.least(F.lit(1000), F.floor(mean * 20)).cast("int"),
              "upper": share(F.col("_upper"), F.col("_chars"))}
    failed = ((F.col("n_words") < MIN_WORDS)
              | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return d.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"), *[values[r].alias(f"v_{r}") for r in RULES])


def allowed_rejections(sizes: DataFrame, risk: float, delta_total: float, rules: int) -> DataFrame:
    """(stratum, n) -> plus k, the most of n that may be rejected: the largest
    k with P(Binomial(n, risk) <= k) <= delta; no row where even 0 is too many.

    Terms come from their logarithms' running sum, on rows (stratum, i)."""
    strata = Window.partitionBy()
    delta = F.lit(delta_total) / (F.count(F.lit(1)).over(strata) * rules)
    i = F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") * risk).cast("long"))
    terms = sizes.withColumn("_delta", delta).select("stratum", "n", "_delta", F.explode(i).alias("i"))
    upto = Window.partitionBy("_s").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    terms = terms.withColumn("_s", F.coalesce(F.concat(F.lit("="), "stratum"), F.lit("")))
    log_step = F.when(F.col("i") == 0, F.col("n") * F.log(F.lit(1 - risk))).otherwise(
        F.log((F.col("n") - F.col("i") + 1) / F.greatest(F.col("i"), F.lit(1))) + F.log(F.lit(risk / (1 - risk))))
    terms = terms.withColumn("_log", F.sum(log_step).over(upto))
    terms = terms.withColumn("_cdf", F.sum(F.exp("_log")).over(upto))
    return terms.where(F.col("_cdf") <= F.col("_delta")).groupBy("stratum").agg(F.max("i").alias("k"))


def cutoffs(measured: DataFrame, labels: DataFrame, id_col: str, label_col: str, risk: float,
            error: float) -> DataFrame:
    """(stratum, rule, cutoff): values above the cutoff are rejected."""
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("doc_id"))
    held = good.join(measured.where(~F.col("base_failed")), "doc_id")
    long = held.select("stratum", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(f"v_{r}").alias("value")) for r in RULES])).alias("x")
        ).select("stratum", "x.*")
    counts = long.groupBy("stratum", "rule", "value").agg(F.count(F.lit(1)).alias("c"))
    counts = write_once(counts, "rule-counts")
    sizes = counts.where(F.col("rule") == RULES[0]).groupBy("stratum").agg(F.sum("c").alias("n"))
    k = allowed_rejections(sizes, risk / len(RULES), error, len(RULES))
    above = Window.partitionBy("stratum", "rule").orderBy(F.col("value").desc()).rowsBetween(
        Window.unboundedPreceding, 0)
    # A value may be the cutoff if at most k good documents lie above it; going
    # down from the largest, the last such value is the strictest.
    c = counts.withColumn("_above", F.sum("c").over(above) - F.col("c"))
    c = c.join(k.withColumnRenamed("stratum", "_st"), F.col("stratum").eqNullSafe(F.col("_st")))
    return c.where("_above <= k").groupBy("stratum", "rule").agg(F.min("value").alias("cutoff"))


def apply_rules(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                stratum_col: str = "lang", label_col: str = "quality", risk: float = RISK,
                error: float = ERROR) -> DataFrame:
    """Per document: doc_id, stratum, the base counts, base_failed, the rule
    values v_<rule> and kept (no base rule and no learnt cutoff rejects it)."""
    measured = write_once(measures(docs, text_col, id_col, stratum_col), "measures")
    cuts = cutoffs(measured, labels, id_col, label_col, risk, error)
    wide = cuts.groupBy("stratum").pivot("rule", RULES).agg(F.first("cutoff"))
    wide = wide.select(F.col("stratum").alias("_st"), *[F.col(r).alias(f"_cut_{r}") for r in RULES])
    j = measured.join(wide, F.col("stratum").eqNullSafe(F.col("_st")), "left")
    above = [F.coalesce(F.col(f"v_{r}") > F.col(f"_cut_{r}"), F.lit(False)) for r in RULES]
    rejected = above[0]
    for a in above[1:]:
        rejected = rejected | a
    return j.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_st", *[f"_cut_{r}" for r in RULES])
