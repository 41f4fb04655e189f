"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order (md5 of the id, rows
of one id and those without by a hash of the whole row), followed by the same documents again up to ``max_repeats`` times. An entry's
virtual finish time is the number of source words up to and including it,
divided by the source's target. Serving entries by finish time and stopping at
the total budget gives every source words in proportion to its target.

At scale: all prefix sums are two-level. A source is cut into hash ranges, the
sums of the ranges are added up over a table of at most ``RANGES`` rows a
source (and as many for each id of over ``TIES`` rows, which gets ranges of its
own by the row hash), and each range is ordered in its own task, so a source
or an id with a third of all rows is spread over thousands of tasks; only rows
equal in every column stay together. The global order by finish time is
a range sort as well: sums per range of virtual time locate the range where the
budget ends, and only that range is ordered. Plain DataFrame operations.

Defined results: null text has size 0; a null source is a source of its own
(last in order); null ids take part; documents of size 0 and sources of size 0
take nothing; an empty table gives no rows; repeated rows are separate entries.
Whole documents are taken, so a source may miss its target by about one of its
documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqwise.llm.common import broadcast_up_to, materialize, own_names, word_count

WEIGHTS = (5, 2, 1)      # by the sources' order, repeating
BUDGET = 1.5             # words of the mix per word of input
MAX_REPEATS = 2          # a source's target stops at this many times its size
SOURCES = 10_000         # up to so many sources their table is broadcast, else joined
RANGES = 4096            # hash ranges of a source, and ranges of virtual time
TIES = 100_000           # rows of one id from which they get ranges of their own


def shuffle_key(doc_id: Column) -> Column:
    """First 60 bits of md5(id) as a long: a fixed shuffle of the documents."""
    hexed = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15)
    return F.conv(hexed, 16, 10).cast("long")


def row_key(docs: DataFrame) -> Column:
    """60 bits of a hash of the whole row: the order of rows with equal ids."""
    return F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t]), 4)


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET,
            max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> plus ``weight`` and ``target``.

    Water filling: target = min(max_repeats * size, level * weight) with the
    level that spends the budget. Sources ordered by the level at which they
    fill up; each is full if its level lies under the level left for the rest.
    One row a source, the only table that is ordered as a whole."""
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(everything)
    cap = F.col("source_size") * F.lit(max_repeats)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (rank - 1) % len(weights) + 1)
    whole = Window.partitionBy()
    t = (sizes.select("source", "source_size", w.alias("weight"))
         .withColumn("_budget", F.sum("source_size").over(whole) * F.lit(budget))
         .withColumn("_weights", F.sum("weight").over(whole))
         .withColumn("_full_at", cap / F.col("weight")))
    earlier = Window.orderBy("_full_at", F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    left = F.col("_budget") - F.coalesce(F.sum(cap).over(earlier), F.lit(0))
    t = t.withColumn("_level", left / (F.col("_weights") - F.coalesce(F.sum("weight").over(earlier), F.lit(0))))
    full = F.col("_full_at") <= F.col("_level")
    t = t.withColumn("_common", F.min(F.when(~full, F.struct("_full_at", "_level"))).over(whole))
    target = F.when(full, cap.cast("double")).otherwise(F.col("weight") * F.col("_common._level"))
    return t.select("source", "source_size", "weight", target.alias("target"))


def _tie_ranges(rows: DataFrame) -> DataFrame:
    """``rows`` plus ``_q``: within a hash range, in the order of (key, tie),
    the ranges of the ids with more than ``TIES`` rows and the rows between."""
    heavy = materialize(rows.groupBy("_s", "_r", "key").count().where(F.col("count") > TIES))
    lists = broadcast_up_to(materialize(heavy.groupBy("_s", "_r").agg(F.collect_list("key").alias("_heavy"))), SOURCES)
    earlier = F.size(F.filter("_heavy", lambda k: k < F.col("key"))) * (2 * RANGES)
    own = F.shiftright("tie", 60 - RANGES.bit_length() + 1).cast("int") + RANGES
    q = earlier + F.when(F.array_contains("_heavy", F.col("key")), own).otherwise(0)
    return rows.join(lists, ["_s", "_r"], "left").withColumn(
        "_q", F.when(F.col("_heavy").isNull(), 0).otherwise(q)).drop("_heavy")


def queue(sized: DataFrame, weights=WEIGHTS, budget: float = BUDGET,
          max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(doc_id, source, size, key, tie) -> plus source_size, target and
    ``served``, the source's words up to and including the row, in the order
    of ``key`` and ``tie``."""
    rows = sized.withColumn("_s", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn(
        "_r", F.shiftright("key", 60 - RANGES.bit_length() + 1)).withColumn("_q", F.lit(0))

    def sums(x: DataFrame) -> DataFrame:
        return materialize(x.groupBy("_s", "_r", "_q").agg(
            F.sum("size").alias("_n"), F.count(F.lit(1)).alias("_rows"), F.first("source").alias("source")))
    ranges = sums(rows)
    if not ranges.where(F.col("_rows") > TIES).isEmpty():
        rows = _tie_ranges(rows.drop("_q"))
        ranges = sums(rows)
    total = ranges.groupBy("_s").agg(F.sum("_n").alias("source_size"), F.first("source").alias("source"))
    t = targets(total.select("source", "source_size"), weights, budget, max_repeats)
    t = t.withColumn("_s", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    before = F.sum("_n").over(Window.partitionBy("_s").orderBy("_r", "_q").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranges.select("_s", "_r", "_q", F.coalesce(before, F.lit(0)).alias("_before")).join(t, "_s")
    inside = (Window.partitionBy("_s", "_r", "_q").orderBy("key", "tie", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_upto", F.sum("size").over(inside))
    return (rows.join(offsets, ["_s", "_r", "_q"])
            .withColumn("served", F.col("_before") + F.col("_upto"))
            .drop("_s", "_r", "_q", "_before", "_upto"))


def _place(finish: Column) -> Column:
    """Finish time (0 to infinity) -> 0 to RANGES, in the same order."""
    return finish / (finish + 1) * RANGES


def cut_off(queued: DataFrame, budget_words: float, max_repeats: int = MAX_REPEATS) -> float:
    """The last virtual finish time within the budget (0 if nothing fits)."""
    rounds = F.array(*[F.lit(i) for i in range(max_repeats)])
    e = (queued.where("size > 0").select("size", "served", "source_size", "target", F.explode(rounds).alias("_k"))
         .select("size", F.try_divide(F.col("served") + F.col("_k") * F.col("source_size"), F.col("target")).alias("finish"))
         .withColumn("_p", _place(F.col("finish"))))
    coarse, fine = F.floor("_p"), F.floor((F.col("_p") - F.floor("_p")) * RANGES)

    def last_within(part: DataFrame, key: Column, spent: float) -> tuple[float | None, float]:
        """First key at which the running sum passes the budget; the sum before it."""
        sums = part.groupBy(key.alias("_b")).agg(F.sum("size").alias("_n"))
        upto = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) + F.lit(spent)
        row = (sums.select("_b", "_n", upto.alias("_upto")).where(F.col("_upto") > F.lit(budget_words))
               .agg(F.min(F.struct("_b", "_upto", "_n")).alias("m")).first().m)
        return (None, spent) if row is None else (row._b, row._upto - row._n)

    over, spent = last_within(e, coarse, 0)
    if over is None:
        return float("inf")
    over2, spent = last_within(e.where(coarse == over), fine, spent)
    here = (coarse == over) & (fine == over2)
    stop, _ = last_within(e.where(here), F.col("finish"), spent)
    return e.where((F.col("finish") < F.lit(stop))).agg(F.max("finish")).first()[0] or 0.0


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source",
        weights=WEIGHTS, budget: float = BUDGET, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies (times
    the document is in the mix) and taken (words of those copies)."""
    sized = materialize(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"), shuffle_key(F.col(id_col)).alias("key"),
        row_key(docs).alias("tie")))
    q = materialize(queue(sized, weights, budget, max_repeats))
    words_in = sized.agg(F.sum("size")).first()[0] or 0
    stop = cut_off(q, words_in * budget, max_repeats)
    copies = sum(F.when(F.try_divide(F.col("served") + F.lit(k) * F.col("source_size"), F.col("target")) <= stop, 1)
                 .otherwise(0) for k in range(max_repeats))
    return (q.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0))
            .withColumn("taken", (F.col("size") * F.col("copies")).cast("long"))
            .select("doc_id", "source", "key", "tie", "size", "source_size", "target", "copies", "taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in the mix, each as often as it is taken.

    Within a source the mix takes the rows up to a place (key, tie) in the
    shuffled order, so one row a source and round says what is taken and no
    text is shuffled. Only rows equal in every column share a place; where the
    mix ends among them, one of them stands for the copies taken."""
    docs, at, back = own_names(docs)
    options = options | {c: at[options.get(c, d)] for c, d in
                         (("text_col", "text"), ("id_col", "doc_id"), ("source_col", "source"))}
    plan = mix(docs, **options)
    place = F.struct("key", "tie")
    last = plan.where("copies > 0").groupBy("source").agg(
        *[F.max(F.when(F.col("copies") > k, place)).alias(f"_to{k}")
          for k in range(options.get("max_repeats", MAX_REPEATS))])
    last = materialize(last)
    last = broadcast_up_to(last, SOURCES).select(F.col("source").alias("_source"), *[c for c in last.columns if c != "source"])
    tos = [c for c in last.columns if c.startswith("_to")]
    at_end = F.lit(False)
    for c in tos:
        at_end = at_end | F.coalesce(F.struct("key", "tie") == F.col(c), F.lit(False))
    ends = plan.where("size > 0").join(last, F.col("source").eqNullSafe(F.col("_source"))).where(at_end)
    cut = ends.groupBy("_source", "key", "tie").agg(
        F.sum("copies").alias("n"), F.min("copies").alias("_lo"), F.max("copies").alias("_hi")).where("_lo < _hi")
    cut = materialize(cut.groupBy("_source").agg(F.collect_list(F.struct("key", "tie", "n")).alias("_cut")))
    id_col, source_col = options["id_col"], options["source_col"]
    some = F.col(options["text_col"]).rlike("[^\\x20\\x09-\\x0D]")
    j = docs.where(some).withColumn("_key", shuffle_key(F.col(id_col))).withColumn("_tie", row_key(docs))
    j = j.join(last, F.col(source_col).cast("string").eqNullSafe(F.col("_source")))
    times = sum(F.when(F.struct(F.col("_key").alias("key"), F.col("_tie").alias("tie")) <= F.col(c), 1).otherwise(0) for c in tos)
    j = j.withColumn("_times", times)

    def copies(x: DataFrame) -> DataFrame:
        return (x.where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
                .select(*docs.columns))
    if cut.isEmpty():
        return back(copies(j))
    j = j.join(broadcast_up_to(cut.withColumnRenamed("_source", "_with"), SOURCES),
               F.col("_source").eqNullSafe(F.col("_with")), "left")
    mine = F.filter(F.col("_cut"), lambda c: (c["key"] == F.col("_key")) & (c["tie"] == F.col("_tie")))
    j = j.withColumn("_n", F.get(mine, F.lit(0))["n"])
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = (j.where("_n is not null").groupBy("_source", "_key", "_tie")
           .agg(F.first(whole).alias("_one"), F.first("_n").alias("_times")).select("_one.*", "_times"))
    return back(copies(j.where("_n is null")).unionByName(copies(one)))
