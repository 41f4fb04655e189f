"""Vocabularies as tables ``(feature, value, id)``.

Static vocabularies are literal maps (see functions.columns.encode_static).
Dynamic ones are built from the data: 0 <PAD>, 1 <UNK>, then the distinct
non-null values in order of first appearance (by event_time, event_id).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqwise.functions.columns import epoch_us
from seqwise.functions.constants import DYNAMIC_FEATURES, DYNAMIC_RESERVED, STATIC_VOCABS
from seqwise.operators.ranking import RankedTable
from seqwise.operators.util import broadcast_checked


def _long_form(events: DataFrame, features: list[str]) -> DataFrame:
    stack = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in features)
    return events.selectExpr("event_time", "event_id",
                             f"stack({len(features)}, {stack}) AS (feature, value)")


# Values, of all features, up to which one task a feature numbers them.
RANK_IN_ONE_TASK = 100_000


def build_vocab(events: DataFrame, features: list[str] = DYNAMIC_FEATURES,
                rank_in_one_task: int = RANK_IN_ONE_TASK) -> DataFrame:
    """Dynamic vocabulary table.

    First appearance = smallest (event_time, event_id). A minimum over a struct
    would force a sort-based aggregate over every unpivoted row, so it is done
    as two hash aggregates: the earliest time per (feature, value), then the
    smallest event id among only the rows at that time (joined against the
    distinct-value table, whose size is counted before it is broadcast)."""
    first = _first_seen(events, features)
    learned = _numbered(first, rank_in_one_task).select(
        "feature", "value", (F.col("rank") + F.lit(len(DYNAMIC_RESERVED) - 1)).cast("int").alias("id"))
    return learned.unionByName(reserved_rows(events.sparkSession, features))


def extend_vocab(vocab: DataFrame, events: DataFrame, features: list[str] = DYNAMIC_FEATURES,
                 rank_in_one_task: int = RANK_IN_ONE_TASK) -> DataFrame:
    """``vocab`` with the values of ``events`` that it lacks: old ids stay, new
    ones follow the feature's largest, in order of first appearance."""
    vocab = vocab.unionByName(reserved_rows(events.sparkSession, features)).groupBy("feature", "value").agg(
        F.min("id").alias("id"))  # features without rows yet begin with the reserved ones
    new = _first_seen(events, features).join(vocab.select("feature", "value"), ["feature", "value"], "left_anti")
    last = vocab.groupBy(F.col("feature").alias("f")).agg(F.max("id").alias("last"))  # a row a feature
    added = _numbered(new, rank_in_one_task).join(F.broadcast(last), F.col("feature") == F.col("f")).select(
        "feature", "value", (F.col("last") + F.col("rank")).cast("int").alias("id"))
    return vocab.unionByName(added)


def _numbered(first: DataFrame, rank_in_one_task: int) -> DataFrame:
    """(feature, value, rank) in order of appearance: by a window where there are
    few values, else range by range (see ``operators.ranking``)."""
    order = ["_t", "_id", "value"]
    first = first.persist()
    if first.limit(rank_in_one_task + 1).count() <= rank_in_one_task:
        w = Window.partitionBy("feature").orderBy(*order)
        return first.select("feature", "value", F.row_number().over(w).alias("rank"))
    return RankedTable(first, order, group="feature").ranks().select("feature", "value", "rank")


def _first_seen(events: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value, _t, _id): every value with its first time and, there,
    its least event id."""
    present = [c for c in features if c in events.columns]
    lf = _long_form(events, present).where(F.col("value").isNotNull())
    lf = lf.withColumn("_t", epoch_us(lf, "event_time")).select("feature", "value", "_t", "event_id")
    first_t = lf.groupBy("feature", "value").agg(F.min("_t").alias("_t"))
    at_first = lf.join(broadcast_checked(first_t), ["feature", "value", "_t"], "left_semi")
    return at_first.groupBy("feature", "value").agg(F.min("_t").alias("_t"), F.min("event_id").alias("_id"))


def reserved_rows(spark: SparkSession, features: list[str] = DYNAMIC_FEATURES) -> DataFrame:
    rows = [(f, v, i) for f in features for i, v in enumerate(DYNAMIC_RESERVED)]
    return spark.createDataFrame(rows, "feature string, value string, id int")


def static_vocab_table(spark: SparkSession) -> DataFrame:
    rows = [(f, v, i) for f, vals in STATIC_VOCABS.items() for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "feature string, value string, id int")


def encode_dynamic(events: DataFrame, vocab: DataFrame, features: list[str] = DYNAMIC_FEATURES,
                   suffix: str = "_id") -> DataFrame:
    """Dynamic encode, unknown/null -> 1. One broadcast lookup per feature
    (vocabulary size is counted before it is broadcast)."""
    v = broadcast_checked(vocab)
    out = events
    for c in features:
        if c not in events.columns:
            continue
        lk = v.where(F.col("feature") == c).select(F.col("value").alias(f"_v_{c}"),
                                                   F.col("id").alias(f"_i_{c}"))
        out = (out.join(lk, F.col(c).cast("string") == F.col(f"_v_{c}"), "left")
               .withColumn(c + suffix, F.coalesce(F.col(f"_i_{c}"), F.lit(1)).cast("int"))
               .drop(f"_v_{c}", f"_i_{c}"))
    return out


def decode(df: DataFrame, id_col: str, vocab: DataFrame, feature: str, out_col: str,
           missing: str = "unknown") -> DataFrame:
    """Reverse lookup id -> value; a miss gives ``missing``."""
    lk = broadcast_checked(vocab.where(F.col("feature") == feature)
                           .select(F.col("id").alias("_rid"), F.col("value").alias("_rval")))
    return (df.join(lk, F.col(id_col) == F.col("_rid"), "left")
            .withColumn(out_col, F.coalesce(F.col("_rval"), F.lit(missing))).drop("_rid", "_rval"))


def vocab_sizes(vocab: DataFrame) -> DataFrame:
    return vocab.groupBy("feature").agg(F.count(F.lit(1)).alias("size"))


def save_vocab(vocab: DataFrame, path: str) -> None:
    """One JSON folder per feature (partitioned by feature); the values of a
    large feature are written by many tasks."""
    vocab.repartition("feature", F.expr("id div 1000000")).write.mode("overwrite").partitionBy("feature").json(path)


def load_vocab(spark: SparkSession, path: str, features: list[str] = DYNAMIC_FEATURES) -> DataFrame:
    """Reload; a feature without saved rows keeps the default reserved entries."""
    schema = "value string, id int, feature string"
    try:
        saved = spark.read.schema(schema).json(path)
        saved.schema  # noqa: B018  (resolves the path now)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        # nothing saved: defaults only
        saved = spark.createDataFrame([], schema)
    saved = saved.select("feature", "value", "id")
    have = saved.select("feature").distinct()
    defaults = reserved_rows(spark, features).join(have, "feature", "left_anti")
    return saved.unionByName(defaults)


def cardinality(events: DataFrame, cols: list[str] = DYNAMIC_FEATURES, approx: bool = False) -> DataFrame:
    """Distinct non-null values per categorical column, one pass."""
    f = F.approx_count_distinct if approx else F.count_distinct
    return events.agg(*[f(c).alias(f"n_{c}") for c in cols])
