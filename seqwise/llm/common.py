"""Helpers shared by the operators: words as columns, lineage cuts, size checks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwise.llm.words import SEPARATORS
from seqwise.session import ensure_checkpoint_dir

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays (``lower`` would change more)."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null and for texts without words."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SEPARATORS))


TEXT_ROWS = 500  # rows of whole texts (or groups of them) in one Arrow batch


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after lowering the session's Arrow batch size to ``TEXT_ROWS``.

    The default of 10,000 rows is made for numbers: as many whole texts, held
    by the JVM and by the worker of every core, do not fit small executors."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > TEXT_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    return df


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def own_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """``docs`` with its columns as ``_doc_0``, ``_doc_1``, ..., so that none can
    clash with an operator's own, whatever they are called (dots included); the
    new name of each; and the way back for any table that has these columns."""
    at = {c: f"_doc_{i}" for i, c in enumerate(docs.columns)}
    safe = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in at.items()])
    return safe, at, lambda df: df.select(*[F.col(n).alias(c) for c, n in at.items()])


DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries planned and run inside leave no shuffle files behind.

    Otherwise the files stay until the driver's JVM happens to collect what
    refers to them, so a job of many written steps holds those of most steps
    at once. Lost files of a running query are made again as usual."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage.

    Reliable: the rows survive lost executors. Meant for narrow tables."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint()  # a plan of its own: the caller may run df again


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Like ``materialize``, as a compressed Parquet table (for wide rows)."""
    path = shared_folder(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_up_to(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint if ``df``, a materialized table of a few fixed-width
    columns, has at most ``max_rows`` rows; else unchanged (a shuffled join)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
