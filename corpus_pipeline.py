"""A training-data pipeline over ``documents``: quality, near copies, secrets,
mixing, pieces. Each stage's rows are written as Parquet and read again as the
next stage's documents; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwise.llm.common import own_names, write_once
from seqwise.llm.jaccard import one_of_each
from seqwise.llm.mixing import mixed_documents
from seqwise.llm.pieces import encode
from seqwise.llm.quality import THRESHOLD, fit, score_documents
from seqwise.llm.queries import tokenizer_file
from seqwise.llm.secrets import mask_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on their own labels, accepts.

    Null and empty texts are scored like others, by their structure; repeated
    rows and ties get equal scores. Columns may have any name."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    safe, at, back = own_names(docs)
    return back(score_documents(safe, model, text_col=at["text"], score_col="score").where(F.col("score") >= THRESHOLD))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, 0.8): the one
    with the least id, nulls last. Rows equal in id and text are one document;
    documents without words all stay."""
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked and n_chars counted
    anew; null texts stay null, ids do not matter."""
    return mask_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken: documents without
    words are not in it, a null source is one of its own, and rows tied in the
    shuffled order are served by a hash of the whole row."""
    return mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the piece ids of each document of the mix (whole texts;
    none for an empty one, null for null)."""
    return encode(docs, tokenizer_file(spark), keep=["doc_id", "source"])


STAGES = [("quality", quality), ("near_copies", near_copies), ("secrets", secrets), ("mixing", mixing),
          ("pieces", pieces)]

# The classifier and the tokeniser cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
