"""Registered queries of this package: every operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "piece_bpe_32k.model"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqwise.llm.jaccard import near_copies
    return near_copies(_read(spark, sf_dir, "documents"), shingle=3, percent=90)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqwise.llm.mixing import mix
    return mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqwise.llm.quality import THRESHOLD, fit, held_out, score_documents
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, _read(spark, sf_dir, "labels"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqwise.llm.secrets import digest, scan_secrets
    return digest(scan_secrets(_read(spark, sf_dir, "documents")))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqwise.llm.urls import judge_urls, rules_table
    return judge_urls(_read(spark, sf_dir, "pages"), rules_table(spark))


def tokenizer_file(spark: SparkSession) -> str:
    """``seqwise.tokenizer`` of the session, else the installed public model."""
    path = spark.conf.get("seqwise.tokenizer", None)
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(TOKENIZER)
    return str(path)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqwise.llm.pieces import encode
    docs = _read(spark, sf_dir, "documents")
    ids = encode(docs, tokenizer_file(spark), keep=["doc_id"], verify_col="same")
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "same")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqwise.llm.rules import apply_rules
    rows = apply_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqwise.llm.licenses import scan_licenses, templates_table
    return scan_licenses(_read(spark, sf_dir, "documents"), templates_table(spark))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqwise.llm.warc import archive_round_trip
    return archive_round_trip(_read(spark, sf_dir, "pages"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqwise.llm.topk import top_k
    return top_k(_read(spark, sf_dir, "embeddings"))


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqwise.llm.substrings import remove_repeats
    rows = remove_repeats(_read(spark, sf_dir, "documents"), width=35, keep=["doc_id"], digest=True)
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqwise.llm.merkle import tampered_documents
    rows = tampered_documents(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"),
                       "folded_root", "verified")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqwise.llm.phrases import collocations
    return collocations(_read(spark, sf_dir, "documents"))


def all_queries() -> dict:
    from corpus_pipeline import run
    ops = [op1_ngram_jaccard, op2_mix_sources, op3_quality, op4_secrets, op5_url_rules, op6_pieces,
           op7_quality_rules, op8_licenses, op9_warc, op10_top_k, op11_substrings, op12_merkle,
           op13_phrases]
    return {f.__name__: f for f in ops} | {"pipeline": run}
