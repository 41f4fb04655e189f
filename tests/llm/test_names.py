"""Extra columns may be called like the operators' own, or hold a dot."""

from collections import Counter

import pytest
from llm.helpers import prose

import corpus_pipeline
from seqwise.llm import mixing, pieces, quality, secrets
from seqwise.llm.queries import tokenizer_file

NAMES = ["_key", "_tie", "_source", "_times", "_copy", "_row_key", "_rk", "_score", "score", "_one", "_n", "_doc_0",
         "a.b", "key", "tie", "rk", "size"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    out = [(i, " ".join(prose(i % 17, 20 + i)), "en", [None, "a", "b"][i % 3], 1) for i in range(40)]
    return out + [(50, None, None, None, None), (51, "", "en", "a", 0), (None, "password = hunter2abc x", "de", "b", 3)] + out[:2]


def both(spark, rows):
    plain = spark.createDataFrame(rows, DOCS)
    extra = ", ".join(f"`{n}` int" for n in NAMES)
    return plain, spark.createDataFrame([(*r, *range(100, 100 + len(NAMES))) for r in rows], f"{DOCS}, {extra}")


def same(got, want):
    """Equal rows in the columns of ``want``; the extra ones untouched."""
    a, b = got.collect(), want.collect()
    assert Counter(str([r[c] for c in want.columns]) for r in a) == Counter(str(list(r)) for r in b) and len(a) > 0
    assert all([r[n] for n in NAMES] == list(range(100, 100 + len(NAMES))) for r in a)


def test_masking_and_encoding(spark, rows):
    plain, extra = both(spark, rows)
    same(secrets.mask_secrets(extra), secrets.mask_secrets(plain))
    same(pieces.encode(extra, tokenizer_file(spark)), pieces.encode(plain, tokenizer_file(spark)))


def test_quality_stage(spark, rows, tmp_path):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    plain, extra = both(spark, rows)
    same(corpus_pipeline.quality(spark, extra, str(tmp_path)), corpus_pipeline.quality(spark, plain, str(tmp_path)))
    model = quality.fit(plain, labels)
    assert quality.score_documents(extra.drop("score"), model).count() == len(rows)


def test_near_copies_stage(spark, rows):
    plain, extra = both(spark, rows)
    same(corpus_pipeline.near_copies(spark, extra, ""), corpus_pipeline.near_copies(spark, plain, ""))


def test_mixing_stage(spark, rows):
    # the row hash, which orders ties only, sees the extra columns: no ties here
    distinct = [r for r in dict.fromkeys(rows) if r[0] is not None]
    plain, extra = both(spark, distinct)
    same(mixing.mixed_documents(extra), mixing.mixed_documents(plain))
