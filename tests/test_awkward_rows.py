"""Rows without user, time or id: equal results whatever the size settings."""

from helpers import T0, ev, frame
from pyspark.sql import functions as F
from seqwise.functions.columns import norm_text
from seqwise.operators.sampling import merge_recent, user_positions
from seqwise.operators.vocab import load_vocab
from seqwise.sources import load_events
from seqwise.streaming.feed import event_records, write_chunked

import datetime as dt

import pytest
from conftest import SF001


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_user_positions_on_both_paths(spark):
    e = load_events(spark, SF001).select("event_id", "muid", "event_time")
    e = e.withColumn("muid", F.when(F.col("event_id") % 10 == 0, None).when(F.col("event_id") % 3 == 0, F.lit(0))
                     .otherwise(F.col("muid")))
    e = e.withColumn("event_time", F.when(F.col("event_id") % 11 != 0, F.col("event_time")))
    plain, split = user_positions(e, hot=None), user_positions(e, rows_per_split=50)
    assert _same(plain, split) and plain.count() == e.where("muid is not null and event_time is not null").count()


def test_merge_recent(spark):
    history = frame(spark, [ev(1, 5, T0), ev(2, 5, T0), ev(None, 5, T0)])
    recent = frame(spark, [ev(2, 1, T0 + dt.timedelta(hours=1), name="late"), ev(2, 9, T0, name="early"),
                           ev(None, 1, T0), ev(None, 2, T0)])
    got = merge_recent(history, recent).collect()
    assert sorted((str(r.event_id), r.event_name) for r in got) == [
        ("1", "pageview"), ("2", "late"), ("None", "pageview"), ("None", "pageview"), ("None", "pageview")]


def test_norm_text_strips_all_white_space(spark):
    df = spark.createDataFrame([("books\t",), ("\n Books\u00a0",), (None,), ("a b",)], "c string")
    assert [r.n for r in df.select(norm_text("c").alias("n")).collect()] == ["books", "books", "", "a b"]


def test_feed_keeps_rows_without_time(spark, tmp_path):
    e = frame(spark, [ev(i, 1, T0 + dt.timedelta(hours=i)) for i in range(20)] + [ev(99, 1, None)])
    assert write_chunked(event_records(e), str(tmp_path / "f"), "_feed_time", 3) == 1
    assert spark.read.json(str(tmp_path / "f")).count() == 21


def test_unreadable_vocabulary_is_an_error(spark, tmp_path):
    assert load_vocab(spark, str(tmp_path / "none")).count() == 10
    with pytest.raises(Exception, match="nosuchscheme"):
        load_vocab(spark, "nosuchscheme://host/vocab").count()


def test_predictions_with_text_ids_and_gaps(spark):
    """Text ids on both paths; predictions without user or time keep their row."""
    from seqwise.operators.feedback import next_event_after
    from seqwise.operators.scoring import prediction_log
    e = load_events(spark, SF001).select("event_id", "muid", "event_name", "event_time")
    text = e.select(F.format_string("%08d-e", "event_id").alias("event_id"),
                    F.format_string("%06d-u", "muid").alias("muid"), "event_name", "event_time")
    numbers = next_event_after(prediction_log(e), e)
    log = prediction_log(text)
    for kw in ({"hot": None}, {"rows_per_split": 9}):
        got = next_event_after(log, text, **kw)
        assert _same(got.select("prediction_id", "actual_event_id", "actual_event_name"), numbers.select(
            F.format_string("%08d-e", "prediction_id"), F.when(F.col("actual_event_id").isNotNull(), F.format_string(
                "%08d-e", "actual_event_id")), "actual_event_name"))
        holes = log.withColumn("user_id", F.when(F.col("prediction_id") > "00000500-e", F.col("user_id"))).withColumn(
            "created_at", F.when(F.col("prediction_id") < "00000900-e", F.col("created_at")))
        whole = next_event_after(holes, text, **kw)
        assert whole.count() == log.count()
        assert whole.where("(user_id is null or created_at is null) and actual_t is not null").count() == 0


def test_expression_scorer_equals_the_pluggable_one(spark):
    from seqwise.operators.scoring import OUTPUTS, score_features, score_windows
    from seqwise.operators.windows import sliding_windows
    from seqwise.sources import TRAIN_COLUMNS
    w = sliding_windows(load_events(spark, SF001, TRAIN_COLUMNS + ["event_id"]))
    assert _same(score_features(w).select("event_id", *OUTPUTS), score_windows(w).select("event_id", *OUTPUTS))


def test_scorer_gets_sequences_and_mask(spark):
    """A scorer that answers from the id sequence and the mask alone."""
    from seqwise.operators.sampling import merge_recent
    from seqwise.operators.scoring import feature_scorer, predict_batch
    from seqwise.operators.sequences import serving_windows
    from seqwise.operators.vocab import build_vocab
    e = load_events(spark, SF001)

    def factory():
        base = feature_scorer()

        def score(pdf):
            out = base(pdf)
            out["p_engagement"] = [float(s[-1]) for s in pdf["seq_event_name"]]
            out["p_inactivity"] = [float(sum(m)) for m in pdf["padding_mask"]]
            return out
        return score
    vocab = build_vocab(e)
    recent = e.limit(0)
    got = predict_batch(e, recent, vocab, ["<PAD>"], ["<PAD>"], factory)
    want = serving_windows(merge_recent(e, recent), vocab).select(
        "muid", F.element_at("seq_event_name", -1).cast("double"),
        F.size(F.filter("padding_mask", lambda m: m)).cast("double"))
    assert _same(got.select("user_id", "engagement_score", "inactivity_risk"), want)


def test_malformed_records_are_kept_as_they_came(spark):
    import json
    from seqwise.sources.sinks import scratch_path
    from seqwise.streaming.feed import RECORD_SCHEMA
    from seqwise.streaming.ingest import ingest_stream
    e = load_events(spark, SF001).limit(3)
    folder, table, rejects = (scratch_path(spark, n) for n in ("feed", "t", "r"))
    good = [r.value for r in event_records(e).collect()]
    lines = [json.dumps({"key": "k", "value": v, "topic": "t"}) for v in [*good, '{"event_id": 1, "mu', "no json"]]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(folder)
    stream = spark.readStream.schema(RECORD_SCHEMA).json(folder)
    ingest_stream(spark, stream, e.schema, table, rejects, scratch_path(spark, "c"))
    assert spark.read.parquet(table).count() == 3
    bad = {(r.reject_reason, r.raw_value) for r in spark.read.parquet(rejects).collect()}
    assert ("malformed", "no json") in bad and len(bad) == 2
