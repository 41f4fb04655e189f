"""Streams drained with availableNow equal their batch twins."""

from pyspark.sql import functions as F

from conftest import SF001


def test_feedback_stream_matches_batch(spark):
    from __spark_entry__ import queries
    q = queries()
    stream = q["STR-6"](spark, SF001)
    batch = q["FBK-1"](spark, SF001).where(F.col("actual").isNotNull())
    cols = ["prediction_id", "predicted_next_event", "actual", "reward"]
    # Every stream result is a resolved batch row; rows the stream still holds are
    # only those whose 168 h have not passed the watermark at the end of the input.
    assert stream.select(*cols).exceptAll(batch.select(*cols)).count() == 0
    missing = batch.select(*cols).exceptAll(stream.select(*cols))
    assert missing.where(F.col("actual") != "churn").count() == 0


def test_buffer_stream_matches_batch(spark):
    from __spark_entry__ import queries
    q = queries()
    s = q["STR-3"](spark, SF001)
    from seqwise.operators.scoring import prediction_log
    from seqwise.sources import load_events
    b = prediction_log(load_events(spark, SF001, ["event_id", "muid", "event_name", "event_time"]))
    cols = ["prediction_id", "window_events", "purchase_probability", "churn_risk", "predicted_next_event"]
    assert s.select(*cols).exceptAll(b.select(*cols)).count() == 0
    assert b.select(*cols).exceptAll(s.select(*cols)).count() == 0


def test_feature_upkeep_retry_is_idempotent(spark):
    """A micro-batch rewritten after a failure leaves the feature view unchanged,
    and the view equals the batch feature document."""
    import tempfile
    from seqwise.operators.aggregates import user_features
    from seqwise.sources import load_events
    from seqwise.sources.sinks import batch_folder
    from seqwise.streaming import features as SF
    from conftest import SF001
    e = load_events(spark, SF001)
    table = tempfile.mkdtemp(prefix="upkeep-", dir="/tmp") + "/log"
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    for part, rows in (("activity", SF.channel_activity), ("distinct", SF.distinct_values)):
        # state after batch 1: all events so far
        for bid, seen in [(0, e.where(F.col("event_time") < cut)), (1, e), (1, e)]:  # batch 1 retried
            rows(seen).write.mode("overwrite").parquet(batch_folder(f"{table}/{part}", bid, "batch_id"))
    got = SF.read_features(spark, table, "2024-02-01 00:00:00")
    exp = user_features(e, "2024-02-01 00:00:00").drop("last_event_time").select(*got.columns)
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_dedup_ingest_drops_and_counts_late_rows(spark):
    from seqwise.plans import q_streaming as QS
    from seqwise.sources import load_events
    from seqwise.sources.events import EVENT_COLUMNS
    from seqwise.sources.sinks import scratch_path
    from seqwise.streaming import ingest as SI
    from conftest import SF001
    early = F.lit("2024-01-05").cast("timestamp_ntz")
    schema, rec = QS._feed(spark, SF001, extra=lambda e: e.where(F.col("event_time") < early))
    table = scratch_path(spark, "t")
    stats = SI.ingest_stream(spark, rec, schema, table, scratch_path(spark, "r"), scratch_path(spark, "c"),
                             dedup_delay="2 days")
    e = load_events(spark, SF001)
    n_redelivered = e.where(F.col("event_time") < early).count()
    assert stats["late_dropped"] == n_redelivered > 0
    got = spark.read.parquet(table).select(*EVENT_COLUMNS)
    assert got.count() == e.count() and got.exceptAll(e.select(*EVENT_COLUMNS)).count() == 0


def _text_ids(e):
    """The events with UUID-like ids."""
    return (e.withColumn("muid", F.concat(F.lit("user-"), F.col("muid").cast("string")))
            .withColumn("event_id", F.format_string("e-%09d", "event_id")))


def test_feature_upkeep_stream_equals_batch_on_text_ids(spark):
    from seqwise.operators.aggregates import user_features
    from seqwise.sources import load_events
    from seqwise.sources.sinks import scratch_path
    from seqwise.streaming import features as SF
    from seqwise.streaming import ingest as SI
    from seqwise.streaming.feed import read_record_stream, write_record_feed
    e = _text_ids(load_events(spark, SF001))
    folder, table = scratch_path(spark, "feed"), scratch_path(spark, "t")
    files = write_record_feed(e, folder, 4)
    events = SI.decode(read_record_stream(spark, folder, files_per_trigger=files), e.schema)
    SF.feature_upkeep_stream(spark, events, table, scratch_path(spark, "c"))
    got = SF.read_features(spark, table, "2024-02-01 00:00:00")
    exp = user_features(e, "2024-02-01 00:00:00").select(*got.columns)
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0
    batches = spark.read.parquet(f"{table}/activity").select("batch_id").distinct().count()
    assert batches >= 4  # the state was carried across micro-batches


def test_feature_state_rows_do_not_grow_with_sessions(spark):
    """Nothing that the streams group by or aggregate collects values."""
    from seqwise.streaming import features as SF
    schema = "muid string, session_id string, category string, channel string, event_name string, event_time timestamp_ntz"
    rate = spark.readStream.schema(schema).parquet("/root/testdata/sf0.001")
    for rows in (SF.channel_activity(rate), SF.distinct_values(rate), SF.distinct_values(rate, "30 days")):
        plan = rows._jdf.queryExecution().analyzed().toString()
        assert "collect_" not in plan and "mode(" not in plan and "count(distinct" not in plan
        kinds = {f.dataType.typeName() for f in rows.schema.fields}
        assert not kinds & {"array", "map"}


def test_stateful_processors_take_text_ids(spark):
    from seqwise.operators.scoring import prediction_log
    from seqwise.sources import load_events
    from seqwise.sources.sinks import scratch_path
    from seqwise.functions.columns import epoch_us
    from seqwise.streaming import ingest as SI
    from seqwise.streaming import stateful as SS
    from seqwise.streaming.feed import read_record_stream, write_chunked, write_record_feed
    from seqwise.operators import feedback as FB
    e = load_events(spark, SF001, ["event_id", "muid", "event_name", "event_time"])
    text = _text_ids(e)
    folder, out = scratch_path(spark, "feed"), scratch_path(spark, "out")
    files = write_record_feed(text, folder, 3)
    events = SI.decode(read_record_stream(spark, folder, files_per_trigger=files), text.schema)
    (SS.buffer_predictions(events).writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", scratch_path(spark, "c")).trigger(availableNow=True).start().awaitTermination())
    cols = ["prediction_id", "user_id", "window_events", "predicted_next_event"]
    log = prediction_log(e)
    exp = log.select(F.format_string("e-%09d", "prediction_id").alias("prediction_id"),
                     F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("user_id"), *cols[2:])
    got = spark.read.parquet(out).select(*cols)
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0

    feed = (text.select(F.lit("event").alias("kind"), "muid", epoch_us(text, "event_time").alias("t"),
                        F.col("event_id").alias("id"), F.col("event_name").alias("name"), "event_time")
            .unionByName(log.select(F.lit("prediction").alias("kind"),
                                    F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("muid"),
                                    epoch_us(log, "created_at").alias("t"),
                                    F.format_string("e-%09d", "prediction_id").alias("id"),
                                    F.col("predicted_next_event").alias("name"),
                                    F.col("created_at").alias("event_time"))))
    folder, out = scratch_path(spark, "feed"), scratch_path(spark, "out")
    files = write_chunked(feed, folder, "event_time", 3)
    stream = spark.readStream.schema(SS.feedback_input("string", "string")).option("maxFilesPerTrigger", files).json(folder)
    (SS.feedback_stream(stream).writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", scratch_path(spark, "c")).trigger(availableNow=True).start().awaitTermination())
    got = spark.read.parquet(out).where(F.col("actual") != "churn")
    whole = FB.actual_outcome(FB.next_event_after(log, e), F.lit(10**18)).where("actual is not null and actual <> 'churn'")
    assert got.count() == whole.count() > 0
    want = whole.select(F.format_string("e-%09d", "prediction_id").alias("prediction_id"), "actual")
    assert got.select("prediction_id", "actual").exceptAll(want).count() == 0


def test_late_rows_are_compared_with_the_table(spark):
    """Beyond the watermark a duplicate is dropped and a new row is kept."""
    from seqwise.plans import q_streaming as QS
    from seqwise.sources import load_events
    from seqwise.sources.events import EVENT_COLUMNS
    from seqwise.sources.sinks import scratch_path
    from seqwise.streaming import ingest as SI
    from seqwise.streaming.feed import read_record_stream, write_record_feed
    e = load_events(spark, SF001)
    early = F.col("event_time") < F.lit("2024-01-05").cast("timestamp_ntz")
    odd = F.col("event_id") % 2 == 1
    held_back = e.where(early & odd)
    folder = scratch_path(spark, "feed")
    files = write_record_feed(e.where(~(early & odd)), folder, 4)
    write_record_feed(e.where(early), folder, 1)         # long after: half known, half new
    write_record_feed(held_back.limit(5), folder, 1)     # new ones again
    table, index = scratch_path(spark, "t"), scratch_path(spark, "i")
    stats = SI.ingest_stream(spark, read_record_stream(spark, folder, files_per_trigger=files), e.schema, table,
                             scratch_path(spark, "r"), scratch_path(spark, "c"), dedup_delay="2 days", index=index)
    got = spark.read.parquet(table).select(*EVENT_COLUMNS)
    assert stats["late_kept"] == held_back.count() > 0 and stats["late_dropped"] > 0
    assert got.count() == e.count() and got.exceptAll(e.select(*EVENT_COLUMNS)).count() == 0


def test_bloom_filters_know_every_id_and_few_others():
    import numpy as np
    from seqwise.streaming.seen import bloom_bits, in_bloom
    r = np.random.default_rng(2)
    ids = r.integers(-2**63, 2**63 - 1, 5_000)
    others = r.integers(-2**63, 2**63 - 1, 20_000)
    raw = bloom_bits(ids)
    assert in_bloom(ids, raw).all() and in_bloom(others, raw).mean() < 0.02
    assert in_bloom(ids[:1], bloom_bits(ids[:1])).all()


def _started(processor):
    """A state value and the timers of a processor outside of Spark."""
    from types import SimpleNamespace

    class Value:
        held, writes = None, 0

        def get(self):
            return self.held

        def update(self, value):
            self.held, self.writes = value, self.writes + 1

        def clear(self):
            self.held = None
    timers, state = set(), Value()
    handle = SimpleNamespace(getValueState=lambda *_: state, registerTimer=timers.add, deleteTimer=timers.remove)
    processor.init(handle)
    return state, timers


def test_many_users_share_a_call_and_a_state_value(spark):
    """The state's keys are buckets: their number does not grow with the users,
    and each user's answers are those of the user alone."""
    import pandas as pd
    from seqwise.streaming import stateful as SS
    rows = spark.range(5_000).select(F.col("id").alias("muid"))
    assert rows.select(SS.user_bucket("muid", 64)).distinct().count() == 64

    def frame(t0):
        return pd.DataFrame([(u, t0 + 10 * k + u % 3, 1_000 * t0 + 100 * u + k, name) for u in range(50) for k, name in
                             enumerate(["pageview", "add_to_cart", None, "purchase"][u % 4:] + ["scroll"] * (u % 5))],
                            columns=["muid", "t_us", "event_id", "event_name"])
    batches = [frame(1_000), frame(500), frame(2_000)]  # the second: older than what is stored

    def run(users):
        p = SS.LastEventsBuffer(3, "bigint", lambda u: f"v{u % 2}")
        p.SLICE = 7
        state, _ = _started(p)
        out = [o for b in batches for o in p.handleInputRows((0,), iter([b[b["muid"].isin(users)]]), None)]
        return pd.concat(out), state
    together, state = run(range(50))
    alone = pd.concat([run([u])[0] for u in range(50)])
    key = ["prediction_id"]
    pd.testing.assert_frame_equal(together.sort_values(key).reset_index(drop=True),
                                  alone.sort_values(key).reset_index(drop=True))
    assert len(together) == sum(map(len, batches)) and state.writes == 3
    assert SS.read_rows(state).groupby("muid").size().max() == 3


def test_feedback_bucket_keeps_one_timer_and_null_users_apart():
    import pandas as pd
    from types import SimpleNamespace
    from seqwise.streaming import stateful as SS
    p = SS.FeedbackProcessor("bigint")
    state, timers = _started(p)

    def feed(*rows):
        df = pd.DataFrame(rows, columns=["person", "t_us", "tag", "rid", "rname"])
        got = pd.concat(list(p.handleInputRows((0,), iter([df]), None)))
        return {r.prediction_id: (r.actual, r.reward) for r in got.itertuples()}
    week = SS.WEEK_US
    assert feed(("1", 10, 1, 1, "scroll"), ("2", 20_000, 1, 2, "purchase"), (None, 10, 1, 3, "scroll"),
                ("2", 20_000, 0, 9, "scroll")) == {}  # an event at the same time is not after
    assert timers == {(10 + week) // 1000 + 1}
    assert feed(("2", 30_000, 0, 12, "scroll"), ("2", 30_000, 0, 11, "checkout")) == {2: ("checkout", 0.5)}
    assert feed((None, 10 + week + 1, 0, 13, "scroll")) == {3: ("churn", -2.0)}
    assert feed(("4", 40_000_000, 1, 4, "scroll")) == {} and len(timers) == 1
    late = SimpleNamespace(getCurrentWatermarkInMs=lambda: (10 + week) // 1000 + 2)
    [out] = p.handleExpiredTimer((0,), late, None)
    assert out["prediction_id"].tolist() == [1] and out["actual"].tolist() == ["churn"]
    assert timers == {(40_000_000 + week) // 1000 + 1}
    assert feed(("4", 50_000_000, 0, 14, "scroll")) == {4: ("scroll", 1.0)}
    assert not timers and state.held is None


def test_events_without_user_or_time_bring_no_prediction(spark):
    import datetime as dt
    from seqwise.sources.sinks import scratch_path
    from seqwise.streaming import stateful as SS
    t = dt.datetime(2024, 1, 1)
    schema = "event_id long, muid long, event_name string, event_time timestamp_ntz"
    folder, out = scratch_path(spark, "feed"), scratch_path(spark, "out")
    spark.createDataFrame([(1, 1, "scroll", t), (2, None, "scroll", t), (3, 1, "scroll", None)], schema).write.parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder)
    (SS.buffer_predictions(stream).writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", scratch_path(spark, "c")).trigger(availableNow=True).start().awaitTermination())
    assert [tuple(r) for r in spark.read.parquet(out).select("prediction_id", "window_events").collect()] == [(1, 1)]
