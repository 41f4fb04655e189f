"""Registered queries: sources, quality, projections, vocabularies, sets,
sorting, sampling and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqwise.functions.columns import encode_static, epoch_us, hour_enc, norm_text, period_of_hour, r9
from seqwise.operators import aggregates as A
from seqwise.operators import quality as Q
from seqwise.operators import sampling as S
from seqwise.operators import vocab as V
from seqwise.operators.quantiles import order_statistics, stored_column
from seqwise.operators.ranking import RankedTable
from seqwise.operators.sketches import distinct_counts, write_sketches
from seqwise.operators.windows import sliding_windows
from seqwise.plans.registry import query
from seqwise.sources import TRAIN_COLUMNS, load_events, read_events, read_events_range, read_users
from seqwise.sources.events import EVENT_COLUMNS, adapt_events, table_path
from seqwise.sources.sinks import (
    append_events, append_rows, from_stream_records, scratch_path, to_stream_records, write_bounded,
    write_clustered,
)

AS_OF = "2024-02-01 00:00:00"


def ev(spark, sf_dir, cols=None):
    return load_events(spark, sf_dir, cols)


# ------------------------------------------------------------------ sources
@query("SRC-1")
def src_1(spark, sf_dir):
    return adapt_events(read_events(spark, table_path(sf_dir, "events"))).select(*TRAIN_COLUMNS)


@query("SRC-2")
def src_2(spark, sf_dir):
    return ev(spark, sf_dir)


@query("SRC-3")
def src_3(spark, sf_dir):
    return read_users(spark, sf_dir).drop("last_active_at")


@query("SRC-4")
def src_4(spark, sf_dir):
    path = scratch_path(spark, "events_appended")
    e = ev(spark, sf_dir)
    append_events(e.where(F.col("event_time") < F.lit("2024-01-15").cast("timestamp_ntz")), path)
    later = F.col("event_time") >= F.lit("2024-01-15").cast("timestamp_ntz")
    append_events(e.where(F.coalesce(later, F.lit(True))), path)  # events without a time too
    return spark.read.parquet(path).select(*EVENT_COLUMNS)


@query("SRC-5")
def src_5(spark, sf_dir):
    path = scratch_path(spark, "users_appended")
    append_rows(read_users(spark, sf_dir).drop("last_active_at"), path)
    return spark.read.parquet(path)


@query("SRC-6")
def src_6(spark, sf_dir):
    path = scratch_path(spark, "user_features_etl")
    write_bounded(A.etl_user_features(ev(spark, sf_dir)), path, files=10)
    return spark.read.parquet(path)


@query("SRC-7")
def src_7(spark, sf_dir):
    path = scratch_path(spark, "events_by_month")
    append_events(ev(spark, sf_dir), path)
    t = spark.read.parquet(path)
    return t.groupBy(F.col("event_month").cast("string").alias("event_month")).agg(F.count(F.lit(1)).alias("n_events"),
                                        F.count_distinct("muid").alias("n_users"))


@query("SRC-8")
def src_8(spark, sf_dir):
    r = to_stream_records(ev(spark, sf_dir))
    return r.select("key", "topic",
                    F.get_json_object("value", "$.event_id").cast("long").alias("event_id"),
                    F.get_json_object("value", "$.event_name").alias("event_name"),
                    F.get_json_object("value", "$.channel").alias("channel"))


@query("SRC-9")
def src_9(spark, sf_dir):
    e = ev(spark, sf_dir)
    return from_stream_records(to_stream_records(e), e.schema)


# ------------------------------------------------------------------ data quality
@query("DQ-1")
def dq_1(spark, sf_dir):
    return Q.validate_events(ev(spark, sf_dir)).select("event_id", "muid", "reject_reason")


@query("DQ-2")
def dq_2(spark, sf_dir):
    e = ev(spark, sf_dir, ["event_id", "event_time"]).withColumn(
        "batch_day", F.date_format("event_time", "yyyy-MM-dd"))
    return Q.validate_batches(e, "batch_day")


@query("DQ-3")
def dq_3(spark, sf_dir):
    return Q.validate_users(read_users(spark, sf_dir)).select("id", "reject_reason")


@query("DQ-4")
def dq_4(spark, sf_dir):
    d = Q.apply_defaults(ev(spark, sf_dir, ["event_id", "muid", "event_time"]), AS_OF)
    return d.select("event_id", "muid", epoch_us(d, "event_time").alias("event_time_us"))


@query("DQ-5")
def dq_5(spark, sf_dir):
    return Q.null_profile(ev(spark, sf_dir)).withColumn("null_pct", r9("null_pct"))


@query("DQ-6")
def dq_6(spark, sf_dir):
    return Q.not_null_violations(Q.assert_not_null(ev(spark, sf_dir)), "muid")


# ------------------------------------------------------------------ projections
@query("PRJ-1")
def prj_1(spark, sf_dir):
    e = ev(spark, sf_dir, ["event_id", "category", "traffic_source"])
    return e.select("event_id", norm_text("category").alias("category_norm"),
                    norm_text("traffic_source").alias("traffic_source_norm"))


@query("PRJ-2")
def prj_2(spark, sf_dir):
    e = ev(spark, sf_dir, ["event_id", "event_time"])
    return e.select("event_id", F.hour("event_time").alias("hour"), hour_enc("event_time").alias("hour_enc"))


@query("PRJ-3")
def prj_3(spark, sf_dir):
    e = ev(spark, sf_dir, ["event_id", "event_time"])
    return e.select("event_id", period_of_hour(F.hour("event_time")).alias("period"))


@query("PRJ-4")
def prj_4(spark, sf_dir):
    """Events of one user (the predicate reaches the Parquet scan)."""
    return ev(spark, sf_dir, ["event_id", "muid", "event_name"]).where(F.col("muid") == 7)


@query("PRJ-4-user")
def prj_4_user(spark, sf_dir):
    """One user by primary key, from a table clustered by it."""
    users = read_users(spark, sf_dir).select("id", "name", "location", "last_active_at")
    path = write_clustered(users, scratch_path(spark, "users"), "id")
    return spark.read.schema(users.schema).parquet(path).where(F.col("id") == 7)


@query("PRJ-5")
def prj_5(spark, sf_dir):
    path = scratch_path(spark, "events_by_month")
    append_events(ev(spark, sf_dir), path)
    t = spark.read.parquet(path)
    r = read_events_range(t, "2024-01-10 00:00:00", "2024-01-20 00:00:00")
    return r.select("event_id", "muid", "event_name")


# ------------------------------------------------------------------ vocabularies
@query("VOC-1")
def voc_1(spark, sf_dir):
    e = ev(spark, sf_dir)
    return e.select("event_id",
                    encode_static("event_name", "event_name").alias("event_name_id"),
                    encode_static("device_os", "device_os").alias("device_os_id"),
                    encode_static("channel", "channel").alias("channel_id"),
                    encode_static("category", norm_text("category")).alias("category_id"),
                    encode_static("traffic_source", norm_text("traffic_source")).alias("traffic_source_id"))


@query("VOC-2")
def voc_2(spark, sf_dir):
    return V.build_vocab(ev(spark, sf_dir))


@query("VOC-3")
def voc_3(spark, sf_dir):
    e = ev(spark, sf_dir)
    enc = V.encode_dynamic(e, V.build_vocab(e))
    return enc.select("event_id", *[f"{c}_id" for c in V.DYNAMIC_FEATURES])


@query("VOC-4")
def voc_4(spark, sf_dir):
    """Decode target IDs of the windows through the dynamic vocabulary; IDs the
    vocabulary lacks give 'unknown'."""
    e = ev(spark, sf_dir)
    w = sliding_windows(e.select(*TRAIN_COLUMNS, "event_id"))
    d = V.decode(w, "target_next_event", V.build_vocab(e), "event_name", "decoded_name")
    return d.select("muid", "event_id", "target_next_event", "decoded_name")


@query("VOC-5")
def voc_5(spark, sf_dir):
    return V.vocab_sizes(V.build_vocab(ev(spark, sf_dir)))


@query("VOC-2-append")
def voc_2_append(spark, sf_dir):
    """A vocabulary of the first half-month, extended by the other: ids of the
    first part stay, so the whole is that of all events at once."""
    e = ev(spark, sf_dir)
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    old = V.build_vocab(e.where(F.col("event_time") < cut), rank_in_one_task=0)
    return V.extend_vocab(old, e.where(F.col("event_time") >= cut), rank_in_one_task=0)


@query("VOC-6")
def voc_6(spark, sf_dir):
    e = ev(spark, sf_dir)
    path = scratch_path(spark, "vocab")
    V.save_vocab(V.build_vocab(e, ["event_name", "channel", "category"]), path)
    return V.load_vocab(spark, path)


@query("VOC-7")
def voc_7(spark, sf_dir):
    return V.cardinality(ev(spark, sf_dir))


# ------------------------------------------------------------------ sets / sorting / sampling
@query("SET-1")
def set_1(spark, sf_dir):
    e = ev(spark, sf_dir, ["event_id", "muid", "event_time"])
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    return e.where(F.col("event_time") < cut).unionByName(e.where(F.coalesce(F.col("event_time") >= cut, F.lit(True)))) \
            .select("event_id", "muid")


@query("SET-2")
def set_2(spark, sf_dir):
    e = ev(spark, sf_dir, ["muid", "event_name"])
    users = e.select(F.lit("muid").alias("what"), F.col("muid").cast("string").alias("value")).distinct()
    names = e.select(F.lit("event_name").alias("what"), F.col("event_name").alias("value")).distinct()
    return users.unionByName(names)


@query("SRT-1")
def srt_1(spark, sf_dir):
    """Newest 10 events of every user."""
    return A.newest_events(ev(spark, sf_dir, ["event_id", "muid", "event_time", "event_name"]), 10) \
            .select("event_id", "muid", "event_name")


@query("SRT-1-oldest")
def srt_1_oldest(spark, sf_dir):
    return A.newest_events(ev(spark, sf_dir, ["event_id", "muid", "event_time"]), 10, desc=False) \
            .select("event_id", "muid")


@query("SRT-2")
def srt_2(spark, sf_dir):
    return S.user_positions(ev(spark, sf_dir, ["event_id", "muid", "event_time"])) \
            .select("event_id", "muid", "position")


@query("SRT-3")
def srt_3(spark, sf_dir):
    """Users page: order by id, offset 50, limit 100."""
    return S.paginate(read_users(spark, sf_dir).select("id", "name", "location"), "id", 100, 50)


@query("SRT-3-deep")
def srt_3_deep(spark, sf_dir):
    """A page beyond the middle of all events, from the range that holds it."""
    e = ev(spark, sf_dir, ["event_id", "muid", "event_name", "event_time"])
    table = RankedTable(e, ["event_time", "event_id"])
    n = table.starts.agg(F.sum("n")).first()[0]
    return table.page(n // 2 + 7, 50).select("event_id", "muid", "event_name")


@query("SMP-1")
def smp_1(spark, sf_dir):
    """50 users chosen by md5 order (seed 42), all of their events."""
    return S.sample_users(ev(spark, sf_dir, ["event_id", "muid"]), 50, seed=42)


@query("SMP-2")
def smp_2(spark, sf_dir):
    w = sliding_windows(ev(spark, sf_dir, TRAIN_COLUMNS + ["event_id"]))
    return S.split_by_user(w.select("muid", "event_id"), 15, seed=42)


@query("SMP-2-row")
def smp_2_row(spark, sf_dir):
    """Row-level 85/15 split of the windows (per window, md5 of its event id)."""
    w = sliding_windows(ev(spark, sf_dir, TRAIN_COLUMNS + ["event_id"]))
    return S.split_by_row(w.select("muid", "event_id"), 15, seed=42)


# ------------------------------------------------------------------ aggregates
@query("AGG-1")
def agg_1(spark, sf_dir):
    return A.etl_user_features(ev(spark, sf_dir))


@query("AGG-2")
def agg_2(spark, sf_dir):
    return A.user_features(ev(spark, sf_dir), AS_OF).drop("last_event_time")


@query("AGG-3")
def agg_3(spark, sf_dir):
    """Features over each user's newest 2000 events, users joined from the user table."""
    users = read_users(spark, sf_dir).select(F.col("id").alias("muid"))
    e = A.newest_events(ev(spark, sf_dir), 2000).join(users, "muid", "left_semi")
    return A.user_features(e, AS_OF).drop("last_event_time")


@query("AGG-3-k30")
def agg_3_k30(spark, sf_dir):
    e = A.newest_events(ev(spark, sf_dir), 30)
    return A.user_features(e, AS_OF).drop("last_event_time")


@query("AGG-4")
def agg_4(spark, sf_dir):
    return A.count_by_user(ev(spark, sf_dir, ["muid"]))


@query("AGG-5")
def agg_5(spark, sf_dir):
    return A.value_counts(ev(spark, sf_dir, ["event_name"]), "event_name")


@query("AGG-6")
def agg_6(spark, sf_dir):
    return A.session_depth(ev(spark, sf_dir, ["muid", "session_id"]))


@query("AGG-7")
def agg_7(spark, sf_dir):
    d = A.describe(A.session_depth(ev(spark, sf_dir, ["muid", "session_id"])), "depth")
    return d.select(*[r9(c).alias(c) if c != "count" else F.col(c) for c in d.columns])


@query("AGG-8")
def agg_8(spark, sf_dir):
    h = A.histogram(A.session_depth(ev(spark, sf_dir, ["muid", "session_id"])), "depth", 50, 0.99)
    return h.select("bin", r9("bin_start").alias("bin_start"), r9("bin_end").alias("bin_end"), "n",
                    r9("crop_value").alias("crop_value"))


SKETCHED = ["muid", "session_id", "event_name", "category", "channel", "device_os"]


@query("VOC-7-sketch")
def voc_7_sketch(spark, sf_dir):
    """Distinct values from sketches of two batches, merged: whether the estimate
    lies within 3 % of the exact count beside it."""
    e = ev(spark, sf_dir, [*SKETCHED, "event_id", "event_time"])
    path = scratch_path(spark, "sketches")
    for b in (0, 1):
        write_sketches(e.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == b), path, b, SKETCHED)
    estimates = distinct_counts(spark, path, SKETCHED)
    exact = e.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in SKETCHED])
    one = A.with_stats_row(estimates, exact)
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"n_{c}").alias("distinct_values"),
                     (F.abs(F.col(c) - F.col(f"n_{c}")) <= 0.03 * F.col(f"n_{c}")).alias("estimate_fits"))
            for c in SKETCHED]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query("AGG-7-times")
def agg_7_times(spark, sf_dir):
    """Exact order statistics of a column of nearly all-distinct values: the
    event times in microseconds at the ends, tenths and quarters."""
    e = ev(spark, sf_dir, ["event_time"])
    times = stored_column(e.select(epoch_us(e, "event_time").alias("t")), "t")
    n = times.count()
    ranks = sorted({int(p * (n - 1) // 100) for p in (0, 1, 10, 25, 50, 75, 90, 99, 100)}) if n else []
    rows = list(zip(ranks, order_statistics(times, ranks))) if n else []
    return spark.createDataFrame(rows, "rank long, event_us long")


def _class_weight_rows(spark, sf_dir):
    w = sliding_windows(ev(spark, sf_dir, TRAIN_COLUMNS + ["event_id"]))
    out = A.class_weights_many(w, {"next_event": ("target_next_event", 7), "channel": ("target_channel", 3),
                                   "period": ("target_active_period", 4)})
    return out.select("head", "cls", "n", r9("weight").alias("weight"))


query("AGG-9")(_class_weight_rows)


@query("AGG-10")
def agg_10(spark, sf_dir):
    w = sliding_windows(ev(spark, sf_dir, TRAIN_COLUMNS + ["event_id"]))
    out = A.positive_rates(w, ["target_purchase", "target_churn"])
    out = out.withColumn("label", F.regexp_replace("label", "^target_", ""))
    return out.withColumn("rate", r9("rate"))


@query("AGG-11")
def agg_11(spark, sf_dir):
    return A.window_stats(sliding_windows(ev(spark, sf_dir, TRAIN_COLUMNS + ["event_id"])))
