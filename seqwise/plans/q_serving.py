"""Registered queries: serving sequences, future labels, joins, store merges,
scoring, metrics and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqwise.functions.columns import argmax0, epoch_us, r9
from seqwise.functions.constants import CHANNELS, EVENT_NAMES
from seqwise.operators import aggregates as A
from seqwise.operators import drift as DR
from seqwise.operators import feedback as FB
from seqwise.operators import metrics as M
from seqwise.operators import quality as Q
from seqwise.operators import scoring as SC
from seqwise.operators import store as ST
from seqwise.operators.keyed import KeyedTable
from seqwise.operators.labels import future_labels
from seqwise.operators.sequences import SERVING_FEATURES, serving_windows, skew_report
from seqwise.operators.util import broadcast_checked
from seqwise.operators.vocab import build_vocab
from seqwise.operators.windows import sliding_windows
from seqwise.plans.registry import query
from seqwise.sources import TRAIN_COLUMNS, load_events, read_users
from seqwise.sources.sinks import scratch_path, write_clustered

AS_OF = "2024-02-01 00:00:00"
CUTOFF = "2024-01-20 00:00:00"


def ev(spark, sf_dir, cols=None):
    return load_events(spark, sf_dir, cols)


def _serving(spark, sf_dir):
    e = ev(spark, sf_dir)
    return serving_windows(e, build_vocab(e))


def _windows(spark, sf_dir):
    return sliding_windows(ev(spark, sf_dir, TRAIN_COLUMNS + ["event_id"]))


def _scored(spark, sf_dir):
    return SC.score_features(_windows(spark, sf_dir))


def _log(spark, sf_dir):
    return SC.prediction_log(ev(spark, sf_dir, ["event_id", "muid", "event_name", "event_time"]))


def _log_with_outcome(spark, sf_dir):
    e = ev(spark, sf_dir, ["event_id", "muid", "event_name", "event_time"])
    j = FB.next_event_after(SC.prediction_log(e), e)
    end = e.agg(F.max(epoch_us(e, "event_time")).alias("_data_end"))
    j = A.with_stats_row(j, end)
    return FB.reward(FB.actual_outcome(j, F.col("_data_end"))).drop("_data_end")


def _store_v1(spark, sf_dir):
    e = ev(spark, sf_dir).where(F.col("event_time") < F.lit(CUTOFF).cast("timestamp_ntz"))
    return ST.to_store_rows(A.user_features(e, CUTOFF), 1, CUTOFF)


def _incoming_v2(spark, sf_dir):
    e = ev(spark, sf_dir)
    active = e.where(F.col("event_time") >= F.lit(CUTOFF).cast("timestamp_ntz")).select("muid")
    feats = A.user_features(e, AS_OF).join(active, "muid", "left_semi")
    return ST.to_store_rows(feats, 2, AS_OF)


def _store_v2(spark, sf_dir):
    return ST.upsert_features(_store_v1(spark, sf_dir), _incoming_v2(spark, sf_dir))


def _stored(spark, sf_dir):
    """The feature store as a bucketed table: created, then upserted."""
    table = KeyedTable.create(_store_v1(spark, sf_dir), scratch_path(spark, "features"), ST.STORE_KEY, ST.STORE_ORDER)
    table.upsert(_incoming_v2(spark, sf_dir), ST.STORE_ORDER)
    return table


def _store_table(spark, sf_dir):
    """The store as a table: materialized once (reliable checkpoint in the
    shared checkpoint folder), as a feature store is, so the lookups, the cache
    derived from it and the write-back all read it instead of rebuilding it."""
    from seqwise.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    return _store_v2(spark, sf_dir).checkpoint(eager=True)


def _flat_store(df):
    return df.select("user_id", "feature_version", *[F.col(f"features.{c}").alias(c) for c in ST.FEATURE_FIELDS])


# ------------------------------------------------------------------ sequences / labels
@query("SEQ-1")
def seq_1(spark, sf_dir):
    s = _serving(spark, sf_dir)
    return s.select("muid", *[F.array_join(f"seq_{f}", ",").alias(f"seq_{f}") for f in SERVING_FEATURES],
                    F.size(F.filter("padding_mask", lambda x: x)).cast("int").alias("n_padding"),
                    "n_events")


@query("SEQ-2")
def seq_2(spark, sf_dir):
    return skew_report(_serving(spark, sf_dir)).withColumn("mean_abs_diff", r9("mean_abs_diff"))


@query("LBL-8")
def lbl_8(spark, sf_dir):
    e = ev(spark, sf_dir)
    lab = future_labels(e, build_vocab(e), horizon=5)
    return lab.select(*[r9(c).alias(c) if c in ("target_engagement", "target_inactivity") else F.col(c)
                        for c in lab.columns])


@query("SET-3")
def set_3(spark, sf_dir):
    """Request-time events (each user's newest 5) merged with stored history
    (all but the newest 3), dedup on event_id, then the serving sequence."""
    from seqwise.operators.sampling import merge_recent
    e = ev(spark, sf_dir)
    recent = A.newest_events(e, 5)
    newest3 = A.newest_events(e, 3).select("event_id")
    history = e.join(newest3, "event_id", "left_anti")
    merged = merge_recent(history, recent)
    s = serving_windows(merged, build_vocab(e))
    return s.select("muid", F.array_join("seq_event_name", ",").alias("seq_event_name"), "n_events")


# ------------------------------------------------------------------ joins
@query("JOI-1")
def joi_1(spark, sf_dir):
    """Events of users in region 0 (semi join to a chosen user set)."""
    cust = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_regionkey = 0").select("n_nationkey")
    chosen = cust.join(F.broadcast(nation), cust.c_nationkey == nation.n_nationkey, "left_semi") \
                 .select(F.col("c_custkey").alias("muid"))
    return ev(spark, sf_dir, ["event_id", "muid"]).join(chosen, "muid", "left_semi")


@query("JOI-2")
def joi_2(spark, sf_dir):
    """Users with their event counts; users without events are skipped
    (aggregate first, then join: one row per user crosses the shuffle)."""
    users = read_users(spark, sf_dir).select("id", "name")
    counts = A.count_by_user(ev(spark, sf_dir, ["muid"]))
    return users.join(counts, users.id == counts.muid, "inner").select("id", "name", "n_events")


@query("JOI-3")
def joi_3(spark, sf_dir):
    store = _store_table(spark, sf_dir)
    cache = store.withColumn("computed_at", F.lit(AS_OF).cast("timestamp_ntz")
                             - F.make_interval(secs=(F.lit(3590) + F.col("user_id") % 20).cast("int")))
    requests = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    out = ST.lookup_features(requests, cache, store, AS_OF)
    return out.select("user_id", "source", F.col("features.total_events").alias("total_events"), "write_back")


@query("JOI-3-writeback")
def joi_3_writeback(spark, sf_dir):
    """The cache after writing back the store hits of the JOI-3 lookup."""
    store = _store_table(spark, sf_dir)
    cache = store.withColumn("computed_at", F.lit(AS_OF).cast("timestamp_ntz")
                             - F.make_interval(secs=(F.lit(3590) + F.col("user_id") % 20).cast("int")))
    requests = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    stored = KeyedTable.create(cache.select("user_id", "features", "computed_at"), scratch_path(spark, "cache"),
                               ST.STORE_KEY)
    ST.write_back(stored, ST.lookup_features(requests, stored.read(), store, AS_OF), AS_OF)
    return stored.read().select("user_id", F.col("features.total_events").alias("total_events"),
                                (F.col("computed_at") == F.lit(AS_OF).cast("timestamp_ntz")).alias("written_back"))


@query("JOI-4")
def joi_4(spark, sf_dir):
    e = ev(spark, sf_dir, ["event_id", "muid", "event_name", "event_time"])
    j = FB.next_event_after(SC.prediction_log(e), e)
    return j.select("prediction_id", "actual_event_id", "actual_event_name")


@query("JOI-5")
def joi_5(spark, sf_dir):
    log = _log(spark, sf_dir)
    versions = log.groupBy(F.col("model_version").alias("version")).agg(F.count(F.lit(1)).alias("n_logged"))
    versions = versions.withColumn("is_active", F.col("version") == F.lit("v1"))
    j = log.join(broadcast_checked(versions), log.model_version == F.col("version"), "left")
    return j.select("prediction_id", "model_version", "is_active")


# ------------------------------------------------------------------ store
@query("STO-1")
def sto_1(spark, sf_dir):
    """A batch upserted into the bucketed store as deltas of its own buckets."""
    return _flat_store(_stored(spark, sf_dir).read())


@query("STO-2")
def sto_2(spark, sf_dir):
    requests = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    return _flat_store(_stored(spark, sf_dir).get_all(requests))


@query("PRJ-4-key")
def prj_4_key(spark, sf_dir):
    """The stored features of one user by primary key: one bucket is opened."""
    return _flat_store(_stored(spark, sf_dir).get(7))


def _versions(spark, sf_dir):
    """The registry of the versions in the log, clustered by version."""
    log = _log(spark, sf_dir)
    rows = (log.groupBy(F.col("model_version").alias("version")).agg(F.count(F.lit(1)).alias("n_logged"))
            .withColumn("is_active", F.col("version") == F.lit("v1")))
    return spark.read.schema(rows.schema).parquet(write_clustered(rows, scratch_path(spark, "versions"), "version"))


@query("PRJ-4-active")
def prj_4_active(spark, sf_dir):
    return _versions(spark, sf_dir).where("is_active")


@query("PRJ-4-version")
def prj_4_version(spark, sf_dir):
    return _versions(spark, sf_dir).where(F.col("version") == "v0")


@query("STO-3")
def sto_3(spark, sf_dir):
    log = _log(spark, sf_dir)
    rows = log.select("prediction_id", "user_id", "model_version", "created_at",
                      F.struct("window_events").alias("input_sequence"),
                      F.struct("purchase_probability", "churn_risk", "predicted_next_event",
                               "engagement_score", "inactivity_risk").alias("predictions"),
                      F.to_date("created_at").alias("day"))
    path = scratch_path(spark, "prediction_log")
    rows.write.mode("append").option("maxRecordsPerFile", 50_000).partitionBy("day").parquet(path)
    back = spark.read.parquet(path)
    return back.select("prediction_id", "user_id", "model_version",
                       F.col("predictions.predicted_next_event").alias("predicted_next_event"),
                       r9("predictions.purchase_probability").alias("purchase_probability"),
                       F.col("input_sequence.window_events").alias("window_events"))


@query("STO-4")
def sto_4(spark, sf_dir):
    """Log predictions by day, attach the actual outcome, and rewrite only the
    day partitions whose rows got an outcome (dynamic partition overwrite)."""
    from seqwise.operators.util import broadcast_checked
    from seqwise.session import ensure_checkpoint_dir
    from seqwise.sources.sinks import overwrite_partitions
    path = scratch_path(spark, "prediction_log_outcomes")
    e = ev(spark, sf_dir, ["event_id", "muid", "event_name", "event_time"])
    (SC.prediction_log(e).select("prediction_id", "user_id", "model_version", "predicted_next_event", "created_at",
                                 F.date_format("created_at", "yyyy-MM-dd").alias("day"),
                                 F.lit(None).cast("struct<event_name:string,event_id:bigint>").alias("actual_outcome"))
     .write.mode("overwrite").partitionBy("day").parquet(path))
    # From here on only the stored log is read, as a later job would.
    stored = spark.read.parquet(path).withColumn("day", F.col("day").cast("string"))
    end = e.agg(F.max(epoch_us(e, "event_time")).alias("_data_end"))
    j = A.with_stats_row(FB.next_event_after(stored, e), end)
    found = F.struct(F.col("actual").alias("event_name"), F.col("actual_event_id").alias("event_id"))
    j = (FB.actual_outcome(j, F.col("_data_end"))
         .withColumn("actual_outcome", F.when(F.col("actual").isNotNull(), found)).select(*stored.columns))
    # the partitions read are those rewritten: the new rows are settled first
    ensure_checkpoint_dir(spark)
    j = j.checkpoint()
    touched = j.where(F.col("actual_outcome").isNotNull()).select("day").distinct()
    overwrite_partitions(j.join(broadcast_checked(touched), "day", "left_semi").select(*stored.columns), path, "day")
    back = spark.read.parquet(path)
    return back.select("prediction_id", F.col("actual_outcome.event_name").alias("actual_event_name"),
                       F.col("actual_outcome.event_id").alias("actual_event_id"))


@query("SRC-10")
def src_10(spark, sf_dir):
    docs = ST.features_to_json(_store_v2(spark, sf_dir))
    return _flat_store(ST.features_from_json(docs))


# ------------------------------------------------------------------ scoring
def _scalar_scores(df):
    return df.select("muid", "event_id", r9("p_purchase").alias("p_purchase"), r9("p_churn").alias("p_churn"),
                     r9("p_engagement").alias("p_engagement"), r9("p_inactivity").alias("p_inactivity"),
                     argmax0("p_next_event").alias("next_idx"), argmax0("p_channel").alias("channel_idx"),
                     argmax0("p_action").alias("action_idx"), argmax0("p_active_period").alias("period_idx"))


@query("SCO-1")
def sco_1(spark, sf_dir):
    d = SC.decode_predictions(_scored(spark, sf_dir), EVENT_NAMES, CHANNELS)
    return d.select("muid", "event_id", r9("purchase_probability").alias("purchase_probability"),
                    r9("churn_risk").alias("churn_risk"), "next_event", "preferred_channel",
                    r9("engagement_score").alias("engagement_score"),
                    r9("inactivity_risk").alias("inactivity_risk"), "recommended_action", "active_time")


@query("SCO-2")
def sco_2(spark, sf_dir):
    h = SC.heuristic_score(_serving(spark, sf_dir))
    return h.select("muid", "purchase_probability", "churn_risk", "predicted_next_event",
                    "preferred_channel", r9("engagement_score").alias("engagement_score"),
                    "inactivity_risk", "active_time")


@query("SCO-3")
def sco_3(spark, sf_dir):
    """The same scores through the pluggable scorer (Arrow batches)."""
    return _scalar_scores(SC.score_windows(_windows(spark, sf_dir)))


@query("DQ-7")
def dq_7(spark, sf_dir):
    d = SC.decode_predictions(_scored(spark, sf_dir), EVENT_NAMES, CHANNELS)
    return Q.range_check(d, ["purchase_probability", "churn_risk"])


# ------------------------------------------------------------------ metrics
def _r9_all(df):
    return df.select(*[r9(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("MET-1")
def met_1(spark, sf_dir):
    return _r9_all(M.evaluate(_scored(spark, sf_dir)))


@query("MET-2")
def met_2(spark, sf_dir):
    m = M.evaluate(_scored(spark, sf_dir))
    return m.select(r9(F.col("next_event_acc") / 100).alias("next_event_accuracy"), "n")


@query("MET-3")
def met_3(spark, sf_dir):
    return _r9_all(M.composite_score(M.evaluate(_scored(spark, sf_dir))).select("val_score"))


@query("MET-4")
def met_4(spark, sf_dir):
    return _r9_all(M.losses(_scored(spark, sf_dir)).select("focal_purchase", "focal_churn"))


@query("MET-5")
def met_5(spark, sf_dir):
    return _r9_all(M.losses(_scored(spark, sf_dir)).select(
        "ce_next_event", "ce_channel", "ce_action", "ce_period"))


@query("MET-6")
def met_6(spark, sf_dir):
    return _r9_all(M.losses(_scored(spark, sf_dir)).select("mse_engagement", "mse_inactivity"))


@query("MET-7")
def met_7(spark, sf_dir):
    return _r9_all(M.losses(_scored(spark, sf_dir)).select("total_focal", "total_bce"))


@query("MET-8")
def met_8(spark, sf_dir):
    j = _log_with_outcome(spark, sf_dir)
    r = j.where(F.col("actual").isNotNull())
    out = r.groupBy("model_version").agg(
        F.count(F.lit(1)).alias("resolved"),
        (F.avg(F.when(F.col("predicted_next_event") == F.col("actual"), 1.0).otherwise(0.0)) * 100)
        .alias("next_event_acc"),
        (F.avg(F.when((F.col("purchase_probability") / 100 > 0.5) == (F.col("actual") == "purchase"), 1.0)
               .otherwise(0.0)) * 100).alias("purchase_acc"),
        F.avg("reward").alias("mean_reward"))
    return _r9_all(out)


@query("MET-8-windows")
def met_8_windows(spark, sf_dir):
    """All eight metrics per model version over the scored windows."""
    s = _scored(spark, sf_dir)
    return _r9_all(M.evaluate(s.withColumn("model_version", SC.version_of(s)), ["model_version"]))


@query("AGG-12")
def agg_12(spark, sf_dir):
    j = _log_with_outcome(spark, sf_dir).withColumn("actual_event_name", F.col("actual"))
    return A.log_counts(j).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _drift(counts, pairs):
    d = DR.drift(counts, pairs)
    return d.select(F.col("group").alias("compared"), "reference", "metric", "n", "n_reference",
                    r9("psi").alias("psi"), r9("distance").alias("distance"))


@query("AGG-12-drift")
def agg_12_drift(spark, sf_dir):
    """How far the predictions of each model version lie from those of v0."""
    counts = DR.binned_counts(_log(spark, sf_dir), F.col("model_version"))
    return _drift(counts, DR.against(counts, "v0"))


@query("AGG-12-drift-day")
def agg_12_drift_day(spark, sf_dir):
    """Each day's predictions against those of the day before."""
    counts = DR.binned_counts(_log(spark, sf_dir), F.date_format("created_at", "yyyy-MM-dd"))
    return _drift(counts, DR.against_previous(counts))


# ------------------------------------------------------------------ feedback
@query("FBK-1")
def fbk_1(spark, sf_dir):
    j = _log_with_outcome(spark, sf_dir)
    return j.select("prediction_id", "predicted_next_event", "actual", "reward")


@query("FBK-2")
def fbk_2(spark, sf_dir):
    return _r9_all(FB.reward_by_action(_log_with_outcome(spark, sf_dir)))


# ------------------------------------------------------------------ training
@query("TRN-1")
def trn_1(spark, sf_dir):
    """Fit the 8 heads on the user-level training split, score the validation
    split; output the decoded predictions with their targets."""
    from seqwise.operators.sampling import split_by_user
    from seqwise.operators.training import fit_heads, predict_heads
    from seqwise.operators.windows import TARGETS
    w = split_by_user(sliding_windows(ev(spark, sf_dir, TRAIN_COLUMNS + ["event_id"])), 15, seed=42)
    models = fit_heads(w.where(F.col("split") == "train"))
    val = predict_heads(models, w.where(F.col("split") == "val"), ["muid", "event_id", *TARGETS])
    return SC.decode_predictions(val, EVENT_NAMES, CHANNELS).select(
        "muid", "event_id", *TARGETS, "purchase_probability", "churn_risk", "next_event", "preferred_channel",
        "engagement_score", "inactivity_risk", "recommended_action", "active_time")


@query("TRN-1-eval")
def trn_1_eval(spark, sf_dir):
    """Validation metrics of the fitted heads (MET-1 on TRN-1)."""
    from seqwise.operators.sampling import split_by_user
    from seqwise.operators.training import fit_heads, predict_heads
    from seqwise.operators.windows import TARGETS
    w = split_by_user(sliding_windows(ev(spark, sf_dir, TRAIN_COLUMNS + ["event_id"])), 15, seed=42)
    models = fit_heads(w.where(F.col("split") == "train"))
    val = predict_heads(models, w.where(F.col("split") == "val"), ["muid", "event_id", *TARGETS])
    return M.evaluate(val)


@query("TRN-1-joint")
def trn_1_joint(spark, sf_dir):
    """Fit the 8 heads together on the weighted total loss, stopped early on the
    validation split; output that split's decoded predictions with their targets."""
    from seqwise.operators.joint import fit_jointly, predict_jointly
    from seqwise.operators.sampling import split_by_user
    from seqwise.operators.windows import TARGETS
    w = split_by_user(sliding_windows(ev(spark, sf_dir, TRAIN_COLUMNS + ["event_id"])), 15, seed=42)
    model = fit_jointly(w, F.col("split") == "val", steps=15)
    val = predict_jointly(model, w.where(F.col("split") == "val"), ["muid", "event_id", *TARGETS])
    return SC.decode_predictions(val, EVENT_NAMES, CHANNELS).select(
        "muid", "event_id", *TARGETS, "purchase_probability", "churn_risk", "next_event", "preferred_channel",
        "engagement_score", "inactivity_risk", "recommended_action", "active_time")


@query("SRT-4")
def srt_4(spark, sf_dir):
    """Newest 5 prediction logs of every user."""
    log = _log(spark, sf_dir)
    top = A.newest_events(log, 5, key="user_id", time_col="created_at", tie="prediction_id")
    return top.select("prediction_id", "user_id", "predicted_next_event")


@query("predict_batch")
def predict_batch_q(spark, sf_dir):
    """Batch form of the prediction entry point: request events (each user's
    newest 5) merged with history (all but the newest 3), serving window,
    scorer, decoded fields."""
    e = ev(spark, sf_dir)
    recent = A.newest_events(e, 5)
    history = e.join(A.newest_events(e, 3).select("event_id"), "event_id", "left_anti")
    p = SC.predict_batch(history, recent, build_vocab(e), EVENT_NAMES, CHANNELS)
    return p.select("user_id", "model_version", "window_events",
                    *[r9(c).alias(c) for c in ["purchase_probability", "churn_risk", "engagement_score",
                                               "inactivity_risk"]],
                    "next_event", "preferred_channel", "recommended_action", "active_time")
