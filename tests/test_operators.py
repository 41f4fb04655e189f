import datetime as dt
import math

import numpy as np

from pyspark.sql import functions as F

from conftest import SF01
from helpers import T0, ev, frame
from seqwise.operators import aggregates as A
from seqwise.operators import feedback as FB
from seqwise.operators import metrics as M
from seqwise.operators import quality as Q
from seqwise.operators import scoring as SC
from seqwise.operators import vocab as V
from seqwise.operators.labels import future_labels
from seqwise.operators.sampling import user_positions
from seqwise.operators.sequences import serving_windows
from seqwise.sources import load_events


def _same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_user_features_golden(spark):
    # Two events -> total 2, one purchase, channel "app", one category.
    rows = [ev(1, 9, dt.datetime(2024, 1, 1, 10, 0), "viewcontent", session="s1", channel="app"),
            ev(2, 9, dt.datetime(2024, 1, 1, 10, 5), "purchase", session="s1", channel="app")]
    r = A.user_features(frame(spark, rows), "2024-01-03 10:05:00").first()
    assert (r.total_events, r.purchase_count, r.preferred_channel, r.unique_categories) == (2, 1, "app", 1)
    assert r.session_count == 1 and r.days_since_active == 2


def test_mode_ties_and_all_null(spark):
    rows = [ev(1, 1, T0, channel="browser"), ev(2, 1, T0 + dt.timedelta(seconds=1), channel="app"),
            ev(3, 2, T0, channel=None), ev(4, 2, T0 + dt.timedelta(seconds=1), channel=None)]
    got = {r.muid: r.preferred_channel for r in A.user_features(frame(spark, rows), "2024-02-01 00:00:00").collect()}
    assert got == {1: "app", 2: None}


def test_days_since_active_floors_negative(spark):
    rows = [ev(1, 1, dt.datetime(2024, 1, 2, 12, 0))]
    r = A.user_features(frame(spark, rows), "2024-01-02 00:00:00").first()
    assert r.days_since_active == -1


def test_class_weights_rules(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,), (5,)], "y int")
    got = {r.cls: r.weight for r in A.class_weights(df, "y", 3).collect()}
    # total 5 includes the out-of-range label 5; class 2 absent -> 1.0
    assert math.isclose(got[0], 5 / (3 * 3)) and math.isclose(got[1], min(5 / 3, 10.0)) and got[2] == 1.0


def test_batch_size_rule(spark):
    rows = [("a", i) for i in range(1)] + [("b", i) for i in range(1000)] + [("c", i) for i in range(1001)]
    got = {r.batch: r.valid for r in Q.validate_batches(spark.createDataFrame(rows, "batch string, i int"), "batch").collect()}
    assert got == {"a": True, "b": True, "c": False}


def test_validation_reasons(spark):
    rows = [ev(1, 1, T0, name="x" * 51), ev(2, None, T0), ev(3, 1, T0, device="d" * 21)]
    got = {r.event_id: r.reject_reason for r in Q.validate_events(frame(spark, rows)).collect()}
    assert got == {1: "too_long_event_name", 2: "missing_muid", 3: "too_long_device_os"}


def test_static_and_dynamic_unknowns(spark):
    # Out-of-vocabulary values: static encode gives 0, dynamic encode gives 1.
    from seqwise.functions.columns import encode_static, norm_text
    known = frame(spark, [ev(1, 1, T0, "pageview", channel="app", category="books")])
    oov = frame(spark, [ev(2, 1, T0, "view_item", channel="mobile", category="shoes")])
    s = oov.select(encode_static("event_name", "event_name").alias("e"), encode_static("channel", "channel").alias("c"),
                   encode_static("category", norm_text("category")).alias("k")).first()
    assert tuple(s) == (0, 0, 0)
    d = V.encode_dynamic(oov, V.build_vocab(known), ["event_name", "channel", "category"]).first()
    assert (d.event_name_id, d.channel_id, d.category_id) == (1, 1, 1)


def test_vocab_first_appearance(spark):
    rows = [ev(1, 1, T0 + dt.timedelta(seconds=5), "b"), ev(2, 2, T0, "c"), ev(3, 1, T0 + dt.timedelta(seconds=9), "a")]
    v = V.build_vocab(frame(spark, rows), ["event_name"])
    got = {r.value: r.id for r in v.collect()}
    assert got == {"<PAD>": 0, "<UNK>": 1, "c": 2, "b": 3, "a": 4}


def test_serving_window_one_event_padding(spark):
    rows = [ev(1, 5, T0, "pageview", device="desktop", channel="browser", source="direct", category="home")]
    df = frame(spark, rows)
    r = serving_windows(df, V.build_vocab(df)).first()
    assert r.seq_event_name == [0] * 19 + [2] and r.padding_mask == [True] * 19 + [False] and r.n_events == 1


def test_split_paths_equal_plain_paths(spark):
    e = load_events(spark, SF01)
    vocab = V.build_vocab(e)
    assert _same(future_labels(e, vocab, 5, hot=None), future_labels(e, vocab, 5, rows_per_split=9))
    small = e.select("event_id", "muid", "event_time")
    assert _same(user_positions(small, hot=None), user_positions(small, rows_per_split=9))
    pe = e.select("event_id", "muid", "event_name", "event_time")
    assert _same(SC.prediction_log(pe, hot=None), SC.prediction_log(pe, rows_per_split=9))
    preds = SC.prediction_log(pe, hot=None)
    assert _same(FB.next_event_after(preds, pe, hot=None), FB.next_event_after(preds, pe, rows_per_split=9))


def test_reward_order(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "churn"), ("a", "purchase"), ("a", "checkout"), ("a", "b"),
                                ("churn", "churn"), ("a", None)], "predicted_next_event string, actual string")
    got = [r.reward for r in FB.reward(df).collect()]
    assert got == [1.0, -2.0, 0.5, 0.5, -0.1, 1.0, None]


def _pytorch_ce(logits, y, w, eps):
    """NumPy restatement of mean CE with class weights and label smoothing."""
    lp = logits - logits.max(1, keepdims=True)
    lp = lp - np.log(np.exp(lp).sum(1, keepdims=True))
    wy = w[y]
    nll = (wy * -lp[np.arange(len(y)), y]).sum() / wy.sum()
    smooth = (-(lp * w[None, :]).sum(1)).sum() / wy.sum()
    return (1 - eps) * nll + eps / logits.shape[1] * smooth


def test_cross_entropy_matches_pytorch_formula(spark):
    rng = np.random.default_rng(3)
    logits = rng.normal(size=(50, 4))
    y = rng.integers(0, 4, 50)
    w = np.array([0.5, 2.0, 1.0, 3.0])
    df = spark.createDataFrame([(list(map(float, l)), int(t)) for l, t in zip(logits, y)], "lg array<double>, y int")
    counts = np.bincount(y, minlength=4)
    w = np.where(counts == 0, 1.0, np.clip(len(y) / (4 * np.maximum(counts, 1)), 0.1, 10.0))
    got = M.ce_loss_frame(df, "lg", "y", 4, 0.1, weighted=True).first().loss
    assert math.isclose(got, _pytorch_ce(logits, y, w, 0.1), rel_tol=1e-9)
    plain = M.ce_loss_frame(df, "lg", "y", 4).first().loss
    assert math.isclose(plain, _pytorch_ce(logits, y, np.ones(4), 0.0), rel_tol=1e-9)


def test_focal_loss(spark):
    x, yv = 0.7, 1.0
    bce = max(x, 0) - x * yv + math.log1p(math.exp(-abs(x)))
    exp = 0.25 * (1 - math.exp(-bce)) ** 2 * bce
    df = spark.createDataFrame([(x, yv)], "x double, y double")
    assert math.isclose(df.select(M.focal_terms("x", "y")).first()[0], exp, rel_tol=1e-12)


def test_decode_first_max_and_unknown(spark):
    df = spark.createDataFrame([(0.0, 0.0, [1.0, 3.0, 3.0], [0.0, 0.0, 9.0], 0.2, 0.3, [0.0, 1.0], [2.0, 2.0])],
                               "p_purchase double, p_churn double, p_next_event array<double>, "
                               "p_channel array<double>, p_engagement double, p_inactivity double, "
                               "p_action array<double>, p_active_period array<double>")
    r = SC.decode_predictions(df, ["<PAD>", "scroll", "add_to_cart"], ["<PAD>", "browser"]).first()
    assert r.next_event == "scroll" and r.preferred_channel == "unknown"
    assert r.purchase_probability == 0.5 and r.recommended_action == "action_1" and r.active_time == "period_0"


def test_asof_split_path_with_predictions_between_events(spark):
    """Predictions at times where no event happened still find the next event."""
    e = load_events(spark, SF01).select("event_id", "muid", "event_name", "event_time")
    preds = (SC.prediction_log(e, hot=None)
             .withColumn("created_at", F.col("created_at") + F.make_interval(secs=F.lit(1.5))))
    assert _same(FB.next_event_after(preds, e, hot=None), FB.next_event_after(preds, e, rows_per_split=9))


def test_split_validation_never_empty(spark):
    from seqwise.operators.sampling import md5_bucket, split_by_user
    df = spark.range(40).withColumnRenamed("id", "muid")
    b = {r.muid: r.b for r in df.select("muid", md5_bucket("muid", 42).alias("b")).collect()}
    # choose users that all have bucket >= 15, so the plain rule gives no validation user
    users = [u for u, x in b.items() if x >= 15][:3]
    got = split_by_user(spark.createDataFrame([(u,) for u in users], "muid long")).collect()
    vals = [r.muid for r in got if r.split == "val"]
    assert vals == [min(users, key=lambda u: b[u])]
