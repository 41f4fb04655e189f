"""The joint fit: its loss is MET-7's, its gradient the numeric one; skewed,
null and empty rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from seqwise.operators import joint as J
from seqwise.operators import metrics as M
from seqwise.operators.sampling import split_by_user
from seqwise.operators.windows import LAST_EVENT_FEATURES, NUMERIC_FEATURES, TARGETS, sliding_windows
from seqwise.sources import TRAIN_COLUMNS, load_events


@pytest.fixture(scope="module")
def rows(spark):
    w = split_by_user(sliding_windows(load_events(spark, SF001, TRAIN_COLUMNS + ["event_id"])), 30, seed=42)
    return w.select("muid", "event_id", *NUMERIC_FEATURES, *LAST_EVENT_FEATURES, *TARGETS, "split").checkpoint()


def test_reported_loss_is_the_weighted_total(rows):
    model = J.fit_jointly(rows, F.col("split") == "val", steps=8)
    train = J.predict_jointly(model, rows.where("split = 'train'"), ["muid", *TARGETS])
    assert M.losses(train).first().total_focal == pytest.approx(model.train_loss, rel=1e-9)
    val = [h["val_loss"] for h in model.history]
    assert min(val) < 0.9 * val[0] and len(model.history) <= 9
    sizes = train.select(F.size("p_next_event"), F.size("p_channel"), F.size("p_action"), F.size("p_active_period"))
    assert [tuple(r) for r in sizes.distinct().collect()] == [(7, 3, 20, 4)]


def test_gradient_is_the_numeric_one(spark, rows):
    some = rows.limit(120).withColumn("_val", F.col("event_id") % 5 == 0)
    some = some.withColumn("target_purchase", F.when(F.col("event_id") % 7 != 0, F.col("target_purchase"))) \
               .withColumn("target_channel", F.when(F.col("event_id") % 3 == 0, F.lit(9)).otherwise(F.col("target_channel"))) \
               .withColumn("last_hour_id", F.when(F.col("event_id") % 4 != 0, F.col("last_hour_id"))).checkpoint()
    design = J.make_design(some.where("not _val"))
    r = np.random.default_rng(1)
    w = r.normal(size=(design.width, J.N_OUT)) * 0.3
    loss, val, grad = J.one_pass(some.repartition(5), design, w)
    one = J.one_pass(some.coalesce(1), design, w)
    assert one[0] == pytest.approx(loss) and one[1] == pytest.approx(val) and np.allclose(one[2], grad)
    for i, j in [(0, 0), (2, 1), (0, 5), (3, 11), (design.width - 1, 20), (1, 33), (0, 36), (6, 37)]:
        step = np.zeros_like(w)
        step[i, j] = 1e-5
        up, down = (J.one_pass(some.coalesce(1), design, w + k * step)[0] for k in (1, -1))
        assert grad[i, j] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-8)


def test_early_stop_keeps_the_best_step(spark, rows):
    # validation rows whose targets contradict the training rows: their loss only grows
    train = rows.where("split = 'train'").limit(200)
    wrong = {"target_purchase": 1 - F.col("target_purchase"), "target_churn": 1 - F.col("target_churn"),
             "target_next_event": (F.col("target_next_event") + 3) % 7, "target_channel": (F.col("target_channel") + 1) % 3,
             "target_recommended_action": (F.col("target_recommended_action") + 9) % 20,
             "target_active_period": (F.col("target_active_period") + 2) % 4,
             "target_engagement": -5 * F.col("target_engagement"), "target_inactivity": -5 * F.col("target_inactivity")}
    bad = train.withColumns(wrong).withColumn("split", F.lit("val"))
    model = J.fit_jointly(train.unionByName(bad), F.col("split") == "val", steps=40, patience=2)
    val = [h["val_loss"] for h in model.history]
    kept = model.history[int(np.argmin(val))]
    assert model.train_loss == kept["train_loss"] and len(val) < 41
    assert len(val) - 1 - kept["step"] in (0, 1, 2)


def test_unseen_levels_nulls_and_no_rows(spark, rows):
    model = J.fit_jointly(rows.where("split = 'train'"), F.lit(None).cast("boolean"), steps=2)
    assert model.history[-1]["val_loss"] is None
    odd = rows.limit(3).withColumn("last_event_name_id", F.lit(999)).withColumn("avg_time_delta", F.lit(None).cast("double")) \
              .withColumn("last_hour_id", F.lit(None).cast("int"))
    got = J.predict_jointly(model, odd, ["muid"]).collect()
    assert len(got) == 3 and all(None not in r and None not in r.p_action for r in got)
    with pytest.raises(ValueError, match="no training rows"):
        J.fit_jointly(rows.limit(0), F.lit(False))
