from pyspark.sql import functions as F

from conftest import SF001
from seqwise.operators import metrics as M
from seqwise.operators.sampling import split_by_user
from seqwise.operators.training import fit_heads, predict_heads
from seqwise.operators.windows import TARGETS, sliding_windows
from seqwise.sources import TRAIN_COLUMNS, load_events


def test_heads_fit_and_score(spark):
    w = split_by_user(sliding_windows(load_events(spark, SF001, TRAIN_COLUMNS + ["event_id"])), 30, seed=42)
    models = fit_heads(w.where(F.col("split") == "train"), max_iter=10)
    val = predict_heads(models, w.where(F.col("split") == "val"), ["muid", "event_id", *TARGETS])
    r = val.select(F.size("p_next_event").alias("ne"), F.size("p_channel").alias("ch"),
                   F.size("p_action").alias("ac"), F.size("p_active_period").alias("pe")).distinct().collect()
    assert [tuple(x) for x in r] == [(7, 3, 20, 4)]
    m = M.evaluate(val).first()
    assert m.n == val.count() > 0 and 0 <= m.purchase_acc <= 100 and m.engagement_mae >= 0
