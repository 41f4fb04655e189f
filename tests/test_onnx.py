import tempfile

import numpy as np

from conftest import SF001
from onnx_fixture import model_bytes
from seqwise.operators.scoring import onnx_scorer_factory, score_windows
from seqwise.operators.windows import NUMERIC_FEATURES, sliding_windows
from seqwise.sources import TRAIN_COLUMNS, load_events


def test_onnx_scorer_in_batch_scoring(spark):
    path = tempfile.mkdtemp(prefix="onnx-", dir="/tmp") + "/m.onnx"
    open(path, "wb").write(model_bytes())
    w = sliding_windows(load_events(spark, SF001, TRAIN_COLUMNS + ["event_id"]))
    scored = score_windows(w.select("muid", "event_id", *NUMERIC_FEATURES), onnx_scorer_factory(path),
                           keep=["muid", "event_id"])
    feats = {r.event_id: np.array([r[c] for c in NUMERIC_FEATURES], dtype=np.float32)
             for r in w.select("event_id", *NUMERIC_FEATURES).collect()}
    rows = scored.collect()
    assert len(rows) == 700
    for r in rows:
        x = feats[r.event_id]
        assert np.isclose(r.p_purchase, x.mean(), atol=1e-6) and np.isclose(r.p_churn, x.max(), atol=1e-6)
        assert np.isclose(r.p_engagement, x.min(), atol=1e-6) and np.isclose(r.p_inactivity, np.abs(x).sum(), atol=1e-5)
        assert np.allclose(r.p_next_event, x, atol=1e-6) and len(r.p_action) == 6
