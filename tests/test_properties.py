"""Property test: random event sequences, Spark windows == plain-Python rules."""

import datetime as dt
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helpers import T0, ev, frame
from test_windows import brute_windows
from seqwise.operators.windows import sliding_windows

NAMES = ["scroll", "add_to_cart", "purchase", "pageview", "search", "error"]


@st.composite
def event_sets(draw):
    rows, eid = [], 0
    for muid in range(draw(st.integers(1, 3))):
        t = T0
        for _ in range(draw(st.integers(15, 45))):
            t = t + dt.timedelta(seconds=draw(st.sampled_from([0, 1, 60, 3600, 86400 * 3, 604800, 604801])))
            rows.append(ev(eid, muid, t, draw(st.sampled_from(NAMES)),
                           session=draw(st.sampled_from([None, "a", "b", "c"])),
                           channel=draw(st.sampled_from([None, "app", "browser"]))))
            eid += 1
    return rows


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=event_sets())
def test_windows_equal_rules(spark, rows):
    exp = brute_windows(rows)
    df = frame(spark, rows)
    for kw in ({"hot": None}, {"rows_per_split": 10}):
        got = {r["event_id"]: r.asDict() for r in sliding_windows(df, **kw).collect()}
        assert set(got) == set(exp)
        for k, e in exp.items():
            for c, v in e.items():
                assert math.isclose(got[k][c], v, rel_tol=1e-9, abs_tol=1e-12), (kw, k, c)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=event_sets(), horizon=st.integers(1, 6))
def test_future_labels_equal_rules(spark, rows, horizon):
    from seqwise.operators.labels import future_labels
    from seqwise.operators.vocab import build_vocab
    from test_labels import brute_future
    df = frame(spark, rows)
    vocab = build_vocab(df)
    exp = brute_future(rows, [(r.feature, r.value, r.id) for r in vocab.collect()], horizon)
    for kw in ({"hot": None}, {"rows_per_split": 10}):
        got = {r.event_id: tuple(r)[2:] for r in future_labels(df, vocab, horizon=horizon, **kw).collect()}
        assert got == exp, kw


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=event_sets(), data=st.data())
def test_next_event_after_equal_rules(spark, rows, data):
    from seqwise.operators.feedback import next_event_after
    n = data.draw(st.integers(1, 30))
    preds = []
    for pid in range(n):
        r = rows[data.draw(st.integers(0, len(rows) - 1))]
        shift = data.draw(st.sampled_from([0, 1, -1, 3600]))
        preds.append((10_000 + pid, r[1], r[4] + dt.timedelta(seconds=shift)))
    exp = {}
    for pid, u, t in preds:
        later = sorted((e[4], e[0], e[3]) for e in rows if e[1] == u and e[4] > t)
        exp[pid] = (later[0][1], later[0][2]) if later else (None, None)
    pdf = spark.createDataFrame(preds, "prediction_id long, user_id long, created_at timestamp_ntz")
    evs = frame(spark, rows)
    for kw in ({"hot": None}, {"rows_per_split": 10}):
        got = {r.prediction_id: (r.actual_event_id, r.actual_event_name)
               for r in next_event_after(pdf, evs, **kw).collect()}
        assert got == exp, kw


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=event_sets())
def test_positions_and_features_equal_rules(spark, rows):
    from collections import Counter
    from seqwise.operators.aggregates import user_features
    from seqwise.operators.sampling import user_positions
    df = frame(spark, rows)
    by_user = {}
    for r in rows:
        by_user.setdefault(r[1], []).append(r)
    pos = {}
    for evs in by_user.values():
        for i, e in enumerate(sorted(evs, key=lambda x: (x[4], x[0]))):
            pos[e[0]] = i + 1
    for kw in ({"hot": None}, {"rows_per_split": 10}):
        got = {r.event_id: r.position for r in user_positions(df.select("event_id", "muid", "event_time"), **kw).collect()}
        assert got == pos, kw
    as_of = dt.datetime(2024, 3, 1, 12, 0, 0)
    exp = {}
    for u, evs in by_user.items():
        chans = Counter(e[6] for e in evs if e[6] is not None)
        top = max(chans.values()) if chans else None
        last = max(e[4] for e in evs)
        exp[u] = (len(evs), sum(e[3] == "purchase" for e in evs), len({e[8] for e in evs if e[8] is not None}),
                  len({e[2] for e in evs if e[2] is not None}), math.floor((as_of - last).total_seconds() / 86400),
                  min(k for k, v in chans.items() if v == top) if chans else None)
    got = {r.muid: (r.total_events, r.purchase_count, r.unique_categories, r.session_count, r.days_since_active,
                    r.preferred_channel) for r in user_features(df, "2024-03-01 12:00:00").collect()}
    assert got == exp


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=event_sets())
def test_serving_windows_equal_rules(spark, rows):
    from seqwise.operators.sequences import serving_windows
    from seqwise.operators.vocab import build_vocab
    df = frame(spark, rows)
    vocab = build_vocab(df)
    ids = {(r.feature, r.value): r.id for r in vocab.collect()}
    by_user = {}
    for r in rows:
        by_user.setdefault(r[1], []).append(r)
    exp = {}
    for u, evs in by_user.items():
        tail = sorted(evs, key=lambda x: (x[4], x[0]))[-20:]
        pad = 20 - len(tail)
        exp[u] = ([0] * pad + [ids.get(("event_name", e[3]), 1) for e in tail],
                  [0] * pad + [ids.get(("channel", e[6]), 1) if e[6] is not None else 1 for e in tail],
                  [True] * pad + [False] * len(tail))
    got = {r.muid: (r.seq_event_name, r.seq_channel, r.padding_mask) for r in serving_windows(df, vocab).collect()}
    assert got == exp
