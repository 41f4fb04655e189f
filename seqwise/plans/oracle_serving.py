"""DuckDB oracles for serving sequences, future labels, joins, store merges,
scoring, metrics and feedback."""

from __future__ import annotations

from seqwise.functions.constants import CHANNELS, EVENT_NAMES
from seqwise.plans.oracle import EV, PERIOD, _static as _static_vocab, windows_sql
from seqwise.plans.oracle_tables import USERS, user_features_sql, vocab_ctes

AS_OF = "2024-02-01 00:00:00"


def _static_ev(col: str) -> str:
    return _static_vocab("event_name", col)
CUTOFF = "2024-01-20 00:00:00"
WEEK_US = 168 * 3_600_000_000

PL = """pl AS (
  SELECT event_id AS prediction_id, muid AS user_id, 'v' || CAST(muid % 2 AS VARCHAR) AS model_version,
    event_time AS created_at, epoch_us(event_time) AS pt, CAST(n AS INTEGER) AS window_events,
    CAST(CASE WHEN event_name = 'purchase' THEN 2.0
         ELSE least(95.0, n * 5.0 + CASE WHEN cart = 1 THEN 40.0 ELSE 0.0 END) END AS DOUBLE) AS purchase_probability,
    CAST(CASE WHEN event_name = 'purchase' THEN 60.0 ELSE greatest(5.0, 80.0 - n * 10.0) END AS DOUBLE) AS churn_risk,
    CASE WHEN event_name = 'purchase' THEN 'pageview' WHEN cart = 1 THEN 'purchase'
         WHEN n > 2 THEN 'add_to_cart' ELSE 'viewcontent' END AS predicted_next_event,
    CAST(n AS DOUBLE) * 0.15 AS engagement_score, CAST(10 - n AS DOUBLE) AS inactivity_risk
  FROM (SELECT *, count(*) OVER f AS n,
          max(CASE WHEN event_name = 'add_to_cart' THEN 1 ELSE 0 END) OVER f AS cart
        FROM ev WINDOW f AS (PARTITION BY muid ORDER BY event_time, event_id
                             ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)))"""

OUTCOME = f"""nx AS (
  SELECT p.*, e.event_id AS actual_event_id, e.event_name AS actual_event_name, e.t AS actual_t
  FROM pl p ASOF LEFT JOIN (SELECT muid, event_id, event_name, epoch_us(event_time) AS t FROM ev) e
    ON p.user_id = e.muid AND e.t > p.pt),
oc AS (
  SELECT nx.*, CASE WHEN actual_t IS NOT NULL AND actual_t - pt <= {WEEK_US} THEN actual_event_name
    WHEN actual_t IS NOT NULL OR (SELECT max(epoch_us(event_time)) FROM ev) - pt >= {WEEK_US} THEN 'churn'
    END AS actual FROM nx),
rw AS (
  SELECT oc.*, CAST(CASE WHEN actual IS NULL THEN NULL WHEN predicted_next_event = actual THEN 1.0
    WHEN actual = 'churn' THEN -2.0 WHEN actual IN ('purchase', 'checkout') THEN 0.5 ELSE -0.1 END AS DOUBLE)
    AS reward FROM oc)"""

FEATS = "total_events, purchase_count, unique_categories, session_count, days_since_active, preferred_channel"
STORE = f"""v1 AS (SELECT *, 1 AS feature_version FROM ({user_features_sql(
    f"(SELECT * FROM ev WHERE event_time < TIMESTAMP '{CUTOFF}')", CUTOFF)})),
inc AS (SELECT *, 2 AS feature_version FROM ({user_features_sql('ev', AS_OF)})
        WHERE muid IN (SELECT muid FROM ev WHERE event_time >= TIMESTAMP '{CUTOFF}')),
store AS (SELECT muid AS user_id, feature_version, {FEATS} FROM inc
          UNION ALL SELECT muid, feature_version, {FEATS} FROM v1 WHERE muid NOT IN (SELECT muid FROM inc))"""

D = "CAST({x} AS DOUBLE)"


def _drift_sql(group: str, pairs: str) -> str:
    def number(c: str, hi: float) -> str:
        at = f"greatest(0, least(19, CAST(floor({c} * 20 / {hi}) AS INTEGER)))"
        return f"SELECT {group} AS g, '{c}' AS metric, lpad(CAST({at} AS VARCHAR), 6, '0') AS bin FROM pl"
    rows = " UNION ALL ".join([number("purchase_probability", 100.0), number("churn_risk", 100.0),
                               number("engagement_score", 3.0),
                               f"SELECT {group}, 'predicted_next_event', '=' || predicted_next_event FROM pl"])
    return f"""bins AS ({rows}), cnt AS (SELECT g, metric, bin, count(*) AS n FROM bins GROUP BY 1, 2, 3),
pairs AS ({pairs}),
both_ AS (SELECT compared, reference, metric, bin, sum(a) AS a, sum(b) AS b FROM (
    SELECT compared, reference, metric, bin, n AS a, 0 AS b FROM cnt JOIN pairs ON g = compared UNION ALL
    SELECT compared, reference, metric, bin, 0, n FROM cnt JOIN pairs ON g = reference) GROUP BY 1, 2, 3, 4),
sh AS (SELECT compared, reference, metric, a, b, sum(a) OVER o AS n, sum(b) OVER o AS m,
    sum(a) OVER u AS ca, sum(b) OVER u AS cb FROM both_
    WINDOW o AS (PARTITION BY compared, reference, metric), u AS (PARTITION BY compared, reference, metric
      ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT compared, reference, metric, CAST(max(n) AS BIGINT) AS n, CAST(max(m) AS BIGINT) AS n_reference,
  round(sum((greatest(a / n, 1e-4) - greatest(b / m, 1e-4)) * ln(greatest(a / n, 1e-4) / greatest(b / m, 1e-4))), 9) AS psi,
  round(max(abs(ca / n - cb / m)), 9) AS distance FROM sh GROUP BY 1, 2, 3"""


SCORED = """sc AS (
  SELECT muid, event_id, target_purchase, target_churn, target_next_event, target_channel,
    target_engagement, target_inactivity, target_recommended_action, target_active_period,
    pr * 10.0 - 1.0 AS p_purchase, sr * 4.0 - 2.0 AS p_churn,
    [0.0::DOUBLE, sr, ar, ut, 0.1::DOUBLE, 0.1::DOUBLE, pr] AS p_next_event,
    [0.0::DOUBLE, sc, 1.0 - sc] AS p_channel,
    1.0 - sr AS p_engagement, td AS p_inactivity,
    list_concat([0.0::DOUBLE, sr, ar, ut, 0.1::DOUBLE, 0.1::DOUBLE, pr],
                list_transform(range(13), lambda x: 0.0::DOUBLE)) AS p_action,
    [td, 0.5::DOUBLE, ut, 0.5::DOUBLE] AS p_active_period
  FROM wu)"""


def am(c: str) -> str:
    return f"(list_position({c}, list_max({c})) - 1)"


def sig(c: str) -> str:
    return f"(1.0 / (1.0 + exp(-{c})))"


def _name(values: list[str], idx: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {idx} {whens} ELSE 'unknown' END"


EVAL = f"""SELECT count(*) AS n,
  round(COALESCE(avg(CASE WHEN (CASE WHEN {sig('p_purchase')} > 0.5 THEN 1.0 ELSE 0.0 END) = target_purchase
                     THEN 1.0 ELSE 0.0 END) * 100, 0), 9) AS purchase_acc,
  round(COALESCE(avg(CASE WHEN (CASE WHEN {sig('p_churn')} > 0.5 THEN 1.0 ELSE 0.0 END) = target_churn
                     THEN 1.0 ELSE 0.0 END) * 100, 0), 9) AS churn_acc,
  round(avg(CASE WHEN {am('p_next_event')} = target_next_event THEN 1.0 ELSE 0.0 END) * 100, 9) AS next_event_acc,
  round(avg(CASE WHEN {am('p_channel')} = target_channel THEN 1.0 ELSE 0.0 END) * 100, 9) AS channel_acc,
  round(avg(CASE WHEN {am('p_action')} = target_recommended_action THEN 1.0 ELSE 0.0 END) * 100, 9) AS action_acc,
  round(avg(CASE WHEN {am('p_active_period')} = target_active_period THEN 1.0 ELSE 0.0 END) * 100, 9) AS period_acc,
  round(avg(abs(p_engagement - target_engagement)), 9) AS engagement_mae,
  round(avg(abs(p_inactivity - target_inactivity)), 9) AS inactivity_mae
FROM sc"""

BCE = "(greatest({x}, 0) - {x} * {y} + ln(1 + exp(-abs({x}))))"


def focal(x: str, y: str) -> str:
    b = BCE.format(x=x, y=y)
    return f"(0.25 * power(1.0 - exp(-{b}), 2) * {b})"


def _cw(head: str, target: str, c: int) -> str:
    return f"""cw_{head} AS (
  SELECT list(weight ORDER BY cls) AS wv_{head} FROM (
    SELECT cls, least(greatest(CASE WHEN n IS NULL THEN 1.0 ELSE total / ({c} * greatest(n, 1)) END, 0.1), 10.0)
      AS weight
    FROM (SELECT CAST(range AS INTEGER) AS cls FROM range({c})) k
    LEFT JOIN (SELECT {target} AS t, count(*) AS n FROM sc GROUP BY 1) cnt ON cnt.t = k.cls,
    (SELECT count(*) AS total FROM sc) tot))"""


def _ce(logits: str, target: str, c: int, eps: float, wv: str) -> str:
    """(1-e) sum(w_y nll)/sum(w_y) + e/C sum(-sum_c w_c logp_c)/sum(w_y), via log-softmax."""
    lse = f"(ln(list_sum(list_transform({logits}, lambda v: exp(v - list_max({logits}))))) + list_max({logits}))"
    wy = f"{wv}[{target} + 1]"
    nll = f"(-({logits}[{target} + 1] - {lse}))"
    smooth = f"(-list_sum(list_transform(range(1, {c} + 1), lambda i: {wv}[i] * ({logits}[i] - {lse}))))"
    return (f"((1 - {eps}) * sum({wy} * {nll}) / sum({wy}) + ({eps} / {c}) * sum({smooth}) / sum({wy}))")


ONES = {c: "[" + ", ".join(["1.0::DOUBLE"] * c) + "]" for c in (3, 4, 7, 20)}
LOSS_BASE = f"""{windows_sql()}, {SCORED}, {_cw('ne', 'target_next_event', 7)}, {_cw('ch', 'target_channel', 3)},
{_cw('pe', 'target_active_period', 4)},
losses AS (SELECT
  avg({focal('p_purchase', 'target_purchase')}) AS focal_purchase,
  avg({focal('p_churn', 'target_churn')}) AS focal_churn,
  avg({BCE.format(x='p_purchase', y='target_purchase')}) AS bce_purchase,
  avg({BCE.format(x='p_churn', y='target_churn')}) AS bce_churn,
  avg(power(p_engagement - target_engagement, 2)) AS mse_engagement,
  avg(power(p_inactivity - target_inactivity, 2)) AS mse_inactivity,
  {_ce('p_next_event', 'target_next_event', 7, 0.1, 'wv_ne')} AS ce_next_event,
  {_ce('p_channel', 'target_channel', 3, 0.05, 'wv_ch')} AS ce_channel,
  {_ce('p_action', 'target_recommended_action', 20, 0.1, ONES[20])} AS ce_action,
  {_ce('p_active_period', 'target_active_period', 4, 0.1, 'wv_pe')} AS ce_period,
  {_ce('p_next_event', 'target_next_event', 7, 0.0, ONES[7])} AS ce_next_event_plain,
  {_ce('p_channel', 'target_channel', 3, 0.0, ONES[3])} AS ce_channel_plain,
  {_ce('p_action', 'target_recommended_action', 20, 0.0, ONES[20])} AS ce_action_plain,
  {_ce('p_active_period', 'target_active_period', 4, 0.0, ONES[4])} AS ce_period_plain
FROM sc, cw_ne, cw_ch, cw_pe),
tot AS (SELECT *,
  3.0 * focal_purchase + 2.5 * focal_churn + 3.0 * ce_next_event + 1.0 * ce_channel
  + 1.5 * mse_engagement + 1.0 * mse_inactivity + 2.0 * ce_action + 2.0 * ce_period AS total_focal,
  1.0 * bce_purchase + 1.0 * bce_churn + 0.5 * ce_next_event_plain + 0.5 * ce_channel_plain
  + 0.1 * mse_engagement + 0.1 * mse_inactivity + 0.2 * ce_action_plain + 0.2 * ce_period_plain AS total_bce
FROM losses)"""


def _r(cols: list[str]) -> str:
    return ", ".join(f"round({c}, 9) AS {c}" for c in cols)


TAIL = f"""tail AS (SELECT * FROM (SELECT *, epoch_us(event_time) AS t, row_number() OVER (PARTITION BY muid
  ORDER BY event_time DESC, event_id DESC) AS rk FROM ev) WHERE rk <= 20)"""

SEQ1 = f"""WITH {EV}, {vocab_ctes()}, {TAIL},
enc AS (SELECT tail.*, {', '.join(f"COALESCE(v_{c}.id, 1) AS {c}_id" for c in ['event_name', 'device_os', 'channel', 'traffic_source', 'category'])}
  FROM tail {' '.join(f"LEFT JOIN vocab v_{c} ON v_{c}.feature = '{c}' AND v_{c}.value = tail.{c}" for c in ['event_name', 'device_os', 'channel', 'traffic_source', 'category'])})
SELECT muid, {', '.join(f"CASE WHEN count(*) < 20 THEN repeat('0,', CAST(20 - count(*) AS INTEGER)) ELSE '' END || string_agg(CAST({c}_id AS VARCHAR), ',' ORDER BY t, event_id) AS seq_{c}" for c in ['event_name', 'device_os', 'channel', 'traffic_source', 'category'])},
  CAST(20 - count(*) AS INTEGER) AS n_padding, CAST(count(*) AS INTEGER) AS n_events
FROM enc GROUP BY muid"""

SEQ2 = f"""WITH {EV}, {TAIL},
u AS (SELECT muid, count(*) AS n,
  count(*) FILTER (WHERE event_name = 'purchase') AS np, count(*) FILTER (WHERE event_name = 'add_to_cart') AS na,
  count(*) FILTER (WHERE event_name = 'scroll') AS ns, count(DISTINCT event_name) AS nt,
  count(DISTINCT session_id) + max(CASE WHEN session_id IS NULL THEN 1 ELSE 0 END) AS nsess,
  max(t) - min(t) AS span FROM tail GROUP BY muid),
d AS (SELECT
  abs(np / n - np / 20.0) AS purchase_ratio, abs(na / n - na / 20.0) AS atc_ratio,
  abs(ns / n - ns / 20.0) AS scroll_ratio, abs(nt / 10.0 - nt / 7.0) AS unique_types,
  abs(0.5 - least(ln(1 + CASE WHEN n > 1 THEN span / 1e6 / (n - 1) ELSE 0 END) / 15.0, 1.0)) AS avg_time_delta,
  abs(1.0 - least(nsess / 5.0, 1.0)) AS session_count_norm FROM u)
SELECT (SELECT count(*) FROM u) AS users, feature, round(mean_abs_diff, 9) AS mean_abs_diff FROM (
  UNPIVOT (SELECT avg(purchase_ratio) AS purchase_ratio, avg(atc_ratio) AS atc_ratio, avg(scroll_ratio) AS scroll_ratio,
    avg(unique_types) AS unique_types, avg(avg_time_delta) AS avg_time_delta,
    avg(session_count_norm) AS session_count_norm FROM d)
  ON purchase_ratio, atc_ratio, scroll_ratio, unique_types, avg_time_delta, session_count_norm
  INTO NAME feature VALUE mean_abs_diff)"""

LBL8 = f"""WITH {EV}, {vocab_ctes()},
lb AS (SELECT muid, event_id, t,
  count(*) OVER f AS nf,
  max(CASE WHEN event_name = 'purchase' THEN 1 ELSE 0 END) OVER f AS anyp,
  lead(event_name) OVER o AS next_name, lead(t) OVER o AS next_t, lead(hour(event_time)) OVER o AS next_hour,
  sum(CASE WHEN channel = 'app' THEN 1 ELSE 0 END) OVER f AS n_app,
  sum(CASE WHEN channel = 'browser' THEN 1 ELSE 0 END) OVER f AS n_browser
  FROM (SELECT *, epoch_us(event_time) AS t FROM ev)
  WINDOW o AS (PARTITION BY muid ORDER BY event_time, event_id),
         f AS (PARTITION BY muid ORDER BY event_time, event_id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
lm AS (SELECT *, CASE WHEN COALESCE(n_app, 0) = 0 AND COALESCE(n_browser, 0) = 0 THEN NULL
                      WHEN n_app >= n_browser THEN 'app' ELSE 'browser' END AS mode_channel FROM lb)
SELECT lm.muid, lm.event_id,
  CASE WHEN nf > 0 AND anyp = 1 THEN 1.0 ELSE 0.0 END AS target_purchase,
  CASE WHEN nf = 0 THEN 1.0 ELSE 0.0 END AS target_churn,
  CASE WHEN nf > 0 THEN COALESCE(vn.id, 1) ELSE 0 END AS target_next_event,
  CASE WHEN nf > 0 AND mode_channel IS NOT NULL THEN COALESCE(vc.id, 1) ELSE 0 END AS target_channel,
  round(CAST(nf AS DOUBLE), 9) AS target_engagement,
  round(CASE WHEN nf > 0 THEN CAST(floor((next_t - t) / 86400000000.0) AS DOUBLE) ELSE 0.0 END, 9) AS target_inactivity,
  0 AS target_recommended_action,
  CASE WHEN nf > 0 THEN {PERIOD.format(h='next_hour')} ELSE 0 END AS target_active_period
FROM lm LEFT JOIN vocab vn ON vn.feature = 'event_name' AND vn.value = lm.next_name
        LEFT JOIN vocab vc ON vc.feature = 'channel' AND vc.value = lm.mode_channel"""

ORACLE_SERVING: dict[str, str] = {
    "SEQ-1": SEQ1,
    "SEQ-2": SEQ2,
    "LBL-8": LBL8,
    "SET-3": f"""WITH {EV}, {vocab_ctes()}, {TAIL}
        SELECT muid, string_agg(CAST(COALESCE(v.id, 1) AS VARCHAR), ',' ORDER BY t, event_id) AS seq_event_name,
          CAST(count(*) AS INTEGER) AS n_events
        FROM tail LEFT JOIN vocab v ON v.feature = 'event_name' AND v.value = tail.event_name GROUP BY muid""",
    "JOI-1": f"""WITH {EV} SELECT event_id, muid FROM ev WHERE muid IN (
        SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0)""",
    "JOI-2": f"""WITH {EV}, {USERS} SELECT id, name, n_events FROM users
        JOIN (SELECT muid, count(*) AS n_events FROM ev GROUP BY muid) c ON users.id = c.muid""",
    "JOI-3": f"""WITH {EV}, {STORE},
        cache AS (SELECT user_id, total_events, TIMESTAMP '{AS_OF}' - to_seconds(CAST(3590 + user_id % 20 AS BIGINT)) AS computed_at FROM store),
        req AS (SELECT DISTINCT c_custkey AS user_id FROM customer),
        j AS (SELECT req.user_id, cache.total_events AS c_te, cache.computed_at,
                 store.total_events AS s_te, store.user_id IS NOT NULL AS has_store,
                 cache.user_id IS NOT NULL AND epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(cache.computed_at) < 3600000000 AS fresh
              FROM req LEFT JOIN cache ON cache.user_id = req.user_id LEFT JOIN store ON store.user_id = req.user_id)
        SELECT user_id, CASE WHEN fresh THEN 'cache' WHEN has_store THEN 'store' END AS source,
          CASE WHEN fresh THEN c_te ELSE s_te END AS total_events, (NOT fresh) AND has_store AS write_back FROM j""",
    "JOI-3-stream": f"""WITH RECURSIVE {EV}, {STORE},
        req AS (SELECT event_id, muid, epoch_us(event_time) AS t FROM ev WHERE muid IS NOT NULL AND event_time IS NOT NULL),
        filled AS (SELECT muid, min(t) AS t FROM req WHERE muid IN (SELECT user_id FROM store) GROUP BY muid
          UNION ALL SELECT req.muid, min(req.t) FROM filled JOIN req ON req.muid = filled.muid
            AND req.t >= filled.t + 3600000000 GROUP BY req.muid),
        r AS (SELECT req.*, row_number() OVER (PARTITION BY req.muid, req.t ORDER BY event_id) = 1
                AND filled.t IS NOT NULL AS write_back
              FROM req LEFT JOIN filled ON filled.muid = req.muid AND filled.t = req.t)
        SELECT event_id AS request_id, muid AS user_id, CASE WHEN write_back THEN 'store'
          WHEN store.user_id IS NOT NULL THEN 'cache' END AS source, total_events, write_back
        FROM r LEFT JOIN store ON store.user_id = r.muid""",
    "JOI-4": f"WITH {EV}, {PL}, {OUTCOME} SELECT prediction_id, actual_event_id, actual_event_name FROM nx",
    "JOI-5": f"""WITH {EV}, {PL} SELECT prediction_id, model_version, model_version = 'v1' AS is_active FROM pl""",
    "PRJ-4-key": f"WITH {EV}, {STORE} SELECT * FROM store WHERE user_id = 7",
    "PRJ-4-active": f"""WITH {EV}, {PL}, r AS (SELECT model_version AS version, count(*) AS n_logged,
        model_version = 'v1' AS is_active FROM pl GROUP BY 1, 3) SELECT * FROM r WHERE is_active""",
    "PRJ-4-version": f"""WITH {EV}, {PL}, r AS (SELECT model_version AS version, count(*) AS n_logged,
        model_version = 'v1' AS is_active FROM pl GROUP BY 1, 3) SELECT * FROM r WHERE version = 'v0'""",
    "STO-1": f"WITH {EV}, {STORE} SELECT * FROM store",
    "STO-2": f"WITH {EV}, {STORE} SELECT * FROM store WHERE user_id IN (SELECT c_custkey FROM customer)",
    "STO-3": f"""WITH {EV}, {PL} SELECT prediction_id, user_id, model_version, predicted_next_event,
        round(purchase_probability, 9) AS purchase_probability, window_events FROM pl""",
    "STO-4": f"""WITH {EV}, {PL}, {OUTCOME} SELECT prediction_id, actual AS actual_event_name,
        CASE WHEN actual IS NOT NULL THEN actual_event_id END AS actual_event_id FROM rw""",
    "SRC-10": f"WITH {EV}, {STORE} SELECT * FROM store",
    "SCO-1": f"""{windows_sql()}, {SCORED} SELECT muid, event_id,
        round({sig('p_purchase')}, 9) AS purchase_probability, round({sig('p_churn')}, 9) AS churn_risk,
        {_name(EVENT_NAMES, am('p_next_event'))} AS next_event, {_name(CHANNELS, am('p_channel'))} AS preferred_channel,
        round(p_engagement, 9) AS engagement_score, round(p_inactivity, 9) AS inactivity_risk,
        'action_' || CAST({am('p_action')} AS VARCHAR) AS recommended_action,
        'period_' || CAST({am('p_active_period')} AS VARCHAR) AS active_time FROM sc""",
    "SCO-2": f"""WITH {EV}, {TAIL},
        u AS (SELECT muid, count(*) AS n, bool_or(event_name = 'add_to_cart') AS cart,
                 arg_max(event_name, (t, event_id)) = 'purchase' AS lp FROM tail GROUP BY muid)
        SELECT muid,
          CAST(CASE WHEN lp THEN 2.0 ELSE least(95.0, n * 5.0 + CASE WHEN cart THEN 40.0 ELSE 0.0 END) END AS DOUBLE) AS purchase_probability,
          CAST(CASE WHEN lp THEN 60.0 ELSE greatest(5.0, 80.0 - n * 10.0) END AS DOUBLE) AS churn_risk,
          CASE WHEN lp THEN 'pageview' WHEN cart THEN 'purchase' WHEN n > 2 THEN 'add_to_cart' ELSE 'viewcontent' END AS predicted_next_event,
          'browser' AS preferred_channel, round(CAST(n AS DOUBLE) * 0.15, 9) AS engagement_score,
          CAST(10 - n AS DOUBLE) AS inactivity_risk, 'Evening' AS active_time FROM u""",
    "SCO-3": f"""{windows_sql()}, {SCORED} SELECT muid, event_id, round(p_purchase, 9) AS p_purchase,
        round(p_churn, 9) AS p_churn, round(p_engagement, 9) AS p_engagement, round(p_inactivity, 9) AS p_inactivity,
        CAST({am('p_next_event')} AS INTEGER) AS next_idx, CAST({am('p_channel')} AS INTEGER) AS channel_idx,
        CAST({am('p_action')} AS INTEGER) AS action_idx, CAST({am('p_active_period')} AS INTEGER) AS period_idx FROM sc""",
    "DQ-7": f"""{windows_sql()}, {SCORED} SELECT count(*) AS n, count(*) FILTER (WHERE
        {sig('p_purchase')} < 0 OR {sig('p_purchase')} > 1 OR {sig('p_churn')} < 0 OR {sig('p_churn')} > 1) AS out_of_range FROM sc""",
    "MET-1": f"{windows_sql()}, {SCORED} {EVAL}",
    "MET-2": f"""{windows_sql()}, {SCORED} SELECT round(avg(CASE WHEN {am('p_next_event')} = target_next_event
        THEN 1.0 ELSE 0.0 END), 9) AS next_event_accuracy, count(*) AS n FROM sc""",
    "MET-3": f"""{windows_sql()}, {SCORED}, m AS ({EVAL.replace('round(', '(').replace(', 9) AS', ') AS')})
        SELECT round(0.3 * (100 - next_event_acc) / 100 + 0.2 * (100 - purchase_acc) / 100
          + 0.15 * (100 - period_acc) / 100 + 0.15 * (100 - action_acc) / 100
          + 0.1 * engagement_mae + 0.1 * inactivity_mae, 9) AS val_score FROM m""",
    "MET-4": f"{LOSS_BASE} SELECT {_r(['focal_purchase', 'focal_churn'])} FROM tot",
    "MET-5": f"{LOSS_BASE} SELECT {_r(['ce_next_event', 'ce_channel', 'ce_action', 'ce_period'])} FROM tot",
    "MET-6": f"{LOSS_BASE} SELECT {_r(['mse_engagement', 'mse_inactivity'])} FROM tot",
    "MET-7": f"{LOSS_BASE} SELECT {_r(['total_focal', 'total_bce'])} FROM tot",
    "MET-8": f"""WITH {EV}, {PL}, {OUTCOME} SELECT model_version, count(*) AS resolved,
        round(avg(CASE WHEN predicted_next_event = actual THEN 1.0 ELSE 0.0 END) * 100, 9) AS next_event_acc,
        round(avg(CASE WHEN (purchase_probability / 100 > 0.5) = (actual = 'purchase') THEN 1.0 ELSE 0.0 END) * 100, 9)
          AS purchase_acc, round(avg(reward), 9) AS mean_reward
        FROM rw WHERE actual IS NOT NULL GROUP BY model_version""",
    "MET-8-windows": f"""{windows_sql()}, {SCORED}
        {EVAL.replace("SELECT", "SELECT 'v' || CAST(muid % 2 AS VARCHAR) AS model_version,", 1)} GROUP BY 1""",
    "AGG-12": f"""WITH {EV}, {PL}, {OUTCOME} SELECT model_version, strftime(created_at, '%Y-%m-%d') AS day,
        count(*) AS predictions, count(actual) AS labelled,
        count(*) FILTER (WHERE predicted_next_event = actual) AS hits FROM rw GROUP BY 1, 2""",
    "AGG-12-drift": f"""WITH {EV}, {PL}, {_drift_sql("model_version",
        "SELECT DISTINCT g AS compared, 'v0' AS reference FROM cnt WHERE g <> 'v0'")}""",
    "AGG-12-drift-day": f"""WITH {EV}, {PL}, {_drift_sql("strftime(created_at, '%Y-%m-%d')",
        "SELECT * FROM (SELECT g AS compared, lag(g) OVER (ORDER BY g) AS reference FROM (SELECT DISTINCT g FROM cnt)) "
        "WHERE reference IS NOT NULL")}""",
    "FBK-1": f"WITH {EV}, {PL}, {OUTCOME} SELECT prediction_id, predicted_next_event, actual, reward FROM rw",
    "STR-6-resolved": f"""WITH {EV}, {PL}, {OUTCOME}
        SELECT prediction_id, predicted_next_event, actual, reward FROM rw WHERE actual <> 'churn'""",
    "FBK-2": f"""WITH {EV}, {PL}, {OUTCOME} SELECT predicted_next_event AS predicted_action, count(*) AS n,
        round(sum(reward), 9) AS reward_sum, round(avg(reward), 9) AS reward_mean
        FROM rw WHERE reward IS NOT NULL GROUP BY 1""",
    "STR-1": f"WITH {EV} SELECT event_id, muid, session_id, event_name, event_time, device_os, channel, "
             "traffic_source, category, product_id, page_url FROM ev",
    "STR-1-compacted": f"WITH {EV} SELECT event_id, muid, session_id, event_name, event_time, device_os, channel, "
             "traffic_source, category, product_id, page_url FROM ev",
    "STR-2-late": f"WITH {EV} SELECT event_id, muid, session_id, event_name, event_time, device_os, channel, "
             "traffic_source, category, product_id, page_url FROM ev",
    "STR-2": f"WITH {EV} SELECT event_id, muid, session_id, event_name, event_time, device_os, channel, "
             "traffic_source, category, product_id, page_url FROM ev",
    "STR-3": f"""WITH {EV}, {PL},
        wid AS (SELECT event_id,
          repeat('0,', CAST(20 - count(*) OVER f AS INTEGER))
            || string_agg(CAST({_static_ev('event_name')} AS VARCHAR), ',') OVER f AS window_event_ids
          FROM ev WINDOW f AS (PARTITION BY muid ORDER BY event_time, event_id
                               ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
        SELECT prediction_id, user_id, model_version, window_events, purchase_probability,
        churn_risk, predicted_next_event, round(engagement_score, 9) AS engagement_score, inactivity_risk,
        window_event_ids FROM pl JOIN wid ON wid.event_id = pl.prediction_id""",
    "STR-4": f"WITH {EV} {user_features_sql()}",
    "STR-5": f"""WITH {EV} SELECT epoch_us(date_trunc('hour', event_time)) AS hour_start_us, count(*) AS n_events
        FROM ev GROUP BY 1""",
    "SRT-4": f"""WITH {EV}, {PL} SELECT prediction_id, user_id, predicted_next_event FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, prediction_id DESC) AS rk
        FROM pl) WHERE rk <= 5""",
    "predict_batch": f"""WITH {EV}, {TAIL},
        u AS (SELECT muid, count(*) AS n,
          count(*) FILTER (WHERE event_name = 'purchase') / count(*) AS pr,
          count(*) FILTER (WHERE event_name = 'add_to_cart') / count(*) AS ar,
          count(*) FILTER (WHERE event_name = 'scroll') / count(*) AS sr,
          count(DISTINCT event_name) / 10.0 AS ut, 0.5 AS td, 1.0 AS sc FROM tail GROUP BY muid),
        s AS (SELECT muid, n, pr * 10.0 - 1.0 AS p_purchase, sr * 4.0 - 2.0 AS p_churn,
          [0.0::DOUBLE, sr, ar, ut, 0.1::DOUBLE, 0.1::DOUBLE, pr] AS p_next_event,
          [0.0::DOUBLE, sc, 1.0 - sc] AS p_channel, 1.0 - sr AS p_engagement, td AS p_inactivity,
          list_concat([0.0::DOUBLE, sr, ar, ut, 0.1::DOUBLE, 0.1::DOUBLE, pr],
                      list_transform(range(13), lambda x: 0.0::DOUBLE)) AS p_action,
          [td, 0.5::DOUBLE, ut, 0.5::DOUBLE] AS p_active_period FROM u)
        SELECT muid AS user_id, 'v1' AS model_version, CAST(n AS INTEGER) AS window_events,
          round({sig('p_purchase')}, 9) AS purchase_probability, round({sig('p_churn')}, 9) AS churn_risk,
          round(p_engagement, 9) AS engagement_score, round(p_inactivity, 9) AS inactivity_risk,
          {_name(EVENT_NAMES, am('p_next_event'))} AS next_event,
          {_name(CHANNELS, am('p_channel'))} AS preferred_channel,
          'action_' || CAST({am('p_action')} AS VARCHAR) AS recommended_action,
          'period_' || CAST({am('p_active_period')} AS VARCHAR) AS active_time FROM s""",
    "STR-5-total": "SELECT count(*) AS events_ingested_total FROM events",
    "JOI-3-writeback": f"""WITH {EV}, {STORE}
        SELECT user_id, total_events, (3590 + user_id % 20) >= 3600 AS written_back FROM store""",
}
