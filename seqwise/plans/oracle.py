"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Every statement reads the pre-registered views (events, customer, nation, ...)
and starts from the same event-model adapter as the Spark side.
"""

from __future__ import annotations

# Event-model adapter (same rules as seqwise.sources.events.adapt_events).
EV = """ev AS (
  SELECT event_id, user_id AS muid,
    CASE WHEN k%20=19 THEN NULL
         ELSE concat(CAST(user_id AS VARCHAR),'-',strftime(ts,'%Y%m%d')) END AS session_id,
    CASE WHEN event_type='click' THEN CASE WHEN k%3=0 THEN 'add_to_cart' ELSE 'scroll' END
         WHEN event_type='view'  THEN CASE WHEN k%2=0 THEN 'pageview' ELSE 'viewcontent' END
         WHEN event_type='signup' THEN 'search' ELSE event_type END AS event_name,
    ts AS event_time,
    CASE k%4 WHEN 0 THEN 'android' WHEN 1 THEN 'ios' WHEN 2 THEN 'desktop' END AS device_os,
    CASE WHEN k%10=9 THEN NULL WHEN user_id%3=0 THEN 'app' ELSE 'browser' END AS channel,
    CASE k%6 WHEN 0 THEN 'direct' WHEN 1 THEN 'organic' WHEN 2 THEN ' Paid '
             WHEN 3 THEN 'REFERRAL' WHEN 4 THEN 'social' END AS traffic_source,
    CASE k%8 WHEN 0 THEN 'books' WHEN 1 THEN 'Beauty' WHEN 2 THEN ' electronics'
             WHEN 3 THEN 'fashion' WHEN 4 THEN 'toys' WHEN 5 THEN 'unknown-cat'
             WHEN 6 THEN 'other' END AS category,
    CAST(k AS VARCHAR) AS product_id, CAST(NULL AS VARCHAR) AS page_url
  FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS INT) AS k FROM events) e)"""


def _case_vocab(expr: str, values: list[str], default: int) -> str:
    whens = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(values))
    return f"COALESCE(CASE {expr} {whens} END, {default})"


def _static(feature: str, expr: str) -> str:
    from seqwise.functions.constants import STATIC_VOCABS
    return _case_vocab(expr, STATIC_VOCABS[feature], 0)


def _norm(c: str) -> str:
    return f"lower(trim(COALESCE({c}, '')))"


# Encoded events (static vocabularies, unknown -> 0) with epoch microseconds.
ENC = f"""enc AS (
  SELECT *,
    {_static('event_name', 'event_name')} AS event_name_id,
    {_static('device_os', 'device_os')} AS device_os_id,
    {_static('channel', 'channel')} AS channel_id,
    {_static('category', _norm('category'))} AS category_id,
    {_static('traffic_source', _norm('traffic_source'))} AS traffic_source_id,
    hour(event_time) + 1 AS hour_id,
    epoch_us(event_time) AS t
  FROM ev)"""

PERIOD = "CASE WHEN {h} < 6 THEN 0 WHEN {h} < 12 THEN 1 WHEN {h} < 18 THEN 2 ELSE 3 END"


def windows_sql(size: int = 20, churn_hours: float = 168) -> str:
    churn_us = int(round(churn_hours * 3_600_000_000))
    return f"""WITH {EV}, {ENC},
wf AS (
  SELECT muid, event_id, event_name, event_name_id, channel_id, event_time, t,
    count(*) OVER wb AS n_prev,
    sum(CASE WHEN event_name='purchase' THEN 1 ELSE 0 END) OVER wb AS n_pur,
    sum(CASE WHEN event_name='add_to_cart' THEN 1 ELSE 0 END) OVER wb AS n_atc,
    sum(CASE WHEN event_name='scroll' THEN 1 ELSE 0 END) OVER wb AS n_scr,
    count(DISTINCT event_name) OVER wb AS n_types,
    count(DISTINCT session_id) OVER wb
      + max(CASE WHEN session_id IS NULL THEN 1 ELSE 0 END) OVER wb AS n_sess,
    min(t) OVER wb AS t_first, max(t) OVER wb AS t_last,
    first(event_id) OVER wb AS win_first_id, last(event_id) OVER wb AS win_last_id,
    string_agg(CAST(event_name_id AS VARCHAR), ',') OVER wb AS seq_event_name,
    string_agg(CAST(device_os_id AS VARCHAR), ',') OVER wb AS seq_device_os,
    string_agg(CAST(channel_id AS VARCHAR), ',') OVER wb AS seq_channel,
    string_agg(CAST(category_id AS VARCHAR), ',') OVER wb AS seq_category,
    string_agg(CAST(hour_id AS VARCHAR), ',') OVER wb AS seq_hour,
    string_agg(CAST(traffic_source_id AS VARCHAR), ',') OVER wb AS seq_traffic_source
  FROM enc
  WINDOW wb AS (PARTITION BY muid ORDER BY event_time, event_id
                ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING)),
w AS (
  SELECT muid, event_id, win_first_id, win_last_id,
    seq_event_name, seq_device_os, seq_channel, seq_category, seq_hour, seq_traffic_source,
    round(n_pur / {float(size)}, 9) AS purchase_ratio,
    round(n_atc / {float(size)}, 9) AS atc_ratio,
    round(n_scr / {float(size)}, 9) AS scroll_ratio,
    round(n_types / 7.0, 9) AS unique_types,
    round(least(ln(1 + (t_last - t_first) / 1e6 / {float(size - 1)}) / 15.0, 1.0), 9) AS avg_time_delta,
    round(least(n_sess / 5.0, 1.0), 9) AS session_count_norm,
    CASE WHEN event_name = 'purchase' THEN 1.0 ELSE 0.0 END AS target_purchase,
    CASE WHEN t - t_last > {churn_us} THEN 1.0 ELSE 0.0 END AS target_churn,
    event_name_id AS target_next_event,
    channel_id AS target_channel,
    round(({size} - n_scr) / {float(size)}, 9) AS target_engagement,
    round(least(greatest((t_last - t_first) / 3600000000.0, 0.01) / {float(size)}, 1.0), 9)
      AS target_inactivity,
    least(event_name_id, 19) AS target_recommended_action,
    {PERIOD.format(h='hour(event_time)')} AS target_active_period
  FROM wf WHERE n_prev = {size}),
wu AS (
  SELECT muid, event_id,
    n_pur / {float(size)} AS pr, n_atc / {float(size)} AS ar, n_scr / {float(size)} AS sr,
    n_types / 7.0 AS ut,
    least(ln(1 + (t_last - t_first) / 1e6 / {float(size - 1)}) / 15.0, 1.0) AS td,
    least(n_sess / 5.0, 1.0) AS sc,
    CASE WHEN event_name = 'purchase' THEN 1.0 ELSE 0.0 END AS target_purchase,
    CASE WHEN t - t_last > {churn_us} THEN 1.0 ELSE 0.0 END AS target_churn,
    event_name_id AS target_next_event, channel_id AS target_channel,
    ({size} - n_scr) / {float(size)} AS target_engagement,
    least(greatest((t_last - t_first) / 3600000000.0, 0.01) / {float(size)}, 1.0) AS target_inactivity,
    least(event_name_id, 19) AS target_recommended_action,
    {PERIOD.format(h='hour(event_time)')} AS target_active_period
  FROM wf WHERE n_prev = {size})"""


FEATURES_AND_TARGETS = ("purchase_ratio, atc_ratio, scroll_ratio, unique_types, avg_time_delta, "
                        "session_count_norm, target_purchase, target_churn, target_next_event, "
                        "target_channel, target_engagement, target_inactivity, "
                        "target_recommended_action, target_active_period")

ORACLE: dict[str, str] = {
    "window_features": f"{windows_sql()} SELECT muid, event_id, {FEATURES_AND_TARGETS} FROM w",
    "window_features_churn24": f"{windows_sql(churn_hours=24)} SELECT muid, event_id, target_churn FROM w",
    "WIN-1": f"""{windows_sql()} SELECT muid, count(*) AS n_windows,
        min(event_id) AS first_target_event_id, max(event_id) AS last_target_event_id
        FROM w GROUP BY muid""",
    "WIN-2": f"""{windows_sql()} SELECT muid, event_id, seq_event_name, seq_device_os, seq_channel,
        seq_category, seq_hour, seq_traffic_source, CAST(0 AS BIGINT) AS mask_true,
        CAST(20 AS BIGINT) AS mask_len FROM w""",
    "WIN-3": f"{windows_sql()} SELECT muid, event_id, purchase_ratio, atc_ratio, scroll_ratio FROM w",
    "WIN-4": f"{windows_sql()} SELECT muid, event_id, unique_types FROM w",
    "WIN-5": f"{windows_sql()} SELECT muid, event_id, avg_time_delta FROM w",
    "WIN-6": f"{windows_sql()} SELECT muid, event_id, session_count_norm FROM w",
    "WIN-7": f"""WITH {EV} SELECT muid, event_id,
        round((epoch_us(event_time) - lag(epoch_us(event_time)) OVER (PARTITION BY muid
          ORDER BY event_time, event_id)) / 1e6, 9) AS gap_seconds FROM ev""",
    "LBL-1": f"{windows_sql()} SELECT muid, event_id, target_purchase FROM w",
    "LBL-2": f"{windows_sql()} SELECT muid, event_id, target_churn FROM w",
    "LBL-3": f"{windows_sql()} SELECT muid, event_id, target_next_event, target_channel FROM w",
    "LBL-4": f"{windows_sql()} SELECT muid, event_id, target_engagement FROM w",
    "LBL-5": f"{windows_sql()} SELECT muid, event_id, target_inactivity FROM w",
    "LBL-6": f"{windows_sql()} SELECT muid, event_id, target_recommended_action FROM w",
    "LBL-7": f"{windows_sql()} SELECT muid, event_id, target_active_period FROM w",
}


def all_oracles() -> dict[str, str]:
    from seqwise.plans.oracle_tables import ORACLE_TABLES
    from seqwise.plans.oracle_serving import ORACLE_SERVING
    out = dict(ORACLE)
    out.update(ORACLE_TABLES)
    out.update(ORACLE_SERVING)
    return out
