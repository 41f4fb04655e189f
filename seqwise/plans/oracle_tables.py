"""DuckDB oracles for sources, quality, projections, vocabularies, sets,
sorting, sampling and aggregates."""

from __future__ import annotations

from seqwise.functions.constants import DYNAMIC_FEATURES, EVENT_MAX_LEN, USER_MAX_LEN
from seqwise.plans.oracle import EV, PERIOD, _norm, _static, windows_sql

TRAIN = "muid, event_name, event_time, device_os, channel, category, traffic_source, session_id"
ALL_EV = ("event_id, muid, session_id, event_name, event_time, device_os, channel, traffic_source, "
          "category, product_id, page_url")
USERS = """users AS (
  SELECT c_custkey AS id, CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS phone,
         c_name AS name, n_name AS location
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"""
AGG1 = """SELECT muid, count(event_id) AS total_events, count(DISTINCT device_os) AS distinct_devices,
  count(DISTINCT category) AS unique_categories, max(event_time) AS last_event_time FROM ev GROUP BY muid"""


def user_features_sql(src: str = "ev", as_of: str = "2024-02-01 00:00:00") -> str:
    return f"""SELECT muid, count(*) AS total_events,
  count(*) FILTER (WHERE event_name = 'purchase') AS purchase_count,
  count(DISTINCT category) AS unique_categories, count(DISTINCT session_id) AS session_count,
  CAST(floor((epoch_us(TIMESTAMP '{as_of}') - epoch_us(max(event_time))) / 86400000000.0) AS BIGINT)
    AS days_since_active,
  mode() WITHIN GROUP (ORDER BY channel) AS preferred_channel
FROM {src} GROUP BY muid"""


def _reject_events() -> str:
    parts = ["WHEN muid IS NULL THEN 'missing_muid'", "WHEN event_name IS NULL THEN 'missing_event_name'",
             "WHEN event_time IS NULL THEN 'missing_event_time'"]
    parts += [f"WHEN length({c}) > {n} THEN 'too_long_{c}'" for c, n in EVENT_MAX_LEN.items()]
    return "CASE " + " ".join(parts) + " END"


def _reject_users() -> str:
    parts = ["WHEN id IS NULL THEN 'missing_id'"]
    parts += [f"WHEN length({c}) > {n} THEN 'too_long_{c}'" for c, n in USER_MAX_LEN.items()]
    parts.append("WHEN email IS NOT NULL AND NOT regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') "
                 "THEN 'bad_email'")
    return "CASE " + " ".join(parts) + " END"


EV_TYPES = {"event_id": "bigint", "muid": "bigint", "session_id": "string", "event_name": "string",
            "event_time": "timestamp_ntz", "device_os": "string", "channel": "string",
            "traffic_source": "string", "category": "string", "product_id": "string", "page_url": "string"}


def _null_profile() -> str:
    sel = [f"""SELECT '{c}' AS column_name, '{t}' AS data_type,
      count(*) FILTER (WHERE {c} IS NULL) AS null_count,
      round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / greatest(count(*), 1), 9) AS null_pct FROM ev"""
           for c, t in EV_TYPES.items()]
    return f"WITH {EV} " + " UNION ALL ".join(sel)


def vocab_ctes(features=DYNAMIC_FEATURES) -> str:
    lf = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, event_time, event_id FROM ev" for c in features)
    reserved = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, '<PAD>' AS value, 0 AS id UNION ALL SELECT '{c}', '<UNK>', 1"
        for c in features)
    return f"""lf AS ({lf}),
firsts AS (SELECT feature, value, event_time, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY feature, value ORDER BY event_time, event_id) AS rn
  FROM lf WHERE value IS NOT NULL) WHERE rn = 1),
vocab AS (
  SELECT feature, value,
    CAST(row_number() OVER (PARTITION BY feature ORDER BY event_time, event_id, value) + 1 AS INTEGER) AS id
  FROM firsts
  UNION ALL {reserved})"""


def _dyn_encode_cols() -> tuple[str, str]:
    joins = " ".join(
        f"LEFT JOIN vocab v_{c} ON v_{c}.feature = '{c}' AND v_{c}.value = CAST(ev.{c} AS VARCHAR)"
        for c in DYNAMIC_FEATURES)
    cols = ", ".join(f"COALESCE(v_{c}.id, 1) AS {c}_id" for c in DYNAMIC_FEATURES)
    return joins, cols


_J, _C = _dyn_encode_cols()
MD5_BUCKET = "(CAST(('0x' || substr(md5('42:' || CAST({k} AS VARCHAR)), 1, 8)) AS BIGINT) % 100)"
DEPTH = "depth AS (SELECT muid, session_id, count(*) AS depth FROM ev WHERE session_id IS NOT NULL GROUP BY muid, session_id)"


def _class_weights() -> str:
    return f"""{windows_sql()},
cnt AS (SELECT 'next_event' AS head, target_next_event AS cls, count(*) AS n FROM w GROUP BY 2
  UNION ALL SELECT 'channel', target_channel, count(*) FROM w GROUP BY 2
  UNION ALL SELECT 'period', target_active_period, count(*) FROM w GROUP BY 2),
tot AS (SELECT head, sum(n) AS total FROM cnt GROUP BY head),
classes AS (SELECT 'next_event' AS head, 7 AS c, CAST(range AS INTEGER) AS cls FROM range(7)
  UNION ALL SELECT 'channel', 3, CAST(range AS INTEGER) FROM range(3)
  UNION ALL SELECT 'period', 4, CAST(range AS INTEGER) FROM range(4))
SELECT classes.head, classes.cls, CAST(COALESCE(cnt.n, 0) AS BIGINT) AS n,
  round(least(greatest(CASE WHEN cnt.n IS NULL THEN 1.0
                            ELSE tot.total / (classes.c * greatest(cnt.n, 1)) END, 0.1), 10.0), 9) AS weight
FROM classes LEFT JOIN cnt ON classes.head = cnt.head AND classes.cls = cnt.cls
JOIN tot ON tot.head = classes.head"""


ORACLE_TABLES: dict[str, str] = {
    "SRC-1": f"WITH {EV} SELECT {TRAIN} FROM ev",
    "SRC-2": f"WITH {EV} SELECT {ALL_EV} FROM ev",
    "SRC-3": f"WITH {USERS} SELECT * FROM users",
    "SRC-4": f"WITH {EV} SELECT {ALL_EV} FROM ev",
    "SRC-5": f"WITH {USERS} SELECT * FROM users",
    "SRC-6": f"WITH {EV} {AGG1}",
    "SRC-7": f"""WITH {EV} SELECT strftime(event_time, '%Y-%m') AS event_month, count(*) AS n_events,
        count(DISTINCT muid) AS n_users FROM ev GROUP BY 1""",
    "SRC-8": f"""WITH {EV} SELECT CAST(muid AS VARCHAR) AS key, 'raw_behavioral_events' AS topic,
        event_id, event_name, channel FROM ev""",
    "SRC-9": f"WITH {EV} SELECT {ALL_EV} FROM ev",
    "DQ-1": f"WITH {EV} SELECT event_id, muid, {_reject_events()} AS reject_reason FROM ev",
    "DQ-2": f"""WITH {EV} SELECT strftime(event_time, '%Y-%m-%d') AS batch_day, count(*) AS n_events,
        count(*) BETWEEN 1 AND 1000 AS valid FROM ev GROUP BY 1""",
    "DQ-3": f"WITH {USERS} SELECT id, {_reject_users()} AS reject_reason FROM users",
    "DQ-4": f"WITH {EV} SELECT CAST(event_id AS VARCHAR) AS event_id, muid, epoch_us(event_time) AS event_time_us FROM ev",
    "DQ-5": _null_profile(),
    "DQ-6": f"WITH {EV} SELECT count(*) FILTER (WHERE muid IS NULL) AS null_muid, count(*) AS n FROM ev",
    "PRJ-1": f"""WITH {EV} SELECT event_id, {_norm('category')} AS category_norm,
        {_norm('traffic_source')} AS traffic_source_norm FROM ev""",
    "PRJ-2": f"""WITH {EV} SELECT event_id, CAST(hour(event_time) AS INTEGER) AS hour,
        CAST(hour(event_time) + 1 AS INTEGER) AS hour_enc FROM ev""",
    "PRJ-3": f"WITH {EV} SELECT event_id, {PERIOD.format(h='hour(event_time)')} AS period FROM ev",
    "PRJ-4": f"WITH {EV} SELECT event_id, muid, event_name FROM ev WHERE muid = 7",
    "PRJ-4-user": f"""WITH {USERS}, {EV} SELECT id, name, location,
        (SELECT max(event_time) FROM ev WHERE muid = 7) AS last_active_at FROM users WHERE id = 7""",
    "PRJ-5": f"""WITH {EV} SELECT event_id, muid, event_name FROM ev
        WHERE event_time >= TIMESTAMP '2024-01-10 00:00:00' AND event_time < TIMESTAMP '2024-01-20 00:00:00'""",
    "VOC-1": f"""WITH {EV} SELECT event_id,
        {_static('event_name', 'event_name')} AS event_name_id,
        {_static('device_os', 'device_os')} AS device_os_id,
        {_static('channel', 'channel')} AS channel_id,
        {_static('category', _norm('category'))} AS category_id,
        {_static('traffic_source', _norm('traffic_source'))} AS traffic_source_id FROM ev""",
    "VOC-2": f"WITH {EV}, {vocab_ctes()} SELECT feature, value, id FROM vocab",
    "VOC-2-append": f"WITH {EV}, {vocab_ctes()} SELECT feature, value, id FROM vocab",
    "SRT-3-deep": f"""WITH {EV} SELECT event_id, muid, event_name FROM ev
        ORDER BY event_time, event_id LIMIT 50 OFFSET (SELECT count(*) // 2 + 7 FROM events)""",
    "VOC-3": f"WITH {EV}, {vocab_ctes()} SELECT ev.event_id, {_C} FROM ev {_J}",
    "VOC-4": f"""{windows_sql()}, {vocab_ctes()}
        SELECT w.muid, w.event_id, w.target_next_event, COALESCE(v.value, 'unknown') AS decoded_name
        FROM w LEFT JOIN vocab v ON v.feature = 'event_name' AND v.id = w.target_next_event""",
    "VOC-5": f"WITH {EV}, {vocab_ctes()} SELECT feature, count(*) AS size FROM vocab GROUP BY feature",
    "VOC-6": f"""WITH {EV}, {vocab_ctes(['event_name', 'channel', 'category'])}
        SELECT feature, value, id FROM vocab
        UNION ALL SELECT f, v, i FROM (VALUES ('device_os', '<PAD>', 0), ('device_os', '<UNK>', 1),
          ('traffic_source', '<PAD>', 0), ('traffic_source', '<UNK>', 1)) t(f, v, i)""",
    "VOC-7": f"""WITH {EV} SELECT {', '.join(f'count(DISTINCT {c}) AS n_{c}' for c in DYNAMIC_FEATURES)} FROM ev""",
    "SET-1": f"WITH {EV} SELECT event_id, muid FROM ev",
    "SET-2": f"""WITH {EV} SELECT DISTINCT 'muid' AS what, CAST(muid AS VARCHAR) AS value FROM ev
        UNION ALL SELECT DISTINCT 'event_name', event_name FROM ev""",
    "SRT-1": f"""WITH {EV} SELECT event_id, muid, event_name FROM (SELECT *, row_number() OVER
        (PARTITION BY muid ORDER BY event_time DESC, event_id DESC) AS rk FROM ev) WHERE rk <= 10""",
    "SRT-1-oldest": f"""WITH {EV} SELECT event_id, muid FROM (SELECT *, row_number() OVER
        (PARTITION BY muid ORDER BY event_time, event_id) AS rk FROM ev) WHERE rk <= 10""",
    "SRT-2": f"""WITH {EV} SELECT event_id, muid, row_number() OVER
        (PARTITION BY muid ORDER BY event_time, event_id) AS position FROM ev""",
    "SRT-3": f"WITH {USERS} SELECT id, name, location FROM users ORDER BY id LIMIT 100 OFFSET 50",
    "SMP-1": f"""WITH {EV}, chosen AS (SELECT muid FROM (SELECT DISTINCT muid FROM ev)
        ORDER BY md5('42:' || CAST(muid AS VARCHAR)), muid LIMIT 50)
        SELECT event_id, muid FROM ev WHERE muid IN (SELECT muid FROM chosen)""",
    "SMP-2": f"""{windows_sql()} SELECT muid, event_id,
        CASE WHEN {MD5_BUCKET.format(k='muid')} < 15 THEN 'val' ELSE 'train' END AS split FROM w""",
    "SMP-2-row": f"""{windows_sql()} SELECT muid, event_id,
        CASE WHEN {MD5_BUCKET.format(k='event_id')} < 15 THEN 'val' ELSE 'train' END AS split FROM w""",
    "AGG-1": f"WITH {EV} {AGG1}",
    "AGG-2": f"WITH {EV} {user_features_sql()}",
    "AGG-3": f"""WITH {EV}, {USERS}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY muid
        ORDER BY event_time DESC, event_id DESC) AS rk FROM ev) WHERE rk <= 2000
        AND muid IN (SELECT id FROM users)) {user_features_sql('top')}""",
    "AGG-3-k30": f"""WITH {EV}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY muid
        ORDER BY event_time DESC, event_id DESC) AS rk FROM ev) WHERE rk <= 30) {user_features_sql('top')}""",
    "AGG-4": f"WITH {EV} SELECT muid, count(*) AS n_events FROM ev GROUP BY muid",
    "AGG-5": f"WITH {EV} SELECT event_name, count(*) AS n FROM ev GROUP BY event_name",
    "AGG-6": f"WITH {EV}, {DEPTH} SELECT * FROM depth",
    "AGG-7": f"""WITH {EV}, {DEPTH} SELECT count(depth) AS count, round(avg(depth), 9) AS mean,
        round(stddev_samp(depth), 9) AS std, round(CAST(min(depth) AS DOUBLE), 9) AS min,
        round(quantile_cont(depth, 0.25), 9) AS p25, round(quantile_cont(depth, 0.5), 9) AS p50,
        round(quantile_cont(depth, 0.75), 9) AS p75, round(CAST(max(depth) AS DOUBLE), 9) AS max FROM depth""",
    "VOC-7-sketch": f"WITH {EV} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS distinct_values, true AS estimate_fits FROM ev"
        for c in ("muid", "session_id", "event_name", "category", "channel", "device_os")),
    "AGG-7-times": f"""WITH {EV}, t AS (
        SELECT epoch_us(event_time) AS event_us, row_number() OVER (ORDER BY event_time) - 1 AS rank,
               count(*) OVER () AS n FROM ev WHERE event_time IS NOT NULL)
        SELECT rank, event_us FROM t WHERE rank IN (0, (n - 1) // 100, 10 * (n - 1) // 100, 25 * (n - 1) // 100,
          50 * (n - 1) // 100, 75 * (n - 1) // 100, 90 * (n - 1) // 100, 99 * (n - 1) // 100, n - 1)""",
    "AGG-8": f"""WITH {EV}, {DEPTH},
        st AS (SELECT CAST(min(depth) AS DOUBLE) AS lo, CAST(max(depth) AS DOUBLE) AS hi,
               quantile_cont(depth, 0.99) AS crop FROM depth),
        b AS (SELECT CAST(CASE WHEN (hi - lo) / 50 = 0 THEN 0
                   ELSE least(floor((depth - lo) / ((hi - lo) / 50)), 49) END AS INTEGER) AS bin, lo, hi, crop
              FROM depth, st)
        SELECT bin, round(lo + bin * ((hi - lo) / 50), 9) AS bin_start,
          round(lo + (bin + 1) * ((hi - lo) / 50), 9) AS bin_end, count(*) AS n, round(crop, 9) AS crop_value
        FROM b GROUP BY bin, lo, hi, crop""",
    "AGG-9": _class_weights(),
    "AGG-10": f"""{windows_sql()}
        SELECT count(*) FILTER (WHERE target_purchase > 0.5) AS positives, count(*) AS n,
          round(count(*) FILTER (WHERE target_purchase > 0.5) / greatest(count(*), 1), 9) AS rate,
          'purchase' AS label FROM w
        UNION ALL SELECT count(*) FILTER (WHERE target_churn > 0.5), count(*),
          round(count(*) FILTER (WHERE target_churn > 0.5) / greatest(count(*), 1), 9), 'churn' FROM w""",
    "AGG-11": f"{windows_sql()} SELECT count(*) AS windows, count(DISTINCT muid) AS users FROM w",
}
