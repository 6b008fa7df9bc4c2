"""Independent SQL (DuckDB dialect) for every registered question.

The common table expressions rebuild the presence tables from ``events`` and
``nation`` with the same rules as the adapter; each question is then plain
SQL with window functions, so it checks the Spark operators from the outside.
"""

from __future__ import annotations

P = 14400                      # adapter poll interval (s)
GAP = 2 * P                    # session break: gap strictly above two intervals
DAY = 86400

PRELUDE = f"""
ev AS (
  SELECT event_id, user_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
         CAST(floor(epoch(ts) / {P}) AS BIGINT) AS tick
  FROM events
),
cs AS (
  SELECT event_id AS id, tick AS snapshot_id, tick * {P} AS ts,
         CASE WHEN k >= (user_id % 10) * 10 AND tick - 118338 >= (user_id % 30) * 6
              THEN 'u' || CAST(user_id AS VARCHAR) ELSE 'guest' || CAST(user_id % 3 AS VARCHAR) END AS client_uid,
         user_id AS client_database_id,
         'nick' || CAST(user_id AS VARCHAR) || '_' || CAST(k % 3 AS VARCHAR) AS nickname,
         k % 27 + 1 AS channel_id,
         CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(floor(value * 10000) AS BIGINT) END AS idle_ms,
         event_type = 'view' AS is_away,
         CASE WHEN event_type = 'view' OR k % 10 = 0 THEN 'brb' || CAST(k % 5 AS VARCHAR) ELSE '' END AS away_message,
         event_type = 'click' AS is_talking,
         event_type = 'error' AS input_muted,
         event_type = 'signup' AS output_muted,
         (event_type = 'purchase' AND k % 4 = 0) AS is_recording,
         CASE WHEN k % 9 = 0 THEN NULL WHEN k % 9 = 1 THEN ''
              ELSE CAST(user_id % 3 + 6 AS VARCHAR) || ', ' || CAST(k % 2 + 9 AS VARCHAR) END AS server_groups,
         CAST(floor(value * 60) AS BIGINT) AS connected_time
  FROM ev
),
sn AS (
  SELECT g.snapshot_id, g.snapshot_id * {P} AS ts, CAST(COALESCE(c.n, 0) AS BIGINT) AS total_clients
  FROM (SELECT unnest(generate_series((SELECT min(tick) FROM ev), (SELECT max(tick) FROM ev))) AS snapshot_id) g
  LEFT JOIN (SELECT snapshot_id, count(*) AS n FROM cs GROUP BY snapshot_id) c ON c.snapshot_id = g.snapshot_id
),
ch AS (
  SELECT CAST(n_nationkey AS BIGINT) + 1 AS channel_id,
         CASE WHEN n_nationkey = 3 THEN '' ELSE n_name END AS channel_name,
         CAST(n_regionkey AS BIGINT) AS parent_channel_id,
         CAST(n_nationkey AS BIGINT) AS channel_order,
         CAST(0 AS BIGINT) AS total_clients,
         CAST(0 AS BIGINT) AS last_updated
  FROM nation
),
prm AS (SELECT max(ts) AS as_of FROM sn)
"""

LATEST = "arg_max({c}, (ts, snapshot_id, id))"
UTC = "make_timestamp(ts * 1000000)"
DOW_NAMES = "['Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday']"


def rnd(x: str, digits: int = 2) -> str:
    """Rounding of the exact binary value, ties to even, through its decimal text (the operators compute it in arithmetic)."""
    return f"CAST(format('{{:.{digits}f}}', CAST(({x}) AS DOUBLE)) AS DOUBLE)"


def R(days: int | None, col: str = "ts") -> str:
    if days is None:
        return f"{col} BETWEEN 0 AND (SELECT as_of FROM prm)"
    return f"{col} BETWEEN (SELECT as_of FROM prm) - {days * DAY} AND (SELECT as_of FROM prm)"


def label(id_col: str, name_col: str) -> str:
    return (f"CASE WHEN {name_col} IS NULL OR {name_col} = '' "
            f"THEN 'Channel ' || CAST({id_col} AS VARCHAR) ELSE {name_col} END")


def pct(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN {rnd(f"CAST({num} AS DOUBLE) / {den} * 100")} ELSE 0.0 END"


def wrap(body: str, extra: str = "") -> str:
    return "WITH " + PRELUDE + ("," + extra if extra else "") + "\n" + body


# --- question bodies (reusable as subqueries) ------------------------------

def top_users(days=7, limit=10):
    return f"""SELECT client_uid, nickname, sample_count,
  CAST(sample_count * {P} AS BIGINT) AS online_seconds,
  {rnd(f"CAST(sample_count * {P} AS DOUBLE) / 60")} AS online_minutes,
  {rnd(f"CAST(sample_count * {P} AS DOUBLE) / 60 / 60")} AS online_hours,
  first_seen, last_seen
FROM (SELECT client_uid, {LATEST.format(c='nickname')} AS nickname, count(*) AS sample_count,
             min(ts) AS first_seen, max(ts) AS last_seen
      FROM cs WHERE {R(days)} GROUP BY client_uid) u
ORDER BY sample_count DESC, client_uid LIMIT {limit}"""


def user_profile(days=30):
    return f"""SELECT client_uid, {LATEST.format(c='nickname')} AS nickname, count(*) AS sample_count,
  CAST(count(*) * {P} AS BIGINT) AS online_seconds,
  {rnd(f"CAST(count(*) * {P} AS DOUBLE) / 3600")} AS online_hours,
  min(ts) AS first_seen, max(ts) AS last_seen,
  CAST(trunc(COALESCE(avg(idle_ms), 0)) AS BIGINT) AS avg_idle_ms
FROM cs WHERE {R(days)} GROUP BY client_uid"""


def favorite_channels(days=30, k=5):
    return f"""SELECT v.client_uid, CAST(v.rnk AS INTEGER) AS rank, v.channel_id,
  {label('v.channel_id', 'ch.channel_name')} AS channel_name, v.visits
FROM (SELECT client_uid, channel_id, visits,
             row_number() OVER (PARTITION BY client_uid ORDER BY visits DESC, channel_id) AS rnk
      FROM (SELECT client_uid, channel_id, count(*) AS visits FROM cs WHERE {R(days)}
            GROUP BY client_uid, channel_id) x) v
LEFT JOIN ch ON ch.channel_id = v.channel_id
WHERE v.rnk <= {k}"""


def user_weekday_activity(days=30):
    return f"""SELECT client_uid, CAST(dayofweek({UTC}) AS INTEGER) AS day_of_week, count(*) AS sample_count
FROM cs WHERE {R(days)} GROUP BY 1, 2"""


def hourly_heatmap(days=7):
    return f"""SELECT CAST(hour({UTC}) AS INTEGER) AS hour, {rnd(f"avg(total_clients)")} AS avg_clients,
  count(*) AS sample_count
FROM sn WHERE {R(days)} GROUP BY 1"""


def daily_activity(days=30):
    return f"""SELECT CAST(dayofweek({UTC}) AS INTEGER) AS day_of_week,
  {DOW_NAMES}[dayofweek({UTC}) + 1] AS day_name,
  {rnd(f"avg(total_clients)")} AS avg_clients, count(*) AS sample_count
FROM sn WHERE {R(days)} GROUP BY 1, 2"""


def load_bars(curve: str):
    return f"""SELECT c.*, CAST(CASE WHEN m.mx > 0 THEN trunc(c.avg_clients / m.mx * 30) ELSE 0 END AS INTEGER) AS bar
FROM ({curve}) c, (SELECT max(avg_clients) AS mx FROM ({curve}) c2) m"""


def top_idle_users(days=7, limit=10):
    return f"""SELECT client_uid, nickname, CAST(trunc(a) AS BIGINT) AS avg_idle_ms,
  {rnd(f"a / 60000")} AS avg_idle_minutes, sample_count
FROM (SELECT client_uid, {LATEST.format(c='nickname')} AS nickname, avg(idle_ms) AS a, count(*) AS sample_count
      FROM cs WHERE {R(days)} AND idle_ms IS NOT NULL GROUP BY client_uid HAVING count(*) > 10) t
ORDER BY a DESC, client_uid LIMIT {limit}"""


def peak_times(days=7, limit=10):
    return f"""SELECT ts AS timestamp, strftime({UTC}, '%Y-%m-%dT%H:%M:%S') AS datetime, total_clients
FROM sn WHERE {R(days)} ORDER BY total_clients DESC, ts DESC LIMIT {limit}"""


def channel_stats(days=7):
    return f"""SELECT c.channel_id, {label('c.channel_id', 'ch.channel_name')} AS channel_name,
  c.total_visits, c.unique_users, CAST(trunc(COALESCE(c.a, 0)) AS BIGINT) AS avg_idle_ms
FROM (SELECT channel_id, count(*) AS total_visits, count(DISTINCT client_uid) AS unique_users, avg(idle_ms) AS a
      FROM cs WHERE {R(days)} GROUP BY channel_id) c
LEFT JOIN ch ON ch.channel_id = c.channel_id"""


def growth_metrics(days=7):
    return f"""SELECT total_unique_users, new_users, total_unique_users - new_users AS returning_users,
  {pct('new_users', 'total_unique_users')} AS new_user_percentage
FROM (SELECT count(DISTINCT client_uid) AS total_unique_users FROM cs WHERE {R(days)}) a,
     (SELECT count(*) AS new_users FROM (SELECT client_uid, min(ts) AS f FROM cs GROUP BY client_uid) x
      WHERE {R(days, 'f')}) b"""


def _now_rows():
    return f"""SELECT cs.*, ch.channel_name AS raw_name,
  CASE WHEN idle_ms IS NULL OR idle_ms = 0 THEN 0.0 ELSE {rnd(f"CAST(idle_ms AS DOUBLE) / 60000")} END AS idle_minutes
FROM cs LEFT JOIN ch ON ch.channel_id = cs.channel_id
WHERE cs.snapshot_id = (SELECT max(snapshot_id) FROM sn)"""


def online_now():
    return f"""SELECT client_uid, nickname, channel_id, {label('channel_id', 'raw_name')} AS channel_name,
  idle_ms, idle_minutes, is_away, COALESCE(away_message, '') AS away_message,
  is_talking, input_muted, output_muted, is_recording,
  COALESCE(server_groups, '') AS server_groups, connected_time,
  CASE WHEN connected_time IS NULL OR connected_time = 0 THEN 0.0
       ELSE {rnd(f"CAST(connected_time AS DOUBLE) / 3600")} END AS connected_hours,
  ts AS snapshot_time
FROM ({_now_rows()}) n"""


def active_now():
    return f"""SELECT count(*) AS online_users,
  count(*) FILTER (WHERE NOT is_away AND idle_minutes < 5) AS active_users
FROM ({_now_rows()}) n"""


def summary(days=7):
    return f"""SELECT total_snapshots, avg_users_online, max_users_online, unique_users
FROM (SELECT count(*) AS total_snapshots, {rnd(f"COALESCE(avg(total_clients), 0)")} AS avg_users_online,
             CAST(COALESCE(max(total_clients), 0) AS BIGINT) AS max_users_online
      FROM sn WHERE {R(days)}) a,
     (SELECT count(DISTINCT client_uid) AS unique_users FROM cs WHERE {R(days)}) b"""


def away_summary(days=7):
    return f"""SELECT total_samples, away_samples, {pct('away_samples', 'total_samples')} AS away_percentage
FROM (SELECT count(*) AS total_samples, count(*) FILTER (WHERE is_away) AS away_samples
      FROM cs WHERE {R(days)}) t"""


def top_away_users(days=7, limit=10):
    return f"""SELECT client_uid, nickname, total_samples, away_count,
  {pct('away_count', 'total_samples')} AS away_percentage, last_away_message
FROM (SELECT client_uid, {LATEST.format(c='nickname')} AS nickname, count(*) AS total_samples,
             count(*) FILTER (WHERE is_away) AS away_count,
             {LATEST.format(c='away_message')} AS last_away_message
      FROM cs WHERE {R(days)} AND away_message IS NOT NULL AND away_message <> ''
      GROUP BY client_uid HAVING count(*) > 10) t
ORDER BY away_count DESC, client_uid LIMIT {limit}"""


def mute_summary(days=7):
    return f"""SELECT total_samples,
  {pct('mic', 'total_samples')} AS mic_muted_percentage,
  {pct('spk', 'total_samples')} AS speaker_muted_percentage,
  {pct('rec', 'total_samples')} AS recording_percentage,
  {pct('talk', 'total_samples')} AS talking_percentage
FROM (SELECT count(*) AS total_samples, count(*) FILTER (WHERE input_muted) AS mic,
             count(*) FILTER (WHERE output_muted) AS spk, count(*) FILTER (WHERE is_recording) AS rec,
             count(*) FILTER (WHERE is_talking) AS talk
      FROM cs WHERE {R(days)}) t"""


def top_recorders(days=7, limit=10):
    return f"""SELECT client_uid, nickname, recording_count,
  {pct('recording_count', 'total_samples')} AS recording_percentage
FROM (SELECT client_uid, {LATEST.format(c='nickname')} AS nickname, count(*) AS total_samples,
             count(*) FILTER (WHERE is_recording) AS recording_count
      FROM cs WHERE {R(days)} GROUP BY client_uid) t
WHERE recording_count > 0 ORDER BY recording_count DESC, client_uid LIMIT {limit}"""


def server_group_stats(days=7):
    return f"""SELECT group_id, CAST(sum(members) AS BIGINT) AS unique_members,
  CAST(sum(samples) AS BIGINT) AS total_samples
FROM (SELECT trim(unnest(string_split(server_groups, ','))) AS group_id, members, samples
      FROM (SELECT server_groups, count(DISTINCT client_uid) AS members, count(*) AS samples
            FROM cs WHERE {R(days)} AND server_groups IS NOT NULL AND server_groups <> ''
            GROUP BY server_groups) s) g
WHERE group_id <> '' GROUP BY group_id"""


def server_group_stats_exact(days=7):
    return f"""SELECT group_id, count(DISTINCT client_uid) AS unique_members, count(*) AS total_samples
FROM (SELECT DISTINCT id, client_uid, group_id
      FROM (SELECT id, client_uid, trim(unnest(string_split(server_groups, ','))) AS group_id
            FROM cs WHERE {R(days)} AND server_groups IS NOT NULL AND server_groups <> '') x
      WHERE group_id <> '') g
GROUP BY group_id"""


def _lagged(days):
    return f"""SELECT *, lag(channel_id) OVER w AS prev_ch, lag(ts) OVER w AS prev_ts
FROM cs WHERE {R(days)}
WINDOW w AS (PARTITION BY client_uid ORDER BY ts, snapshot_id, id)"""


def channel_switches(days=7, limit=10):
    return f"""SELECT client_uid, nickname, total_samples, channel_switches,
  {rnd(f"channel_switches / (CAST(total_samples * {P} AS DOUBLE) / 3600)")} AS switches_per_hour
FROM (SELECT client_uid, {LATEST.format(c='nickname')} AS nickname, count(*) AS total_samples,
             count(*) FILTER (WHERE prev_ch IS NOT NULL AND channel_id <> prev_ch) AS channel_switches
      FROM ({_lagged(days)}) x GROUP BY client_uid) u
WHERE channel_switches > 0 ORDER BY channel_switches DESC, client_uid LIMIT {limit}"""


def session_counts(days=7, limit=10):
    return f"""SELECT client_uid, nickname, session_count,
  {rnd(f"CAST(n AS DOUBLE) / session_count * {P} / 60")} AS avg_session_length_minutes
FROM (SELECT client_uid, {LATEST.format(c='nickname')} AS nickname, count(*) AS n,
             count(*) FILTER (WHERE prev_ts IS NULL OR ts - prev_ts > {GAP}) AS session_count
      FROM ({_lagged(days)}) x GROUP BY client_uid) u
WHERE session_count > 0 ORDER BY session_count DESC, client_uid LIMIT {limit}"""


def connection_summary(days=7):
    return f"""SELECT count(*) AS total_users, COALESCE({rnd(f"avg(n) * {P} / 3600")}, 0.0) AS avg_online_time_hours
FROM (SELECT client_uid, count(*) AS n FROM cs WHERE {R(days)} GROUP BY client_uid) u"""


def sessions(days=7):
    return f"""SELECT client_uid, CAST(session_no AS BIGINT) AS session_no, min(ts) AS session_start,
  max(ts) AS session_end, count(*) AS samples
FROM (SELECT *, sum(st) OVER (PARTITION BY client_uid ORDER BY ts, snapshot_id, id
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_no
      FROM (SELECT *, CASE WHEN prev_ts IS NULL OR ts - prev_ts > {GAP} THEN 1 ELSE 0 END AS st
            FROM ({_lagged(days)}) x) y) z
GROUP BY client_uid, session_no"""


def _ltv_scored(days=None):
    return f"""SELECT m.*, CAST(trunc(
    CAST(total_samples AS DOUBLE) / mn * 40 + CAST(days_active AS DOUBLE) / md * 30
    + CASE WHEN mk > 0 THEN CAST(talking_samples AS DOUBLE) / mk * 20 ELSE 0.0 END
    + CAST(channels_visited AS DOUBLE) / mc * 10) AS BIGINT) AS ltv_score
FROM (SELECT client_uid, max(nickname) AS nickname, count(*) AS total_samples,
             count(DISTINCT CAST({UTC} AS DATE)) AS days_active,
             count(DISTINCT channel_id) AS channels_visited,
             count(*) FILTER (WHERE is_talking) AS talking_samples,
             avg(idle_ms) AS avg_idle, min(ts) AS first_seen, max(ts) AS last_seen,
             count(*) FILTER (WHERE prev_ts IS NULL OR ts - prev_ts > {GAP}) AS session_count
      FROM ({_lagged(days)}) x GROUP BY client_uid) m,
     (SELECT max(total_samples) AS mn, max(days_active) AS md, max(talking_samples) AS mk,
             max(channels_visited) AS mc
      FROM (SELECT client_uid, count(*) AS total_samples,
                   count(DISTINCT CAST({UTC} AS DATE)) AS days_active,
                   count(DISTINCT channel_id) AS channels_visited,
                   count(*) FILTER (WHERE is_talking) AS talking_samples
            FROM cs WHERE {R(days)} GROUP BY client_uid) q) nm
WHERE total_samples > 5"""


def lifetime_value(days=None, limit=50):
    return f"""SELECT client_uid, nickname, ltv_score,
  CASE WHEN ltv_score >= 80 THEN 'power_user' WHEN ltv_score >= 50 THEN 'regular' ELSE 'casual' END AS category,
  CASE WHEN ltv_score >= 80 THEN 'Power User' WHEN ltv_score >= 50 THEN 'Regular User' ELSE 'Casual User' END
    AS category_label,
  total_samples, {rnd(f"CAST(total_samples * {P} AS DOUBLE) / 3600")} AS online_hours, days_active,
  CASE WHEN last_seen - first_seen > 0
       THEN {rnd(f"days_active / (CAST(last_seen - first_seen AS DOUBLE) / 86400) * 100")} ELSE 0.0 END
    AS activity_frequency_percent,
  channels_visited, talking_samples, {pct('talking_samples', 'total_samples')} AS talking_percentage,
  CASE WHEN avg_idle IS NULL OR avg_idle = 0 THEN 0.0 ELSE {rnd(f"avg_idle / 60000")} END AS avg_idle_minutes,
  session_count,
  CASE WHEN session_count > 0
       THEN {rnd(f"CAST(total_samples * {P} AS DOUBLE) / 3600 / session_count")} ELSE 0.0 END
    AS avg_session_length_hours,
  first_seen, last_seen
FROM ({_ltv_scored(days)}) s
ORDER BY ltv_score DESC, client_uid LIMIT {limit}"""


def ltv_summary(days=None):
    return f"""SELECT count(*) AS total_users, COALESCE({rnd(f"avg(ltv_score)")}, 0.0) AS avg_ltv_score,
  count(*) FILTER (WHERE ltv_score >= 80) AS power_users,
  {pct('count(*) FILTER (WHERE ltv_score >= 80)', 'count(*)')} AS power_users_percent,
  count(*) FILTER (WHERE ltv_score >= 50 AND ltv_score < 80) AS regular_users,
  {pct('count(*) FILTER (WHERE ltv_score >= 50 AND ltv_score < 80)', 'count(*)')} AS regular_users_percent,
  count(*) FILTER (WHERE ltv_score < 50) AS casual_users,
  {pct('count(*) FILTER (WHERE ltv_score < 50)', 'count(*)')} AS casual_users_percent
FROM ({_ltv_scored(days)}) s"""


def dataset_stats():
    return """SELECT (SELECT count(*) FROM sn) AS snapshot_count, (SELECT count(*) FROM cs) AS client_snapshot_count,
  (SELECT count(DISTINCT client_uid) FROM cs) AS unique_clients,
  (SELECT min(ts) FROM sn) AS first_snapshot_timestamp, (SELECT max(ts) FROM sn) AS last_snapshot_timestamp"""


def list_channels():
    return "SELECT * FROM ch ORDER BY channel_order NULLS FIRST, channel_id"


def channel_name_lookup():
    return """SELECT d.channel_id, ch.channel_name
FROM (SELECT DISTINCT channel_id FROM cs) d LEFT JOIN ch ON ch.channel_id = d.channel_id"""


def metrics_snapshot(days=7):
    return f"""SELECT name, label_channel_id, label_channel_name, value FROM (
  SELECT 'ts_users_total' AS name, NULL AS label_channel_id, NULL AS label_channel_name,
         CAST(unique_users AS DOUBLE) AS value FROM ({summary(days)}) s
  UNION ALL SELECT 'ts_avg_users_online', NULL, NULL, CAST(avg_users_online AS DOUBLE) FROM ({summary(days)}) s
  UNION ALL SELECT 'ts_peak_users', NULL, NULL, CAST(max_users_online AS DOUBLE) FROM ({summary(days)}) s
  UNION ALL SELECT 'ts_snapshots_total', NULL, NULL, CAST(total_snapshots AS DOUBLE) FROM ({summary(days)}) s
  UNION ALL SELECT 'ts_users_online', NULL, NULL, CAST(online_users AS DOUBLE) FROM ({active_now()}) a
  UNION ALL SELECT 'ts_users_online_active', NULL, NULL, CAST(active_users AS DOUBLE) FROM ({active_now()}) a
  UNION ALL SELECT 'ts_ltv_power_users', NULL, NULL, CAST(power_users AS DOUBLE) FROM ({ltv_summary()}) l
  UNION ALL SELECT 'ts_ltv_regular_users', NULL, NULL, CAST(regular_users AS DOUBLE) FROM ({ltv_summary()}) l
  UNION ALL SELECT 'ts_ltv_casual_users', NULL, NULL, CAST(casual_users AS DOUBLE) FROM ({ltv_summary()}) l
  UNION ALL SELECT 'ts_ltv_avg_score', NULL, NULL, CAST(avg_ltv_score AS DOUBLE) FROM ({ltv_summary()}) l
  UNION ALL SELECT 'ts_channels_total', NULL, NULL, CAST(count(*) AS DOUBLE) FROM ({channel_stats(days)}) c
  UNION ALL SELECT 'ts_channel_visits', CAST(channel_id AS VARCHAR), channel_name, CAST(total_visits AS DOUBLE)
    FROM ({channel_stats(days)}) t
  UNION ALL SELECT 'ts_channel_unique_users', CAST(channel_id AS VARCHAR), channel_name, CAST(unique_users AS DOUBLE)
    FROM ({channel_stats(days)}) t
) m"""


def daily_user_rollup():
    flags = ("is_away", "is_talking", "input_muted", "output_muted", "is_recording")
    per_channel_flags = ", ".join(f"count(*) FILTER (WHERE {f}) AS c_{f}" for f in flags)
    per_day_flags = ", ".join(f"CAST(sum(c_{f}) AS BIGINT) AS {f}_count" for f in flags)
    return f"""SELECT client_uid, strftime(d, '%Y-%m-%d') AS date, max(nick) AS nickname,
  CAST(sum(n) AS BIGINT) AS total_samples, CAST(sum(n) * {P} AS BIGINT) AS online_seconds,
  CASE WHEN sum(icnt) > 0 THEN CAST(sum(isum) AS DOUBLE) / sum(icnt) END AS avg_idle_ms,
  arg_max(channel_id, (n, -channel_id)) AS most_visited_channel_id, {per_day_flags}
FROM (SELECT client_uid, CAST({UTC} AS DATE) AS d, channel_id, count(*) AS n, max(nickname) AS nick,
             sum(idle_ms) AS isum, count(idle_ms) AS icnt, {per_channel_flags}
      FROM cs GROUP BY 1, 2, 3) pc
GROUP BY client_uid, d"""


def daily_user_rollup_compat():
    flags = ("is_away", "is_talking", "input_muted", "output_muted", "is_recording")
    per_day_flags = ", ".join(f"CAST(count(*) FILTER (WHERE {f}) AS BIGINT) AS {f}_count" for f in flags)
    return f"""SELECT r.client_uid, strftime(r.d, '%Y-%m-%d') AS date, max(r.nickname) AS nickname,
  CAST(count(*) AS BIGINT) AS total_samples, CAST(count(*) * {P} AS BIGINT) AS online_seconds,
  avg(r.idle_ms) AS avg_idle_ms, any_value(m.mode) AS most_visited_channel_id, {per_day_flags}
FROM (SELECT cs.*, CAST({UTC} AS DATE) AS d FROM cs
      UNION ALL
      SELECT cs.*, CAST({UTC} AS DATE) - 1 AS d FROM cs WHERE ts % 86400 = 0) r
LEFT JOIN (SELECT client_uid, arg_max(channel_id, (n, -channel_id)) AS mode
           FROM (SELECT client_uid, channel_id, count(*) AS n FROM cs GROUP BY 1, 2) c GROUP BY 1) m
  ON m.client_uid = r.client_uid
GROUP BY r.client_uid, r.d"""


def channel_upsert():
    cols = ("channel_name", "parent_channel_id", "channel_order", "total_clients", "last_updated")
    picks = ", ".join(f"arg_max({c}, (last_updated, src, seq)) AS {c}" for c in cols)
    return f"""SELECT channel_id, {picks}
FROM (SELECT channel_id, channel_name, parent_channel_id, channel_order, total_clients, last_updated,
             0 AS src, CAST(0 AS BIGINT) AS seq FROM ch
      UNION ALL
      SELECT k % 27 + 1, 'room ' || CAST(k % 27 + 1 AS VARCHAR) || '/' || CAST(user_id % 4 AS VARCHAR),
             k % 3, k % 27, user_id % 7, tick * {P}, 1, event_id FROM ev) a
GROUP BY channel_id"""


def retention_report(days=7):
    cut = f"(SELECT as_of FROM prm) - {days * DAY}"
    return f"""SELECT (SELECT count(*) FROM sn WHERE ts < {cut}) AS removed_snapshots,
  (SELECT count(*) FROM cs WHERE ts < {cut}) AS removed_client_rows,
  (SELECT count(*) FROM sn WHERE ts >= {cut}) AS kept_snapshots,
  (SELECT count(*) FROM cs WHERE ts >= {cut}) AS kept_client_rows"""


def ingest_clients():
    return f"""SELECT ts * 2147483648 + pos AS id, ts AS snapshot_id, ts, client_uid, client_database_id, nickname,
  channel_id, idle_ms, is_away, COALESCE(away_message, '') AS away_message, is_talking, input_muted,
  output_muted, is_recording, COALESCE(server_groups, '') AS server_groups, connected_time
FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY id) - 1 AS pos FROM cs) x"""


def ingest_snapshots():
    return "SELECT ts AS snapshot_id, ts, total_clients FROM sn"


# the varied documents: rows with part and place, the accepted documents with the position of their first row
VARIED = """r AS (SELECT *, id // 50 AS part, row_number() OVER (PARTITION BY snapshot_id, id // 50 ORDER BY id) - 1 AS place FROM cs),
d AS (SELECT snapshot_id, part, count(*) AS size FROM r GROUP BY ALL),
acc AS (SELECT *, 0 AS variant FROM d WHERE part % 9 <> 0
  UNION ALL SELECT *, 1 FROM d WHERE part % 9 NOT IN (0, 1) AND part % 6 = 1),
o AS (SELECT *, COALESCE(sum(size) OVER (PARTITION BY snapshot_id ORDER BY CASE WHEN part % 9 = 1 THEN 0 ELSE 1 END, part, variant
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM acc),
kept AS (SELECT r.*, o.start + r.place AS pos FROM r JOIN o ON o.snapshot_id = r.snapshot_id AND o.part = r.part AND o.variant = 0
  WHERE r.id % 11 <> 0)"""


def ingest_rules_clients():
    return f"""SELECT CAST(ts * 2147483648 + pos AS BIGINT) AS id, ts AS snapshot_id, ts,
  CASE WHEN id % 13 = 0 THEN 'unknown' ELSE client_uid END AS client_uid, client_database_id,
  CASE WHEN id % 17 = 0 THEN 'Unknown' ELSE nickname END AS nickname, CASE WHEN id % 19 = 0 THEN 0 ELSE channel_id END AS channel_id,
  idle_ms, is_away AND id % 5 <> 0 AS is_away, CASE WHEN id % 7 = 0 THEN '' ELSE COALESCE(away_message, '') END AS away_message,
  is_talking, input_muted, output_muted, is_recording, COALESCE(server_groups, '') AS server_groups, connected_time
FROM (WITH {VARIED} SELECT * FROM kept) x"""


def ingest_rules_snapshots():
    return f"""SELECT s.ts AS snapshot_id, s.ts, CAST(COALESCE(k.n, 0) AS BIGINT) AS total_clients
FROM sn s LEFT JOIN (WITH {VARIED} SELECT snapshot_id, count(*) AS n FROM kept GROUP BY snapshot_id) k ON k.snapshot_id = s.snapshot_id
WHERE s.snapshot_id % 5 = 0 OR s.snapshot_id IN (SELECT snapshot_id FROM cs WHERE (id // 50) % 9 <> 0)"""


def ingest_rejected():
    return """SELECT poll_ts, '512' AS code, 'no such server' AS message
FROM (SELECT DISTINCT ts AS poll_ts, id // 50 AS part FROM cs WHERE (id // 50) % 9 = 0) x,
  unnest(CASE WHEN part % 4 = 0 AND part % 6 = 1 THEN [1, 2, 3] WHEN part % 4 = 0 OR part % 6 = 1 THEN [1, 2] ELSE [1] END) AS t(copy)"""


def user_stats(uid="guest0", days=30):
    mine = f"client_uid = '{uid}' AND {R(days)}"
    return f"""SELECT client_uid, {LATEST.format(c='nickname')} AS nickname, count(*) AS sample_count, min(ts) AS first_seen, max(ts) AS last_seen,
  CAST(floor(COALESCE(avg(idle_ms), 0)) AS BIGINT) AS avg_idle_ms,
  (SELECT string_agg(label || '=' || CAST(n AS VARCHAR), ';' ORDER BY n DESC, channel_id) FROM (
    SELECT f.channel_id, f.n, CASE WHEN ch.channel_name IS NULL OR ch.channel_name = '' THEN 'Channel ' || CAST(f.channel_id AS VARCHAR) ELSE ch.channel_name END AS label
    FROM (SELECT channel_id, count(*) AS n FROM cs WHERE {mine} GROUP BY channel_id ORDER BY n DESC, channel_id LIMIT 5) f
    LEFT JOIN ch ON ch.channel_id = f.channel_id) a) AS favorites,
  (SELECT string_agg(CAST(w AS VARCHAR) || '=' || CAST(n AS VARCHAR), ';' ORDER BY w) FROM (
    SELECT dayofweek({UTC}) AS w, count(*) AS n FROM cs WHERE {mine} GROUP BY 1) b) AS weekdays
FROM cs WHERE {mine} GROUP BY client_uid"""


def retained_clients(days=7):
    return f"SELECT id, ts, client_uid FROM cs WHERE ts >= (SELECT as_of FROM prm) - {days * DAY}"


def rollup_of_day(date="2024-01-15"):
    return f"SELECT * FROM ({daily_user_rollup()}) x WHERE date = '{date}'"


def session_windows():
    return f"""SELECT client_uid, min(ts) AS session_start, max(ts) AS session_end, count(*) AS samples FROM (
  SELECT client_uid, ts, sum(fresh) OVER (PARTITION BY client_uid ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT client_uid, ts, id, CASE WHEN ts - lag(ts) OVER (PARTITION BY client_uid ORDER BY ts, id) <= {GAP} THEN 0 ELSE 1 END AS fresh FROM cs) a) b
GROUP BY client_uid, g"""


def hourly_windows():
    return """SELECT ts // 3600 * 3600 AS hour_start, avg(total_clients) AS avg_clients, max(total_clients) AS max_clients, count(*) AS polls
FROM sn GROUP BY 1"""


def unique_users(days=7):
    return f"SELECT count(*) AS total_samples, count(DISTINCT client_uid) AS unique_users_estimate FROM cs WHERE {R(days)}"


def channel_users(days=7):
    return f"SELECT channel_id, channel_name, total_visits, unique_users AS unique_users_estimate FROM ({channel_stats(days)}) x"


def ingest_channel_updates():
    return f"""SELECT k % 27 + 1 AS channel_id,
  'room ' || CAST(k % 27 + 1 AS VARCHAR) || '/' || CAST(user_id % 4 AS VARCHAR) AS channel_name,
  k % 3 AS parent_channel_id, k % 27 AS channel_order, user_id % 7 AS total_clients,
  tick * {P} AS last_updated,
  tick * {P} * 2147483648 + row_number() OVER (PARTITION BY tick ORDER BY event_id) - 1 AS list_seq
FROM ev"""


def first_seen():
    return "SELECT client_uid, min(ts) AS first_ts FROM cs GROUP BY client_uid"


def conform_layouts(old_days=15):
    cut = f"(SELECT as_of FROM prm) - {old_days * DAY}"
    old = f"ts < {cut}"
    return f"""SELECT id, snapshot_id, ts, client_uid, client_database_id, nickname, channel_id, idle_ms,
  CASE WHEN {old} THEN false ELSE is_away END AS is_away,
  CASE WHEN {old} THEN NULL ELSE away_message END AS away_message,
  CASE WHEN {old} THEN false ELSE is_talking END AS is_talking,
  CASE WHEN {old} THEN false ELSE input_muted END AS input_muted,
  CASE WHEN {old} THEN false ELSE output_muted END AS output_muted,
  CASE WHEN {old} THEN false ELSE is_recording END AS is_recording,
  CASE WHEN {old} THEN NULL ELSE server_groups END AS server_groups,
  CASE WHEN {old} THEN NULL ELSE connected_time END AS connected_time
FROM cs"""


def oracle_sql() -> dict[str, str]:
    return {
        "top_users": wrap(top_users(7, 10)),
        "user_profile": wrap(user_profile(30)),
        "favorite_channels": wrap(favorite_channels(30, 5)),
        "user_weekday_activity": wrap(user_weekday_activity(30)),
        "hourly_heatmap": wrap(hourly_heatmap(7)),
        "daily_activity": wrap(daily_activity(30)),
        "hourly_load_bars": wrap(load_bars(hourly_heatmap(7))),
        "daily_load_bars": wrap(load_bars(daily_activity(30))),
        "top_idle_users": wrap(top_idle_users(7, 10)),
        "peak_times": wrap(peak_times(7, 10)),
        "channel_stats": wrap(channel_stats(7)),
        "growth_metrics": wrap(growth_metrics(7)),
        "online_now": wrap(online_now()),
        "summary": wrap(summary(7)),
        "away_summary": wrap(away_summary(7)),
        "top_away_users": wrap(top_away_users(7, 10)),
        "top_away_users_all_time": wrap(top_away_users(None, 10)),
        "mute_summary": wrap(mute_summary(7)),
        "top_recorders": wrap(top_recorders(7, 10)),
        "server_group_stats": wrap(server_group_stats(7)),
        "server_group_stats_exact": wrap(server_group_stats_exact(7)),
        "channel_switches": wrap(channel_switches(7, 10)),
        "session_counts": wrap(session_counts(7, 10)),
        "connection_summary": wrap(connection_summary(7)),
        "sessions": wrap(sessions(7)),
        "lifetime_value": wrap(lifetime_value(None, 50)),
        "ltv_summary": wrap(ltv_summary(None)),
        "dataset_stats": wrap(dataset_stats()),
        "list_channels": wrap(list_channels()),
        "channel_name_lookup": wrap(channel_name_lookup()),
        "active_now": wrap(active_now()),
        "metrics_snapshot": wrap(metrics_snapshot(7)),
        "daily_user_rollup": wrap(daily_user_rollup()),
        "daily_user_rollup_compat": wrap(daily_user_rollup_compat()),
        "channel_upsert": wrap(channel_upsert()),
        "retention_report": wrap(retention_report(7)),
        "ingest_clients": wrap(ingest_clients()),
        "ingest_snapshots": wrap(ingest_snapshots()),
        "conform_layouts": wrap(conform_layouts(15)),
        "ingest_channel_updates": wrap(ingest_channel_updates()),
        "first_seen": wrap(first_seen()),
        "ingest_rules_clients": wrap(ingest_rules_clients()),
        "ingest_rules_snapshots": wrap(ingest_rules_snapshots()),
        "ingest_rejected": wrap(ingest_rejected()),
        "user_stats": wrap(user_stats()),
        "retained_clients": wrap(retained_clients(7)),
        "rollup_of_day": wrap(rollup_of_day()),
        "session_windows": wrap(session_windows()),
        "hourly_windows": wrap(hourly_windows()),
        "unique_users_estimate": wrap(unique_users(7)),
        "channel_users_estimate": wrap(channel_users(7)),
    }
