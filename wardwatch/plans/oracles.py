"""The registered queries as plain SQL over the ``events`` table, written for another engine.

They restate each operator from its definition (ordered folds, row numbers, recursion), not from the Spark plan, so
that a shared mistake is unlikely.
"""

from __future__ import annotations

_AS_OF = "TIMESTAMP '2024-01-30 00:00:00'"
_SNAPSHOT = "TIMESTAMP '2024-01-20 00:00:00'"
_LOG_END = "TIMESTAMP '2024-02-01 00:00:00'"
_WEEK_US = 604_800_000_000
_RETENTION_US = 172_800_000_000

_FEED = """
feed AS (
  SELECT event_id,
         event_id * 10 + c.copy AS seq,
         printf('dev_%04d', user_id) AS device_id,
         printf('room_%03d', user_id // 2) AS room_id,
         CASE event_type WHEN 'click' THEN 'heartbeat' WHEN 'view' THEN 'motion' WHEN 'purchase' THEN 'presence'
                         WHEN 'signup' THEN 'sleep_state' ELSE 'fall_warn' END AS type,
         ts,
         ts + INTERVAL '1' SECOND * (CASE event_id % 20 WHEN 0 THEN 7200 WHEN 1 THEN -7200 WHEN 2 THEN 45
                                     WHEN 3 THEN 1200 ELSE 1 END)
            + INTERVAL '1' SECOND * (6 * (c.copy - 1)) AS received_at,
         CASE WHEN event_type = 'purchase' THEN value >= 40 END AS in_room,
         CASE WHEN event_type = 'error' THEN least(value / 400, 0.99) END AS confidence
  FROM events CROSS JOIN (VALUES (1), (2), (3)) c(copy)
  WHERE c.copy <= CASE WHEN event_type = 'error' THEN 1 + event_id % 3 ELSE 1 END
),
arrivals AS (
  SELECT *, epoch_us(ts) AS t, epoch_us(received_at) AS r,
         CASE WHEN epoch_us(ts) - epoch_us(received_at) > 3600000000 THEN 'clock_skew_future'
              WHEN epoch_us(received_at) - epoch_us(ts) > 3600000000 THEN 'clock_skew_past' END AS reason,
         epoch_us(received_at) - epoch_us(ts) > 30000000 AS late
  FROM feed
),
accepted AS (SELECT * FROM arrivals WHERE reason IS NULL),
wire AS (
  SELECT * EXCLUDE (reason), CASE WHEN event_id % 13 = 0 THEN (event_id // 13) % 10 END AS spoiled,
         CASE WHEN event_id % 13 <> 0 THEN reason
              WHEN (event_id // 13) % 10 <= 2 THEN 'invalid_json'
              WHEN (event_id // 13) % 10 = 8 THEN 'invalid_timestamp'
              ELSE 'invalid_schema' END AS reason
  FROM arrivals
),
wired AS (SELECT * FROM wire WHERE reason IS NULL)
"""

_VISIBLE = f"""
visible AS (SELECT * FROM accepted WHERE received_at <= {_AS_OF}),
beats AS (SELECT * FROM visible WHERE type = 'heartbeat'),
presence AS (SELECT * FROM visible WHERE type = 'presence')
"""

_FALLS = """
falls AS (
  SELECT *, 'dedup:' || sha256(device_id || ':' || room_id || ':' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00') AS dedup_key
  FROM accepted WHERE type = 'fall_warn'
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY ts, received_at, seq) AS rn FROM falls),
alarms AS (SELECT device_id, room_id, ts, confidence, received_at, dedup_key FROM ranked WHERE rn = 1)
"""

_EARLY_ALARMS = f"""
early AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY ts, received_at, seq) AS n FROM falls
                 WHERE received_at < {_SNAPSHOT}) WHERE n = 1
)
"""

_CURRENT = """
current_presence AS (
  SELECT room_id, in_room, ts FROM (
    SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY ts DESC, received_at, seq) AS n FROM presence
  ) WHERE n = 1
)
"""

_RETAINED = f"""
cutoffs AS (SELECT room_id, max(r) - {_RETENTION_US} AS cutoff FROM presence GROUP BY room_id),
floors AS (
  SELECT c.room_id,
         coalesce((SELECT max(p.t) FROM presence p WHERE p.room_id = c.room_id AND p.t <= c.cutoff) - 1000, c.cutoff) AS floor_us
  FROM cutoffs c
),
retained AS (SELECT DISTINCT room_id, t, ts, in_room FROM presence JOIN floors USING (room_id) WHERE t > floor_us)
"""


def _occupied(source: str, windows: str) -> str:
    """Occupied microseconds per room and window by the ordered fold."""
    return f"""
spans AS (
  SELECT room_id, t, in_room,
         coalesce(lead(t) OVER (PARTITION BY room_id ORDER BY t, in_room), epoch_us({_AS_OF})) AS nx
  FROM (SELECT DISTINCT room_id, t, in_room FROM {source} WHERE t <= epoch_us({_AS_OF}))
),
windows(win, secs) AS (VALUES {windows}),
occupied AS (
  SELECT room_id, win, secs,
         CAST(sum(CASE WHEN in_room THEN greatest(0, nx - greatest(t, epoch_us({_AS_OF}) - CAST(secs AS BIGINT) * 1000000)) ELSE 0 END) AS BIGINT) AS us
  FROM spans CROSS JOIN windows GROUP BY room_id, win, secs
)
"""


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(part.strip() for part in parts) + "\n"


_WEEK = "('w', 604800)"
_ALL_WINDOWS = "('1440m', 86400), ('168h', 604800), ('2419200', 2419200)"

_STATE = f"""
device_floor AS (SELECT device_id, max(r) - {_WEEK_US} AS floor_us FROM beats GROUP BY device_id),
state AS (
  SELECT 'device_last' AS state_table, device_id AS entity_id, max(ts) AS ts, CAST(NULL AS BOOLEAN) AS in_room
  FROM beats GROUP BY device_id
  UNION ALL
  SELECT DISTINCT 'device_beats', device_id, ts, CAST(NULL AS BOOLEAN)
  FROM beats JOIN device_floor USING (device_id) WHERE t > floor_us
  UNION ALL
  SELECT 'room_presence', room_id, ts, in_room FROM current_presence
  UNION ALL
  SELECT 'room_transitions', room_id, ts, in_room FROM retained
)
"""

_WIRED_VISIBLE = """
beats AS (SELECT * FROM wired WHERE type = 'heartbeat'),
presence AS (SELECT * FROM wired WHERE type = 'presence')
"""

_STATE_SQL = _with(_FEED, _VISIBLE, _CURRENT, _RETAINED, _STATE) + "SELECT state_table, entity_id, ts, in_room FROM state"

_FALL_WALK = """
ordered AS (SELECT dedup_key, r, received_at, seq, row_number() OVER (PARTITION BY dedup_key ORDER BY r, seq) AS n FROM falls),
walk AS (
  SELECT dedup_key, received_at, seq, n, r AS set_at, 'new' AS outcome FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.dedup_key, o.received_at, o.seq, o.n,
         CASE WHEN o.r - w.set_at >= 10000000 THEN o.r ELSE w.set_at END,
         CASE WHEN o.r - w.set_at >= 10000000 THEN 'dedup_post_ttl' ELSE 'dedup_in_window' END
  FROM walk w JOIN ordered o ON o.dedup_key = w.dedup_key AND o.n = w.n + 1
)
"""


def _windows(rows: str, key: str) -> str:
    """Windows of two hours of receipt that open with a key's first arrival and then with the first after the last window."""
    return f"""
times AS (SELECT {key}, epoch_us(received_at) AS t, row_number() OVER (PARTITION BY {key} ORDER BY epoch_us(received_at)) AS n
          FROM (SELECT DISTINCT {key}, received_at FROM {rows})),
steps AS (
  SELECT {key}, t, n, t AS open FROM times WHERE n = 1
  UNION ALL
  SELECT o.{key}, o.t, o.n, CASE WHEN o.t - s.open >= 7200000000 THEN o.t ELSE s.open END
  FROM steps s JOIN times o ON o.{key} = s.{key} AND o.n = s.n + 1
),
placed AS (SELECT r.*, open FROM {rows} r JOIN steps s ON s.{key} = r.{key} AND s.t = epoch_us(r.received_at))
"""


ORACLES: dict[str, str] = {
    "s1_json_source": _with(_FEED)
    + """SELECT CASE WHEN spoiled IN (0, 1, 2) THEN NULL WHEN spoiled = 9 THEN '7' ELSE type END AS type,
       coalesce(spoiled NOT IN (0, 1, 2), true) AS is_object, count(*) AS lines
FROM wire GROUP BY 1, 2""",
    "s3_event_log": _with(_FEED)
    + """SELECT device_id, room_id, type, ts, received_at, seq, late,
       CASE WHEN type = 'fall_warn' THEN 'high' ELSE 'normal' END AS priority, in_room, confidence,
       CAST(received_at AS DATE) AS event_date
FROM accepted""",
    "s4_log_since": _with(_FEED)
    + f"""SELECT row_number() OVER (ORDER BY ts, received_at, seq) AS position, device_id, type, ts, received_at, seq, late
FROM accepted WHERE received_at >= {_SNAPSHOT}""",
    "s5_alarm_insert_ignore": _with(_FEED, _FALLS, _EARLY_ALARMS)
    + """SELECT CAST(ts AS DATE) AS alarm_date, batch, count(*) AS alarms, count(DISTINCT dedup_key) AS keys
FROM (SELECT ts, dedup_key, 'first' AS batch FROM early
      UNION ALL
      SELECT ts, dedup_key, 'second' FROM alarms WHERE dedup_key NOT IN (SELECT dedup_key FROM early))
GROUP BY 1, 2""",
    "v1_invalid_json": _with(_FEED) + "SELECT received_at, reason FROM wire WHERE reason = 'invalid_json'",
    "v2_schema_reasons": _with(_FEED)
    + """SELECT CAST(received_at AS DATE) AS received_date, reason, spoiled = 4 AS no_device, spoiled = 9 AS no_type,
       count(*) AS events
FROM wire WHERE reason = 'invalid_schema' GROUP BY 1, 2, 3, 4""",
    "v3_timestamp": """SELECT event_id,
       CASE event_id % 12
         WHEN 0 THEN ts
         WHEN 1 THEN date_trunc('millisecond', ts)
         WHEN 2 THEN date_trunc('second', ts) - INTERVAL '2' HOUR
         WHEN 3 THEN date_trunc('second', ts)
         WHEN 4 THEN CAST(date_trunc('day', ts) AS TIMESTAMP)
         WHEN 5 THEN CAST(date_trunc('day', ts) AS TIMESTAMP)
         WHEN 6 THEN date_trunc('minute', ts) + INTERVAL '210' MINUTE
         WHEN 7 THEN ts
       END AS parsed_ts
FROM events""",
    "v4_clock_skew": _with(_FEED)
    + "SELECT device_id, seq, reason, (t - r) / 1000000.0 AS offset_seconds FROM arrivals WHERE reason IS NOT NULL",
    "v5_late_flag": _with(_FEED) + "SELECT device_id, late, count(*) AS events FROM accepted GROUP BY 1, 2",
    "v6_priority": _with(_FEED)
    + """SELECT type, CASE WHEN type = 'fall_warn' THEN 'high' ELSE 'normal' END AS priority, count(*) AS events
FROM accepted GROUP BY 1, 2""",
    "v7_payload": """SELECT event_id AS seq, event_type AS type,
       '{"note":null,"payload":{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}}' AS payload
FROM events""",
    "v8_rejects_by_reason": _with(_FEED)
    + """SELECT reason, count(*) AS events, reason LIKE 'clock_skew%' AS is_skew
FROM wire WHERE reason IS NOT NULL GROUP BY reason""",
    "v9_type_routing": _with(_FEED)
    + """SELECT type, count(*) AS events,
       CASE WHEN type IN ('heartbeat', 'presence', 'fall_warn') THEN type ELSE 'generic' END AS handler
FROM accepted GROUP BY type""",
    "v10_payload_typed": """SELECT event_id, event_id % 13 IN (0, 4, 7, 9, 11) AS in_room,
       CASE event_id % 11 WHEN 0 THEN CAST(0.5 AS DOUBLE) WHEN 1 THEN 0.25 WHEN 2 THEN 10.5 WHEN 4 THEN 1 WHEN 8 THEN 0.01
                          WHEN 9 THEN 3 WHEN 10 THEN 0 END AS confidence
FROM events""",
    "v12_replay_tolerant": _with(_FEED)
    + "SELECT type, seq % 7 NOT IN (1, 2, 3, 4) AS readable, count(*) AS rows FROM accepted GROUP BY 1, 2",
    "o1_device_order": _with(_FEED)
    + """SELECT row_number() OVER (PARTITION BY device_id ORDER BY ts, received_at, seq) AS position,
       device_id, ts, received_at, seq, type
FROM accepted""",
    "o2_room_alarm_order": _with(_FEED, _FALLS)
    + """SELECT room_id, row_number() OVER (PARTITION BY room_id ORDER BY ts, received_at, dedup_key) AS position, ts, dedup_key
FROM alarms""",
    "o3_priority_order": _with(_FEED)
    + """SELECT row_number() OVER (PARTITION BY type = 'fall_warn' ORDER BY received_at, seq) AS position,
       CASE WHEN type = 'fall_warn' THEN 'high' ELSE 'normal' END AS priority, received_at, seq, device_id, type
FROM accepted""",
    "a1_last_heartbeat": _with(_FEED, _VISIBLE)
    + "SELECT device_id, max(ts) AS last_heartbeat_ts FROM beats GROUP BY device_id",
    "a2_recent_beats": _with(_FEED, _VISIBLE)
    + f"SELECT DISTINCT device_id, ts FROM beats WHERE t >= epoch_us({_AS_OF}) - {_WEEK_US}",
    "a3_availability": _with(_FEED, _VISIBLE)
    + f"""SELECT device_id, count(DISTINCT w) AS beats, round(least(count(DISTINCT w) / 14.0, 1.0), 6) AS availability
FROM (SELECT device_id, CASE WHEN t BETWEEN epoch_us({_AS_OF}) - {_WEEK_US} AND epoch_us({_AS_OF}) THEN t END AS w FROM beats)
GROUP BY device_id""",
    "a4_device_health": _with(_FEED, _VISIBLE)
    + f"""SELECT device_id, max(ts) AS last_heartbeat_ts,
       round(least(count(DISTINCT CASE WHEN t BETWEEN epoch_us({_AS_OF}) - {_WEEK_US} AND epoch_us({_AS_OF}) THEN t END) / 14.0, 1.0), 6) AS availability
FROM beats GROUP BY device_id""",
    "a5_room_presence": _with(_FEED, _VISIBLE, _CURRENT) + "SELECT room_id, in_room, ts FROM current_presence",
    "a6_transitions": _with(_FEED, _VISIBLE) + "SELECT DISTINCT room_id, ts, in_room FROM presence",
    "a7_retained_transitions": _with(_FEED, _VISIBLE, _RETAINED) + "SELECT room_id, ts, in_room FROM retained",
    "a8_initial_state": _with(_FEED, _VISIBLE)
    + f"""SELECT r.room_id, coalesce(s.in_room, false) AS initial_in_room
FROM (SELECT DISTINCT room_id FROM presence) r
LEFT JOIN (SELECT room_id, in_room, row_number() OVER (PARTITION BY room_id ORDER BY t DESC, in_room DESC) AS n
           FROM presence WHERE t <= epoch_us({_AS_OF}) - {_WEEK_US}) s
  ON s.room_id = r.room_id AND s.n = 1""",
    "a8_as_of_join": _with(_FEED, _VISIBLE)
    + """SELECT q.room_id, q.moment, coalesce(p.in_room, false) AS in_room, p.ts AS since
FROM (SELECT DISTINCT room_id, ts AS moment FROM visible WHERE type IN ('motion', 'fall_warn')) q
ASOF LEFT JOIN (SELECT room_id, ts, bool_or(in_room) AS in_room FROM presence GROUP BY room_id, ts) p
  ON p.room_id = q.room_id AND q.moment >= p.ts""",
    "a9_occupied_seconds": _with(_FEED, _VISIBLE, _occupied("presence", _WEEK))
    + """SELECT r.room_id, round(coalesce(us, 0) / 1000000.0, 6) AS occupied_seconds
FROM (SELECT DISTINCT room_id FROM presence) r LEFT JOIN occupied o ON o.room_id = r.room_id""",
    "a10_room_occupancy": _with(_FEED, _VISIBLE, _CURRENT, _occupied("presence", _WEEK))
    + """SELECT r.room_id, coalesce(c.in_room, false) AS in_room,
       round(least(coalesce(o.us, 0) / (604800 * 1000000.0), 1.0), 6) AS occupied_pct, CAST(604800 AS BIGINT) AS window_seconds
FROM (SELECT DISTINCT room_id FROM visible) r
LEFT JOIN current_presence c ON c.room_id = r.room_id
LEFT JOIN occupied o ON o.room_id = r.room_id""",
    "a10_room_occupancy_retained": _with(_FEED, _VISIBLE, _CURRENT, _RETAINED, _occupied("retained", _WEEK))
    + """SELECT c.room_id, c.in_room,
       round(least(coalesce(o.us, 0) / (604800 * 1000000.0), 1.0), 6) AS occupied_pct, CAST(604800 AS BIGINT) AS window_seconds
FROM current_presence c LEFT JOIN occupied o ON o.room_id = c.room_id""",
    "a11_multi_window": _with(_FEED, _VISIBLE, _CURRENT, _occupied("presence", _ALL_WINDOWS))
    + """SELECT r.room_id, q.win AS "window", CAST(q.secs AS BIGINT) AS window_seconds,
       CASE WHEN q.secs IS NOT NULL THEN coalesce(c.in_room, false) END AS in_room,
       CASE WHEN q.secs IS NOT NULL THEN round(least(coalesce(o.us, 0) / (q.secs * 1000000.0), 1.0), 6) END AS occupied_pct,
       CASE WHEN q.secs IS NOT NULL THEN 'ok' ELSE 'invalid_window' END AS status
FROM (SELECT DISTINCT room_id FROM visible) r
CROSS JOIN (VALUES ('1440m', 86400), ('168h', 604800), ('2419200', 2419200), ('0', NULL), ('-5m', NULL), ('soon', NULL), ('1d', NULL)) q(win, secs)
LEFT JOIN current_presence c ON c.room_id = r.room_id
LEFT JOIN occupied o ON o.room_id = r.room_id AND o.win = q.win""",
    "f1_dedup_key": _with(_FEED, _FALLS) + "SELECT seq, dedup_key FROM falls",
    "f2_fall_dedup": _with(_FEED, _FALLS)
    + "SELECT device_id, room_id, ts, round(confidence, 6) AS confidence, received_at, dedup_key FROM alarms",
    "f3_fall_outcomes": _with(_FEED, _FALLS, _FALL_WALK, recursive=True)
    + "SELECT dedup_key, received_at, outcome, count(*) AS copies FROM walk GROUP BY ALL",
    "f5_alarms_since": _with(_FEED, _FALLS)
    + f"""SELECT row_number() OVER (ORDER BY ts, received_at, dedup_key) AS position,
       device_id, room_id, ts, round(confidence, 6) AS confidence, received_at
FROM alarms WHERE ts >= {_SNAPSHOT}""",
    "f5_alarms_since_room": _with(_FEED, _FALLS)
    + f"""SELECT row_number() OVER (ORDER BY ts, received_at, dedup_key) AS position,
       device_id, room_id, ts, round(confidence, 6) AS confidence, received_at
FROM alarms WHERE ts >= {_SNAPSHOT} AND room_id = 'room_003'""",
    "f6_alarm_feed": _with(_FEED, _FALLS)
    + f"""SELECT device_id, room_id, ts, received_at, dedup_key,
       CASE WHEN received_at >= {_SNAPSHOT} THEN 'live' ELSE 'history' END AS phase
FROM alarms WHERE room_id = 'room_003' AND (received_at >= {_SNAPSHOT} OR ts >= TIMESTAMP '2024-01-10 00:00:00')""",
    "f6_stream_feed": _with(_FEED, _FALLS)
    + f"""SELECT device_id, room_id, ts, received_at, dedup_key,
       CASE WHEN received_at >= {_SNAPSHOT} THEN 'live' ELSE 'history' END AS phase
FROM alarms WHERE room_id = 'room_003' AND (received_at >= {_SNAPSHOT} OR ts >= TIMESTAMP '2024-01-10 00:00:00')""",
    "f7_reconcile": _with(_FEED, _FALLS)
    + f"""SELECT fall_date, room_id, alarms, expected, alarms - expected AS delta,
       CASE WHEN alarms > expected THEN 'leak' WHEN alarms < expected THEN 'miss' ELSE 'match' END AS verdict
FROM (SELECT CAST(ts AS DATE) AS fall_date, room_id, count(*) AS expected,
             CAST(sum(CASE WHEN room_id = 'room_003' THEN 2 WHEN room_id = 'room_004' AND received_at >= {_SNAPSHOT} THEN 0 ELSE 1 END) AS BIGINT) AS alarms
      FROM alarms GROUP BY 1, 2)""",
    "m1_ingest_counters": _with(_FEED)
    + """SELECT 'events_ingested_total' AS counter, count(*) AS value FROM wire
UNION ALL SELECT 'events_late', count(*) FROM wire WHERE reason IS NULL AND late
UNION ALL SELECT 'events_rejected_invalid_json', count(*) FROM wire WHERE reason = 'invalid_json'
UNION ALL SELECT 'events_rejected_invalid_schema', count(*) FROM wire WHERE reason IN ('invalid_schema', 'invalid_timestamp')
UNION ALL SELECT 'events_rejected_clock_skew', count(*) FROM wire WHERE reason LIKE 'clock_skew%'
UNION ALL SELECT 'events_rejected_clock_skew_future', count(*) FROM wire WHERE reason = 'clock_skew_future'
UNION ALL SELECT 'events_rejected_clock_skew_past', count(*) FROM wire WHERE reason = 'clock_skew_past'""",
    "m2_fall_counters": _with(_FEED, _FALLS)
    + """SELECT 'fall_warnings_total' AS counter, count(*) AS value FROM ranked WHERE rn = 1
UNION ALL SELECT 'fall_warnings_deduped', count(*) FROM ranked WHERE rn > 1
UNION ALL SELECT 'fall_warnings_db_conflicts', CAST(0 AS BIGINT)""",
    "m3_alarm_latency": _with(_FEED, _FALLS)
    + """SELECT dedup_key, round(greatest(0, (epoch_us(ts) % 1009 - 20) * 1000 + epoch_us(ts) % 997) / 1000.0, 3) AS latency_ms
FROM alarms""",
    "m4_alarm_p95": _with(
        _FEED,
        _FALLS,
        """
timed AS (SELECT *, (epoch_us(ts) % 1009 - 20) * 1000 + epoch_us(ts) % 997 AS delay FROM alarms),
recent AS (SELECT greatest(0, delay) / 1000.0 AS ms FROM timed
           ORDER BY epoch_us(received_at) + delay DESC, received_at DESC, dedup_key DESC LIMIT 5000),
placed AS (SELECT ms, row_number() OVER (ORDER BY ms) AS n, count(*) OVER () AS total FROM recent)
""",
    )
    + """SELECT coalesce(CAST(max(CASE WHEN n = CAST(ceil(0.95 * total) AS BIGINT) THEN round_even(ms, 0) END) AS BIGINT), 0) AS alarm_feed_latency_ms_p95,
       count(*) AS samples
FROM placed""",
    "r1_state_as_of": _STATE_SQL,
    "r2_restore_equals_full": _STATE_SQL,
    "r2_stream_restore": _STATE_SQL,
    "s6_snapshot_versions": _with(
        _FEED, _VISIBLE.replace("WHERE received_at <=", f"WHERE received_at < {_SNAPSHOT} AND received_at <="), _CURRENT, _RETAINED, _STATE
    )
    + "SELECT state_table, entity_id, ts, in_room FROM state",
    "r3_fall_replay": _with(_FEED, _FALLS, _EARLY_ALARMS)
    + """SELECT dedup_key, 'inserted' AS outcome, CAST(1 AS BIGINT) AS events FROM alarms WHERE dedup_key NOT IN (SELECT dedup_key FROM early)
UNION ALL
SELECT dedup_key, 'db_conflict', count(*) FROM falls WHERE dedup_key IN (SELECT dedup_key FROM early) GROUP BY dedup_key""",
    "t1_stream_validate": _with(_FEED)
    + """SELECT CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS outcome, reason,
       CASE WHEN spoiled IN (0, 1, 2, 9) THEN NULL ELSE type END AS type,
       CASE WHEN reason IS NULL THEN late END AS late, count(*) AS events
FROM wire GROUP BY 1, 2, 3, 4""",
    "t3_stream_fall_dedup": _with(_FEED, _FALLS)
    + """SELECT dedup_key, device_id, room_id, ts, round(confidence, 6) AS confidence, received_at
FROM alarms WHERE dedup_key IN (SELECT dedup_key FROM falls WHERE event_id % 13 <> 0)""",
    "t4_stream_presence": _with(_FEED, _WIRED_VISIBLE, _CURRENT) + "SELECT room_id, in_room, ts FROM current_presence",
    "t5_stream_state": _with(_FEED, _WIRED_VISIBLE, _CURRENT, _RETAINED, _STATE)
    + "SELECT state_table, entity_id, ts, in_room FROM state",
    # The stream reads the wire records, so spoiled events raise no alarm. Copies of an event are spoiled together.
    "t7_stream_alarms": _with(_FEED, _FALLS)
    + """SELECT row_number() OVER (PARTITION BY room_id ORDER BY ts, received_at, dedup_key) AS position,
       device_id, room_id, ts, round(confidence, 6) AS confidence, received_at, dedup_key
FROM alarms WHERE dedup_key IN (SELECT dedup_key FROM falls WHERE event_id % 13 <> 0)""",
    "f3_stream_outcomes": _with(_FEED, _FALLS.replace("FROM accepted", "FROM wired"), _FALL_WALK, recursive=True)
    + "SELECT dedup_key, received_at, outcome, count(*) AS copies FROM walk GROUP BY ALL",
    "a3_stream_availability": _with(_FEED, _WIRED_VISIBLE)
    + f"""SELECT device_id, max(ts) AS last_heartbeat_ts, count(DISTINCT w) AS beats, round(least(count(DISTINCT w) / 14.0, 1.0), 6) AS availability
FROM (SELECT device_id, ts, CASE WHEN t BETWEEN epoch_us({_LOG_END}) - {_WEEK_US} AND epoch_us({_LOG_END}) THEN t END AS w FROM beats)
GROUP BY device_id""",
    # A key is over when the newest event of the log is later than the end of its second by two hours.
    "f7_stream_reconcile": _with(_FEED, _FALLS.replace("FROM accepted", "FROM wired"))
    + f"""SELECT *, CASE WHEN alarms > expected THEN 'leak' WHEN alarms < expected THEN 'miss' ELSE 'match' END AS verdict
FROM (SELECT dedup_key, room_id, date_trunc('second', ts) AS fall_second, CAST(1 AS BIGINT) AS expected,
             CAST(CASE WHEN room_id = 'room_003' THEN 2 WHEN room_id = 'room_004' AND received_at >= {_SNAPSHOT} THEN 0 ELSE 1 END AS BIGINT) AS alarms
      FROM alarms
      UNION ALL
      SELECT dedup_key || ':stray', room_id, date_trunc('second', ts), CAST(0 AS BIGINT), CAST(1 AS BIGINT)
      FROM alarms WHERE room_id = 'room_005')
WHERE fall_second + INTERVAL '1' SECOND <= (SELECT max(ts) FROM wired) - INTERVAL '2' HOUR""",
    "o1_reordered_stream": _with(_FEED, _windows("wired", "device_id"), recursive=True)
    + """SELECT device_id, row_number() OVER (PARTITION BY device_id ORDER BY open, ts, received_at, seq) AS position, ts, received_at, seq,
       make_timestamp(open + 7200000000) AS released_at
FROM placed""",
    "t7_reordered_stream": _with(_FEED, _FALLS.replace("FROM accepted", "FROM wired"), _windows("alarms", "room_id"), recursive=True)
    + """SELECT room_id, row_number() OVER (PARTITION BY room_id ORDER BY open, ts, received_at, dedup_key) AS position, ts, received_at, dedup_key,
       make_timestamp(open + 7200000000) AS released_at
FROM placed""",
}

# The table holds all alarms received in the slices of the stream, which is all of them.
# This query keeps its own window.
ORACLES["m4_stream_p95"] = ORACLES["m4_alarm_p95"].replace("LIMIT 5000", "LIMIT 1000")
