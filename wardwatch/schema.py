"""Declared schemas and the fixed settings of the event model."""

from __future__ import annotations

# Fixed values of the event model.
LATE_AFTER_SECONDS = 30
MAX_SKEW_SECONDS = 3600
BEAT_WINDOW_SECONDS = 300
BEAT_INTERVAL_SECONDS = 1.0
RETAIN_SECONDS = 3600
ANCHOR_SLACK_MICROS = 1000
DEDUP_TTL_SECONDS = 10
LATENCY_SAMPLES = 5000
WATERMARK = "2 hours"
ENVELOPE_KEYS = ("device_id", "room_id", "type", "ts", "seq")

MICROS = 1_000_000

# in_room and confidence are the two payload fields that derived state reads. They are promoted to
# typed columns when an event is validated, so reads of the log never parse JSON again.
EVENT_DDL = (
    "device_id STRING, room_id STRING, type STRING, ts TIMESTAMP, received_at TIMESTAMP, seq BIGINT, "
    "payload STRING, late BOOLEAN, priority STRING, in_room BOOLEAN, confidence DOUBLE"
)
EVENT_COLUMNS = tuple(part.split()[0] for part in EVENT_DDL.split(", "))

# Every arrival, accepted or not. outcome and event_date are partition columns of the stored table.
ARRIVAL_DDL = EVENT_DDL + (
    ", raw STRING, reason STRING, offset_seconds DOUBLE, outcome STRING, event_date DATE"
)
ARRIVAL_COLUMNS = tuple(part.split()[0] for part in ARRIVAL_DDL.split(", "))

REJECT_COLUMNS = ("raw", "device_id", "type", "reason", "offset_seconds", "received_at")

ALARM_DDL = (
    "device_id STRING, room_id STRING, ts TIMESTAMP, confidence DOUBLE, received_at TIMESTAMP, dedup_key STRING"
)
ALARM_COLUMNS = tuple(part.split()[0] for part in ALARM_DDL.split(", "))
