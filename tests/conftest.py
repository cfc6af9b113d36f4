import os
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools"), os.path.dirname(os.path.abspath(__file__))]

from wardwatch import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


NOW = datetime(2026, 6, 29, 12, 0, 0)


def at(seconds: float = 0, minutes: float = 0) -> datetime:
    return NOW + timedelta(seconds=seconds, minutes=minutes)


EVENT_DDL = (
    "device_id STRING, room_id STRING, type STRING, ts TIMESTAMP_NTZ, received_at TIMESTAMP_NTZ, seq BIGINT, "
    "payload STRING, late BOOLEAN, priority STRING, in_room BOOLEAN, confidence DOUBLE"
)


def event(kind, ts, received_at=None, device="d1", room="r1", seq=None, in_room=None, confidence=None):
    received_at = ts + timedelta(seconds=1) if received_at is None else received_at
    late = (received_at - ts).total_seconds() > 30
    return (device, room, kind, ts, received_at, seq, "{}", late, "high" if kind == "fall_warn" else "normal", in_room, confidence)


def events(spark, rows):
    """Event rows with zone-free UTC times as the engine's event table."""
    frame = spark.createDataFrame(rows, EVENT_DDL)
    return frame.withColumns({name: frame[name].cast("timestamp") for name in ("ts", "received_at")})


def plain(frame):
    """Collected rows with timestamps as zone-free datetimes."""
    for field in frame.schema.fields:
        if field.dataType.typeName() == "timestamp":
            frame = frame.withColumn(field.name, frame[field.name].cast("timestamp_ntz"))
    return [row.asDict() for row in frame.collect()]
