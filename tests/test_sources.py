import glob
import json

from conftest import NOW, at, event, events, plain
from pyspark.sql import functions as F

from wardwatch.operators import falls, validate
from wardwatch.operators.validate import validate_raw
from wardwatch.session import new_table_path
from wardwatch.sources import alarm_table, event_log, raw_json


def record(seconds, **extra):
    return json.dumps({"device_id": "d1", "room_id": "r1", "type": "motion", "ts": at(seconds).isoformat(), **extra})


def test_text_files_to_log_and_back(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join([record(0, seq=1), record(0, seq=1), "broken", record(-7200)]) + "\n")
    arrivals = validate_raw(raw_json.read_raw(spark, str(tmp_path / "a.jsonl"), NOW))
    path = new_table_path(spark, "log")
    event_log.append_arrivals(arrivals, path)
    event_log.append_arrivals(arrivals.where("seq = 1").limit(1), path)
    assert [row["seq"] for row in plain(event_log.read_log(spark, path))] == [1, 1, 1]
    assert sorted(row["reason"] for row in plain(event_log.read_rejects(spark, path))) == ["clock_skew_past", "invalid_json"]


def test_log_since_is_by_receipt_inclusive_and_ordered_by_time(spark):
    rows = [event("motion", at(minutes=m), at(minutes=m), seq=-m) for m in (-3, -2, -1)]
    rows.append(event("motion", at(minutes=-20), at(minutes=-1), seq=20))
    log = events(spark, rows).withColumn("event_date", F.to_date("received_at"))
    assert [row["seq"] for row in plain(event_log.log_since(log, at(minutes=-2)))] == [20, 2, 1]


def test_log_scan_prunes_dates_and_columns(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    path = new_table_path(spark, "log")
    frame = events(spark, [event("presence", at(0), in_room=True)])
    extra = {"raw": F.lit(None).cast("string"), "reason": F.lit(None).cast("string"), "offset_seconds": F.lit(None).cast("double"),
             "outcome": F.lit("accepted"), "event_date": F.to_date("received_at")}
    event_log.append_arrivals(frame.withColumns(extra), path)
    scan = event_log.log_since(event_log.read_log(spark, path), NOW).where("type = 'presence'").select("room_id", "ts")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    partition_filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "event_date" in partition_filters and "outcome" in partition_filters
    assert "EqualTo(type,presence)" in plan and "payload" not in plan.split("ReadSchema: ")[1]


def alarms_of(spark, *pairs):
    return falls.alarms_from_falls(
        events(spark, [event("fall_warn", ts, received_at, confidence=0.5) for ts, received_at in pairs])
    )


def test_alarm_sink_ignores_stored_keys_and_repeats(spark):
    path = new_table_path(spark, "alarms")
    assert plain(alarm_table.read_alarms(spark, path)) == []
    first = alarms_of(spark, (at(0), at(1)), (at(5), at(6)))
    second = alarms_of(spark, (at(5), at(30)), (at(9), at(31)))
    alarm_table.store_alarms(first, path, "q-0")
    alarm_table.store_alarms(first, path, "q-0")
    alarm_table.store_alarms(second, path, "q-1")
    alarm_table.store_alarms(second, path, "q-1")
    alarm_table.store_alarms(first, path, "other-0")
    stored = plain(alarm_table.read_alarms(spark, path))
    assert sorted((row["ts"], row["received_at"]) for row in stored) == [(at(0), at(1)), (at(5), at(6)), (at(9), at(31))]


def test_alarm_sink_accepts_an_empty_batch(spark):
    path = new_table_path(spark, "alarms")
    alarm_table.store_alarms(alarms_of(spark), path, "q-0")
    assert glob.glob(f"{path}/*") == []


def test_small_inputs_are_spread_and_large_ones_left_alone(spark):
    one = spark.range(10).coalesce(1)
    assert raw_json.spread_for_parsing(one).rdd.getNumPartitions() == 4
    many = spark.range(0, 100, 1, 9)
    assert raw_json.spread_for_parsing(many) is many


def test_text_log_migration(spark):
    ddl = "device_id STRING, room_id STRING, type STRING, ts STRING, payload STRING, received_at STRING, late INT"
    row = ("d", "r", "fall_warn", "2026-06-29T12:00:00.5+00:00", '{"confidence": "0.7"}', "2026-06-29T12:00:01+00:00", 0)
    (found,) = plain(validate.replayable(spark.createDataFrame([row], ddl)))
    assert (found["ts"], found["confidence"], found["priority"]) == (at(0.5), 0.7, "high")
