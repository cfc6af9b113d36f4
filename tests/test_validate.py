import json

import pytest
from conftest import NOW, at
from pyspark.sql import functions as F

from wardwatch.functions import json_fields as J
from wardwatch.operators import validate
from wardwatch.schema import ARRIVAL_COLUMNS, EVENT_COLUMNS

GOOD = {"device_id": "d1", "room_id": "r1", "type": "motion", "ts": "2026-06-29T12:00:00Z"}


def wire(**changes):
    record = {**GOOD, **changes}
    return json.dumps({key: value for key, value in record.items() if value is not ...})


def run(spark, texts, received_at=NOW):
    frame = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "i INT, raw STRING")
    stamped = frame.select("raw", F.lit(str(received_at)).cast("timestamp").alias("received_at"))
    rows = validate.validate_raw(stamped.coalesce(1)).withColumn("ts", F.col("ts").cast("timestamp_ntz")).collect()
    return [row.asDict() for row in rows]


def reasons(spark, texts, **options):
    return [row["reason"] for row in run(spark, texts, **options)]


CASES = [
    (wire(), None),
    (wire(seq=7), None),
    (wire(seq=None), None),
    ("not json", "invalid_json"),
    ("", "invalid_json"),
    ("[1]", "invalid_json"),
    ('"text"', "invalid_json"),
    ("null", "invalid_json"),
    (wire() + " extra", "invalid_json"),
    (wire() + wire(), "invalid_json"),
    (wire() + "," + wire(), "invalid_json"),
    (wire() + "] [", "invalid_json"),
    (wire() + ",1] 2", "invalid_json"),
    ("{'device_id': 'd1'}", "invalid_json"),
    ("  " + wire() + "\t", None),
    ("﻿" + wire(), None),
    (wire(extra=float("nan")), None),
    ('{"device_id":"x",' + wire()[1:], None),
    (wire(device_id=...), "invalid_schema"),
    (wire(room_id=...), "invalid_schema"),
    (wire(type=...), "invalid_schema"),
    (wire(ts=...), "invalid_schema"),
    (wire(device_id=""), "invalid_schema"),
    (wire(device_id=5), "invalid_schema"),
    (wire(device_id="5"), None),
    (wire(device_id="true"), None),
    (wire(device_id="{"), None),
    (wire(room_id=True), "invalid_schema"),
    (wire(room_id={"a": 1}), "invalid_schema"),
    (wire(type=["x"]), "invalid_schema"),
    (wire(type=None), "invalid_schema"),
    (wire(type="anything"), None),
    (wire(ts=1719662400), "invalid_schema"),
    (wire(ts="not-a-timestamp"), "invalid_timestamp"),
    (wire(ts="2026"), "invalid_timestamp"),
    (wire(seq="42"), "invalid_schema"),
    (wire(seq=True), "invalid_schema"),
    (wire(seq=1.0), "invalid_schema"),
    (wire(seq=1e5), "invalid_schema"),
    (wire(seq=2**70), None),
    (wire(seq=2**150), None),
    (wire(ts="2026-06-29T13:00:00Z"), None),
    (wire(ts="2026-06-29T11:00:00Z"), None),
    (wire(ts="2026-06-29T13:00:01Z"), "clock_skew_future"),
    (wire(ts="2026-06-29T10:59:59Z"), "clock_skew_past"),
    (wire(ts="2026-06-29T13:00:00.000001Z"), "clock_skew_future"),
    (wire(seq="42", ts="2026-06-29T15:00:00Z"), "invalid_schema"),
]


def test_reasons(spark):
    found = reasons(spark, [text for text, _ in CASES])
    assert [(text, reason) for (text, _), reason in zip(CASES, found)] == CASES


def test_text_that_is_not_utf8_is_invalid_json(spark):
    frame = spark.sql("SELECT cast(X'7B2261223AFF7D' AS STRING) AS raw, timestamp '2026-06-29 12:00:00' AS received_at")
    assert validate.validate_raw(frame).first()["reason"] == "invalid_json"


def test_accepted_row(spark):
    (row,) = run(spark, [wire(type="fall_warn", confidence=0.92, seq=3, ts="2026-06-29T14:00:00.5+02:00")])
    assert list(row) == list(ARRIVAL_COLUMNS)
    assert row["ts"] == at(0.5)
    assert (row["payload"], row["confidence"], row["seq"], row["priority"], row["late"]) == ('{"confidence":0.92}', 0.92, 3, "high", False)
    assert (row["raw"], row["reason"], row["outcome"]) == (None, None, "accepted")


def test_rejected_row_keeps_the_text(spark):
    text = wire(ts="2026-06-29T14:00:01Z")
    (row,) = run(spark, [text])
    assert (row["raw"], row["offset_seconds"], row["outcome"], row["payload"]) == (text, 7201.0, "rejected", None)


def test_late_flag(spark):
    times = ["2026-06-29T11:59:15Z", "2026-06-29T11:59:30Z", "2026-06-29T11:59:29.999999Z"]
    assert [row["late"] for row in run(spark, [wire(ts=t) for t in times])] == [True, False, True]


@pytest.mark.parametrize(
    ("more", "good"),
    [
        ('"seq":1.0,"x":{"seq":12345678901234567890}', False),
        ('"seq":12345678901234567890,"x":1.5', True),
        ('"x":{"seq":1.0},"seq":-12345678901234567890', True),
        ('"seq":1e30', False),
        ('"seq":1.5,"seq":7', True),
        ('"seq":7,"seq":"7"', False),
    ],
)
def test_seq_is_judged_by_its_own_spelling(spark, more, good):
    (row,) = run(spark, ['{"device_id":"d","room_id":"r","type":"motion","ts":"%s",%s}' % (at(0).isoformat(), more)])
    assert row["reason"] == (None if good else "invalid_schema")


def test_payload_keeps_the_spelling_of_values(spark):
    more = '"a":7,"b":%s,"c":NaN,"d":"1.0","e":{"f":[1.5,"x"]},"g":"q\\"uo\\nte","h":null,"a":1.0' % ("7" * 50)
    (row,) = run(spark, ['{"device_id":"d","room_id":"r","type":"motion","ts":"%s",%s}' % (at(0).isoformat(), more)])
    assert row["payload"] == '{"a":1.0,"b":%s,"c":NaN,"d":"1.0","e":{"f":[1.5,"x"]},"g":"q\\"uo\\nte","h":null}' % ("7" * 50)


def test_payload_keeps_types_nesting_and_its_own_payload_key(spark):
    extra = {"state": "awake", "rssi": -60, "note": None, "ok": True, "payload": {"a": [1, None, {"b": "c"}]}}
    (row,) = run(spark, [wire(**extra)])
    assert json.loads(row["payload"]) == extra
    assert run(spark, [wire()])[0]["payload"] == "{}"


TRUTH = [("true", True), ("false", False), ("null", False), ("0", False), ("2", True), ("0.0", False), ("0.5", True),
         ('""', False), ('"false"', True), ("[]", False), ("[null]", True), ("{}", False), ('{"a":0}', True), ("-0", False)]


def test_truth_values(spark):
    texts = [f'{{"in_room":{value}}}' for value, _ in TRUTH] + ["{}"]
    frame = J.with_document(spark.createDataFrame([(t,) for t in texts], "raw STRING").coalesce(1), F.col("raw"))
    found = [row[0] for row in frame.select(J.truthy(F.col("document"), "in_room")).collect()]
    assert found == [truth for _, truth in TRUTH] + [False]


NUMBERS = ["0.5", "1", "true", "false", "null", '"0.25"', '" 7 "', '"1_000.5"', '"1__0"', '"0.9d"', '"1e-2"', '"x"', '""',
           '".5"', '"5."', '"nan"', '"-3"', "[1]", "{}", "12345678901234567890", "1e300"]


def number_of(text):
    try:
        value = float(json.loads(text))
    except (TypeError, ValueError):
        return None
    return value if value == value and abs(value) != float("inf") else None


def test_numbers(spark):
    texts = [f'{{"confidence":{value}}}' for value in NUMBERS]
    frame = J.with_document(spark.createDataFrame([(t,) for t in texts], "raw STRING").coalesce(1), F.col("raw"))
    found = [row[0] for row in frame.select(J.float_or_default(F.col("document"), "confidence", 0.0)).collect()]
    assert found == [number_of(value) for value in NUMBERS]
    missing = J.with_document(spark.createDataFrame([("{}",)], "raw STRING"), F.col("raw"))
    assert missing.select(J.float_or_default(F.col("document"), "confidence", 0.0)).first()[0] == 0.0


def test_split_and_reason_counts(spark):
    frame = spark.createDataFrame([(wire(),), ("x",), (wire(ts="2026-06-29T15:00:00Z"),)], "raw STRING")
    arrivals = validate.validate_raw(frame.withColumn("received_at", F.lit(str(NOW)).cast("timestamp")))
    assert validate.accepted_events(arrivals).columns == list(EVENT_COLUMNS)
    assert validate.accepted_events(arrivals).count() == 1
    rejects = validate.rejected_arrivals(arrivals)
    assert {row.reason: (row.device_id, row.offset_seconds) for row in rejects.collect()} == {
        "invalid_json": (None, None),
        "clock_skew_future": ("d1", 10800.0),
    }
    counts = {row.reason: (row.events, row.is_skew) for row in validate.rejects_by_reason(arrivals).collect()}
    assert counts == {"invalid_json": (1, False), "clock_skew_future": (1, True)}


def test_each_text_is_parsed_once_under_a_filter(spark):
    frame = spark.createDataFrame([(wire(),)], "raw STRING").withColumn("received_at", F.lit(str(NOW)).cast("timestamp"))
    plan = validate.accepted_events(validate.validate_raw(frame))._jdf.queryExecution().optimizedPlan().toString()
    # Once into the document, and once into spelled fields where a number needs it.
    assert plan.count("from_json(") == 2


def test_bad_log_rows_are_skipped(spark):
    rows = [
        ("d", "r", "presence", "2026-06-29T12:00:00+00:00", '{"in_room": true}', "2026-06-29T12:00:01+00:00", 0),
        ("d", "r", "presence", "bad", "{}", "2026-06-29T12:00:01+00:00", 0),
        ("d", "r", "presence", "2026-06-29T12:00:00+00:00", "{bad", "2026-06-29T12:00:01+00:00", 0),
        ("d", "r", "presence", "2026-06-29T12:00:00+00:00", "[1]", "2026-06-29T12:00:01+00:00", 0),
        ("d", "r", "presence", "2026-06-29T12:00:00+00:00", "{}", "bad", 1),
    ]
    ddl = "device_id STRING, room_id STRING, type STRING, ts STRING, payload STRING, received_at STRING, late INT"
    log = spark.createDataFrame(rows, ddl)
    assert [row.in_room for row in validate.replayable(log).collect()] == [True]
    assert validate.read_text_log(log).where("NOT readable").count() == 4


@pytest.mark.parametrize("kind,handler", [("heartbeat", "heartbeat"), ("motion", "generic"), ("toaster", "generic")])
def test_routing(spark, kind, handler):
    frame = spark.createDataFrame([(kind,)], "type STRING")
    assert validate.routing_counts(frame).first()["handler"] == handler
    routed = validate.route_by_type(frame, {"heartbeat": lambda rows: rows})
    assert routed["heartbeat"].count() == (kind == "heartbeat")
