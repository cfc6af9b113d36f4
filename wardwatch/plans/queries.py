"""Queries over the ``events`` table, one per operator, for the driver's checks.

Every query reads the whole table through the adapter in ``sources.device_feed``. Timestamps leave as zone-free
UTC and ratios are rounded to six digits, so that another SQL engine can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import TimestampType

from wardwatch.functions import json_fields as J
from wardwatch.functions.timeline import iso_text, parse_iso_utc
from wardwatch.operators import falls, health, metrics, occupancy, ordering, recovery, validate
from wardwatch.session import configure, new_table_path
from wardwatch.sources import alarm_table, event_log, snapshots
from wardwatch.sources.device_feed import (
    adapt,
    feed_arrivals,
    feed_events,
    feed_json,
    source_events,
    stream_source_events,
    wire_json,
)
from wardwatch.sources.raw_json import read_raw
from wardwatch.streaming import alarms as alarm_stream
from wardwatch.streaming import availability as availability_stream
from wardwatch.streaming import ingest, latency as latency_stream, ordered as ordered_stream, reconcile as reconcile_stream, state as state_stream

AS_OF = "2024-01-30 00:00:00"
SNAPSHOT_TS = "2024-01-20 00:00:00"
DAY = 86_400
WEEK = 7 * DAY
#: After the last receipt of the log.
LOG_END = "2024-02-01 00:00:00"
BEAT_INTERVAL = 43_200.0
RETENTION = 2 * DAY
WINDOWS = ("1440m", "168h", "2419200", "0", "-5m", "soon", "1d")
PARSE_TASKS = 8
STATE_BUCKETS = 4
HOLD_SECONDS = 2 * 3600
SLICES = ("2024-01-01", "2024-01-11 12:00:00", "2024-01-20", "2024-03-01")
ALARMS_SINCE = 1705708800.0  # 2024-01-20 00:00:00 UTC

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register a query: session settings before it, comparable output types after it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _comparable(function(configure(spark), sf_dir))

    QUERIES[function.__name__] = run
    return run


def _comparable(result: DataFrame) -> DataFrame:
    stamps = {f.name for f in result.schema.fields if isinstance(f.dataType, TimestampType)}
    if not stamps:
        return result
    return result.select(
        *[F.col(name).cast("timestamp_ntz").alias(name) if name in stamps else F.col(name) for name in result.columns]
    )


def _six(name: str) -> Column:
    return F.round(name, 6).alias(name)


def _alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return falls.alarms_from_falls(feed_events(spark, sf_dir))


def _alarms_before(spark: SparkSession, sf_dir: str, moment: str) -> DataFrame:
    return falls.alarms_from_falls(feed_events(spark, sf_dir).where(F.col("received_at") < moment))


def _stored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "event-log")
    event_log.append_arrivals(feed_arrivals(spark, sf_dir), path)
    return event_log.read_log(spark, path)


def _as_given(rows: DataFrame) -> DataFrame:
    """``position`` of each row in the order the rows come in: their number in the partition after all of the partitions before."""
    path = new_table_path(rows.sparkSession, "as-given")
    rows.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    stored = rows.sparkSession.read.parquet(path).withColumn("_part", F.shiftright("_id", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    counts = stored.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.join(counts, "_part").withColumn("position", F.col("before") + inside + 1).drop("_id", "_part", "before")


# Sources and sinks


@query
def s1_json_source(spark, sf_dir):
    path = new_table_path(spark, "json-lines")
    feed_json(spark, sf_dir).select("raw").write.text(path)
    lines = J.with_document(read_raw(spark, path, AS_OF), F.col("raw"))
    return (
        lines.select(
            F.try_variant_get("document", "$.type", "string").alias("type"),
            F.col("document").isNotNull().alias("is_object"),
        )
        .groupBy("type", "is_object")
        .agg(F.count("*").alias("lines"))
    )


@query
def s3_event_log(spark, sf_dir):
    return _stored_log(spark, sf_dir).select(
        "device_id", "room_id", "type", "ts", "received_at", "seq", "late", "priority", "in_room", "confidence", "event_date"
    )


@query
def s4_log_since(spark, sf_dir):
    rows = event_log.log_since(_stored_log(spark, sf_dir), SNAPSHOT_TS)
    return _as_given(rows).select("position", "device_id", "type", "ts", "received_at", "seq", "late")


@query
def s5_alarm_insert_ignore(spark, sf_dir):
    path = new_table_path(spark, "alarms")
    alarm_table.store_alarms(_alarms_before(spark, sf_dir, SNAPSHOT_TS), path, "first")
    alarm_table.store_alarms(_alarms(spark, sf_dir), path, "second")
    return alarm_table.read_alarms(spark, path).groupBy("alarm_date", "batch").agg(
        F.count("*").alias("alarms"), F.count_distinct("dedup_key").alias("keys")
    )


# Validation


@query
def v1_invalid_json(spark, sf_dir):
    arrivals = validate.validate_raw(feed_json(spark, sf_dir))
    return validate.rejected_arrivals(arrivals).where(F.col("reason") == validate.INVALID_JSON).select("received_at", "reason")


@query
def v2_schema_reasons(spark, sf_dir):
    arrivals = validate.validate_raw(feed_json(spark, sf_dir))
    return (
        validate.rejected_arrivals(arrivals)
        .where(F.col("reason") == validate.INVALID_SCHEMA)
        .groupBy(F.to_date("received_at").alias("received_date"), "reason", F.col("device_id").isNull().alias("no_device"), F.col("type").isNull().alias("no_type"))
        .agg(F.count("*").alias("events"))
    )


def _spelled(number: Column, ts: Column) -> Column:
    """The timestamp spelled in one of twelve ways."""
    spellings = [
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS"),
        F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")),
        F.date_format(ts, "yyyyMMdd'T'HHmmss"),
        F.date_format(ts, "yyyy-MM-dd"),
        F.concat(F.year(F.date_add(ts.cast("date"), 3 - F.weekday(ts))), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"), F.lit("-"), (F.weekday(ts) + 1).cast("string")),
        F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm"), F.lit("-0330")),
        F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("789")),
        F.date_format(ts, "yyyy"),
        F.date_format(ts, "'T'HH:mm:ss"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'z'"),
        F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+24:00")),
    ]
    text = F.lit(None).cast("string")
    for position, spelling in enumerate(spellings):
        text = F.when(number == position, spelling).otherwise(text)
    return text


@query
def v3_timestamp(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return source_events(spark, sf_dir).select(
        "event_id", parse_iso_utc(_spelled(F.col("event_id") % 12, ts)).alias("parsed_ts")
    )


@query
def v4_clock_skew(spark, sf_dir):
    arrivals = feed_arrivals(spark, sf_dir)
    return arrivals.where(F.col("offset_seconds").isNotNull()).select("device_id", "seq", "reason", "offset_seconds")


@query
def v5_late_flag(spark, sf_dir):
    return feed_events(spark, sf_dir).groupBy("device_id", "late").agg(F.count("*").alias("events"))


@query
def v6_priority(spark, sf_dir):
    return feed_events(spark, sf_dir).groupBy("type", "priority").agg(F.count("*").alias("events"))


@query
def v7_payload(spark, sf_dir):
    source = source_events(spark, sf_dir).withColumn("copy", F.lit(1))
    stamp = F.col("ts").cast("timestamp")
    raw = F.concat(
        F.lit('{"device_id":"d","room_id":"r","note":null,"type":"'),
        F.col("event_type"),
        F.lit('","ts":"'),
        iso_text(stamp),
        F.lit('","payload":'),
        F.col("props"),
        F.lit(',"seq":'),
        F.col("event_id").cast("string"),
        F.lit("}"),
    )
    arrivals = validate.validate_raw(source.select(raw.alias("raw"), stamp.alias("received_at")))
    return validate.accepted_events(arrivals).select("seq", "type", "payload")


@query
def v8_rejects_by_reason(spark, sf_dir):
    return validate.rejects_by_reason(validate.validate_raw(feed_json(spark, sf_dir)))


@query
def v9_type_routing(spark, sf_dir):
    return validate.routing_counts(feed_events(spark, sf_dir))


def _payload_variants() -> tuple[Column, Column]:
    """Field spellings for truth values and numbers, chosen by the event id."""
    flags = ["true", "false", "null", "0", "1", "0.0", '""', '"false"', "[]", "[null]", "{}", '{"a":1}']
    numbers = ["0.5", '"0.25"', '" 1_0.5 "', "null", "true", '"0.9d"', "NaN", "[1]", '"1e-2"', "3"]
    number = F.col("event_id")
    flag, confidence = F.lit(""), F.lit("")
    for position, text in enumerate(flags):
        flag = F.when(number % 13 == position, f'"in_room":{text}').otherwise(flag)
    for position, text in enumerate(numbers):
        confidence = F.when(number % 11 == position, f'"confidence":{text}').otherwise(confidence)
    return flag, confidence


@query
def v10_payload_typed(spark, sf_dir):
    flag, confidence = _payload_variants()
    comma = F.when((flag != "") & (confidence != ""), ",").otherwise("")
    raw = F.concat(F.lit("{"), flag, comma, confidence, F.lit("}"))
    documents = J.with_document(source_events(spark, sf_dir).withColumn("raw", raw), F.col("raw"))
    return documents.select(
        "event_id",
        J.truthy(F.col("document"), "in_room").alias("in_room"),
        J.float_or_default(F.col("document"), "confidence", 0.0).alias("confidence"),
    )


@query
def v12_replay_tolerant(spark, sf_dir):
    number = F.col("seq") % 7
    text_log = feed_events(spark, sf_dir).select(
        "device_id",
        "room_id",
        "type",
        F.when(number == 1, "yesterday").otherwise(iso_text(F.col("ts"))).alias("ts"),
        F.when(number == 2, "{broken").when(number == 3, "[1]").otherwise(F.col("payload")).alias("payload"),
        F.when(number == 4, "").otherwise(iso_text(F.col("received_at"))).alias("received_at"),
        F.col("late").cast("int").alias("late"),
    )
    return validate.read_text_log(text_log).groupBy("type", "readable").agg(F.count("*").alias("rows"))


# Orders


@query
def o1_device_order(spark, sf_dir):
    placed = ordering.device_positions(feed_events(spark, sf_dir), DAY)
    return placed.select("position", "device_id", "ts", "received_at", "seq", "type")


@query
def o2_room_alarm_order(spark, sf_dir):
    return ordering.room_alarm_positions(_alarms(spark, sf_dir), slice_seconds=DAY).select(
        "room_id", "position", "ts", "dedup_key"
    )


@query
def o3_priority_order(spark, sf_dir):
    placed = ordering.priority_positions(feed_events(spark, sf_dir), DAY)
    return placed.select("position", "priority", "received_at", "seq", "device_id", "type")


# Device health


@query
def a1_last_heartbeat(spark, sf_dir):
    return health.last_heartbeat(feed_events(spark, sf_dir), AS_OF)


@query
def a2_recent_beats(spark, sf_dir):
    return health.recent_beats(feed_events(spark, sf_dir), AS_OF, WEEK)


@query
def a3_availability(spark, sf_dir):
    shares = health.availability(feed_events(spark, sf_dir), AS_OF, WEEK, BEAT_INTERVAL)
    return shares.select("device_id", "beats", _six("availability"))


@query
def a4_device_health(spark, sf_dir):
    report = health.device_health(feed_events(spark, sf_dir), AS_OF, WEEK, BEAT_INTERVAL)
    return report.select("device_id", "last_heartbeat_ts", _six("availability"))


# Room presence and occupancy


@query
def a5_room_presence(spark, sf_dir):
    return occupancy.current_presence(feed_events(spark, sf_dir), AS_OF)


@query
def a6_transitions(spark, sf_dir):
    return occupancy.transitions(feed_events(spark, sf_dir), AS_OF)


@query
def a7_retained_transitions(spark, sf_dir):
    return occupancy.retained_transitions(feed_events(spark, sf_dir), AS_OF, RETENTION)


@query
def a8_initial_state(spark, sf_dir):
    return occupancy.initial_state(feed_events(spark, sf_dir), AS_OF, WEEK)


@query
def a8_as_of_join(spark, sf_dir):
    # Whether a room was occupied when something moved or fell there.
    events = feed_events(spark, sf_dir)
    requests = health.visible(events, AS_OF).where(F.col("type").isin("motion", "fall_warn")).select("room_id", F.col("ts").alias("moment"))
    return occupancy.presence_at(events, requests, AS_OF, DAY)


@query
def a9_occupied_seconds(spark, sf_dir):
    seconds = occupancy.occupied_seconds(feed_events(spark, sf_dir), AS_OF, WEEK)
    return seconds.select("room_id", _six("occupied_seconds"))


@query
def a10_room_occupancy(spark, sf_dir):
    events = feed_events(spark, sf_dir)
    report = occupancy.room_occupancy(events, AS_OF, WEEK, all_rooms=True)
    return report.select("room_id", "in_room", _six("occupied_pct"), "window_seconds")


@query
def a10_room_occupancy_retained(spark, sf_dir):
    events = feed_events(spark, sf_dir)
    report = occupancy.room_occupancy(events, AS_OF, WEEK, retain_seconds=RETENTION)
    return report.select("room_id", "in_room", _six("occupied_pct"), "window_seconds")


@query
def a11_multi_window(spark, sf_dir):
    events = feed_events(spark, sf_dir)
    report = occupancy.occupancy_windows(events, AS_OF, WINDOWS, all_rooms=True)
    return report.select("room_id", "window", "window_seconds", "in_room", _six("occupied_pct"), "status")


# Falls and alarms


@query
def f1_dedup_key(spark, sf_dir):
    return falls.keyed_falls(feed_events(spark, sf_dir)).select("seq", "dedup_key")


@query
def f2_fall_dedup(spark, sf_dir):
    return _alarms(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))


@query
def f3_fall_outcomes(spark, sf_dir):
    return falls.fall_outcomes(feed_events(spark, sf_dir))


def _listed(alarms: DataFrame) -> DataFrame:
    return _as_given(alarms).select("position", "device_id", "room_id", "ts", _six("confidence"), "received_at")


@query
def f5_alarms_since(spark, sf_dir):
    return _listed(falls.alarms_since(_alarms(spark, sf_dir), ALARMS_SINCE))


@query
def f5_alarms_since_room(spark, sf_dir):
    return _listed(falls.alarms_since(_alarms(spark, sf_dir), ALARMS_SINCE, room_id="room_003"))


@query
def f6_alarm_feed(spark, sf_dir):
    feed = falls.alarm_feed(_alarms(spark, sf_dir), "room_003", start=SNAPSHOT_TS, since="2024-01-10 00:00:00")
    return feed.select("device_id", "room_id", "ts", "received_at", "dedup_key", "phase")


@query
def f7_reconcile(spark, sf_dir):
    # Every alarm, except that one room has each twice (leaks) and another has none from a day on (misses).
    alarms = _alarms(spark, sf_dir)
    lost = (F.col("room_id") == "room_004") & (F.col("received_at") >= SNAPSHOT_TS)
    raised = alarms.where(~lost).unionByName(alarms.where(F.col("room_id") == "room_003"))
    return falls.reconcile(feed_events(spark, sf_dir), raised)


# Metrics


@query
def m1_ingest_counters(spark, sf_dir):
    return metrics.ingest_counters(validate.validate_raw(feed_json(spark, sf_dir)))


@query
def m2_fall_counters(spark, sf_dir):
    return metrics.fall_counters(feed_events(spark, sf_dir))


def _dispatch_moment() -> Column:
    """Up to about a second after the receipt, for some just before it."""
    delay = (F.unix_micros("ts") % 1009 - 20) * 1000 + F.unix_micros("ts") % 997
    return F.timestamp_micros(F.unix_micros("received_at") + delay)


@query
def m3_alarm_latency(spark, sf_dir):
    path = new_table_path(spark, "dispatched")
    alarm_table.store_alarms(_alarms(spark, sf_dir), path, "only", _dispatch_moment())
    stored = metrics.alarm_latency(alarm_table.read_alarms(spark, path))
    return stored.select("dedup_key", F.round("latency_ms", 3).alias("latency_ms"))


@query
def m4_alarm_p95(spark, sf_dir):
    return metrics.alarm_latency_p95(_alarms(spark, sf_dir).withColumn("dispatched_at", _dispatch_moment()))


# Recovery


@query
def r1_state_as_of(spark, sf_dir):
    state = recovery.state_as_of(feed_events(spark, sf_dir), AS_OF, WEEK, RETENTION)
    return recovery.state_rows(state)


@query
def r2_restore_equals_full(spark, sf_dir):
    log = _stored_log(spark, sf_dir)
    folder = new_table_path(spark, "state")
    before = log.where(F.col("received_at") < SNAPSHOT_TS)
    snapshots.write_snapshot(recovery.state_as_of(before, AS_OF, WEEK, RETENTION), folder, 1, SNAPSHOT_TS)
    latest = snapshots.read_latest(spark, folder)
    restored = recovery.restore_state(log, latest.state, latest.snapshot_ts, AS_OF, WEEK, RETENTION)
    return recovery.state_rows(restored)


@query
def r2_stream_restore(spark, sf_dir):
    path = new_table_path(spark, "handover")
    event_log.append_arrivals(feed_arrivals(spark, sf_dir).where(F.col("received_at") <= AS_OF), f"{path}/log")
    before = event_log.read_log(spark, f"{path}/log").where(F.col("received_at") < SNAPSHOT_TS)
    snapshots.write_snapshot(recovery.state_as_of(before, AS_OF, WEEK, RETENTION), f"{path}/snapshots", 1, SNAPSHOT_TS)
    since = state_stream.start_from_snapshot(spark, f"{path}/snapshots", f"{path}/state", STATE_BUCKETS)
    state_stream.start_state(
        spark, f"{path}/log", f"{path}/state", f"{path}/checkpoint", WEEK, RETENTION, since=since, buckets=STATE_BUCKETS
    ).awaitTermination()
    return recovery.state_rows(state_stream.read_state(spark, f"{path}/state"))


@query
def s6_snapshot_versions(spark, sf_dir):
    log = feed_events(spark, sf_dir)
    folder = new_table_path(spark, "versions")
    first = recovery.state_as_of(log.where(F.col("received_at") < SNAPSHOT_TS), AS_OF, WEEK, RETENTION)
    snapshots.write_snapshot(first, folder, 1, SNAPSHOT_TS)
    held = snapshots.read_latest(spark, folder)
    small = {"device_last": held.state["device_last"].limit(0)}
    for version in range(2, 8):
        snapshots.write_snapshot(small, folder, version, AS_OF)
    # Read after six later versions.
    return recovery.state_rows(held.state)


@query
def r3_fall_replay(spark, sf_dir):
    log = feed_events(spark, sf_dir)
    stored = _alarms_before(spark, sf_dir, SNAPSHOT_TS)
    inserted = recovery.replayed_alarms(log, stored).select(
        "dedup_key", F.lit("inserted").alias("outcome"), F.lit(1).cast("bigint").alias("events")
    )
    conflicts = recovery.replay_conflicts(log, stored).select(
        "dedup_key", F.lit("db_conflict").alias("outcome"), F.col("conflicts").alias("events")
    )
    return inserted.unionByName(conflicts)


# Streaming, run over all available input and compared with the batch answer


def _tasks(spark: SparkSession) -> int:
    """Tasks that rows are dealt to: two per core, so that the time of one does not grow while cores are free."""
    return max(PARSE_TASKS, 2 * spark.sparkContext.defaultParallelism)


def _stream_log(spark: SparkSession, sf_dir: str) -> str:
    path = new_table_path(spark, "stream-log")
    raw = wire_json(adapt(stream_source_events(spark, sf_dir))).select("raw", "received_at")
    ingest.start_log(raw, f"{path}/table", f"{path}/checkpoint", parse_tasks=_tasks(spark)).awaitTermination()
    return f"{path}/table"


def _backlog(spark: SparkSession, sf_dir: str) -> str:
    """The log with its days written in three parts, ``_tasks`` files each: as a stream of a part per batch, receipts go back."""
    log = event_log.read_arrivals(spark, _stream_log(spark, sf_dir)).where(F.col("outcome") == "accepted")
    path = new_table_path(spark, "backlog")
    third = F.pmod(F.dayofmonth("ts"), F.lit(3))
    for part in (2, 1, 0):
        # Copies of a fall share the second, and so the part.
        log.where(third == part).repartition(_tasks(spark)).write.mode("append").partitionBy("outcome").parquet(path)
    return path


@query
def t1_stream_validate(spark, sf_dir):
    log = event_log.read_arrivals(spark, _stream_log(spark, sf_dir))
    return log.groupBy("outcome", "reason", "type", "late").agg(F.count("*").alias("events"))


@query
def t3_stream_fall_dedup(spark, sf_dir):
    path = new_table_path(spark, "stream-dedup")
    alarm_stream.start_alarms(
        spark, _backlog(spark, sf_dir), f"{path}/table", f"{path}/checkpoint", max_files_per_trigger=_tasks(spark)
    ).awaitTermination()
    return alarm_table.read_alarms(spark, f"{path}/table").select(
        "dedup_key", "device_id", "room_id", "ts", _six("confidence"), "received_at"
    )


def _run_state_twice(spark: SparkSession, log: str, tables) -> dict[str, DataFrame]:
    """The state after part of the log, a lost checkpoint, and the log from its beginning, three batches each."""
    path = new_table_path(spark, "stream-state")
    part = new_table_path(spark, "first-part")
    spark.read.parquet(log).where(F.dayofmonth("ts") % 2 == 0).repartition(3 * _tasks(spark)).write.partitionBy("outcome").parquet(part)
    for source, checkpoint in ((part, "lost"), (log, "new")):
        state_stream.start_state(
            spark, source, f"{path}/state", f"{path}/{checkpoint}", WEEK, RETENTION, _tasks(spark), tables, buckets=STATE_BUCKETS
        ).awaitTermination()
    return state_stream.read_state(spark, f"{path}/state")


@query
def t4_stream_presence(spark, sf_dir):
    return _run_state_twice(spark, _backlog(spark, sf_dir), state_stream.LATEST_TABLES)["room_presence"].select(
        "room_id", "in_room", "ts"
    )


@query
def t5_stream_state(spark, sf_dir):
    return recovery.state_rows(_run_state_twice(spark, _backlog(spark, sf_dir), recovery.STATE_TABLES))


@query
def t7_stream_alarms(spark, sf_dir):
    log = _stream_log(spark, sf_dir)
    path = new_table_path(spark, "stream-alarms")
    alarm_stream.start_alarms(spark, log, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    alarms = ordering.room_alarm_positions(alarm_table.read_alarms(spark, f"{path}/table"), DAY)
    return alarms.select("position", "device_id", "room_id", "ts", _six("confidence"), "received_at", "dedup_key")


def _in_slices(spark: SparkSession, sf_dir: str):
    """The path of a log that grows by slices of receipt time; a stream is run after each."""
    log = event_log.read_arrivals(spark, _stream_log(spark, sf_dir)).where(F.col("outcome") == "accepted")
    path = new_table_path(spark, "growing")
    for low, high in zip(SLICES, SLICES[1:]):
        days = F.col("event_date").between(F.to_date(F.lit(low)), F.to_date(F.lit(high)))
        log.where(days & (F.col("received_at") >= low) & (F.col("received_at") < high)).write.mode("append").partitionBy("outcome").parquet(path)
        yield path


def _reordered(spark: SparkSession, folder: str, streams, key: str, order: tuple[str, ...]) -> DataFrame:
    """Rows of a stream run slice by slice, with their position in the order in which the buffer releases them."""
    for source in streams:
        ordered_stream.start_ordered(source, f"{folder}/ordered", f"{folder}/ordered-checkpoint", [key], HOLD_SECONDS, order).awaitTermination()
        schema = source.schema
    ordered_stream.drain(spark, f"{folder}/ordered", schema, [key], HOLD_SECONDS, order)
    shown = ordered_stream.read_ordered(spark, f"{folder}/ordered", schema)
    return ordering.with_positions(shown, [key], "released_at", order, DAY)


@query
def o1_reordered_stream(spark, sf_dir):
    folder = new_table_path(spark, "reorder")
    streams = (event_log.stream_log(spark, path) for path in _in_slices(spark, sf_dir))
    placed = _reordered(spark, folder, streams, "device_id", ("ts", "received_at", "seq"))
    return placed.select("device_id", "position", "ts", "received_at", "seq", "released_at")


@query
def t7_reordered_stream(spark, sf_dir):
    folder = new_table_path(spark, "reorder-alarms")

    def streams():
        for path in _in_slices(spark, sf_dir):
            alarm_stream.start_alarms(spark, path, f"{folder}/table", f"{folder}/alarms-checkpoint").awaitTermination()
            yield alarm_table.stream_alarms(spark, f"{folder}/table")

    placed = _reordered(spark, folder, streams(), "room_id", ("ts", "received_at", "dedup_key"))
    return placed.select("room_id", "position", "ts", "received_at", "dedup_key", "released_at")


@query
def f3_stream_outcomes(spark, sf_dir):
    folder = new_table_path(spark, "live-outcomes")
    for path in _in_slices(spark, sf_dir):
        alarm_stream.start_alarms(
            spark, path, f"{folder}/table", f"{folder}/checkpoint", outcomes_path=f"{folder}/outcomes"
        ).awaitTermination()
    return alarm_stream.alarm_outcomes(spark, f"{folder}/outcomes")


@query
def a3_stream_availability(spark, sf_dir):
    # A ring of days; the first two slices expire in part while the log grows.
    folder = new_table_path(spark, "running-health")
    for path in _in_slices(spark, sf_dir):
        availability_stream.start_availability(
            spark, path, f"{folder}/ring", f"{folder}/checkpoint", WEEK, DAY, STATE_BUCKETS
        ).awaitTermination()
    report = availability_stream.running_health(spark, f"{folder}/ring", LOG_END, WEEK, BEAT_INTERVAL)
    return report.select("device_id", "last_heartbeat_ts", "beats", _six("availability"))


@query
def m4_stream_p95(spark, sf_dir):
    # The alarm table grows by slices, the newest first; the ring is kept up after each.
    path = new_table_path(spark, "latency")
    alarms = _alarms(spark, sf_dir)
    for low, high in reversed(list(zip(SLICES, SLICES[1:]))):
        part = alarms.where((F.col("received_at") >= low) & (F.col("received_at") < high))
        alarm_table.append_alarms(part, f"{path}/table", low, _dispatch_moment())
        latency_stream.start_latency(spark, f"{path}/table", f"{path}/ring", f"{path}/checkpoint", samples=1000).awaitTermination()
    return latency_stream.latency_p95(spark, f"{path}/ring", samples=1000)


@query
def f7_stream_reconcile(spark, sf_dir):
    # As f7_reconcile, and one room has alarms of keys that no fall has.
    log = _stream_log(spark, sf_dir)
    path = new_table_path(spark, "reconcile")
    alarms = falls.alarms_from_falls(event_log.read_log(spark, log))
    lost = (F.col("room_id") == "room_004") & (F.col("received_at") >= SNAPSHOT_TS)
    stray = alarms.where(F.col("room_id") == "room_005").withColumn("dedup_key", F.concat("dedup_key", F.lit(":stray")))
    alarm_table.append_alarms(alarms.where(~lost).unionByName(stray), f"{path}/alarms", "first")
    alarm_table.append_alarms(alarms.where(F.col("room_id") == "room_003"), f"{path}/alarms", "again")
    job = reconcile_stream.start_reconcile(spark, log, f"{path}/alarms", f"{path}/table", f"{path}/checkpoint")
    job.awaitTermination()
    ingest.raise_if_dropped(job)
    return reconcile_stream.read_reconciled(spark, f"{path}/table")


@query
def f6_stream_feed(spark, sf_dir):
    path = new_table_path(spark, "feed")
    alarms = _alarms(spark, sf_dir)
    early = alarms.where(F.col("received_at") < SNAPSHOT_TS)

    def read_feed() -> None:
        (
            alarm_stream.room_feed(spark, f"{path}/table", "room_003", SNAPSHOT_TS, since="2024-01-10 00:00:00")
            .writeStream.format("parquet")
            .option("path", f"{path}/seen")
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )

    alarm_table.store_alarms(early, f"{path}/table", "first")
    read_feed()
    alarm_table.store_alarms(early, f"{path}/table", "first")  # a batch that is repeated
    alarm_table.store_alarms(alarms, f"{path}/table", "second")
    read_feed()
    seen = spark.read.parquet(f"{path}/seen")
    return seen.select("device_id", "room_id", "ts", "received_at", "dedup_key", "phase")
