import random
from datetime import timedelta

import duckdb
import pytest
from conftest import NOW, at, plain
from pyspark.sql import functions as F

from wardwatch.functions.timeline import iso_text
from wardwatch.operators import falls, occupancy, recovery
from wardwatch.operators.metrics import ingest_counters
from wardwatch.operators.validate import accepted_events, validate_raw
from wardwatch.plans import queries
from wardwatch.session import new_table_path
from wardwatch.sources import alarm_table, event_log, keyed_state, raw_json
from wardwatch.streaming import alarms as alarm_stream
from wardwatch.streaming import ingest
from wardwatch.streaming import state as state_stream

RAW_DDL = "raw STRING, received_at TIMESTAMP"


def raw_rows(seed, n=240):
    """Raw records in order of receipt, with bad, late, skewed, and repeated ones."""
    rng = random.Random(seed)
    rows, received = [], at(-7000)
    for i in range(n):
        received += timedelta(seconds=rng.randint(0, 50))
        ts = received - timedelta(seconds=rng.choice([1, 1, 2, 40, 1800, -600, 5000, -5000]))
        kind = rng.choice(["heartbeat", "presence", "fall_warn", "motion"])
        extra = {"presence": f',"in_room":{rng.choice(["true", "false"])}', "fall_warn": ',"confidence":0.8'}.get(kind, "")
        text = f'{{"device_id":"d{i % 4}","room_id":"r{i % 3}","type":"{kind}","ts":"{ts.isoformat()}Z","seq":{i}{extra}}}'
        rows.append(("broken" if rng.random() < 0.05 else text, received))
        if kind == "fall_warn":
            for copy in range(rng.randint(0, 2)):
                rows.append((text, received + timedelta(seconds=6 * (copy + 1))))
    return sorted(rows, key=lambda row: row[1])


def write_files(spark, rows, folder, files):
    size = -(-len(rows) // files)
    for number in range(files):
        frame = spark.createDataFrame(rows[number * size : (number + 1) * size], "raw STRING, received_at TIMESTAMP_NTZ")
        frame = frame.withColumn("received_at", F.col("received_at").cast("timestamp"))
        frame.coalesce(1).write.mode("append").parquet(folder)


def raw_stream(spark, folder, per_batch=1):
    return spark.readStream.schema(RAW_DDL).option("maxFilesPerTrigger", per_batch).parquet(folder)


@pytest.fixture(scope="module")
def job(spark):
    """A log written by the streaming job in several batches, and the same rows as a batch."""
    base, rows = new_table_path(spark, "job"), raw_rows(3)
    write_files(spark, rows, f"{base}/raw", 4)
    query = ingest.start_log(raw_stream(spark, f"{base}/raw"), f"{base}/log", f"{base}/log-checkpoint")
    query.awaitTermination()
    batch = validate_raw(spark.read.schema(RAW_DDL).parquet(f"{base}/raw"))
    return base, batch, query


def sorted_rows(frame):
    return sorted(map(str, (sorted(row.items()) for row in plain(frame))))


def test_stream_log_equals_batch(spark, job):
    base, batch, query = job
    assert sorted_rows(event_log.read_arrivals(spark, f"{base}/log")) == sorted_rows(batch)
    observed = [p["observedMetrics"]["ingest"] for p in query.recentProgress if p["observedMetrics"]]
    assert len(observed) >= 4
    totals = {row["counter"]: row["value"] for row in plain(ingest_counters(batch))}
    summed = {name: sum(o.asDict()[name] if hasattr(o, "asDict") else o[name] for o in observed) for name in totals}
    assert summed == totals


def test_log_compaction_keeps_every_arrival(spark, job):
    base, _, _ = job
    event_log.compact_log(spark, f"{base}/log", f"{base}/log-compact")
    old, new = (event_log.read_arrivals(spark, f"{base}/{name}") for name in ("log", "log-compact"))
    assert sorted_rows(new) == sorted_rows(old)
    assert len(new.inputFiles()) < len(old.inputFiles())


def test_log_restart_reads_only_new_files(spark):
    base, rows = new_table_path(spark, "restart"), raw_rows(5, 60)
    write_files(spark, rows[:40], f"{base}/raw", 2)
    for _ in range(2):
        ingest.start_log(raw_stream(spark, f"{base}/raw"), f"{base}/log", f"{base}/checkpoint").awaitTermination()
    write_files(spark, rows[40:], f"{base}/raw", 1)
    ingest.start_log(raw_stream(spark, f"{base}/raw"), f"{base}/log", f"{base}/checkpoint").awaitTermination()
    assert event_log.read_arrivals(spark, f"{base}/log").count() == len(rows)


def test_backlog_with_receipts_going_back_loses_no_alarm(spark, job):
    base, batch, _ = job
    path, accepted = new_table_path(spark, "back"), accepted_events(batch)
    rows = event_log.read_arrivals(spark, f"{base}/log").where("outcome = 'accepted'")
    for low in range(4, -1, -1):
        part = rows.where(F.pmod(F.unix_seconds("ts") / 1800, F.lit(5)).cast("int") == low)
        part.coalesce(1).write.mode("append").partitionBy("outcome").parquet(f"{path}/log")
    query = alarm_stream.start_alarms(
        spark, f"{path}/log", f"{path}/alarms", f"{path}/checkpoint", max_files_per_trigger=1, counters_path=f"{path}/counters"
    )
    query.awaitTermination()
    expected = falls.alarms_from_falls(accepted)
    stored = alarm_table.read_alarms(spark, f"{path}/alarms")
    assert len(query.recentProgress) >= 4
    assert sorted_rows(stored.drop("dispatched_at", "batch", "alarm_date")) == sorted_rows(expected)
    assert all(row["dispatched_at"] is not None for row in plain(stored))
    counted = alarm_stream.alarm_counters(spark, f"{path}/counters").agg(F.sum("falls"), F.sum("new_alarms"), F.sum("repeats_in_batch"), F.sum("already_stored")).first()
    total = falls.keyed_falls(accepted).count()
    assert tuple(counted) == (total, expected.count(), total - expected.count(), 0)


def test_watermark_drops_are_an_error(spark, job):
    base, _, _ = job
    stream = ingest.with_event_watermark(event_log.stream_log(spark, f"{base}/log", 1)).groupBy("ts").count()
    query = stream.writeStream.format("noop").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    ingest.raise_if_dropped(query)


def test_a_repeated_alarm_batch_writes_nothing_and_compaction_keeps_rows(spark, job):
    base, batch, _ = job
    path, found = new_table_path(spark, "repeat"), falls.alarms_from_falls(accepted_events(batch))
    alarm_table.store_alarms(found, f"{path}/alarms", "b0")
    files = sorted(alarm_table.read_alarms(spark, f"{path}/alarms").inputFiles())
    alarm_table.store_alarms(found, f"{path}/alarms", "b0")
    alarm_table.store_alarms(found, f"{path}/alarms", "b1")
    stored = alarm_table.read_alarms(spark, f"{path}/alarms")
    assert sorted(stored.inputFiles()) == files and stored.count() == found.count()
    alarm_table.compact_alarms(spark, f"{path}/alarms", f"{path}/compact")
    assert sorted_rows(alarm_table.read_alarms(spark, f"{path}/compact")) == sorted_rows(stored)


def test_alarm_job_equals_batch_and_survives_checkpoint_loss(spark, job):
    base, batch, _ = job
    expected = sorted(row["dedup_key"] for row in plain(falls.alarms_from_falls(accepted_events(batch))))
    for checkpoint in ("first", "first", "second"):
        alarm_stream.start_alarms(
            spark, f"{base}/log", f"{base}/alarms", f"{base}/alarms-{checkpoint}", max_files_per_trigger=2
        ).awaitTermination()
        stored = alarm_table.read_alarms(spark, f"{base}/alarms")
        assert sorted(row["dedup_key"] for row in plain(stored)) == expected
    feed = alarm_stream.room_feed(spark, f"{base}/alarms", "r1", at(-3000), since=at(-5000))
    feed.writeStream.format("memory").queryName("feed").trigger(availableNow=True).start().awaitTermination()
    now_batch = falls.alarm_feed(stored.select(*feed.columns[:-1]), "r1", at(-3000), since=at(-5000))
    assert sorted_rows(spark.table("feed")) == sorted_rows(now_batch)


def test_live_classes_equal_the_batch_and_no_batch_scans_the_alarm_table(spark, job, monkeypatch):
    base, batch, _ = job
    path, scans = new_table_path(spark, "live"), []
    real = alarm_stream.read_alarms
    monkeypatch.setattr(alarm_stream, "read_alarms", lambda *args: scans.append(args) or real(*args))
    query = alarm_stream.start_alarms(
        spark, f"{base}/log", f"{path}/alarms", f"{path}/checkpoint", max_files_per_trigger=2, outcomes_path=f"{path}/outcomes"
    )
    query.awaitTermination()
    assert len(query.recentProgress) >= 3 and len(scans) == 1
    assert sorted_rows(alarm_stream.alarm_outcomes(spark, f"{path}/outcomes")) == sorted_rows(falls.fall_outcomes(accepted_events(batch)))
    # A job without state on the same table fills it from there, and raises nothing again.
    before = real(spark, f"{path}/alarms").count()
    alarm_stream.start_alarms(
        spark, f"{base}/log", f"{path}/alarms", f"{path}/new", state_path=f"{path}/other", outcomes_path=f"{path}/again"
    ).awaitTermination()
    assert len(scans) == 2 and real(spark, f"{path}/alarms").count() == before
    assert alarm_stream.alarm_outcomes(spark, f"{path}/again").where("outcome = 'new'").isEmpty()


def test_an_alarm_batch_that_dies_before_or_after_its_commit(spark, job, monkeypatch):
    base, batch, _ = job
    path, expected = new_table_path(spark, "dies"), sorted_rows(falls.alarms_from_falls(accepted_events(batch)))
    stop = {"commit": 1, "append_alarms": 1}

    def dying(module, name):
        real = getattr(module, name)

        def run(*args, **more):
            # The second call of each does nothing but fail.
            stop[name] -= 1
            if stop[name] == 0:
                raise RuntimeError("lost")
            return real(*args, **more)

        monkeypatch.setattr(module, name, run)

    stop["commit"] = 2
    dying(keyed_state, "commit")
    dying(alarm_stream, "append_alarms")
    start = lambda checkpoint: alarm_stream.start_alarms(spark, f"{base}/log", f"{path}/alarms", f"{path}/{checkpoint}", max_files_per_trigger=100)
    for _ in range(2):
        with pytest.raises(Exception):
            start("one").awaitTermination()
    assert alarm_table.read_alarms(spark, f"{path}/alarms").isEmpty()
    # The alarms are committed but not appended, and the checkpoint is lost.
    start("two").awaitTermination()
    stored = alarm_table.read_alarms(spark, f"{path}/alarms")
    assert sorted_rows(stored.drop("dispatched_at", "batch", "alarm_date")) == expected


def test_alarm_files_are_ordered_per_room(spark, job):
    base, batch, _ = job
    path = new_table_path(spark, "ordered")
    alarm_table.store_alarms(falls.alarms_from_falls(accepted_events(batch)), path, "b")
    rows = plain(alarm_table.read_alarms(spark, path).withColumn("file", F.input_file_name()))
    for name in {row["file"] for row in rows}:
        mine = [(row["room_id"], row["ts"]) for row in rows if row["file"] == name]
        assert mine == sorted(mine)


def test_running_state_equals_batch_after_a_lost_checkpoint(spark, job):
    base, batch, _ = job
    accepted, folder = accepted_events(batch), f"{base}/latest"
    later = NOW + timedelta(days=1)
    for checkpoint in ("one", "two"):
        state_stream.start_state(
            spark, f"{base}/log", folder, f"{base}/latest-{checkpoint}", max_files_per_trigger=2, tables=state_stream.LATEST_TABLES
        ).awaitTermination()
        state = state_stream.read_state(spark, folder)
        assert set(state) == set(state_stream.LATEST_TABLES)
        presence = state["room_presence"].select("room_id", "in_room", "ts")
        assert sorted_rows(presence) == sorted_rows(occupancy.current_presence(accepted, later))
        beats = accepted.where("type = 'heartbeat'").groupBy("device_id").agg(F.max("ts").alias("last_heartbeat_ts"))
        assert sorted_rows(state["device_last"].drop("handled_at")) == sorted_rows(beats)


def test_a_new_checkpoint_never_answers_with_less(spark):
    base, rows = new_table_path(spark, "restart-state"), raw_rows(9, 120)
    write_files(spark, rows, f"{base}/raw", 3)
    ingest.start_log(raw_stream(spark, f"{base}/raw"), f"{base}/log", f"{base}/log-checkpoint").awaitTermination()
    start = lambda name, **more: state_stream.start_state(spark, f"{base}/log", f"{base}/state", f"{base}/{name}", max_files_per_trigger=1, **more)
    start("first").awaitTermination()
    full, rooms = keyed_state.latest(spark, f"{base}/state"), lambda: sorted_rows(state_stream.read_state(spark, f"{base}/state")["room_presence"])
    want, seen, write = rooms(), [], keyed_state.commit

    def watch(*args):
        version = write(*args)
        seen.append((version.number, rooms()))
        return version

    keyed_state.commit = watch
    try:
        start("second").awaitTermination()
    finally:
        keyed_state.commit = write
    assert [number for number, _ in seen] == list(range(full.number + 1, full.number + 1 + len(seen))) and seen
    assert all(rows == want for _, rows in seen)


def test_a_batch_of_one_device_writes_one_bucket(spark):
    base, rows = new_table_path(spark, "one-bucket"), raw_rows(10, 200)
    write_files(spark, rows, f"{base}/raw", 1)
    log = lambda: ingest.start_log(raw_stream(spark, f"{base}/raw"), f"{base}/log", f"{base}/log-checkpoint").awaitTermination()
    state = lambda: state_stream.start_state(spark, f"{base}/log", f"{base}/state", f"{base}/checkpoint").awaitTermination()
    log(), state()
    first = keyed_state.latest(spark, f"{base}/state")
    write_files(spark, [(f'{{"device_id":"d1","room_id":"r1","type":"heartbeat","ts":"{NOW.isoformat()}Z"}}', NOW)], f"{base}/raw", 1)
    log(), state()
    second = keyed_state.latest(spark, f"{base}/state")
    changed = {key for key in second.places if second.places[key] != first.places.get(key)}
    bucket = spark.sql("SELECT 'd1' AS d").select(keyed_state.bucket_of("d")).first()[0]
    assert changed == {("device_last", bucket), ("device_beats", bucket)} and len(second.places) > 10
    assert keyed_state.remove_versions(spark, f"{base}/state", second.number) == 1
    full = recovery.state_as_of(accepted_events(validate_raw(spark.read.schema(RAW_DDL).parquet(f"{base}/raw"))), NOW + timedelta(days=1))
    for name, frame in state_stream.read_state(spark, f"{base}/state").items():
        assert sorted_rows(frame) == sorted_rows(full[name]), name


def test_incremental_state_equals_batch_after_a_crash(spark, job, monkeypatch):
    base, batch, _ = job
    folder, checkpoint = f"{base}/state", f"{base}/state-checkpoint"
    write, calls = keyed_state.commit, []

    def crash_on_third(*args):
        calls.append(args)
        version = write(*args)
        if len(calls) == 3:
            raise RuntimeError("lost after writing")
        return version

    monkeypatch.setattr(keyed_state, "commit", crash_on_third)
    start = lambda: state_stream.start_state(spark, f"{base}/log", folder, checkpoint, max_files_per_trigger=2)
    with pytest.raises(Exception):
        start().awaitTermination()
    start().awaitTermination()
    state = state_stream.read_state(spark, folder)
    full = recovery.state_as_of(accepted_events(batch), NOW + timedelta(days=1))
    for name in recovery.STATE_TABLES:
        assert sorted_rows(state[name]) == sorted_rows(full[name]), name


def test_text_stream_uses_the_batch_time_as_receipt(spark, tmp_path):
    folder = new_table_path(spark, "text-raw")
    stamp = iso_text(F.current_timestamp())
    line = F.concat(F.lit('{"device_id":"d","room_id":"r","type":"motion","ts":"'), stamp, F.lit('"}'))
    spark.range(3).select(line).write.text(folder)
    base = new_table_path(spark, "text-job")
    ingest.start_log(raw_json.stream_raw(spark, folder), f"{base}/log", f"{base}/checkpoint").awaitTermination()
    rows = plain(event_log.read_arrivals(spark, f"{base}/log"))
    assert [row["outcome"] for row in rows] == ["accepted"] * 3 and len({row["received_at"] for row in rows}) == 1


@pytest.fixture
def rows_of_its_own(tmp_path):
    duckdb.sql(
        "SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(i * 600_000_000) AS ts, i % 60 AS user_id, "
        "['click', 'purchase', 'error', 'view'][1 + i % 7 % 4] AS event_type, (i % 97)::DOUBLE AS value, '{}' AS props FROM range(4000) r(i)"
    ).write_parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_a_part_of_the_backlog_is_dealt_to_all_tasks(spark, rows_of_its_own):
    backlog = queries._backlog(spark, rows_of_its_own)
    rows = spark.read.parquet(backlog).groupBy(F.input_file_name()).count().collect()
    assert len(rows) == 3 * queries._tasks(spark)
    assert max(r["count"] for r in rows) <= 2 * sum(r["count"] for r in rows) / len(rows)
