import random
from datetime import timedelta

import duckdb
from compare import compare, connect
from conftest import at, event, events, plain
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from wardwatch.operators import falls, metrics
from wardwatch.schema import LATENCY_SAMPLES
from wardwatch.session import new_table_path
from wardwatch.sources import alarm_table, keyed_state
from wardwatch.streaming.latency import latency_p95, read_ring, start_latency


def alarms(spark, rng, n, first):
    rows = [event("fall_warn", at(first + i), at(first + i + 1), room=f"r{i % 3}", confidence=0.5) for i in range(n)]
    delays = F.timestamp_micros(F.unix_micros("received_at") + F.pmod(F.xxhash64("dedup_key"), F.lit(900_000)) + rng.randint(0, 9))
    return falls.alarms_from_falls(events(spark, rows)), delays


def run(spark, path, checkpoint="checkpoint", samples=20, **options):
    start_latency(spark, f"{path}/table", f"{path}/ring", f"{path}/{checkpoint}", samples, **options).awaitTermination()


def test_ring_equals_the_last_of_the_table_after_each_slice_and_when_read_again(spark):
    path, rng = new_table_path(spark, "ring"), random.Random(5)
    assert plain(latency_p95(spark, f"{path}/ring")) == [{"alarm_feed_latency_ms_p95": 0, "samples": 0}]
    for number, (n, first) in enumerate([(7, 0), (50, 500), (30, -900), (25, 490)]):
        found, moment = alarms(spark, rng, n, first)
        alarm_table.append_alarms(found, f"{path}/table", f"b{number}", moment)
        run(spark, path, max_files_per_trigger=2)
        stored = alarm_table.read_alarms(spark, f"{path}/table")
        every = sorted(((r["dispatched_at"], r["received_at"], r["dedup_key"]) for r in plain(stored)), reverse=True)
        ring = {(r["dispatched_at"], r["received_at"], r["dedup_key"]) for r in plain(read_ring(spark, f"{path}/ring"))}
        assert ring == set(every[:20]) and read_ring(spark, f"{path}/ring").count() == min(20, len(every))
        assert plain(latency_p95(spark, f"{path}/ring", 20)) == plain(metrics.alarm_latency_p95(stored, 20))
    run(spark, path, "lost")  # a new checkpoint: the whole table is read again
    assert {(r["dispatched_at"], r["received_at"], r["dedup_key"]) for r in plain(read_ring(spark, f"{path}/ring"))} == set(every[:20])


def test_equal_times_of_dispatch_go_by_receipt_and_key(spark):
    path = new_table_path(spark, "ring-ties")
    found = falls.alarms_from_falls(events(spark, [event("fall_warn", at(i), at(10), confidence=0.5) for i in range(9)]))
    alarm_table.append_alarms(found, f"{path}/table", "b", F.lit(at(10) + timedelta(seconds=1)).cast("timestamp"))
    run(spark, path, samples=4)
    keys = sorted((r["dedup_key"] for r in plain(found)), reverse=True)
    assert sorted((r["dedup_key"] for r in plain(read_ring(spark, f"{path}/ring"))), reverse=True) == keys[:4]


def test_a_batch_reads_its_own_alarms_alone(spark):
    path, rng, read = new_table_path(spark, "ring-reads"), random.Random(6), []
    for number in range(2):
        found, moment = alarms(spark, rng, 40, 1000 * number)
        alarm_table.append_alarms(found, f"{path}/table", f"b{number}", moment)
        job = start_latency(spark, f"{path}/table", f"{path}/ring", f"{path}/checkpoint", 20)
        job.awaitTermination()
        read.append(sum(p["numInputRows"] for p in job.recentProgress))
    # Each alarm is read once per pass over its batch, the stored ones of the first run never again.
    assert read[1] <= read[0] and read_ring(spark, f"{path}/ring").count() == 20
    assert keyed_state.latest(spark, f"{path}/ring").number == 1


def test_the_query_takes_the_whole_window_of_the_metric(spark, tmp_path):
    duckdb.sql(
        "SELECT i AS event_id, TIMESTAMP '2024-01-02' + to_microseconds(i * 1_000_003) AS ts, i % 40 AS user_id, 'error' AS event_type, "
        "10.0::DOUBLE AS value, '{}' AS props FROM range(7000) r(i)"
    ).write_parquet(str(tmp_path / "events.parquet"))
    good, note = compare(spark, connect(str(tmp_path)), "m4_alarm_p95", str(tmp_path))
    assert good, note
    assert plain(entry_points.queries()["m4_alarm_p95"](spark, str(tmp_path)))[0]["samples"] == LATENCY_SAMPLES == 5000
