import hashlib
import random
from collections import Counter
from datetime import timedelta

import pytest
from conftest import NOW, at, event, events, plain

from pyspark.sql import functions as F

from wardwatch.operators import falls, metrics, ordering, recovery
from wardwatch.operators.holding import openings
from wardwatch.session import new_table_path


def fall(ts, received_at=None, device="d1", room="r1", seq=None, confidence=0.9):
    return event("fall_warn", ts, received_at, device=device, room=room, seq=seq, confidence=confidence)


def key_of(device, room, ts):
    text = f"{device}:{room}:{ts.replace(microsecond=0).isoformat()}+00:00"
    return "dedup:" + hashlib.sha256(text.encode()).hexdigest()


def test_dedup_key(spark):
    log = events(spark, [fall(at(0.7)), fall(at(0.1)), fall(at(1)), fall(at(0), device="a:b", room="c"), fall(at(0), device="a", room="b:c")])
    keys = [row["dedup_key"] for row in plain(falls.keyed_falls(log))]
    assert keys[:3] == [key_of("d1", "r1", at(0)), key_of("d1", "r1", at(0)), key_of("d1", "r1", at(1))]
    assert keys[3] == keys[4]


def test_first_copy_becomes_the_alarm(spark):
    log = events(spark, [fall(at(-9.5), at(-1), seq=3, confidence=0.3), fall(at(-9.2), at(-5), seq=1, confidence=0.1), fall(at(-9.5), at(-2), seq=2, confidence=0.2)])
    (alarm,) = plain(falls.alarms_from_falls(log))
    assert (alarm["ts"], alarm["received_at"], alarm["confidence"]) == (at(-9.5), at(-2), 0.2)


def test_fall_without_usable_confidence_does_not_hide_a_good_copy(spark):
    log = events(spark, [fall(at(-9), at(-8), confidence=None), fall(at(-9), at(-7), confidence=0.4)])
    assert [alarm["confidence"] for alarm in plain(falls.alarms_from_falls(log))] == [0.4]
    assert falls.handler_errors(log).count() == 1


def walk(rows, ttl=10):
    """Outcome of each fall by replaying arrivals one by one."""
    set_at, outcomes = {}, Counter()
    for device, room, _, ts, received_at, seq, *_ in sorted(rows, key=lambda r: (r[4], r[5])):
        key = key_of(device, room, ts)
        if key not in set_at:
            outcome, set_at[key] = "new", received_at
        elif received_at - set_at[key] >= timedelta(seconds=ttl):
            outcome, set_at[key] = "dedup_post_ttl", received_at
        else:
            outcome = "dedup_in_window"
        outcomes[key, received_at, outcome] += 1
    return outcomes


def outcomes_of(frame):
    return {(r["dedup_key"], r["received_at"], r["outcome"]): r["copies"] for r in plain(frame)}


def test_the_entry_runs_from_the_last_accepted_arrival(spark):
    rows = [fall(at(0), at(s), seq=s) for s in (0, 6, 12, 18, 22)]
    found = outcomes_of(falls.fall_outcomes(events(spark, rows)))
    assert [k[2] for k in sorted(found, key=lambda k: k[1])] == ["new", "dedup_in_window", "dedup_post_ttl", "dedup_in_window", "dedup_post_ttl"]


@pytest.mark.parametrize("seed", [21, 22])
def test_outcomes_against_a_walk(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        room = rng.choice(["hot"] * 4 + ["r1", "r2", "r3"])
        second = 0 if room == "hot" else rng.randint(0, 5)
        arrival = at(rng.choice([rng.randint(0, 300), rng.random() * 400, 33.333333]))
        rows.append(fall(at(second + rng.random() * 0.9), arrival, room=room, seq=rng.randint(0, 40)))
    assert outcomes_of(falls.fall_outcomes(events(spark, rows))) == dict(walk(rows))


def walked(times, hold):
    out, free = [], None
    for t in sorted(times):
        if free is None or t >= free:
            out.append(t)
            free = t + hold
    return out


@pytest.mark.parametrize("hold", [1, 7, 10, 50])
def test_openings_of_windows(spark, hold):
    rng = random.Random(hold)
    rows = {("dense", t) for t in rng.sample(range(-500, 1500), 900)} | {("even", 5 * k) for k in range(100)}
    rows |= {("sparse", rng.randrange(10**6)) for _ in range(50)} | {("one", -3)} | {("edge", k * hold) for k in range(40)}
    found = openings(spark.createDataFrame(sorted(rows), "k string, t long"), ["k"], hold).collect()
    assert len(found) == len(set(found))
    for key in {k for k, _ in rows}:
        assert sorted(r["t"] for r in found if r["k"] == key) == walked([t for k, t in rows if k == key], hold)
    assert openings(spark.createDataFrame([], "k string, t long"), ["k"], hold).collect() == []


def test_a_key_with_very_many_arrivals_is_spread(spark):
    """10^5 distinct arrivals of one key within two hours."""
    times = spark.range(100_000).selectExpr("'hot' AS k", "pmod(xxhash64(id), 7200000000) AS t").distinct()
    found = openings(times, ["k"], 10_000_000)
    want = walked([r["t"] for r in times.collect()], 10_000_000)
    assert sorted(r["t"] for r in found.collect()) == want and len(want) > 600
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan
    # Before the rounds, rows meet by key and bucket: none of the buckets holds more than a small share.
    biggest = times.groupBy(F.floor(F.col("t") / 10_000_000)).count().agg(F.max("count")).first()[0]
    assert biggest < 300


def test_many_exact_copies_share_rows(spark):
    rows = [fall(at(0), at(1), seq=1)] * 5000 + [fall(at(0), at(12), seq=2)] * 10
    found = falls.fall_outcomes(events(spark, rows))
    assert sorted((r["outcome"], r["copies"]) for r in plain(found)) == [
        ("dedup_in_window", 9), ("dedup_in_window", 4999), ("dedup_post_ttl", 1), ("new", 1)]


def counters(frame):
    return {row["counter"]: row["value"] for row in plain(frame)}


def test_fall_counters_live_and_replay(spark):
    log = events(spark, [fall(at(0), at(1)), fall(at(0), at(2)), fall(at(0), at(20)), fall(at(5), at(6))])
    assert counters(metrics.fall_counters(log)) == {"fall_warnings_total": 2, "fall_warnings_deduped": 2, "fall_warnings_db_conflicts": 0}
    stored = falls.alarms_from_falls(log.where("ts < timestamp '2026-06-29 12:00:03'"))
    assert counters(metrics.fall_counters(log, stored)) == {"fall_warnings_total": 1, "fall_warnings_deduped": 0, "fall_warnings_db_conflicts": 3}
    assert counters(metrics.fall_counters(log.where("false"))) == {"fall_warnings_total": 0, "fall_warnings_deduped": 0, "fall_warnings_db_conflicts": 0}


def test_replay_inserts_missing_alarms_and_reports_conflicts(spark):
    log = events(spark, [fall(at(0), at(1)), fall(at(0), at(2)), fall(at(5), at(6))])
    stored = falls.alarms_from_falls(log.where("ts < timestamp '2026-06-29 12:00:03'"))
    assert [row["ts"] for row in plain(recovery.replayed_alarms(log, stored))] == [at(5)]
    assert [row["conflicts"] for row in plain(recovery.replay_conflicts(log, stored))] == [2]


def test_alarm_list(spark):
    alarms = falls.alarms_from_falls(events(spark, [fall(at(2), at(3)), fall(at(0), at(1), room="r2"), fall(at(-2), at(-1))]))
    epoch = (NOW - timedelta(0)).replace(tzinfo=__import__("datetime").timezone.utc).timestamp()
    assert [row["ts"] for row in plain(falls.alarms_since(alarms, epoch))] == [at(0), at(2)]
    assert [row["ts"] for row in plain(falls.alarms_since(alarms))] == [at(-2), at(0), at(2)]
    assert [row["ts"] for row in plain(falls.alarms_since(alarms, epoch, "r1"))] == [at(2)]


def test_feed_has_history_and_every_live_alarm(spark):
    alarms = falls.alarms_from_falls(events(spark, [fall(at(-50), at(-49)), fall(at(-20), at(-19)), fall(at(-60), at(5)), fall(at(1), at(2), room="r2")]))
    feed = {(row["ts"], row["phase"]) for row in plain(falls.alarm_feed(alarms, "r1", NOW, since="2026-06-29 11:59:40"))}
    assert feed == {(at(-20), "history"), (at(-60), "live")}
    assert [row["phase"] for row in plain(falls.alarm_feed(alarms, "r1", NOW))] == ["live"]


def test_reconcile(spark):
    log = events(spark, [fall(at(0), at(1)), fall(at(0), at(2)), fall(at(5), at(6)), fall(at(5), at(6), room="r2")])
    alarms = falls.alarms_from_falls(log)
    one, twice = alarms.where("room_id = 'r1'").limit(1), alarms.where("room_id = 'r2'")
    verdicts = {row["room_id"]: (row["delta"], row["verdict"]) for row in plain(falls.reconcile(log, one.union(twice).union(twice)))}
    assert verdicts == {"r1": (-1, "miss"), "r2": (1, "leak")}
    assert {row["verdict"] for row in plain(falls.reconcile(log, alarms))} == {"match"}


def test_positions_in_a_room_cross_slices(spark):
    rng = random.Random(2)
    alarms = falls.alarms_from_falls(events(spark, [fall(at(s), at(s + 1), device=f"d{s % 3}", room=f"r{s % 2}") for s in rng.sample(range(500), 200)]))
    rows = plain(ordering.room_alarm_positions(alarms, slice_seconds=30))
    for room in ("r0", "r1"):
        mine = sorted((r for r in rows if r["room_id"] == room), key=lambda r: (r["ts"], r["received_at"], r["dedup_key"]))
        assert [r["position"] for r in mine] == list(range(1, len(mine) + 1))


def test_latency_percentile(spark):
    ddl = "received_at TIMESTAMP, dispatched_at TIMESTAMP, dedup_key STRING"
    rows = [(at(i), at(i) + timedelta(milliseconds=m), str(i)) for i, m in enumerate([*range(1, 101)])]
    frame = spark.createDataFrame(rows, ddl)
    assert metrics.alarm_latency_p95(frame).first()[0] == 95
    assert metrics.alarm_latency_p95(frame, samples=20).first()[0] == 99
    assert metrics.alarm_latency_p95(frame.where("false")).first()[0] == 0
    half = spark.createDataFrame([(at(0), at(0) + timedelta(microseconds=us), "k") for us in (2500,)], ddl)
    assert metrics.alarm_latency_p95(half).first()[0] == 2
    early = spark.createDataFrame([(at(1), at(0), "k")], ddl)
    assert metrics.alarm_latency(early).first()["latency_ms"] == 0.0


def test_openings_read_their_input_in_one_bounded_plan(spark):
    path = new_table_path(spark, "times")
    chain = [("long", 7 * k) for k in range(40)] + [(f"k{k % 9}", 100 * k) for k in range(60)]
    spark.createDataFrame([*chain, (None, 3)], "k string, t long").write.parquet(path)
    found = openings(spark.read.parquet(path), ["k"], 10)
    assert sorted(r["t"] for r in found.collect() if r["k"] == "long") == list(range(0, 280, 14))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # What is left is the union of the rounds: the input is not read again, and no round is planned within another.
    assert path not in " ".join(found.inputFiles()) and "Join" not in plan and "Window" not in plan
    assert found.where("k is null").count() == 0
