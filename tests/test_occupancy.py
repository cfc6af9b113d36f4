import random
from datetime import timedelta

import pytest
from conftest import NOW, at, event, events, plain

from wardwatch.operators import occupancy as O


def seen(ts, in_room, received_at=None, room="r1", seq=None, device="d1"):
    return event("presence", ts, received_at, device=device, room=room, seq=seq, in_room=in_room)


def report(spark, rows, window, **options):
    return {row["room_id"]: row for row in plain(O.room_occupancy(events(spark, rows), NOW, window, **options))}


def test_half_occupied_minute(spark):
    row = report(spark, [seen(at(-50), True), seen(at(-20), False)], 60)["r1"]
    assert (row["in_room"], row["occupied_pct"], row["window_seconds"]) == (False, 0.5, 60)


def test_room_without_presence(spark):
    rooms = spark.createDataFrame([("r1",), ("r9",)], "room_id STRING")
    row = report(spark, [seen(at(-50), True)], 60, rooms=rooms)["r9"]
    assert (row["in_room"], row["occupied_pct"]) == (False, 0.0)


@pytest.mark.parametrize("retain", [None, 3600])
def test_state_before_the_window_counts(spark, retain):
    row = report(spark, [seen(at(minutes=-90), True)], 3600, retain_seconds=retain)["r1"]
    assert (row["in_room"], row["occupied_pct"]) == (True, 1.0)


def test_backfill_out_of_order(spark):
    rows = [seen(at(minutes=-30), False, at(-20)), seen(at(minutes=-50), True, at(-10))]
    row = report(spark, rows, 3600)["r1"]
    assert (row["in_room"], round(row["occupied_pct"], 4)) == (False, 0.3333)


def test_presence_is_latest_by_time_and_first_on_ties(spark):
    rows = [seen(at(-10), True, at(-5)), seen(at(-20), False, at(-4)), seen(at(-10), False, at(-4), device="d2")]
    assert plain(O.current_presence(events(spark, rows), NOW)) == [{"room_id": "r1", "in_room": True, "ts": at(-10)}]
    same = [seen(at(-10), True, at(-5), seq=2), seen(at(-10), False, at(-5), seq=1)]
    assert plain(O.current_presence(events(spark, same), NOW))[0]["in_room"] is False


def test_rows_received_later_are_not_visible(spark):
    assert report(spark, [seen(at(-50), True, at(1))], 60) == {}


def test_retention_keeps_one_anchor(spark):
    rows = [seen(at(minutes=-m), m % 2 == 0, at(minutes=-m)) for m in (300, 200, 90, 70, 50, 10)]
    kept = sorted(row["ts"] for row in plain(O.retained_transitions(events(spark, rows), NOW, 3600)))
    assert kept == [at(minutes=-70), at(minutes=-50), at(minutes=-10)]


def fold(rows, window, now=NOW):
    """Occupied seconds and current presence of each room by replaying its events one by one."""
    result = {}
    for room in {row[1] for row in rows if row[4] <= now}:
        mine = [row for row in rows if row[1] == room and row[4] <= now]
        start = now - timedelta(seconds=window)
        state, since, total = False, start, 0.0
        for ts, in_room in sorted({(row[3], row[9]) for row in mine if row[3] <= now}):
            if state and ts > start:
                total += (ts - max(since, start)).total_seconds()
            state, since = in_room, ts
        if state:
            total += (now - max(since, start)).total_seconds()
        newest = max(row[3] for row in mine)
        first = min((row for row in mine if row[3] == newest), key=lambda row: (row[4], row[5]))
        result[room] = (first[9], round(total, 6))
    return result


def random_rows(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ts = at(rng.randint(-4000, 60) + rng.choice([0, 0.5, 0.000001]))
        received = ts + timedelta(seconds=rng.randint(-30, 90))
        rows.append(seen(ts, rng.random() < 0.5, received, room=f"r{rng.randint(0, 3)}", seq=i))
        if rng.random() < 0.3:
            rows.append(seen(ts, rng.random() < 0.5, received + timedelta(seconds=rng.randint(0, 2)), room=rows[-1][1], seq=i + 10_000))
    return rows


@pytest.mark.parametrize("seed,window,slice_seconds", [(1, 60, 7), (2, 600, 60), (3, 3600, 600), (4, 5000, 100_000), (5, 3600, 1)])
def test_random_logs_against_a_replay(spark, seed, window, slice_seconds):
    rows = random_rows(seed)
    log = events(spark, rows)
    seconds = {r["room_id"]: r["occupied_seconds"] for r in plain(O.occupied_seconds(log, NOW, window, slice_seconds=slice_seconds))}
    current = {r["room_id"]: r["in_room"] for r in plain(O.room_occupancy(log, NOW, window, slice_seconds=slice_seconds))}
    assert {room: (current[room], round(seconds[room], 6)) for room in seconds} == fold(rows, window)


def test_many_windows_equal_single_windows(spark):
    rows = random_rows(9)
    log = events(spark, rows)
    answers = plain(O.occupancy_windows(log, NOW, ["1m", "10m", "1h", "0", "x"], slice_seconds=120))
    for text, window in (("1m", 60), ("10m", 600), ("1h", 3600)):
        single = {r["room_id"]: (r["in_room"], r["occupied_pct"]) for r in plain(O.room_occupancy(log, NOW, window))}
        assert {r["room_id"]: (r["in_room"], r["occupied_pct"]) for r in answers if r["window"] == text} == single
    bad = [r for r in answers if r["window"] in ("0", "x")]
    assert len(bad) == 8 and all(r["status"] == "invalid_window" and r["occupied_pct"] is None for r in bad)


def test_initial_state(spark):
    rows = [seen(at(-100), True), seen(at(-70), False), seen(at(-60), True), seen(at(-10), False), seen(at(-5), True, room="r2")]
    found = {r["room_id"]: r["initial_in_room"] for r in plain(O.initial_state(events(spark, rows), NOW, 60))}
    assert found == {"r1": True, "r2": False}


def trim_per_event(rows, retain=3600):
    """Transitions left per room when the set is trimmed after each event, in arrival order."""
    kept = {}
    for row in sorted(rows, key=lambda r: r[4]):
        cutoff = row[4] - timedelta(seconds=retain)
        held = kept.setdefault(row[1], set())
        anchors = [ts for ts, _ in held if ts <= cutoff] + ([row[3]] if row[3] <= cutoff else [])
        floor = max(anchors) - timedelta(milliseconds=1) if anchors else cutoff
        held.add((row[3], row[9]))
        kept[row[1]] = {item for item in held if item[0] > floor}
    return {(room, *item) for room, held in kept.items() for item in held}


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_one_trim_equals_a_trim_per_event(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        received = at(rng.randint(-20_000, 0))
        rows.append(seen(received - timedelta(seconds=rng.randint(-3600, 3599)), rng.random() < 0.5, received, room=f"r{i % 3}"))
    found = plain(O.retained_transitions(events(spark, rows), NOW, 3600))
    assert {(r["room_id"], r["ts"], r["in_room"]) for r in found} == trim_per_event(rows)


@pytest.mark.parametrize("retain", [None, 3600])
def test_all_rooms_equals_listed_rooms_and_needs_one_scan(spark, retain):
    rows = [event("presence", at(-50), in_room=True, room="r1"), event("presence", at(-20), in_room=False, room="r1")]
    rows += [event("motion", at(-5), room="r2"), event("heartbeat", at(500), at(500), room="later")]
    frame = events(spark, rows)
    listed = O.room_occupancy(frame, NOW, 60, rooms=O.rooms_seen(frame, NOW), retain_seconds=retain)
    found = O.room_occupancy(frame, NOW, 60, retain_seconds=retain, all_rooms=True)
    assert sorted(map(str, plain(found))) == sorted(map(str, plain(listed)))
    assert {row["room_id"] for row in plain(found)} == {"r1", "r2"}
    if retain is None:
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial")[0]
        assert plan.count("Scan") == 1 and "Join" not in plan


def asked(spark, rows):
    return spark.createDataFrame(rows, "room_id STRING, moment TIMESTAMP_NTZ")


@pytest.mark.parametrize("seed,slice_seconds", [(21, 7), (22, 600), (23, 100_000)])
def test_presence_at_many_moments_against_a_search(spark, seed, slice_seconds):
    rng = random.Random(seed)
    rows = random_rows(seed)
    moments = [(f"r{rng.randint(0, 4)}", at(rng.randint(-4200, 100))) for _ in range(300)]
    moments += [(row[1], row[3]) for row in rows[:50]] + moments[:20]
    moments += [(row[1], row[3] - timedelta(microseconds=1)) for row in rows[:50]]
    found = plain(O.presence_at(events(spark, rows), asked(spark, moments), NOW, slice_seconds))
    expected = set()
    for room, moment in set(moments):
        past = [(row[3], row[9]) for row in rows if row[1] == room and row[4] <= NOW and row[3] <= moment]
        since, state = max(past) if past else (None, False)
        expected.add((room, moment, state, since))
    assert {tuple(row.values()) for row in found} == expected and len(found) == len(expected)


def test_presence_at_without_room_moment_or_rows(spark):
    log = events(spark, [seen(at(-50), True)])
    blank = asked(spark, [(None, at(0)), ("r1", None), (None, None), ("r1", at(-50))])
    found = {(row["room_id"], row["moment"]): (row["in_room"], row["since"]) for row in plain(O.presence_at(log, blank, NOW))}
    nothing = (False, None)
    assert found == {(None, at(0)): nothing, ("r1", None): nothing, (None, None): nothing, ("r1", at(-50)): (True, at(-50))}
    assert plain(O.presence_at(events(spark, []), asked(spark, [("r1", at(0))]), NOW))[0]["in_room"] is False
    assert plain(O.presence_at(log, asked(spark, []), NOW)) == []


def test_presence_at_spreads_a_hot_room_and_reads_once(spark):
    rows = [seen(at(-60 * i), i % 3 == 0) for i in range(4000)]
    found = O.presence_at(events(spark, rows), asked(spark, [("r1", at(-30 * i)) for i in range(8000)]), NOW, 600)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert len(found.collect()) == 8000
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("ReusedExchange") >= 1 and "BroadcastExchange" not in plan
