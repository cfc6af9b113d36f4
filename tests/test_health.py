import random
from datetime import timedelta

from conftest import NOW, at, event, events, plain

from wardwatch.operators import health, ordering


def beat(ts, received_at=None, device="d1"):
    return event("heartbeat", ts, received_at, device=device)


def test_an_older_beat_does_not_replace_a_newer_one(spark):
    log = events(spark, [beat(at(-60)), beat(at(-90), at(-59))])
    assert plain(health.last_heartbeat(log, NOW)) == [{"device_id": "d1", "last_heartbeat_ts": at(-60)}]


def test_future_beats_set_the_last_beat_but_not_availability(spark):
    log = events(spark, [beat(at(600), at(-1)), beat(at(-10)), beat(at(-5), at(5))])
    (row,) = plain(health.device_health(log, NOW))
    assert (row["last_heartbeat_ts"], row["beats"], row["availability"]) == (at(600), 1, 1 / 300)


def test_window_is_closed_and_equal_beats_are_one(spark):
    rows = [beat(at(-300)), beat(at(-300), at(-298)), beat(at(0), at(0)), beat(at(-300.000001), at(-299))]
    (row,) = plain(health.availability(events(spark, rows), NOW))
    assert row["beats"] == 2
    assert len(plain(health.recent_beats(events(spark, rows), NOW))) == 2


def test_availability_is_at_most_one(spark):
    log = events(spark, [beat(at(-i / 2), at(-i / 2)) for i in range(700)])
    assert plain(health.availability(log, NOW))[0]["availability"] == 1.0


def test_device_without_beats_is_absent(spark):
    assert plain(health.device_health(events(spark, [event("motion", at(-5))]), NOW)) == []


def test_random_beats_against_a_plain_count(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        ts = at(rng.randint(-400, 100))
        rows.append(beat(ts, ts + timedelta(seconds=rng.randint(-60, 60)), device=f"d{rng.randint(0, 3)}"))
    expected = {}
    for device, _, _, ts, received_at, *_ in rows:
        if received_at <= NOW:
            last, beats = expected.get(device, (ts, set()))
            expected[device] = (max(last, ts), beats | ({ts} if at(-300) <= ts <= NOW else set()))
    found = plain(health.device_health(events(spark, rows), NOW))
    assert {row["device_id"]: (row["last_heartbeat_ts"], row["beats"]) for row in found} == {
        device: (last, len(beats)) for device, (last, beats) in expected.items()
    }


def test_orders(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        kind = rng.choice(["fall_warn", "motion"])
        rows.append(event(kind, at(rng.randint(-20, 20)), at(rng.randint(0, 5)), device=f"d{rng.randint(0, 2)}", seq=i, confidence=0.5))
    log = events(spark, rows)
    by_device = [(r["device_id"], r["ts"], r["received_at"], r["seq"]) for r in plain(ordering.device_order(log))]
    assert by_device == sorted(by_device) and len(by_device) == 300
    by_priority = [(r["priority"] != "high", r["received_at"], r["seq"]) for r in plain(ordering.priority_order(log))]
    assert by_priority == sorted(by_priority)
