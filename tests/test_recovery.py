import random
from datetime import timedelta

import pytest
from conftest import NOW, at, event, events, plain

from wardwatch.operators import recovery
from wardwatch.session import new_table_path
from wardwatch.sources import snapshots


def random_log(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        received = at(rng.randint(-9000, 0))
        ts = received - timedelta(seconds=rng.randint(-3600, 3600) if rng.random() < 0.3 else rng.randint(-5, 40))
        if rng.random() < 0.5:
            rows.append(event("heartbeat", ts, received, device=f"d{i % 4}", seq=i))
        else:
            rows.append(event("presence", ts, received, room=f"r{i % 3}", in_room=rng.random() < 0.5, seq=i))
    return rows


def contents(state):
    return {name: sorted(map(str, (sorted(row.items()) for row in plain(state[name])))) for name in recovery.STATE_TABLES}


@pytest.mark.parametrize("seed,cut", [(1, -8000), (2, -4500), (3, -100)])
def test_restore_equals_full_replay(spark, seed, cut):
    log = events(spark, random_log(seed))
    moment = at(cut)
    before = log.where(f"received_at < timestamp '{moment}'")
    folder = new_table_path(spark, "state")
    snapshots.write_snapshot(recovery.state_as_of(before, NOW), folder, 5, moment)
    latest = snapshots.read_latest(spark, folder)
    assert (latest.version, latest.snapshot_ts) == (5, moment)
    restored = recovery.restore_state(log, latest.state, latest.snapshot_ts, NOW)
    assert contents(restored) == contents(recovery.state_as_of(log, NOW))


def test_merging_twice_changes_nothing(spark):
    log = events(spark, random_log(4))
    state = recovery.state_as_of(log, NOW)
    assert contents(recovery.merge_state([state, state, recovery.contributions(log)])) == contents(state)


def test_order_of_batches_does_not_matter(spark):
    rows = random_log(5)
    random.Random(0).shuffle(rows)
    parts = [recovery.contributions(events(spark, rows[i::3])) for i in range(3)]
    assert contents(recovery.merge_state(parts)) == contents(recovery.state_as_of(events(spark, random_log(5)), NOW))


def test_replay_starts_at_the_receipt_of_the_snapshot(spark):
    rows = [event("heartbeat", at(minutes=m), at(minutes=m), device=f"d{-m}") for m in (-3, -2, -1)]
    rows.append(event("heartbeat", at(minutes=-20), at(minutes=-1), device="late"))
    empty = recovery.merge_state([recovery.contributions(events(spark, []))])
    state = recovery.restore_state(events(spark, rows), empty, at(minutes=-2), NOW)
    assert sorted(row["device_id"] for row in plain(state["device_last"])) == ["d1", "d2", "late"]


def test_snapshot_without_commit_is_ignored(spark, monkeypatch):
    folder = new_table_path(spark, "state")
    assert snapshots.read_latest(spark, folder) is None
    state = recovery.state_as_of(events(spark, random_log(6)), NOW)
    snapshots.write_snapshot(state, folder, 1, NOW)

    def crash(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(snapshots, "_commit", crash)
    with pytest.raises(RuntimeError):
        snapshots.write_snapshot(state, folder, 2, NOW)
    assert snapshots.read_latest(spark, folder).version == 1


def test_a_held_version_outlives_later_ones_until_it_is_removed(spark):
    folder = new_table_path(spark, "state")
    state = recovery.state_as_of(events(spark, random_log(7, 20)), NOW)
    snapshots.write_snapshot(state, folder, 0, NOW)
    held, before = snapshots.read_latest(spark, folder), contents(state)
    for version in range(1, 7):
        snapshots.write_snapshot(state, folder, version, NOW, f"w{version}")
    assert contents(held.state) == before
    latest = snapshots.read_latest(spark, folder)
    assert (latest.version, latest.writer) == (6, "w6")
    assert snapshots.read_latest(spark, folder, before=3).version == 2
    assert snapshots.remove_versions(spark, folder, 5) == 5
    assert snapshots.read_latest(spark, folder, before=6).version == 5
    assert snapshots.read_latest(spark, folder, before=5) is None
    assert snapshots.remove_versions(spark, folder, 100) == 1
    assert contents(snapshots.read_latest(spark, folder).state) == before


def test_some_tables_only(spark):
    log = events(spark, random_log(8, 60))
    full = recovery.state_as_of(log, NOW)
    some = recovery.merge_state([recovery.contributions(log)], tables=("device_last", "room_presence"))
    again = recovery.merge_state([some, recovery.contributions(log)], tables=("device_last", "room_presence"))
    for name in ("device_last", "room_presence"):
        assert sorted(map(str, plain(again[name]))) == sorted(map(str, plain(full[name])))
    assert set(again) == {"device_last", "room_presence"}
