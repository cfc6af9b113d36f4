import random
from datetime import timedelta

import pytest
from conftest import EVENT_DDL, at, event, events, plain
from pyspark.sql import functions as F

from wardwatch.operators import holding
from wardwatch.session import new_table_path
from wardwatch.sources import keyed_state
from wardwatch.streaming import ordered

ORDER = ("ts", "received_at", "seq")


def arrivals(seed, n=300):
    rng, rows, received = random.Random(seed), [], at(0)
    for i in range(n):
        received += timedelta(seconds=rng.choice([0, 0.5, 1, 3, 20]))
        rows.append(event("motion", received - timedelta(seconds=rng.choice([0, 1, 2, 8, 30])), received, device=f"d{rng.choice([0, 0, 0, 1, 2])}", seq=i))
    return rows


def by_hand(rows, hold):
    """Device to sequence numbers in the order of release: windows from the first receipt, ts order inside."""
    out = {}
    for device in {r[0] for r in rows}:
        windows = []
        for r in sorted((r for r in rows if r[0] == device), key=lambda r: r[4]):
            if not windows or r[4] >= windows[-1][0] + timedelta(seconds=hold):
                windows.append((r[4], []))
            windows[-1][1].append(r)
        out[device] = [r[5] for _, held in windows for r in sorted(held, key=lambda r: (r[3], r[4], r[5]))]
    return out


def order_of(frame):
    rows = sorted(plain(frame), key=lambda r: (r["released_at"], r["ts"], r["received_at"], r["seq"]))
    return {d: [r["seq"] for r in rows if r["device_id"] == d] for d in {r["device_id"] for r in rows}}


@pytest.mark.parametrize("hold", [0.4, 5, 60])
def test_release_in_one_batch(spark, hold):
    rows = arrivals(1)
    assert order_of(holding.released(events(spark, rows), ["device_id"], hold)) == by_hand(rows, hold)


def stream(spark, folder, per_batch):
    ddl = EVENT_DDL.replace("_NTZ", "")
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", per_batch).parquet(folder)


def write(spark, folder, rows, files):
    size = -(-len(rows) // files)
    for k in range(0, len(rows), size):
        events(spark, rows[k : k + size]).coalesce(1).write.mode("append").parquet(folder)


def test_late_rows_in_the_next_batch_come_out_in_order(spark):
    rows, base = arrivals(2), new_table_path(spark, "reorder")
    for part in (rows[:170], rows[170:]):
        write(spark, f"{base}/in", part, 3)
        source = stream(spark, f"{base}/in", 1)
        ordered.start_ordered(source, f"{base}/out", f"{base}/checkpoint", ["device_id"], 15, ORDER).awaitTermination()
    shown = ordered.read_ordered(spark, f"{base}/out", source.schema)
    held = len(rows) - shown.count()
    assert held > 0
    before = order_of(shown)
    want = by_hand(rows, 15)
    assert all(want[d][: len(seen)] == seen for d, seen in before.items())
    ordered.drain(spark, f"{base}/out", source.schema, ["device_id"], 15, ORDER)
    assert order_of(ordered.read_ordered(spark, f"{base}/out", source.schema)) == want
    # Some batch held rows that a later one completed.
    assert keyed_state.latest(spark, f"{base}/out/state").number >= 6


def test_rows_far_behind_are_kept_and_shown_last(spark):
    base = new_table_path(spark, "behind")
    first = [event("motion", at(s), at(s), seq=s) for s in (0, 10, 20, 40)]
    for part in (first, [event("motion", at(5), at(5), seq=99), event("motion", at(60), at(60), seq=60)]):
        write(spark, f"{base}/in", part, 1)
        source = stream(spark, f"{base}/in", 1)
        ordered.start_ordered(source, f"{base}/out", f"{base}/checkpoint", ["device_id"], 2, ORDER).awaitTermination()
    ordered.drain(spark, f"{base}/out", source.schema, ["device_id"], 2, ORDER)
    got = order_of(ordered.read_ordered(spark, f"{base}/out", source.schema))["d1"]
    assert sorted(got) == [0, 10, 20, 40, 60, 99] and got.index(99) > got.index(20)


@pytest.mark.parametrize("when", ["commit", "_publish"])
def test_a_batch_that_dies_is_finished_once(spark, monkeypatch, when):
    rows, base = arrivals(3, 120), new_table_path(spark, "dies")
    write(spark, f"{base}/in", rows, 3)
    source = stream(spark, f"{base}/in", 1)
    module = keyed_state if when == "commit" else ordered
    real, calls = getattr(module, when), []

    def dying(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(*args)

    monkeypatch.setattr(module, when, dying)
    start = lambda: ordered.start_ordered(source, f"{base}/out", f"{base}/checkpoint", ["device_id"], 15, ORDER)
    with pytest.raises(Exception):
        start().awaitTermination()
    start().awaitTermination()
    ordered.drain(spark, f"{base}/out", source.schema, ["device_id"], 15, ORDER)
    assert order_of(ordered.read_ordered(spark, f"{base}/out", source.schema)) == by_hand(rows, 15)


def test_files_are_in_order(spark):
    rows, base = arrivals(4, 200), new_table_path(spark, "files")
    write(spark, f"{base}/in", rows, 1)
    source = stream(spark, f"{base}/in", 1)
    ordered.start_ordered(source, f"{base}/out", f"{base}/checkpoint", ["device_id"], 5, ORDER).awaitTermination()
    shown = plain(ordered.read_ordered(spark, f"{base}/out", source.schema).withColumn("file", F.input_file_name()))
    for name in {r["file"] for r in shown}:
        mine = [(r["released_at"], r["ts"]) for r in shown if r["file"] == name]
        assert mine == sorted(mine)
