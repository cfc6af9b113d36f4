import random

import pytest
from conftest import at, event, events, plain
from pyspark.sql import functions as F

from wardwatch.operators import health
from wardwatch.session import new_table_path
from wardwatch.sources import event_log, keyed_state
from wardwatch.streaming.availability import read_beats, running_health, start_availability


def grow(spark, path, rows):
    """Append event rows to a log, one file each time, so a later file is a later batch."""
    arrivals = events(spark, rows).withColumn("outcome", F.lit("accepted")).withColumn("event_date", F.to_date("ts"))
    arrivals.coalesce(1).write.mode("append").partitionBy("outcome", "event_date").parquet(path)


def beats(rng, n, first, last):
    """Beats of a hot device and some others, with copies, future times, and receipts that go back."""
    rows = []
    for _ in range(n):
        ts = at(rng.randint(first, last) + rng.choice([0, 0, 0.000001, 0.5]))
        received = ts if rng.random() < 0.2 else at(rng.randint(first, last))
        rows.append(event("heartbeat", ts, received, device=rng.choice(["hot", "hot", "hot", "d1", "d2", f"d{first}"])))
    return rows + rows[: n // 10] + [event("presence", at(first), in_room=True)]


def run(spark, folder, checkpoint="checkpoint", window=300, slot=None):
    job = start_availability(spark, f"{folder}/log", f"{folder}/ring", f"{folder}/{checkpoint}", window, slot, 3)
    job.awaitTermination()
    return job


def sets(frame):
    return sorted((tuple(sorted(r.items())) for r in plain(frame)), key=str)


@pytest.mark.parametrize("slot", [70, 1000])
def test_ring_equals_the_log_after_each_batch(spark, slot):
    folder, rng, log, newest = new_table_path(spark, "ring-of-beats"), random.Random(slot or 0), [], None
    for n, first, last in [(40, 0, 200), (60, 150, 420), (5, -900, -800), (30, 400, 2000), (20, 100, 2000)]:
        rows = beats(rng, n, first, last)
        log += rows
        grow(spark, f"{folder}/log", rows)
        run(spark, folder, slot=slot)
        newest = max(r[4] for r in log if r[2] == "heartbeat")
        for moment in (newest, newest + (at(137) - at(0)))[: 1 + (first == 150)]:
            got = running_health(spark, f"{folder}/ring", moment, 300, 10.0)
            assert sets(got) == sets(health.device_health(events(spark, log), moment, 300, 10.0))
            assert sets(read_beats(spark, f"{folder}/ring", moment, 300)) == sets(
                health.recent_beats(events(spark, log), moment, 300).where(F.col("ts") <= F.lit(moment).cast("timestamp_ntz").cast("timestamp"))
            )
    before = sets(running_health(spark, f"{folder}/ring", newest, 120))
    run(spark, folder, "lost", slot=slot)  # the whole log is read again
    assert sets(running_health(spark, f"{folder}/ring", newest, 120)) == before
    assert before == sets(health.device_health(events(spark, log), newest, 120))


def test_slots_expire_and_a_batch_writes_its_own_alone(spark):
    folder = new_table_path(spark, "ring-slots")
    for first in (0, 100, 1000):
        grow(spark, f"{folder}/log", [event("heartbeat", at(first + i), device=f"d{i % 2}") for i in range(20)])
        before = keyed_state.latest(spark, f"{folder}/ring")
        run(spark, folder, slot=60)
        after = keyed_state.latest(spark, f"{folder}/ring")
        slots = {b for t, b in after.places if t == "beats"}
        if first == 100:  # 0-19 s and 100-119 s are both held; the first slot keeps its file
            assert len(slots) == 2 and min(slots) == min(b for t, b in before.places if t == "beats")
            assert after.places["beats", min(slots)] == before.places["beats", min(slots)]
    assert len(slots) == 1
    assert {r["device_id"]: r["beats"] for r in plain(running_health(spark, f"{folder}/ring", at(1020)))} == {"d0": 10, "d1": 10}


def test_many_small_batches_do_not_leave_many_places(spark):
    folder = new_table_path(spark, "ring-small")
    for i in range(8):
        grow(spark, f"{folder}/log", [event("heartbeat", at(i))])
        run(spark, folder, slot=3600)
    assert max(len(p) for p in keyed_state.latest(spark, f"{folder}/ring").places.values()) < keyed_state.MOST_PLACES
    assert plain(running_health(spark, f"{folder}/ring", at(11)))[0]["beats"] == 8


def test_before_the_first_batch_and_questions_the_ring_cannot_answer(spark):
    folder = new_table_path(spark, "ring-empty")
    assert running_health(spark, f"{folder}/ring", at(0)).collect() == []
    grow(spark, f"{folder}/log", [event("presence", at(0), in_room=True)])
    run(spark, folder)
    assert read_beats(spark, f"{folder}/ring", at(0)).collect() == []
    grow(spark, f"{folder}/log", [event("heartbeat", at(5), at(6))])
    run(spark, folder)
    for moment, window in ((at(5), 300), (at(6), 301)):
        with pytest.raises(ValueError):
            read_beats(spark, f"{folder}/ring", moment, window)
    assert len(plain(read_beats(spark, f"{folder}/ring", at(6), 300))) == 1
