from datetime import timedelta

import pytest
from conftest import at, event, events, plain
from pyspark.sql import functions as F

from wardwatch.operators import falls
from wardwatch.session import new_table_path
from wardwatch.sources import alarm_table, event_log
from wardwatch.streaming import ingest
from wardwatch.streaming.reconcile import read_reconciled, start_reconcile


class Site:
    """A log, an alarm table, and the job between them."""

    def __init__(self, spark):
        self.spark, self.path = spark, new_table_path(spark, "site")
        self.raised = 0

    def log(self, *rows):
        arrivals = events(self.spark, list(rows)).withColumns(
            {
                "raw": F.lit("{}"),
                "reason": F.lit(None).cast("string"),
                "offset_seconds": F.lit(0.0),
                "outcome": F.lit("accepted"),
                "event_date": F.to_date("received_at"),
            }
        )
        event_log.append_arrivals(arrivals, f"{self.path}/log")

    def alarm(self, *rows, key=None):
        self.raised += 1
        found = falls.alarms_from_falls(events(self.spark, list(rows)))
        if key is not None:
            found = found.withColumn("dedup_key", F.lit(key))
        alarm_table.append_alarms(found, f"{self.path}/alarms", f"b{self.raised}")

    def run(self, **options):
        job = start_reconcile(self.spark, f"{self.path}/log", f"{self.path}/alarms", f"{self.path}/table", f"{self.path}/checkpoint", **options)
        job.awaitTermination()
        self.job = job
        rows = plain(read_reconciled(self.spark, f"{self.path}/table"))
        return sorted((row["room_id"], row["expected"], row["alarms"], row["verdict"]) for row in rows)


def fall(ts, room, received_at=None):
    return event("fall_warn", ts, received_at, room=room, confidence=0.9)


def tick(ts):
    return event("heartbeat", ts, room="quiet")


def test_planted_miss_leaks_and_match(spark):
    site = Site(spark)
    kept, lost, twice = fall(at(0), "kept"), fall(at(1), "lost"), fall(at(2), "twice")
    copies = [fall(at(0), "kept", at(6 * n)) for n in range(1, 5)]
    site.log(kept, lost, twice, *copies, tick(at(5)))
    site.alarm(kept, twice)
    site.alarm(twice)
    site.alarm(fall(at(3), "stray"), key="dedup:none")
    assert site.run() == []  # nobody's time is over
    site.log(tick(at(10_000)))  # an event of another type ends the wait, alarms or not
    assert site.run() == [("kept", 1, 1, "match"), ("lost", 1, 0, "miss"), ("stray", 0, 1, "leak"), ("twice", 1, 2, "leak")]
    assert site.run() == [("kept", 1, 1, "match"), ("lost", 1, 0, "miss"), ("stray", 0, 1, "leak"), ("twice", 1, 2, "leak")]
    ingest.raise_if_dropped(site.job)


def test_an_alarm_in_time_is_a_match_and_one_too_late_is_dropped_loudly(spark):
    site = Site(spark)
    first, second = fall(at(0), "soon"), fall(at(4000), "late")
    site.log(first, tick(at(60)))
    site.alarm(fall(at(9000), "ahead"))  # ahead of the log: it waits and does not move the clock
    assert site.run() == []
    site.alarm(first)
    site.log(second, tick(at(8000)))
    assert site.run() == [("soon", 1, 1, "match")]
    site.log(tick(at(12_000)), fall(at(9000), "ahead"))
    assert site.run() == [("late", 1, 0, "miss"), ("soon", 1, 1, "match")]
    ingest.raise_if_dropped(site.job)
    site.alarm(second)
    site.log(tick(at(17_000)))
    assert site.run() == [("ahead", 1, 1, "match"), ("late", 1, 0, "miss"), ("soon", 1, 1, "match")]
    with pytest.raises(RuntimeError):
        ingest.raise_if_dropped(site.job)


def test_falls_without_usable_confidence_and_copies_at_the_end_of_a_second(spark):
    site = Site(spark)
    unusable = event("fall_warn", at(0), room="bad", confidence=None)
    first, copy = fall(at(1.2), "edge"), fall(at(1.9), "edge", at(1.2) + timedelta(minutes=50))
    site.log(unusable, first, copy, tick(at(20_000)))
    site.alarm(first)
    assert site.run() == [("edge", 1, 1, "match")]


def test_copies_are_combined_before_the_exchange(spark):
    site = Site(spark)
    site.log(*[fall(at(0), "hot", at(0.001 * n)) for n in range(500)], tick(at(20_000)))
    site.alarm(fall(at(0), "hot"))
    assert site.run() == [("hot", 1, 1, "match")]
    # The aggregation keeps one row per key, whatever the number of copies.
    assert max(op["numRowsTotal"] for p in site.job.recentProgress for op in p["stateOperators"]) <= 2
