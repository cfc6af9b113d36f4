"""Streaming fall de-duplication, the alarm job, and the feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wardwatch.operators.falls import alarm_feed, alarms_from_falls, arrivals_of, labelled
from wardwatch.operators.holding import openings
from wardwatch.schema import ALARM_DDL, DEDUP_TTL_SECONDS, MICROS
from wardwatch.sources import keyed_state
from wardwatch.sources.alarm_table import append_alarms, insert_or_ignore, read_alarms, store_alarms, stream_alarms
from wardwatch.sources.event_log import stream_log

COUNTER_DDL = "batch STRING, falls BIGINT, new_alarms BIGINT, repeats_in_batch BIGINT, already_stored BIGINT"
OUTCOME_DDL = "dedup_key STRING, received_at TIMESTAMP, outcome STRING, copies BIGINT"
#: A key and the receipt, in microseconds, from which its time-to-live runs. Rows of a key add up; the latest counts.
KEYS, KEY_DDL = "keys", "dedup_key STRING, last_open BIGINT"
FRESH = "fresh"


def _day(ts: Column) -> Column:
    """Bucket of a key: the day of its fall. A key fixes the second, so its copies have one bucket."""
    return F.unix_date(F.to_date(ts)).cast("bigint")


def _known(version: keyed_state.Version, spark: SparkSession, days: list[int]) -> DataFrame:
    rows = version.read(spark, KEYS, KEY_DDL, days)
    return rows.groupBy("dedup_key").agg(F.max("last_open").alias("last_open"))


def _first_version(spark: SparkSession, alarm_path: str, state_path: str) -> keyed_state.Version | None:
    """State filled from an alarm table that was there before it: read once, when the job has no state."""
    stored = read_alarms(spark, alarm_path)
    rows = stored.select("dedup_key", F.unix_micros("received_at").alias("last_open"), _day(F.col("ts")).alias("bucket"))
    places = keyed_state.written(spark, state_path, KEYS, rows)
    return keyed_state.commit(spark, state_path, None, "alarm table", "", keyed_state.added(None, KEYS, places))


def _publish(spark: SparkSession, version: keyed_state.Version, alarm_path: str, again: bool) -> None:
    """Append the alarms that a version found. ``again``: only those that are missing, as its write may have been cut short."""
    fresh = version.read(spark, FRESH, ALARM_DDL)
    if again:
        store_alarms(fresh, alarm_path, version.writer)
    else:
        append_alarms(fresh, alarm_path, version.writer)


def start_alarms(
    spark: SparkSession,
    log_path: str,
    alarm_path: str,
    checkpoint: str,
    max_files_per_trigger: int = 1000,
    counters_path: str | None = None,
    outcomes_path: str | None = None,
    ttl_seconds: int = DEDUP_TTL_SECONDS,
    state_path: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Alarms from the log into the alarm table; F3 and M2 while it runs.

    Keyed state holds every key with its last accepted receipt, in buckets by the day of the fall (``state_path``, beside the alarm table unless
    given). A batch reads the days of its own falls and adds to them, so no batch scans the alarm table; that happens once, when a job
    without state starts on a table with alarms. There is no watermark: falls may come in any order of receipt and none is dropped, and the table
    stays free of duplicates even when the checkpoint is lost and the log is read again.

    A batch commits its keys and alarms as one state version and then appends the alarms; a batch that is repeated, or a job that starts, adds what is
    missing of the newest version. With ``counters_path`` the counters of each batch (M2), with ``outcomes_path`` the classes of its falls (F3) are
    written there, before the commit. A fall that is received before the last accepted copy of its key counts as in its window.
    """
    state_path = state_path or f"{alarm_path.rstrip('/')}-keys"
    ttl = ttl_seconds * MICROS

    def store(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        # Kept in the checkpoint: the same on restart, new when the checkpoint is new.
        name = f"{session.sparkContext.getLocalProperty('sql.streaming.queryId')}-{batch_id}"
        previous = keyed_state.latest(session, state_path)
        if previous is None:
            previous = _first_version(session, alarm_path, state_path)
        elif previous.writer == name or batch_id == 0:
            _publish(session, previous, alarm_path, again=True)
        if previous.writer == name:
            return
        falls = batch.persist()
        candidates = alarms_from_falls(falls).withColumn("bucket", _day(F.col("ts"))).persist()
        try:
            days = keyed_state.touched(candidates)
            if not days:
                return
            known = _known(previous, session, days).persist()
            fresh = insert_or_ignore(candidates, known)
            arrivals = arrivals_of(falls)
            free = arrivals.join(known, "dedup_key", "left").where(F.col("last_open").isNull() | (F.col("t") >= F.col("last_open") + ttl))
            first = free.groupBy("dedup_key").agg(F.min(F.when(F.col("last_open").isNull(), F.col("t"))).alias("first"))
            outcome = F.when(F.col("t") == F.col("first"), "new").otherwise("dedup_post_ttl")
            accepted = openings(free.select("dedup_key", "t"), ["dedup_key"], ttl).join(first, "dedup_key")
            accepted = accepted.select("dedup_key", "t", outcome.alias("outcome")).persist()
            if outcomes_path is not None:
                labelled(arrivals, accepted).write.mode("overwrite").parquet(f"{outcomes_path}/{name}")
            if counters_path is not None:
                total = falls.agg(F.count_if(F.col("confidence").isNotNull()).alias("falls")).first()["falls"]
                keys, new = candidates.count(), fresh.count()
                row = [(name, total, new, total - keys, keys - new)]
                session.createDataFrame(row, COUNTER_DDL).coalesce(1).write.mode("overwrite").parquet(f"{counters_path}/{name}")
            opened = accepted.groupBy("dedup_key").agg(F.max("t").alias("last_open")).join(candidates.select("dedup_key", "bucket"), "dedup_key")
            places = keyed_state.added(previous, KEYS, keyed_state.written(session, state_path, KEYS, opened))
            for day in keyed_state.crowded({k: v for k, v in places.items() if k[1] in days}):
                every = keyed_state.Version(0, "", "", places)
                one = _known(every, session, [day]).withColumn("bucket", F.lit(day))
                places[KEYS, day] = tuple(keyed_state.written(session, state_path, KEYS, one).values())
            found = keyed_state.written(session, state_path, FRESH, fresh.withColumn("bucket", F.lit(0)))
            places |= keyed_state.replaced(None, FRESH, [], found)
            version = keyed_state.commit(session, state_path, previous, name, "", places)
            _publish(session, version, alarm_path, again=False)
        finally:
            for frame in (falls, candidates):
                frame.unpersist()

    falls = stream_log(spark, log_path, max_files_per_trigger).where(F.col("type") == "fall_warn")
    return (
        falls.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def alarm_outcomes(spark: SparkSession, outcomes_path: str) -> DataFrame:
    """F3 of the running job: the classes of the falls of all batches. Equal rows of two batches are falls of the same microsecond."""
    rows = spark.read.schema(OUTCOME_DDL).parquet(f"{outcomes_path}/*")
    return rows.groupBy("dedup_key", "received_at", "outcome").agg(F.sum("copies").alias("copies"))


def alarm_counters(spark: SparkSession, counters_path: str) -> DataFrame:
    """M2 of the running job: one row per batch."""
    return spark.read.schema(COUNTER_DDL).parquet(f"{counters_path}/*")


def room_feed(spark: SparkSession, alarm_path: str, room_id: str, start, since: str | None = None) -> DataFrame:
    """feed of one room as a stream; stored alarms and new ones come from the same table, without a gap."""
    return alarm_feed(stream_alarms(spark, alarm_path), room_id, start, since)
