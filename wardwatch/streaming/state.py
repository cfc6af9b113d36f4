"""Streaming derived state (T4, T5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wardwatch.functions.timeline import as_of_literal
from wardwatch.operators.recovery import STATE_TABLES, State, contributions, merge_state
from wardwatch.schema import BEAT_WINDOW_SECONDS, RETAIN_SECONDS
from wardwatch.sources import keyed_state
from wardwatch.sources.event_log import stream_log
from wardwatch.sources.snapshots import STATE_DDL, read_latest

#: T4: one row per device and one per room.
LATEST_TABLES = ("device_last", "room_presence")
STATE_KEYS = {"device_last": "device_id", "device_beats": "device_id", "room_presence": "room_id", "room_transitions": "room_id"}


def read_state(spark: SparkSession, folder: str) -> State | None:
    """The newest state; None before the first batch."""
    version = keyed_state.latest(spark, folder)
    if version is None:
        return None
    names = version.stamp.split(",")[1:]
    return {name: version.read(spark, name, STATE_DDL[name]) for name in names}


def start_from_snapshot(
    spark: SparkSession, snapshots_folder: str, state_folder: str, buckets: int = keyed_state.BUCKETS
) -> str | None:
    """R2 handover: the newest snapshot as the first version of the state; its time, from which the log is to be read.

    Does nothing, and answers with the state's own time, where there is a state; None without a snapshot, when the whole log is to be read.
    """
    there = keyed_state.latest(spark, state_folder)
    if there is not None:
        return there.stamp.split(",")[0]
    snapshot = read_latest(spark, snapshots_folder)
    if snapshot is None:
        return None
    places = {}
    for name, rows in snapshot.state.items():
        found = keyed_state.written(spark, state_folder, name, rows.withColumn("bucket", keyed_state.bucket_of(STATE_KEYS[name], buckets=buckets)))
        places |= keyed_state.replaced(None, name, [], found)
    stamp = snapshot.snapshot_ts.strftime("%Y-%m-%d %H:%M:%S.%f")
    keyed_state.commit(spark, state_folder, None, f"snapshot {snapshot.version}", ",".join([stamp, *snapshot.state]), places)
    return stamp


def start_state(
    spark: SparkSession,
    log_path: str,
    state_folder: str,
    checkpoint: str,
    beat_window: int = BEAT_WINDOW_SECONDS,
    retain_seconds: int = RETAIN_SECONDS,
    max_files_per_trigger: int = 1000,
    tables: Sequence[str] = STATE_TABLES,
    since: str | None = None,
    buckets: int = keyed_state.BUCKETS,
    **trigger,
) -> StreamingQuery:
    """T5: keep the state tables current from the log; T4 with ``tables=LATEST_TABLES``.

    State lies in hash buckets of the device or room. Each batch merges its own rows with the buckets of its devices and rooms and writes
    these alone; all others are carried over by name. Values are ranked by their own
    times and every merge may be repeated, so a lost or new checkpoint on the same folder starts from the state
    that is there, reads the log again, and never answers with less than it knew. The commit names the batch;
    a batch that is repeated after its commit writes nothing. ``since`` (R2) leaves out rows received before it: give the time that
    ``start_from_snapshot`` answers with. ``buckets`` stays the same for a folder.
    """

    def advance(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        query_id = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        writer = f"{query_id}-{batch_id}"
        previous = keyed_state.latest(session, state_folder)
        if previous is not None and previous.writer == writer:
            return
        rows = batch.persist()
        try:
            newest = rows.agg(F.date_format(F.max("received_at"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
            if newest is None:
                return
            if previous is not None:
                newest = max(newest, previous.stamp.split(",")[0])
            kinds = {"device_id": "heartbeat", "room_id": "presence"}
            mine = {
                key: keyed_state.touched(rows.where(F.col("type") == kind).select(keyed_state.bucket_of(key, buckets=buckets).alias("bucket")))
                for key, kind in kinds.items()
            }
            parts = [contributions(rows)]
            if previous is not None:
                held = {n: previous.read(session, n, STATE_DDL[n], mine[STATE_KEYS[n]]) for n in tables}
                parts.insert(0, held)
            merged = merge_state(parts, beat_window, retain_seconds, tables)
            places = {}
            for name in tables:
                key = STATE_KEYS[name]
                found = keyed_state.written(session, state_folder, name, merged[name].withColumn("bucket", keyed_state.bucket_of(key, buckets=buckets)))
                places |= keyed_state.replaced(previous, name, mine[key], found)
            keyed_state.commit(session, state_folder, previous, writer, ",".join([newest, *tables]), places)
        finally:
            rows.unpersist()

    stateful = stream_log(spark, log_path, max_files_per_trigger).where(F.col("type").isin("heartbeat", "presence"))
    if since is not None:
        start = as_of_literal(since)
        stateful = stateful.where((F.col("received_at") >= start) & (F.col("event_date") >= F.to_date(start)))
    return (
        stateful.writeStream.foreachBatch(advance)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
