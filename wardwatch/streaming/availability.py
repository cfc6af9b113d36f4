"""Running device health: beats in a ring of time slots that a job keeps (A1-A4)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wardwatch.functions.timeline import as_of_micros
from wardwatch.operators.health import device_health
from wardwatch.schema import BEAT_INTERVAL_SECONDS, BEAT_WINDOW_SECONDS, MICROS
from wardwatch.sources import keyed_state
from wardwatch.sources.event_log import stream_log

BEATS, BEATS_DDL = "beats", "device_id STRING, ts TIMESTAMP"
DEVICES, DEVICES_DDL = "devices", "device_id STRING, ts TIMESTAMP"
#: Slots of a ring, unless the job is given another width of a slot.
SLOTS = 60


def _slot(ts: Column, slot_seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(slot_seconds * MICROS)).cast("bigint")


def _put_together(session: SparkSession, folder: str, places: dict, table: str, ddl: str, rows) -> None:
    """Write the buckets of ``table`` that lie in many places as one place each."""
    for bucket in keyed_state.crowded({k: v for k, v in places.items() if k[0] == table}):
        every = keyed_state.Version(0, "", "", places).read(session, table, ddl, [bucket])
        one = rows(every).withColumn("bucket", F.lit(bucket))
        places[table, bucket] = tuple(keyed_state.written(session, folder, table, one).values())


def _newest_per_device(rows: DataFrame) -> DataFrame:
    return rows.groupBy("device_id").agg(F.max("ts").alias("ts"))


def start_availability(
    spark: SparkSession,
    log_path: str,
    ring_path: str,
    checkpoint: str,
    window_seconds: int = BEAT_WINDOW_SECONDS,
    slot_seconds: int | None = None,
    buckets: int = keyed_state.BUCKETS,
    max_files_per_trigger: int = 1000,
    **trigger,
) -> StreamingQuery:
    """A2 and A3 while the log grows: distinct beats in slots of time, and the newest beat per device in hash buckets.

    A batch adds its own distinct beats to the slots they fall into and reads none of the others; a slot that lies in many places is put
    together. Slots that end before the newest receipt less the window expire: the next version does not name them, and nothing is
    written for it. A beat that comes for an expired slot is too old for any answer and is left out, but counts for the device. Beats are a set
    and the newest beat is a maximum, so receipts in any order, a batch that is repeated, or a log that is read again after the checkpoint is lost
    change no answer. A device with very many beats is spread over its slots, as a slot is written by many tasks.

    ``window_seconds``, ``slot_seconds`` (a part of the window unless given), and ``buckets`` stay the same for a folder.
    """
    width = slot_seconds or max(1, math.ceil(window_seconds / SLOTS))

    def keep(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        name = f"{session.sparkContext.getLocalProperty('sql.streaming.queryId')}-{batch_id}"
        previous = keyed_state.latest(session, ring_path)
        if previous is not None and previous.writer == name:
            return
        rows = batch.select("device_id", "ts", "received_at").persist()
        try:
            newest = rows.agg(F.max(F.unix_micros("received_at"))).first()[0]
            if newest is None:
                return
            if previous is not None:
                newest = max(newest, _stamp(previous)[0])
            oldest = (newest - window_seconds * MICROS) // (width * MICROS)
            slotted = rows.select("device_id", "ts", _slot(F.col("ts"), width).alias("bucket"))
            beats = slotted.where(F.col("bucket") >= oldest).distinct()
            devices = _newest_per_device(rows).withColumn("bucket", keyed_state.bucket_of("device_id", buckets=buckets))
            places = keyed_state.added(previous, BEATS, keyed_state.written(session, ring_path, BEATS, beats))
            places = {k: v for k, v in places.items() if k[1] >= oldest}
            places |= keyed_state.added(previous, DEVICES, keyed_state.written(session, ring_path, DEVICES, devices))
            _put_together(session, ring_path, places, BEATS, BEATS_DDL, DataFrame.distinct)
            _put_together(session, ring_path, places, DEVICES, DEVICES_DDL, _newest_per_device)
            keyed_state.commit(session, ring_path, previous, name, f"{newest},{window_seconds},{width}", places)
        finally:
            rows.unpersist()

    beats = stream_log(spark, log_path, max_files_per_trigger).where(F.col("type") == "heartbeat")
    return (
        beats.writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _stamp(version: keyed_state.Version) -> tuple[int, int, int]:
    """Newest receipt in microseconds, window and width of a slot in seconds."""
    newest, window, width = map(int, version.stamp.split(","))
    return newest, window, width


def read_beats(spark: SparkSession, ring_path: str, as_of, window_seconds: int = BEAT_WINDOW_SECONDS) -> DataFrame:
    """A2 from the ring: distinct beats (device_id, ts) of the closed window that ends at ``as_of``, from its slots alone.

    The ring answers for the newest receipt and any later time, as ``window_seconds`` before them are never expired. An earlier ``as_of``, or
    a window longer than the one that is kept, raises ValueError. Empty before the first batch.
    """
    version = keyed_state.latest(spark, ring_path)
    if version is None:
        return spark.createDataFrame([], BEATS_DDL)
    newest, window, width = _stamp(version)
    moment = spark.range(1).select(as_of_micros(as_of).alias("m")).first()["m"]
    if moment < newest or window_seconds > window:
        raise ValueError("the ring holds the window before the newest receipt; ask the log for an earlier time or a longer window")
    low, high = moment - window_seconds * MICROS, moment
    held = [b for t, b in version.places if t == BEATS and low // (width * MICROS) <= b <= high // (width * MICROS)]
    return version.read(spark, BEATS, BEATS_DDL, held).where(F.unix_micros("ts").between(low, high)).distinct()


def running_health(
    spark: SparkSession,
    ring_path: str,
    as_of,
    window_seconds: int = BEAT_WINDOW_SECONDS,
    interval_seconds: float = BEAT_INTERVAL_SECONDS,
) -> DataFrame:
    """A4 (with A1 and A3) from the ring: equals ``device_health`` of the log for ``as_of`` at or after the newest receipt."""
    version = keyed_state.latest(spark, ring_path)
    rows = read_beats(spark, ring_path, as_of, window_seconds)
    if version is not None:
        rows = rows.unionByName(version.read(spark, DEVICES, DEVICES_DDL))
    # Every row was received by now; the newest beat of a device counts in the window as the copy of a beat that is there.
    seen = rows.select("device_id", "ts", F.lit("heartbeat").alias("type"), F.timestamp_micros(as_of_micros(as_of)).alias("received_at"))
    return device_health(seen, as_of, window_seconds, interval_seconds)
