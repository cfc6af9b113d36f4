"""Reorder buffer across batches: rows wait for their window and come out in timestamp order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from wardwatch.operators.holding import released
from wardwatch.schema import MICROS
from wardwatch.session import shared_files
from wardwatch.sources import keyed_state

HELD, READY = "held", "ready"


def _with_release(schema: StructType) -> StructType:
    return StructType([*schema.fields]).add("released_at", "timestamp")


def _publish(spark: SparkSession, folder: str, version: keyed_state.Version, schema: StructType, order: Sequence[str]) -> None:
    """Write the rows a version released to ``rows/<writer>``, unless that was finished before."""
    target = f"{folder}/rows/{version.writer}"
    ready = version.read(spark, READY, schema)
    if not shared_files(spark, f"{target}/_SUCCESS"):
        ready.repartitionByRange("released_at", *order).sortWithinPartitions("released_at", *order).write.mode("overwrite").parquet(target)


def _advance(
    spark: SparkSession, folder: str, new: DataFrame | None, schema: StructType, writer: str, keys: Sequence[str], hold_seconds: float, order: Sequence[str]
) -> None:
    """Take new rows in and release those whose window is over; all rows without ``new``."""
    state, out = f"{folder}/state", _with_release(schema)
    previous = keyed_state.latest(spark, state)
    if previous is not None:
        _publish(spark, folder, previous, out, order)
        if previous.writer == writer:
            return
    before = int(previous.stamp) if previous else None
    rows = previous.read(spark, HELD, schema) if previous else spark.createDataFrame([], schema)
    clock = before
    if new is not None:
        newest = new.agg(F.max(F.unix_micros("received_at"))).first()[0]
        clock = max((t for t in (before, newest) if t is not None), default=0)
        rows = rows.unionByName(new)
    placed = released(rows, keys, hold_seconds).persist()
    try:
        over = F.lit(True) if new is None else F.coalesce(F.unix_micros("released_at") <= clock, F.lit(True))
        # Never before what is out already.
        shown = placed.where(over)
        if before is not None:
            shown = shown.withColumn("released_at", F.greatest("released_at", F.timestamp_micros(F.lit(before))))
        places = {}
        for name, frame in ((HELD, placed.where(~over).drop("released_at")), (READY, shown)):
            found = keyed_state.written(spark, state, name, frame.withColumn("bucket", F.lit(0)))
            places |= keyed_state.replaced(None, name, [], found)
        version = keyed_state.commit(spark, state, previous, writer, str(clock or 0), places)
    finally:
        placed.unpersist()
    _publish(spark, folder, version, out, order)


def start_ordered(
    stream: DataFrame, folder: str, checkpoint: str, keys: Sequence[str], hold_seconds: float, order: Sequence[str] = ("ts", "received_at"), **trigger
) -> StreamingQuery:
    """O1 per device, T7 per room: the rows of a stream in the order of ``released_at`` and ``order``, over all batches.

    The first arrival of a key opens a window of ``hold_seconds`` of receipt time; the rows of the window come out together, in order, once the clock is at
    its end, and the next arrival opens the next. The clock is the newest receipt so far, so the answer depends on the receipts
    and not on how they fall into batches; ``drain`` lets out what is held when no more rows come. A row that comes later than its window is not
    lost: it opens a window of its own, and is never shown before rows that are out.

    What is held is a table in the shared folder, as long as the hold, and rows of a key are spread over time buckets. A batch
    commits held and released rows as one version; repeated after that, it only finishes the write of its rows.
    """
    schema = stream.schema

    def advance(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        writer = f"{session.sparkContext.getLocalProperty('sql.streaming.queryId')}-{batch_id}"
        rows = batch.persist()
        try:
            if not rows.isEmpty():
                _advance(session, folder, rows, schema, writer, keys, hold_seconds, order)
        finally:
            rows.unpersist()

    return (
        stream.writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def drain(spark: SparkSession, folder: str, schema: StructType, keys: Sequence[str], hold_seconds: float, order: Sequence[str] = ("ts", "received_at")) -> None:
    """Release everything that is held. Call it when the job is stopped."""
    newest = keyed_state.latest(spark, f"{folder}/state")
    if newest is not None:
        _advance(spark, folder, None, schema, f"drain-{newest.number}", keys, hold_seconds, order)


def read_ordered(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Released rows with ``released_at``; empty before the first."""
    if not shared_files(spark, f"{folder}/rows/*/_SUCCESS"):
        return spark.createDataFrame([], _with_release(schema))
    return spark.read.schema(_with_release(schema)).parquet(f"{folder}/rows/*")
