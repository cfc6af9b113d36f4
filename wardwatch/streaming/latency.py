"""The last alarm latencies as a table that a job keeps (M4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from wardwatch.operators.metrics import alarm_latency_p95, last_dispatched
from wardwatch.schema import LATENCY_SAMPLES
from wardwatch.sources import keyed_state
from wardwatch.sources.alarm_table import stream_dispatched

RING, RING_DDL = "ring", "dedup_key STRING, received_at TIMESTAMP, dispatched_at TIMESTAMP"
_COLUMNS = tuple(part.split()[0] for part in RING_DDL.split(", "))


def start_latency(
    spark: SparkSession,
    alarm_path: str,
    ring_path: str,
    checkpoint: str,
    samples: int = LATENCY_SAMPLES,
    max_files_per_trigger: int = 1000,
    **trigger,
) -> StreamingQuery:
    """M4 while the alarm job runs: the ``samples`` alarms dispatched last, as versions of a table of at most so many rows.

    A batch reads its own alarms and the ring, never the alarm table. The ring is the newest of a set of alarms, so neither their order
    nor a batch or a whole table that is read again changes it.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        name = f"{session.sparkContext.getLocalProperty('sql.streaming.queryId')}-{batch_id}"
        previous = keyed_state.latest(session, ring_path)
        if previous is not None and previous.writer == name:
            return
        newest = last_dispatched(batch.select(*_COLUMNS), samples)
        if previous is not None:
            newest = newest.unionByName(previous.read(session, RING, RING_DDL)).distinct()
        ring = last_dispatched(newest, samples).selectExpr("*", "0 AS bucket")
        places = keyed_state.written(session, ring_path, RING, ring)
        keyed_state.commit(session, ring_path, previous, name, "", keyed_state.replaced(None, RING, [], places))

    return (
        stream_dispatched(spark, alarm_path, max_files_per_trigger)
        .writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_ring(spark: SparkSession, ring_path: str) -> DataFrame:
    """The ring of the newest version; empty before the first batch."""
    version = keyed_state.latest(spark, ring_path)
    return spark.createDataFrame([], RING_DDL) if version is None else version.read(spark, RING, RING_DDL)


def latency_p95(spark: SparkSession, ring_path: str, samples: int = LATENCY_SAMPLES) -> DataFrame:
    """M4 from the ring alone."""
    return alarm_latency_p95(read_ring(spark, ring_path), samples)
