"""Delivery orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window

from wardwatch.functions.timeline import time_slice


def device_order(events: DataFrame) -> DataFrame:
    """O1: events of a device in timestamp order, ties in arrival order.

    One range exchange on the whole sort key. A device that holds a large share of the rows is cut by
    time into consecutive ranges, which a hash exchange on ``device_id`` could not do.
    """
    return events.orderBy("device_id", "ts", "received_at", F.col("seq").asc_nulls_first())


def priority_order(events: DataFrame) -> DataFrame:
    """O3: high before normal, then arrival order."""
    return events.orderBy((F.col("priority") != "high").asc(), "received_at", F.col("seq").asc_nulls_first())


def with_positions(rows: DataFrame, keys: Sequence[str], time: str, order: Sequence[Column | str], slice_seconds: int = 3600) -> DataFrame:
    """``position`` of each row, from 1, in the order of ``keys``, then ``time``, then ``order``; per group of ``keys`` when given.

    Rows are ranked inside (keys, time slice) and shifted by the count of the earlier slices, so no task ranks all rows
    of a key. Only the slice counts of a key, bounded by time, meet in one place.
    """
    by = [*keys, "slice"]
    sliced = rows.withColumn("slice", time_slice(F.col(time), slice_seconds))
    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*by)
        .agg(F.count("*").alias("n"))
        .select(*by, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy(*by).orderBy(time, *order)
    return (
        sliced.withColumn("inside", F.row_number().over(inside))
        .join(offsets, by)
        .withColumn("position", F.col("inside") + F.col("before"))
        .drop("slice", "inside", "before")
    )


def device_positions(events: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """O1: ``position`` of each event in its device's timestamp order, ties in arrival order."""
    return with_positions(events, ["device_id"], "ts", ["received_at", F.col("seq").asc_nulls_first()], slice_seconds)


def priority_positions(events: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """O3: ``position`` of each event among those of its priority, in arrival order."""
    return with_positions(events, ["priority"], "received_at", [F.col("seq").asc_nulls_first()], slice_seconds)


def room_alarm_positions(alarms: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """O2: ``position`` of each alarm in its room's timestamp order."""
    return with_positions(alarms, ["room_id"], "ts", ["received_at", "dedup_key"], slice_seconds)
