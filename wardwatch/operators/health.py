"""Device health from heartbeats (A1-A4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardwatch.functions.timeline import as_of_literal, shift
from wardwatch.schema import BEAT_INTERVAL_SECONDS, BEAT_WINDOW_SECONDS


def visible(events: DataFrame, as_of) -> DataFrame:
    """Rows that had arrived by ``as_of``."""
    return events.where(F.col("received_at") <= as_of_literal(as_of))


def heartbeats(events: DataFrame, as_of) -> DataFrame:
    return visible(events.where(F.col("type") == "heartbeat"), as_of)


def last_heartbeat(events: DataFrame, as_of) -> DataFrame:
    """A1: newest beat per device. An older beat never replaces a newer one; a future beat counts."""
    return heartbeats(events, as_of).groupBy("device_id").agg(F.max("ts").alias("last_heartbeat_ts"))


def recent_beats(events: DataFrame, as_of, window_seconds: int = BEAT_WINDOW_SECONDS) -> DataFrame:
    """A2: distinct beats per device since the start of the trailing window; equal timestamps are one beat."""
    start = shift(as_of_literal(as_of), -window_seconds)
    return heartbeats(events, as_of).where(F.col("ts") >= start).select("device_id", "ts").distinct()


def _expected_beats(window_seconds: int, interval_seconds: float) -> float:
    return window_seconds / interval_seconds


def _beat_in_window(as_of, window_seconds: int) -> Column:
    moment = as_of_literal(as_of)
    return F.when(F.col("ts").between(shift(moment, -window_seconds), moment), F.col("ts"))


def device_health(
    events: DataFrame,
    as_of,
    window_seconds: int = BEAT_WINDOW_SECONDS,
    interval_seconds: float = BEAT_INTERVAL_SECONDS,
) -> DataFrame:
    """A4 (with A1 and A3): last beat and availability per device, from one scan.

    Beats outside the window collapse to one row per device before the first exchange, and the distinct
    count is taken in two steps keyed by (device, beat) and then by device, so neither the history nor a
    device with very many beats reaches one task. A device without beats is absent.
    """
    beats = (
        heartbeats(events, as_of)
        .groupBy("device_id", _beat_in_window(as_of, window_seconds).alias("beat"))
        .agg(F.max("ts").alias("newest"))
    )
    expected = _expected_beats(window_seconds, interval_seconds)
    return beats.groupBy("device_id").agg(
        F.max("newest").alias("last_heartbeat_ts"),
        F.count("beat").alias("beats"),
        F.least(F.count("beat") / F.lit(expected), F.lit(1.0)).alias("availability"),
    )


def availability(
    events: DataFrame,
    as_of,
    window_seconds: int = BEAT_WINDOW_SECONDS,
    interval_seconds: float = BEAT_INTERVAL_SECONDS,
) -> DataFrame:
    """A3: share of expected beats seen in the closed window ending at ``as_of``, at most 1."""
    return device_health(events, as_of, window_seconds, interval_seconds).select("device_id", "beats", "availability")
