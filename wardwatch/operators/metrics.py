"""Ingest, fall, and latency metrics (M1-M4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardwatch.functions.timeline import seconds_between
from wardwatch.operators.falls import keyed_falls
from wardwatch.schema import LATENCY_SAMPLES


def ingest_counter_columns() -> dict[str, Column]:
    """M1 as aggregates over arrivals; usable in ``agg`` and, on a stream, in ``observe``."""
    reason = F.col("reason")
    skewed = reason.isin("clock_skew_future", "clock_skew_past")
    return {
        "events_ingested_total": F.count(F.lit(1)),
        "events_late": F.count_if(F.coalesce(F.col("late"), F.lit(False)) & reason.isNull()),
        "events_rejected_invalid_json": F.count_if(reason == "invalid_json"),
        "events_rejected_invalid_schema": F.count_if(reason.isin("invalid_schema", "invalid_timestamp")),
        "events_rejected_clock_skew": F.count_if(skewed),
        "events_rejected_clock_skew_future": F.count_if(reason == "clock_skew_future"),
        "events_rejected_clock_skew_past": F.count_if(reason == "clock_skew_past"),
    }


def _as_rows(counters: DataFrame) -> DataFrame:
    names = counters.columns
    pairs = ", ".join(f"'{name}', `{name}`" for name in names)
    return counters.selectExpr(f"stack({len(names)}, {pairs}) AS (counter, value)")


def ingest_counters(arrivals: DataFrame) -> DataFrame:
    """M1: one row per counter. Every arrival counts as ingested, valid or not; late counts accepted rows."""
    return _as_rows(arrivals.agg(*[column.alias(name) for name, column in ingest_counter_columns().items()]))


def fall_counters(events: DataFrame, alarms: DataFrame | None = None) -> DataFrame:
    """M2: alarms raised, duplicates, and conflicts.

    Live, every copy after the first of a key is a duplicate whichever class it has, so the numbers follow
    from the rows per key. With ``alarms`` the falls are a replay: rows whose key is stored are conflicts.
    """
    keys = keyed_falls(events).groupBy("dedup_key").agg(F.count("*").alias("copies"))
    if alarms is None:
        keys = keys.withColumn("stored", F.lit(False))
    else:
        stored = alarms.select("dedup_key").distinct().withColumn("stored", F.lit(True))
        keys = keys.join(stored, "dedup_key", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))
    stored = F.col("stored")
    zero = F.lit(0).cast("bigint")
    return _as_rows(
        keys.agg(
            F.count_if(~stored).alias("fall_warnings_total"),
            F.coalesce(F.sum(F.when(~stored, F.col("copies") - 1)), zero).alias("fall_warnings_deduped"),
            F.coalesce(F.sum(F.when(stored, F.col("copies"))), zero).alias("fall_warnings_db_conflicts"),
        )
    )


def alarm_latency(dispatched: DataFrame) -> DataFrame:
    """M3: milliseconds from receipt to dispatch per alarm, never negative."""
    return dispatched.withColumn(
        "latency_ms",
        F.greatest(F.lit(0.0), seconds_between(F.col("dispatched_at"), F.col("received_at")) * 1000.0),
    )


def last_dispatched(dispatched: DataFrame, samples: int = LATENCY_SAMPLES) -> DataFrame:
    """The ``samples`` alarms dispatched last; equal times go by receipt and key. A top-k: tasks send at most ``samples`` rows."""
    newest_first = [F.col(name).desc() for name in ("dispatched_at", "received_at", "dedup_key")]
    return dispatched.orderBy(*newest_first).limit(samples)


def alarm_latency_p95(dispatched: DataFrame, samples: int = LATENCY_SAMPLES) -> DataFrame:
    """M4: nearest-rank 95th percentile of the last ``samples`` latencies, rounded half to even; 0 when empty.

    The sample window is the metric's own definition.
    """
    recent = last_dispatched(alarm_latency(dispatched), samples)
    p95 = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)")
    return recent.agg(
        F.coalesce(F.bround(p95, 0).cast("bigint"), F.lit(0).cast("bigint")).alias("alarm_feed_latency_ms_p95"),
        F.count("*").alias("samples"),
    )
