"""Validation of arrivals: JSON parse, schema and time rules, late flag, priority, routing."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from wardwatch.functions import json_fields as J
from wardwatch.functions.timeline import parse_iso_utc, seconds_between
from wardwatch.schema import (
    ARRIVAL_COLUMNS,
    EVENT_COLUMNS,
    LATE_AFTER_SECONDS,
    MAX_SKEW_SECONDS,
    REJECT_COLUMNS,
)

INVALID_JSON = "invalid_json"
INVALID_SCHEMA = "invalid_schema"
INVALID_TIMESTAMP = "invalid_timestamp"
SKEW_FUTURE = "clock_skew_future"
SKEW_PAST = "clock_skew_past"


def skew_reason(ts: Column, received_at: Column) -> Column:
    """V4: strict on both sides; an offset of exactly one hour is accepted."""
    offset = seconds_between(ts, received_at)
    return F.when(offset > MAX_SKEW_SECONDS, SKEW_FUTURE).when(offset < -MAX_SKEW_SECONDS, SKEW_PAST)


def is_late(ts: Column, received_at: Column) -> Column:
    """V5: more than 30 s old on arrival. A late event is accepted."""
    return seconds_between(received_at, ts) > LATE_AFTER_SECONDS


def priority_of(event_type: Column) -> Column:
    """V6: only fall warnings are high."""
    return F.when(event_type == "fall_warn", "high").otherwise("normal")


def apply_time_rules(arrivals: DataFrame) -> DataFrame:
    """V4-V6 on typed rows: adds ``reason`` (NULL = accepted), ``offset_seconds``, ``late``, ``priority``.

    An earlier ``reason`` wins, as the rules stop at the first failure. ``offset_seconds`` is kept for
    skew rejects only.
    """
    earlier = F.col("reason") if "reason" in arrivals.columns else F.lit(None).cast("string")
    return (
        arrivals.withColumn("reason", F.coalesce(earlier, skew_reason(F.col("ts"), F.col("received_at"))))
        .withColumn(
            "offset_seconds",
            F.when(F.col("reason").isin(SKEW_FUTURE, SKEW_PAST), seconds_between(F.col("ts"), F.col("received_at"))),
        )
        .withColumn("late", F.when(F.col("reason").isNull(), is_late(F.col("ts"), F.col("received_at"))))
        .withColumn("priority", F.when(F.col("reason").isNull(), priority_of(F.col("type"))))
    )


def _computed_once(rows: DataFrame) -> DataFrame:
    """The same rows, as the output of a generator of one row.

    The optimizer moves a filter below the projection it reads from by copying the projected expressions into
    it. For parsed JSON that would parse every text again for each use; it does not move filters
    below a generator whose output they read.
    """
    return rows.select(F.explode(F.array(F.struct(*rows.columns))).alias("row")).select("row.*")


def validate_raw(arrivals: DataFrame, raw: str = "raw", received_at: str = "received_at") -> DataFrame:
    """One JSON text per row to one arrival row.

    No shuffle, and each text is parsed once. The rules run in the order JSON, schema, timestamp, skew and the
    first failure is the reason. Accepted rows carry the event columns and no ``raw``; rejected rows keep
    ``raw`` as the dead letter. Works on batch and streaming input.
    """
    document = F.col("document")
    named = arrivals.select(F.col(raw).alias("raw"), F.col(received_at).alias("received_at"))
    parsed = J.with_document(named, F.col("raw"))
    fields = parsed.withColumn("spelled", F.when(document.isNotNull(), J.spellings(F.col("raw")))).select(
        "raw",
        "received_at",
        "document",
        "spelled",
        J.required_text(document, "device_id").alias("device_id"),
        J.required_text(document, "room_id").alias("room_id"),
        J.required_text(document, "type").alias("type"),
        J.required_text(document, "ts").alias("ts_text"),
        J.seq_is_valid(document, F.col("spelled")).alias("seq_ok"),
    )
    incomplete = (
        F.col("device_id").isNull()
        | F.col("room_id").isNull()
        | F.col("type").isNull()
        | F.col("ts_text").isNull()
        | ~F.col("seq_ok")
    )
    stamped = _computed_once(fields.withColumn("ts", parse_iso_utc(F.col("ts_text")))).withColumn(
        "reason",
        F.when(document.isNull(), INVALID_JSON)
        .when(incomplete, INVALID_SCHEMA)
        .when(F.col("ts").isNull(), INVALID_TIMESTAMP),
    )
    ruled = apply_time_rules(stamped)
    accepted = F.col("reason").isNull()
    return ruled.select(
        "device_id",
        "room_id",
        "type",
        "ts",
        "received_at",
        F.when(accepted, J.seq_value(document)).alias("seq"),
        F.when(accepted, J.payload_text(document, F.col("spelled"))).alias("payload"),
        "late",
        "priority",
        F.when(accepted & (F.col("type") == "presence"), J.truthy(document, "in_room")).alias("in_room"),
        F.when(accepted & (F.col("type") == "fall_warn"), J.float_or_default(document, "confidence", 0.0)).alias(
            "confidence"
        ),
        F.when(~accepted, F.col("raw")).alias("raw"),
        "reason",
        "offset_seconds",
        F.when(accepted, "accepted").otherwise("rejected").alias("outcome"),
        F.to_date("received_at").alias("event_date"),
    ).select(*ARRIVAL_COLUMNS)


def accepted_events(arrivals: DataFrame) -> DataFrame:
    """V8, accepted side: the event columns."""
    return arrivals.where(F.col("reason").isNull()).select(*EVENT_COLUMNS)


def rejected_arrivals(arrivals: DataFrame) -> DataFrame:
    """V8, dead-letter side."""
    return arrivals.where(F.col("reason").isNotNull()).select(*REJECT_COLUMNS)


def rejects_by_reason(arrivals: DataFrame) -> DataFrame:
    """V8: rejected rows per reason. Skew rejects were received but dropped; the rest are client errors."""
    return (
        arrivals.where(F.col("reason").isNotNull())
        .groupBy("reason")
        .agg(F.count("*").alias("events"))
        .withColumn("is_skew", F.col("reason").isin(SKEW_FUTURE, SKEW_PAST))
    )


Derivation = Callable[[DataFrame], DataFrame]


def route_by_type(events: DataFrame, routes: Mapping[str, Derivation]) -> dict[str, DataFrame]:
    """V9: hand each event type to its derivation.

    A type without a route is accepted and logged and changes no state, so it is simply not read here.
    """
    return {name: derive(events.where(F.col("type") == name)) for name, derive in routes.items()}


def routing_counts(events: DataFrame) -> DataFrame:
    """V9: events per type with the handler each type goes to."""
    return (
        events.groupBy("type")
        .agg(F.count("*").alias("events"))
        .withColumn(
            "handler",
            F.when(F.col("type").isin("heartbeat", "presence", "fall_warn"), F.col("type")).otherwise("generic"),
        )
    )


def read_text_log(rows: DataFrame) -> DataFrame:
    """Log rows stored as text, with ``readable`` false where a field cannot be read.

    A row is readable when both times are ISO and the payload is a JSON object. One bad row never stops
    the others.
    """
    document = F.col("document")
    typed = _computed_once(
        J.with_document(rows, F.col("payload")).select(
            "device_id",
            "room_id",
            "type",
            parse_iso_utc(F.col("ts")).alias("ts"),
            parse_iso_utc(F.col("received_at")).alias("received_at"),
            F.lit(None).cast("bigint").alias("seq"),
            "payload",
            F.coalesce(F.col("late") != 0, F.lit(False)).alias("late"),
            priority_of(F.col("type")).alias("priority"),
            "document",
        )
    )
    return typed.select(
        *[name for name in EVENT_COLUMNS if name not in ("in_room", "confidence")],
        F.when(F.col("type") == "presence", J.truthy(document, "in_room")).alias("in_room"),
        F.when(F.col("type") == "fall_warn", J.float_or_default(document, "confidence", 0.0)).alias("confidence"),
        (F.col("ts").isNotNull() & F.col("received_at").isNotNull() & document.isNotNull()).alias("readable"),
    )


def replayable(rows: DataFrame) -> DataFrame:
    """The readable rows of a text log as events."""
    return read_text_log(rows).where("readable").select(*EVENT_COLUMNS)
