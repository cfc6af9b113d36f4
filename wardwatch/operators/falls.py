"""Fall-warning de-duplication, alarms, and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardwatch.functions.keys import dedup_key
from wardwatch.functions.timeline import as_of_literal
from wardwatch.operators.holding import openings, stored
from wardwatch.schema import ALARM_COLUMNS, DEDUP_TTL_SECONDS, MICROS


def keyed_falls(events: DataFrame) -> DataFrame:
    """fall warnings with their dedup key.

    A fall whose confidence is not a finite number cannot become an alarm, so it is left out before
    de-duplication and cannot hide a good copy. ``handler_errors`` reports these.
    """
    falls = events.where((F.col("type") == "fall_warn") & F.col("confidence").isNotNull())
    return falls.withColumn("dedup_key", dedup_key(F.col("device_id"), F.col("room_id"), F.col("ts")))


def handler_errors(events: DataFrame) -> DataFrame:
    """Fall warnings that were logged but have no usable confidence."""
    return events.where((F.col("type") == "fall_warn") & F.col("confidence").isNull())


def alarms_from_falls(events: DataFrame) -> DataFrame:
    """one alarm per dedup key; the copy first in (ts, received_at, seq) wins.

    The minimum is combined on the map side, so a key with very many copies sends one row per task.
    """
    first = F.min(
        F.struct(
            "ts",
            "received_at",
            F.coalesce("seq", F.lit(0)).alias("order"),
            "device_id",
            "room_id",
            "confidence",
        )
    )
    return (
        keyed_falls(events)
        .groupBy("dedup_key")
        .agg(first.alias("first"))
        .select("dedup_key", "first.*")
        .select(*ALARM_COLUMNS)
    )


def arrivals_of(events: DataFrame) -> DataFrame:
    """Falls per dedup key and receipt time in microseconds ``t``, with their number ``n``."""
    return keyed_falls(events).groupBy("dedup_key", F.unix_micros("received_at").alias("t")).agg(F.count("*").alias("n"))


def labelled(arrivals: DataFrame, accepted: DataFrame) -> DataFrame:
    """Rows (dedup_key, received_at, outcome, copies) of arrivals, given the accepted ones (dedup_key, t, outcome).

    Of the falls of one key and microsecond one is accepted at most; the others are ``dedup_in_window``.
    """
    hit = F.when(F.col("accepted_as").isNotNull(), 1).otherwise(0).cast("bigint")
    split = F.array(
        F.struct(F.col("accepted_as").alias("outcome"), hit.alias("copies")),
        F.struct(F.lit("dedup_in_window").alias("outcome"), (F.col("n") - hit).alias("copies")),
    )
    return (
        arrivals.join(accepted.withColumnRenamed("outcome", "accepted_as"), ["dedup_key", "t"], "left")
        .select("dedup_key", F.timestamp_micros("t").alias("received_at"), F.explode(split).alias("s"))
        .select("dedup_key", "received_at", "s.outcome", "s.copies")
        .where(F.col("copies") > 0)
    )


def fall_outcomes(events: DataFrame, ttl_seconds: int = DEDUP_TTL_SECONDS) -> DataFrame:
    """what happened to the falls on live arrival: ``new``, ``dedup_in_window``, ``dedup_post_ttl``.

    The time-to-live runs from the last accepted arrival and a hit does not renew it; an arrival exactly at its
    end opens a new one. Falls of one key received at the same microsecond share a row per outcome and are
    counted in ``copies``: one of them is accepted at most. A key's arrivals are spread over time buckets, see ``holding``.
    """
    # Read several times below: the falls are scanned and hashed once.
    arrivals = stored(arrivals_of(events), "arrivals")
    first = arrivals.groupBy("dedup_key").agg(F.min("t").alias("first"))
    accepted = openings(arrivals.select("dedup_key", "t"), ["dedup_key"], ttl_seconds * MICROS).join(first, "dedup_key")
    outcome = F.when(F.col("t") == F.col("first"), "new").otherwise("dedup_post_ttl")
    return labelled(arrivals, accepted.select("dedup_key", "t", outcome.alias("outcome")))


def alarms_since(alarms: DataFrame, since_epoch: float = 0.0, room_id: str | None = None) -> DataFrame:
    """Alarms with ``ts >= since`` (inclusive), optionally of one room, ordered by ts."""
    since = F.timestamp_micros(F.lit(round(since_epoch * MICROS)).cast("bigint"))
    chosen = alarms.where(F.col("ts") >= since)
    if room_id is not None:
        chosen = chosen.where(F.col("room_id") == room_id)
    return chosen.orderBy("ts", "received_at", "dedup_key")


def alarm_feed(alarms: DataFrame, room_id: str, start, since: str | None = None) -> DataFrame:
    """what a subscriber of a room that joins at ``start`` sees.

    Stored alarms with ``ts >= since`` when ``since`` is given, then every alarm received from ``start`` on,
    whatever its ts. Works on a batch table and on a stream over the alarm table alike.
    """
    begin = as_of_literal(start)
    live = F.col("received_at") >= begin
    shown = live
    if since is not None:
        shown = live | ((F.col("received_at") < begin) & (F.col("ts") >= as_of_literal(since)))
    return alarms.where((F.col("room_id") == room_id) & shown).withColumn(
        "phase", F.when(live, "live").otherwise("history")
    )


def reconcile(events: DataFrame, alarms: DataFrame) -> DataFrame:
    """alarms against distinct falls per day and room: match, leak (too many), or miss (too few)."""
    per_room = ["fall_date", "room_id"]
    expected = (
        keyed_falls(events)
        .select("dedup_key", "room_id", F.to_date("ts").alias("fall_date"))
        .distinct()
        .groupBy(*per_room)
        .agg(F.count("*").alias("expected"))
    )
    raised = alarms.groupBy(F.to_date("ts").alias("fall_date"), "room_id").agg(F.count("*").alias("alarms"))
    delta = F.col("alarms") - F.col("expected")
    return (
        expected.join(raised, per_room, "full")
        .select(
            *per_room,
            F.coalesce("alarms", F.lit(0)).alias("alarms"),
            F.coalesce("expected", F.lit(0)).alias("expected"),
        )
        .withColumn("delta", delta)
        .withColumn("verdict", F.when(delta > 0, "leak").when(delta < 0, "miss").otherwise("match"))
    )
