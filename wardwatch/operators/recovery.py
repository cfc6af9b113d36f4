"""Derived state as of a time, restore from snapshot plus replay, and fall replay.

The state is four tables:

* ``device_last(device_id, last_heartbeat_ts, handled_at)``
* ``device_beats(device_id, ts)``
* ``room_presence(room_id, ts, in_room, received_at, seq)``
* ``room_transitions(room_id, ts, in_room, handled_at)``

``handled_at`` is the last receipt for the device or room; trims are measured from it, so the state depends on
the log rows alone. Every merge is a maximum or a set union: order-free and safe to repeat.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from wardwatch.functions.timeline import as_of_literal, shift
from wardwatch.operators.falls import alarms_from_falls, keyed_falls
from wardwatch.operators.health import visible
from wardwatch.operators.occupancy import presence_rank, retained_points
from wardwatch.schema import BEAT_WINDOW_SECONDS, RETAIN_SECONDS

State = dict[str, DataFrame]
STATE_TABLES = ("device_last", "device_beats", "room_presence", "room_transitions")


def contributions(events: DataFrame) -> State:
    """The rows each event adds to the state tables, before merging."""
    beats = events.where(F.col("type") == "heartbeat")
    presence = events.where(F.col("type") == "presence")
    return {
        "device_last": beats.select(
            "device_id", F.col("ts").alias("last_heartbeat_ts"), F.col("received_at").alias("handled_at")
        ),
        "device_beats": beats.select("device_id", "ts"),
        "room_presence": presence.select("room_id", "ts", "in_room", "received_at", F.coalesce("seq", F.lit(0)).alias("seq")),
        "room_transitions": presence.select("room_id", "ts", "in_room", F.col("received_at").alias("handled_at")),
    }


def merge_state(
    parts: list[State],
    beat_window: int = BEAT_WINDOW_SECONDS,
    retain_seconds: int = RETAIN_SECONDS,
    tables: Sequence[str] = STATE_TABLES,
) -> State:
    """Merge states and contributions into one trimmed state with the given tables."""
    rows = {name: reduce(DataFrame.unionByName, [part[name] for part in parts if name in part]) for name in STATE_TABLES}

    device_last = (
        rows["device_last"]
        .groupBy("device_id")
        .agg(F.max("last_heartbeat_ts").alias("last_heartbeat_ts"), F.max("handled_at").alias("handled_at"))
    )
    beat_floor = device_last.select("device_id", shift(F.col("handled_at"), -beat_window).alias("floor"))
    device_beats = (
        rows["device_beats"]
        .distinct()
        .join(beat_floor, "device_id")
        .where(F.col("ts") > F.col("floor"))
        .select("device_id", "ts")
    )

    rank = presence_rank(F.col("ts"), F.col("received_at"), F.col("seq"), F.col("in_room"))
    room_presence = (
        rows["room_presence"]
        .groupBy("room_id")
        .agg(F.max(rank).alias("r"))
        .select(
            "room_id",
            "r.ts",
            "r.in_room",
            F.timestamp_micros(-F.col("r.arrival")).alias("received_at"),
            (-F.col("r.order")).alias("seq"),
        )
    )

    points = (
        rows["room_transitions"].groupBy("room_id", "ts", "in_room").agg(F.max("handled_at").alias("received_at"))
    )
    room_transitions = retained_points(points, retain_seconds).select("room_id", "ts", "in_room", "handled_at")
    merged = {
        "device_last": device_last,
        "device_beats": device_beats,
        "room_presence": room_presence,
        "room_transitions": room_transitions,
    }
    return {name: merged[name] for name in tables}


def state_as_of(
    log: DataFrame, as_of, beat_window: int = BEAT_WINDOW_SECONDS, retain_seconds: int = RETAIN_SECONDS
) -> State:
    """The state from every log row received by ``as_of``."""
    return merge_state([contributions(visible(log, as_of))], beat_window, retain_seconds)


def restore_state(
    log: DataFrame,
    snapshot: State | None,
    snapshot_ts,
    as_of,
    beat_window: int = BEAT_WINDOW_SECONDS,
    retain_seconds: int = RETAIN_SECONDS,
) -> State:
    """R2: latest snapshot merged with the log from its time on (inclusive, by receipt).

    Equals ``state_as_of(log, as_of)``. Without a snapshot the whole log is replayed.
    """
    if snapshot is None:
        return state_as_of(log, as_of, beat_window, retain_seconds)
    start = as_of_literal(snapshot_ts)
    newer = visible(log, as_of).where(F.col("received_at") >= start)
    if "event_date" in log.columns:
        newer = newer.where(F.col("event_date") >= F.to_date(start))
    return merge_state([snapshot, contributions(newer)], beat_window, retain_seconds)


def state_rows(state: State) -> DataFrame:
    """The four tables as one: (state_table, entity_id, ts, in_room)."""
    no_flag = F.lit(None).cast("boolean").alias("in_room")
    return reduce(
        DataFrame.unionByName,
        [
            state["device_last"].select(
                F.lit("device_last").alias("state_table"),
                F.col("device_id").alias("entity_id"),
                F.col("last_heartbeat_ts").alias("ts"),
                no_flag,
            ),
            state["device_beats"].select(
                F.lit("device_beats").alias("state_table"), F.col("device_id").alias("entity_id"), "ts", no_flag
            ),
            state["room_presence"].select(
                F.lit("room_presence").alias("state_table"), F.col("room_id").alias("entity_id"), "ts", "in_room"
            ),
            state["room_transitions"].select(
                F.lit("room_transitions").alias("state_table"), F.col("room_id").alias("entity_id"), "ts", "in_room"
            ),
        ],
    )


def replayed_alarms(log: DataFrame, alarms: DataFrame) -> DataFrame:
    """R3, insert side: alarms of replayed falls whose key is not stored yet; these are also published."""
    return alarms_from_falls(log).join(alarms.select("dedup_key"), "dedup_key", "left_anti")


def replay_conflicts(log: DataFrame, alarms: DataFrame) -> DataFrame:
    """R3, conflict side: replayed falls per stored key. They change nothing and are not published."""
    return (
        keyed_falls(log)
        .groupBy("dedup_key")
        .agg(F.count("*").alias("conflicts"))
        .join(alarms.select("dedup_key"), "dedup_key", "left_semi")
    )
