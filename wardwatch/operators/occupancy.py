"""Room presence and occupancy from presence events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window

from wardwatch.functions.timeline import as_of_micros, shift, time_slice
from wardwatch.functions.windows import window_seconds as parse_window
from wardwatch.operators.health import visible
from wardwatch.schema import ANCHOR_SLACK_MICROS, MICROS, RETAIN_SECONDS

# Width of the time slices that bound the work of one task. A slice of one room holds at most two
# transitions per microsecond whatever the number of events, because transitions are a set.
SLICE_SECONDS = 600


def presence_events(events: DataFrame, as_of) -> DataFrame:
    return visible(events.where(F.col("type") == "presence"), as_of)


def transition_code(ts: Column, in_room: Column) -> Column:
    """One integer per transition that sorts by (ts, in_room), so sets and maxima stay hash aggregates."""
    return F.unix_micros(ts) * 2 + in_room.cast("bigint")


def code_micros(code: Column) -> Column:
    return F.shiftright(code, 1)


def code_in_room(code: Column) -> Column:
    return code.bitwiseAND(F.lit(1)) == 1


def presence_rank(ts: Column, received_at: Column, seq: Column, in_room: Column) -> Column:
    """Sorts the current value of a room last: newest ts wins, and on equal ts the first arrival stays."""
    return F.struct(
        ts.alias("ts"),
        (-F.unix_micros(received_at)).alias("arrival"),
        (-F.coalesce(seq, F.lit(0))).alias("order"),
        in_room.alias("in_room"),
    )


def _event_rank() -> Column:
    return presence_rank(F.col("ts"), F.col("received_at"), F.col("seq"), F.col("in_room"))


def current_presence(events: DataFrame, as_of) -> DataFrame:
    """A5: latest presence per room. Any device of the room may set it; a future ts counts."""
    return (
        presence_events(events, as_of)
        .groupBy("room_id")
        .agg(F.max(_event_rank()).alias("latest"))
        .select("room_id", "latest.in_room", "latest.ts")
    )


def transitions(events: DataFrame, as_of) -> DataFrame:
    """Distinct (ts, in_room) per room."""
    return presence_events(events, as_of).select("room_id", "ts", "in_room").distinct()


def retained_points(points: DataFrame, retain_seconds: int, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """The points a room keeps, with ``handled_at``, the last receipt of the room.

    ``points`` has one row per (room_id, ts, in_room) with the time it was last received as ``received_at``. The cutoff is
    the room's last receipt minus the retention; the newest point at or before it is the anchor and stays.

    Every join is on (room, time slice), so the points of a hot room are spread over its slices; only one row per
    slice meets in the windows of a room. Both conditions on ``received_at`` always hold: they keep the three uses of
    ``points`` alike, so that one scan and one exchange serve all of them.
    """
    keys = ["room_id", "slice"]
    of_room = Window.partitionBy("room_id")
    sliced = points.withColumn("slice", time_slice(F.col("ts"), slice_seconds))
    receipts = sliced.groupBy(*keys).agg(F.max("received_at").alias("last")).withColumn("handled_at", F.max("last").over(of_room))
    anchored = (
        sliced.join(receipts.drop("last"), keys)
        .withColumn("cutoff", shift(F.greatest("handled_at", "received_at"), -retain_seconds))
        .groupBy(*keys)
        .agg(
            F.max(F.when(F.col("ts") <= F.col("cutoff"), F.col("ts"))).alias("anchor"),
            F.max("cutoff").alias("cutoff"),
            F.max("handled_at").alias("handled_at"),
        )
    )
    slack = F.timestamp_micros(F.unix_micros(F.max("anchor").over(of_room)) - ANCHOR_SLACK_MICROS)
    floors = anchored.select(*keys, "handled_at", F.coalesce(slack, F.col("cutoff")).alias("floor"))
    kept = sliced.join(floors, keys).where((F.col("ts") > F.col("floor")) & (F.col("received_at") <= F.col("handled_at")))
    return kept.drop("slice", "floor")


def received_transitions(events: DataFrame, as_of) -> DataFrame:
    """A6 with the last receipt of each transition."""
    return (
        presence_events(events, as_of).groupBy("room_id", "ts", "in_room").agg(F.max("received_at").alias("received_at"))
    )


def retained_transitions(events: DataFrame, as_of, retain_seconds: int = RETAIN_SECONDS) -> DataFrame:
    """Transitions inside the retention plus the anchor before it."""
    return retained_points(received_transitions(events, as_of), retain_seconds).select("room_id", "ts", "in_room")


def initial_state(events: DataFrame, as_of, window_seconds: int) -> DataFrame:
    """State at the start of the window, from the newest transition at or before it.

    A room whose transitions are all newer has the default, false.
    """
    start = as_of_micros(as_of) - window_seconds * MICROS
    code = transition_code(F.col("ts"), F.col("in_room"))
    before = F.max(F.when(F.unix_micros("ts") <= start, code))
    return (
        presence_events(events, as_of)
        .groupBy("room_id")
        .agg(before.alias("code"))
        .select("room_id", F.coalesce(code_in_room(F.col("code")), F.lit(False)).alias("initial_in_room"))
    )


def presence_at(events: DataFrame, requests: DataFrame, as_of, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """A8 for many moments: the newest transition at or before each (room_id, moment) of ``requests``, and since when it holds.

    One row per distinct request. Before the first transition of a room, or without a room or a moment, the state is false and
    ``since`` is null. On equal times true is last and holds; a transition at the moment itself counts.

    Transitions and requests are dealt together by (room, time slice), where a running maximum answers the requests that
    follow a transition of their slice. One row per slice carries the last transition forward to the others, so a room
    with a third of all rows is spread over its slices, and neither side is broadcast or sorted as a whole.
    """
    code = transition_code(F.col("ts"), F.col("in_room"))
    told = presence_events(events, as_of).select("room_id", F.col("ts").alias("moment"), code.alias("code"))
    asked = requests.select("room_id", F.col("moment").cast("timestamp").alias("moment"), F.lit(None).cast("bigint").alias("code"))
    # As one value the key is never null, so the join adds no filter and both of its sides read the same exchange.
    place = F.struct("room_id", time_slice(F.col("moment"), slice_seconds).alias("slice")).alias("place")
    rows = told.unionByName(asked).select(place, "moment", "code").distinct()
    until = Window.partitionBy("place").orderBy("moment").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    answered = rows.withColumn("inside", F.max("code").over(until))
    before = Window.partitionBy("place.room_id").orderBy("place.slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = answered.groupBy("place").agg(F.max("inside").alias("tail")).select("place", F.max("tail").over(before).alias("carried"))
    found = F.coalesce("inside", "carried")
    return (
        answered.where(F.col("code").isNull())
        .join(carried, "place", "left")
        .select(
            "place.room_id",
            "moment",
            F.coalesce(code_in_room(found), F.lit(False)).alias("in_room"),
            F.timestamp_micros(code_micros(found)).alias("since"),
        )
    )


def _occupied(presence: DataFrame, now: Column, starts: Sequence[Column], slice_seconds: int) -> DataFrame:
    """Per room: occupied microseconds in ``[start, now]`` for each start, and the latest presence.

    ``presence`` has the columns of ``_presence_rows``.

    1. Condense (map side first): everything at or before the oldest start becomes one row per room, copies
       of a transition become one row, future and unusable rows become one row that only feeds ``latest``.
       What is shuffled grows with the window, not with the history.
    2. Inside (room, time slice) ``lead`` gives the end of every interval but the last of the slice.
    3. Slice summaries, a number bounded by time, are chained per room to close those last intervals.
    """
    micros = F.unix_micros("ts")
    oldest = F.least(*starts) if len(starts) > 1 else starts[0]
    counted = F.coalesce(F.col("usable") & (micros <= now), F.lit(False))
    code = transition_code(F.col("ts"), F.col("in_room"))
    condensed = (
        presence.select(
            "room_id",
            counted.alias("counted"),
            F.when(counted & (micros > oldest), code).alias("inside"),
            F.when(counted, code).alias("code"),
            F.col("rank").alias("latest"),
        )
        .groupBy("room_id", "counted", "inside")
        .agg(F.max("code").alias("code"), F.max("latest").alias("latest"))
    )

    def seconds_in(code: Column, end: Column, start: Column) -> Column:
        return F.when(
            code_in_room(code), F.greatest(F.lit(0), end - F.greatest(code_micros(code), start))
        ).otherwise(F.lit(0))

    in_slice = Window.partitionBy("room_id", "slice").orderBy("code")
    sliced = condensed.withColumn(
        "slice", F.floor(code_micros(F.col("code")) / F.lit(slice_seconds * MICROS)).cast("bigint")
    ).withColumn("following", F.lead("code").over(in_slice))
    closed = [
        F.sum(
            F.when(F.col("following").isNull(), F.lit(0)).otherwise(
                seconds_in(F.col("code"), code_micros(F.col("following")), start)
            )
        ).alias(f"closed_{i}")
        for i, start in enumerate(starts)
    ]
    summaries = sliced.groupBy("room_id", "slice").agg(
        *closed, F.min("code").alias("head"), F.max("code").alias("tail"), F.max("latest").alias("latest")
    )

    of_room = Window.partitionBy("room_id").orderBy(F.col("slice").asc_nulls_last())
    chained = summaries.withColumn("end", F.coalesce(code_micros(F.lead("head").over(of_room)), now))
    totals = [
        F.sum(
            F.col(f"closed_{i}") + F.coalesce(seconds_in(F.col("tail"), F.col("end"), start), F.lit(0))
        ).alias(f"occupied_{i}")
        for i, start in enumerate(starts)
    ]
    return chained.groupBy("room_id").agg(*totals, F.max("latest").alias("latest"))


def _first_arrival() -> Column:
    """(received_at, seq) as one number that sorts alike: 16 digits of microseconds and 20 of the shifted 64-bit seq."""
    received = F.unix_micros("received_at").cast("decimal(17,0)") * F.lit("1e20").cast("decimal(21,0)")
    shifted = F.coalesce("seq", F.lit(0)).cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")
    return (received + shifted).cast("decimal(38,0)")


def _presence_rows(events: DataFrame, as_of, retain_seconds: int | None, all_rooms: bool = False) -> DataFrame:
    """Presence rows with ``rank`` (see ``presence_rank``) and ``usable``: whether the retention keeps them.

    With ``all_rooms`` the rows of other types come along without values, so that a room that only they name has a row; they
    condense to one row per room and task.

    With a retention, copies of a transition are combined on the map side before anything is joined, and the join is
    the one of ``retained_points``: dropped points still count for the current presence of their room.
    """
    if all_rooms and retain_seconds is None:
        told = F.col("type") == "presence"
        values = {"ts": F.col("ts"), "in_room": F.col("in_room"), "rank": _event_rank()}
        return visible(events, as_of).select(
            "room_id", *[F.when(told, value).alias(name) for name, value in values.items()], told.alias("usable")
        )
    presence = presence_events(events, as_of)
    if retain_seconds is None:
        return presence.select("room_id", "ts", "in_room", _event_rank().alias("rank"), F.lit(True).alias("usable"))
    points = presence.groupBy("room_id", "ts", "in_room").agg(
        F.max("received_at").alias("received_at"), F.min(_first_arrival()).alias("first")
    )
    kept = retained_points(points, retain_seconds)
    rank = F.struct("ts", (-F.col("first")).alias("arrival"), F.lit(0).cast("bigint").alias("order"), "in_room")
    # The newest point of a room is always kept, unless its own time is before its last receipt by the retention.
    newest = points.groupBy("room_id").agg(F.max(rank).alias("rank")).select(
        "room_id", F.col("rank.ts").alias("ts"), F.col("rank.in_room").alias("in_room"), "rank", F.lit(False).alias("usable")
    )
    rows = kept.select("room_id", "ts", "in_room", rank.alias("rank"), F.lit(True).alias("usable")).unionByName(newest)
    if all_rooms:
        nothing = [F.lit(None).cast(kind).alias(name) for name, kind in rows.dtypes if name in ("ts", "in_room", "rank")]
        rows = rows.unionByName(rooms_seen(events, as_of).select("room_id", *nothing, F.lit(False).alias("usable")))
    return rows


def occupied_seconds(
    events: DataFrame,
    as_of,
    window_seconds: int,
    retain_seconds: int | None = None,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Seconds occupied in the trailing window, per room with presence events.

    Intervals run between transitions ordered by (ts, in_room): on equal ts, true is last and holds.
    """
    now = as_of_micros(as_of)
    presence = _presence_rows(events, as_of, retain_seconds)
    folded = _occupied(presence, now, [now - window_seconds * MICROS], slice_seconds)
    return folded.select("room_id", (F.col("occupied_0") / float(MICROS)).alias("occupied_seconds"))


def room_occupancy(
    events: DataFrame,
    as_of,
    window_seconds: int,
    rooms: DataFrame | None = None,
    retain_seconds: int | None = None,
    slice_seconds: int = SLICE_SECONDS,
    all_rooms: bool = False,
) -> DataFrame:
    """A10: current presence and occupied share of the trailing window per room, from one scan.

    With ``rooms``, a listed room without presence events gets false and 0.0; with ``all_rooms``, every room that any
    visible event names, in the same scan.
    """
    now = as_of_micros(as_of)
    presence = _presence_rows(events, as_of, retain_seconds, all_rooms)
    folded = _occupied(presence, now, [now - window_seconds * MICROS], slice_seconds).select(
        "room_id",
        F.col("latest.in_room").alias("in_room"),
        F.least(F.col("occupied_0") / F.lit(float(window_seconds * MICROS)), F.lit(1.0)).alias("occupied_pct"),
    )
    if rooms is not None:
        folded = rooms.select("room_id").distinct().join(folded, "room_id", "left")
    return folded.select(
        "room_id",
        F.coalesce("in_room", F.lit(False)).alias("in_room"),
        F.coalesce("occupied_pct", F.lit(0.0)).alias("occupied_pct"),
        F.lit(window_seconds).cast("bigint").alias("window_seconds"),
    )


def occupancy_windows(
    events: DataFrame,
    as_of,
    windows: Sequence[str],
    rooms: DataFrame | None = None,
    retain_seconds: int | None = None,
    slice_seconds: int = SLICE_SECONDS,
    all_rooms: bool = False,
) -> DataFrame:
    """A10 for many window texts in one pass.

    The texts are parameters of the read. Each adds one sum to the same aggregation, so the scan and the
    shuffles do not grow with their number. A text that is not a positive window yields rows with
    ``status = 'invalid_window'`` and no numbers.
    """
    now = as_of_micros(as_of)
    lengths = [parse_window(F.lit(text)) for text in windows]
    starts = [now - F.coalesce(length, F.lit(0)) * MICROS for length in lengths]
    presence = _presence_rows(events, as_of, retain_seconds, all_rooms)
    folded = _occupied(presence, now, starts, slice_seconds)
    if rooms is not None:
        folded = rooms.select("room_id").distinct().join(folded, "room_id", "left")
    answers = F.array(
        *[
            F.struct(
                F.lit(text).alias("window"),
                length.alias("window_seconds"),
                F.coalesce(F.col(f"occupied_{i}"), F.lit(0)).alias("micros"),
            )
            for i, (text, length) in enumerate(zip(windows, lengths))
        ]
    )
    valid = F.col("a.window_seconds").isNotNull()
    share = F.least(F.col("a.micros") / (F.col("a.window_seconds") * float(MICROS)), F.lit(1.0))
    return folded.select(
        "room_id", F.coalesce("latest.in_room", F.lit(False)).alias("in_room"), F.explode(answers).alias("a")
    ).select(
        "room_id",
        "a.window",
        "a.window_seconds",
        F.when(valid, F.col("in_room")).alias("in_room"),
        F.when(valid, share).alias("occupied_pct"),
        F.when(valid, "ok").otherwise("invalid_window").alias("status"),
    )


def rooms_seen(events: DataFrame, as_of) -> DataFrame:
    """Rooms named by any event that had arrived by ``as_of``."""
    return visible(events, as_of).select("room_id").distinct()
