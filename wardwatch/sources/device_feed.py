"""Adapter from the generic ``events`` table to sensor events.

The table has users, event types, and values but no rooms, receipt times, late rows, or repeats. The adapter maps
its types to sensor types, puts two devices in a room, gives every row a receipt time (some skewed, some late),
and repeats falls one to three times, six seconds apart. It is pure projection; copies come from an explode of
a short sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardwatch.functions.timeline import iso_text
from wardwatch.operators.validate import apply_time_rules
from wardwatch.schema import ARRIVAL_COLUMNS, EVENT_COLUMNS, MICROS
from wardwatch.sources.raw_json import spread_for_parsing

# Fixed values of the mapping.
TYPE_OF = {"click": "heartbeat", "view": "motion", "purchase": "presence", "signup": "sleep_state"}
DELAY_SECONDS = {0: 7200, 1: -7200, 2: 45, 3: 1200}
COPY_GAP_SECONDS = 6


def _padded(number: Column, width: int) -> Column:
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))


def _event_type() -> Column:
    mapped = F.lit("fall_warn")
    for source, target in TYPE_OF.items():
        mapped = F.when(F.col("event_type") == source, target).otherwise(mapped)
    return mapped


def _receipt() -> Column:
    delay = F.lit(1)
    for remainder, seconds in DELAY_SECONDS.items():
        delay = F.when(F.col("event_id") % 20 == remainder, seconds).otherwise(delay)
    seconds = delay + COPY_GAP_SECONDS * (F.col("copy") - 1)
    return F.timestamp_micros(F.unix_micros("ts") + seconds.cast("bigint") * MICROS)


SOURCE_DDL = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)


def source_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(SOURCE_DDL).parquet(f"{sf_dir}/events.parquet")


def stream_source_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(SOURCE_DDL).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def device_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed arrivals before the time rules."""
    return adapt(source_events(spark, sf_dir))


def adapt(source: DataFrame) -> DataFrame:
    """Source rows, batch or streaming, to event_id, the envelope, and the two typed payload fields."""
    copies = F.when(F.col("event_type") == "error", 1 + F.col("event_id") % 3).otherwise(F.lit(1))
    return (
        source.select(
            "event_id",
            F.col("ts").cast("timestamp").alias("ts"),
            "user_id",
            "event_type",
            "value",
            F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("copy"),
        )
        .select(
            "event_id",
            (F.col("event_id") * 10 + F.col("copy")).alias("seq"),
            F.concat(F.lit("dev_"), _padded(F.col("user_id"), 4)).alias("device_id"),
            F.concat(F.lit("room_"), _padded(F.floor(F.col("user_id") / 2), 3)).alias("room_id"),
            _event_type().alias("type"),
            "ts",
            _receipt().alias("received_at"),
            F.when(F.col("event_type") == "purchase", F.col("value") >= 40).alias("in_room"),
            F.when(F.col("event_type") == "error", F.least(F.col("value") / 400, F.lit(0.99))).alias("confidence"),
        )
    )


def feed_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed after the time rules, in the stored arrival layout."""
    ruled = apply_time_rules(device_feed(spark, sf_dir))
    accepted = F.col("reason").isNull()
    return (
        ruled.withColumn("payload", F.to_json(F.struct("in_room", "confidence")))
        .withColumn("raw", F.lit(None).cast("string"))
        .withColumn("outcome", F.when(accepted, "accepted").otherwise("rejected"))
        .withColumn("event_date", F.to_date("received_at"))
        .select(*ARRIVAL_COLUMNS)
    )


def feed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted events of the feed."""
    return feed_arrivals(spark, sf_dir).where(F.col("reason").isNull()).select(*EVENT_COLUMNS)


def wire_json(feed: DataFrame) -> DataFrame:
    """The feed as wire records: one flat JSON text per row with its receipt time.

    Every 13th event is spoiled, in ten ways chosen by its id, so that each parse and schema rule has rows.
    """
    good = F.to_json(
        F.struct(
            "device_id", "room_id", "type", iso_text(F.col("ts")).alias("ts"), "seq", "in_room", "confidence"
        )
    )
    tail = F.substring(good, 2, 2_147_483_647)
    spoiled = [
        F.lit("not json"),
        F.concat(F.lit("["), good, F.lit("]")),
        F.concat(good, F.lit(" extra")),
        F.regexp_replace(good, '"room_id":"[^"]*",', ""),
        F.regexp_replace(good, '"device_id":"[^"]*"', '"device_id":""'),
        F.regexp_replace(good, '"ts":"[^"]*"', '"ts":1719662400'),
        F.regexp_replace(good, '"seq":([0-9]+)', '"seq":"$1"'),
        F.regexp_replace(good, '"seq":[0-9]+', '"seq":true'),
        F.regexp_replace(good, '"ts":"[^"]*"', '"ts":"not-a-timestamp"'),
        F.concat(F.lit('{"type":7,'), F.regexp_replace(tail, '"type":"[^"]*",', "")),
    ]
    kind = F.floor(F.col("event_id") / 13) % len(spoiled)
    raw = good
    for number, text in enumerate(spoiled):
        raw = F.when((F.col("event_id") % 13 == 0) & (kind == number), text).otherwise(raw)
    return feed.select("event_id", raw.alias("raw"), "received_at")


def feed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wire_json(adapt(spread_for_parsing(source_events(spark, sf_dir))))
