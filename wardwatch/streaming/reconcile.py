"""Continuous reconciliation of falls and alarms (F7), on the watermark of the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wardwatch.functions.keys import dedup_key
from wardwatch.schema import WATERMARK
from wardwatch.sources.alarm_table import stream_alarms
from wardwatch.sources.event_log import stream_log
from wardwatch.streaming.ingest import with_event_watermark

RECONCILED_DDL = "dedup_key STRING, room_id STRING, fall_second TIMESTAMP, expected BIGINT, alarms BIGINT, verdict STRING"


def settled_keys(events: DataFrame, alarms: DataFrame, wait: str = WATERMARK) -> DataFrame:
    """One row per dedup key whose time is over, from the log and the alarm table as streams.

    Falls and alarms of a key meet in one aggregation over their union, a full outer join that combines copies on the
    map side, so a key with very many falls sends one row per task. A key fixes the second of its fall, so that second is the window: a key
    has one group, which closes when the newest event of the log, of whatever type, is later by ``wait``. Only the log moves this clock: an
    alarm job that stands still does not hold back its misses, and an alarm that is ahead of the log waits.
    """
    # The condition names ts, else the optimizer would filter below the watermark and only falls would move the clock.
    usable = (F.col("type") == "fall_warn") & F.col("confidence").isNotNull()
    log = with_event_watermark(events, wait).where(usable == F.col("ts").isNotNull())
    key = dedup_key(F.col("device_id"), F.col("room_id"), F.col("ts")).alias("dedup_key")
    falls = log.select(key, "room_id", "ts", F.lit(1).alias("fall"), F.lit(0).alias("alarm"))
    raised = alarms.select("dedup_key", "room_id", "ts", F.lit(0).alias("fall"), F.lit(1).alias("alarm"))
    keys = falls.union(raised).groupBy("dedup_key", "room_id", F.window("ts", "1 second").alias("second"))
    delta = F.col("alarms") - F.col("expected")
    return (
        keys.agg(F.max("fall").cast("bigint").alias("expected"), F.sum("alarm").alias("alarms"))
        .select("dedup_key", "room_id", F.col("second.start").alias("fall_second"), "expected", "alarms")
        .withColumn("verdict", F.when(delta > 0, "leak").when(delta < 0, "miss").otherwise("match"))
    )


def start_reconcile(
    spark: SparkSession,
    log_path: str,
    alarm_path: str,
    path: str,
    checkpoint: str,
    wait: str = WATERMARK,
    max_files_per_trigger: int = 1000,
    **trigger,
) -> StreamingQuery:
    """F7 while the jobs run: match, leak (too many alarms), or miss (none) per dedup key, once its time is over.

    ``wait`` must cover what the alarm job may be behind the log. Falls or alarms that come later than that are counted as dropped:
    end with ``ingest.raise_if_dropped``. The rows are partitioned by verdict, so a read of the misses skips the matches.
    """
    settled = settled_keys(stream_log(spark, log_path, max_files_per_trigger), stream_alarms(spark, alarm_path), wait)
    return (
        settled.writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("verdict")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_reconciled(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECONCILED_DDL).parquet(path)
