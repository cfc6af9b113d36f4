"""The alarm table: insert-or-ignore sink, compaction, and readers.

A row is written once and never again, so a stream over the table gives every alarm once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardwatch.schema import ALARM_COLUMNS, ALARM_DDL

STORED_DDL = ALARM_DDL + ", dispatched_at TIMESTAMP, batch STRING, alarm_date DATE"


def insert_or_ignore(candidates: DataFrame, alarms: DataFrame) -> DataFrame:
    """Candidates whose key is not stored. Both sides have one row per key, so the join has no hot key."""
    return candidates.join(alarms.select("dedup_key"), "dedup_key", "left_anti").select(*ALARM_COLUMNS)


def read_alarms(spark: SparkSession, path: str) -> DataFrame:
    """The stored alarms; empty before the first write."""
    try:
        return spark.read.schema(STORED_DDL).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED_DDL)


def stream_alarms(spark: SparkSession, path: str) -> DataFrame:
    """Alarm table as a stream: what is stored first, then what is added."""
    return spark.readStream.schema(STORED_DDL).parquet(path).select(*ALARM_COLUMNS)


def stream_dispatched(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """As ``stream_alarms``, with the time of dispatch."""
    stored = spark.readStream.schema(STORED_DDL).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)
    return stored.select(*ALARM_COLUMNS, "dispatched_at")


def _write(rows: DataFrame, path: str) -> None:
    (
        rows.repartitionByRange("alarm_date", "room_id", "ts")
        .sortWithinPartitions("alarm_date", "room_id", "ts", "received_at", "dedup_key")
        .write.mode("append")
        .partitionBy("alarm_date")
        .parquet(path)
    )


def append_alarms(alarms: DataFrame, path: str, batch: str, dispatched_at: Column | None = None) -> None:
    """Append alarms that are known not to be stored, ordered per room (T7). ``dispatched_at`` (M3) is the time of the write unless given."""
    moment = F.current_timestamp() if dispatched_at is None else dispatched_at
    _write(
        alarms.select(*ALARM_COLUMNS, moment.alias("dispatched_at"), F.lit(batch).alias("batch"), F.to_date("ts").alias("alarm_date")), path
    )


def store_alarms(candidates: DataFrame, path: str, batch: str, dispatched_at: Column | None = None) -> None:
    """Append the alarms of one batch that are not stored.

    The key fixes the second of the alarm, so only the alarm dates of the candidates can hold the same key; the scan of the stored table is
    limited to these. A repeated batch finds its own rows and writes nothing; after a half-written one only the missing rows are added.
    """
    # One row per date.
    dates = [row[0] for row in candidates.select(F.to_date("ts")).distinct().collect()]
    if dates:
        stored = read_alarms(candidates.sparkSession, path).where(F.col("alarm_date").isin(dates))
        append_alarms(insert_or_ignore(candidates, stored), path, batch, dispatched_at)


def compact_alarms(spark: SparkSession, path: str, target: str) -> None:
    """The same alarms in few large files under a new path, clustered by date and room.

    The old table stays as it is for streams that read it; switch readers and the job over while the job is stopped.
    """
    _write(read_alarms(spark, path), target)
