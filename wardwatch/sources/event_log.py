"""The append-only event log.

One table holds every arrival, partitioned by ``outcome`` and ``event_date`` (date of receipt). Its accepted side is
the event log, its rejected side the dead letters. A log directory is written either by batch appends or by
the streaming sink, not by both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardwatch.functions.timeline import as_of_literal
from wardwatch.schema import ARRIVAL_DDL, EVENT_COLUMNS, REJECT_COLUMNS

PARTITION_COLUMNS = ("outcome", "event_date")


def append_arrivals(arrivals: DataFrame, path: str) -> None:
    """S3: append a batch; duplicates are kept, one row per arrival.

    The rebalance hint lets the adaptive planner split a day that holds most rows and merge small ones, so
    files are well sized. Sorting by type lets a read of one type skip row groups.
    """
    (
        arrivals.hint("rebalance", *PARTITION_COLUMNS)
        .sortWithinPartitions(*PARTITION_COLUMNS, "type", "received_at")
        .write.mode("append")
        .partitionBy(*PARTITION_COLUMNS)
        .parquet(path)
    )


def compact_log(spark: SparkSession, path: str, target: str) -> None:
    """The same arrivals under a new path in few well-sized files per day, whatever number of files the stream made.

    The old log stays as it is for streams that read it; switch readers and the job over while the job is stopped.
    """
    append_arrivals(read_arrivals(spark, path), target)


def read_arrivals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARRIVAL_DDL).parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Accepted events with their ``event_date``."""
    return _accepted(read_arrivals(spark, path))


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    return read_arrivals(spark, path).where(F.col("outcome") == "rejected").select(*REJECT_COLUMNS)


def stream_log(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Accepted events as a stream over the log, so derived data is never ahead of it."""
    stream = spark.readStream.schema(ARRIVAL_DDL).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)
    return _accepted(stream)


def _accepted(arrivals: DataFrame) -> DataFrame:
    return arrivals.where(F.col("outcome") == "accepted").select(*EVENT_COLUMNS, "event_date")


def log_since(log: DataFrame, cutoff) -> DataFrame:
    """Events received at or after ``cutoff``, ordered by device time.

    The cutoff is on receipt, so an old event that arrived late is included. The date condition prunes
    partitions.
    """
    moment = as_of_literal(cutoff)
    return log.where((F.col("received_at") >= moment) & (F.col("event_date") >= F.to_date(moment))).orderBy(
        "ts", "received_at", F.col("seq").asc_nulls_first()
    )
