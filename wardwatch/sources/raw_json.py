"""Raw JSON arrivals, one object per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardwatch.functions.timeline import as_of_literal


def read_raw(spark: SparkSession, path: str, received_at) -> DataFrame:
    """Text files of JSON lines with the receipt time of the load: a time, or a column over the file rows."""
    stamp = received_at if isinstance(received_at, Column) else as_of_literal(received_at)
    return spark.read.text(path).select(F.col("value").alias("raw"), stamp.alias("received_at"))


def spread_for_parsing(raw: DataFrame) -> DataFrame:
    """Spread a batch that is read by fewer tasks than there are cores.

    Validation is bound by CPU, and compressed text or a file of one row group is read by one task. An
    input that already has a task per core, as any large one does, is left alone and pays no shuffle.
    """
    cores = raw.sparkSession.sparkContext.defaultParallelism
    return raw.repartition(cores) if raw.rdd.getNumPartitions() < cores else raw


def stream_raw(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """New files under ``path`` as a stream, received when their micro-batch starts.

    Intake is bounded by ``max_files_per_trigger``; files beyond it wait and none is dropped. The receipt
    time is the batch time that Spark records in the checkpoint, so a re-run batch gets the same one. A
    Kafka topic drops in as any stream with ``raw`` and ``received_at`` columns, bounded by
    ``maxOffsetsPerTrigger``.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(path)
    return lines.select(F.col("value").alias("raw"), F.current_timestamp().alias("received_at"))
