"""Streaming validation into the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from wardwatch.operators.metrics import ingest_counter_columns
from wardwatch.operators.validate import validate_raw
from wardwatch.schema import WATERMARK
from wardwatch.sources.event_log import PARTITION_COLUMNS


def start_log(raw_stream: DataFrame, path: str, checkpoint: str, parse_tasks: int | None = None, **trigger) -> StreamingQuery:
    """Validate a stream of (raw, received_at) and append every arrival to the log.

    ``parse_tasks`` deals the texts of a batch to so many tasks first: without it, a source file is parsed by one task.
    Rows are clustered by the partition columns before the sink, so a batch makes few files per day.

    One query writes accepted and rejected rows as partitions of one table, so a row is on exactly one side
    even when its receipt time is the batch time. The file sink commits each batch once. The ingest counters
    (M1) of every batch are in the query progress under ``ingest``.
    """
    counters = [column.alias(name) for name, column in ingest_counter_columns().items()]
    if parse_tasks is not None:
        raw_stream = raw_stream.repartition(parse_tasks)
    return (
        validate_raw(raw_stream)
        .observe("ingest", *counters)
        .hint("rebalance", *PARTITION_COLUMNS)
        .writeStream.format("parquet")
        .outputMode("append")
        .partitionBy(*PARTITION_COLUMNS)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def with_event_watermark(events: DataFrame, wait: str = WATERMARK) -> DataFrame:
    """Watermark that drops no accepted event while receipts do not go back between batches.

    An accepted ``ts`` is within one hour of its receipt on both sides, so it is never more than two hours
    behind the newest one. A backlog may go back; end such a query with ``raise_if_dropped``. The alarm and state jobs
    use no watermark, the reconciliation does.
    """
    return events.withWatermark("ts", wait)


def raise_if_dropped(query: StreamingQuery) -> None:
    """Fail when a stateful operator of the query has dropped rows behind its watermark."""
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    if dropped:
        raise RuntimeError(f"{dropped} rows came behind the watermark")
