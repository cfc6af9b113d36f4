"""Reading the corpus tables, and intermediate tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardwatch.session import new_table_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written once to the shared folder and read again: it is computed once and has no long lineage."""
    path = new_table_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as bigint and ``text`` with null as empty; every other column but ``more`` is left out."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def text_bytes(docs: DataFrame) -> tuple[int, int]:
    """Rows and bytes of all texts: one narrow pass, used to choose how many parts work is dealt into."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)
