"""Labelled training rows for the classifiers: a bounded sample, and the split into training and held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardwatch.llm.tables import texts


def remainder(modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo ``modulus``; -1 for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % F.lit(modulus), F.lit(-1))


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: dict[int, int], max_bytes: int):
    """Texts and labels of at most ``per_class[label]`` training rows of each class, and the class counts of all labels.

    Rows are taken by a hash of their doc_id, so the same tables give the same sample. Held-out rows, labels other than 0
    and 1, documents with contradicting labels, and texts over ``max_bytes`` are no training rows.
    """
    ids = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(modulus) != held_out))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("high"))
        .where(F.col("label") == F.col("high"))
        .select("doc_id", "label")
    )
    counts = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for value, n in per_class.items():
        part = ids.where(F.col("label") == value).orderBy(F.xxhash64("doc_id", F.lit(label)), "doc_id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most the sum of ``per_class`` rows of two numbers.
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").where(F.octet_length("text") <= max_bytes)
    found = sorted((r["doc_id"], r["text"], r["label"]) for r in rows.select("doc_id", "text", "label").collect())
    return [t for _, t, _ in found], [v for _, _, v in found], counts
