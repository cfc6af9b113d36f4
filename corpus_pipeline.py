"""From raw documents to packed sequences: five stages, each over everything its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardwatch.llm import exact_dedup, ngram_join, packing, quality, suffix_index
from wardwatch.llm.tables import read, stored

VOCABULARY = "word_bpe_49k.json"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents whose doc_id is not among the dropped ones. A null doc_id is never dropped here."""
    return docs.join(dropped.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Null and empty texts are judged by it like others."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.scored(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; of rows that repeat a doc_id with equal texts, one.

    Rows are kept by id and text, so an id that stands for several texts, or a row without an id, goes by its own text.
    """
    found = exact_dedup.exact_dedup(docs).where("kept")
    sha = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), exact_dedup.SPACE, "").cast("binary"), 256)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    keyed = docs.select(*COLUMNS, sha.alias("sha"), key.alias("key"))
    kept = found.select(key.alias("key"), F.col("text_sha256").alias("sha")).distinct()
    longest = keyed.join(kept, ["key", "sha"], "left_semi").groupBy("key", "sha").agg(
        F.max_by(F.struct(*COLUMNS), F.length(F.coalesce("text", F.lit("")))).alias("row")
    )
    return longest.select("row.*")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates."""
    found = ngram_join.near_duplicates(docs)
    return without(docs, found.where("component_id is not null and component_id <> doc_id"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes that repeat in the corpus; n_chars is that of what is left."""
    cut = suffix_index.remove_repeated_bytes(docs, more=("lang", "source"))
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("bigint").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document with their place in a sequence."""
    return packing.packed(docs, public_tokenizers.path(VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

#: The quality model, the tokenizer and the packing plan have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
