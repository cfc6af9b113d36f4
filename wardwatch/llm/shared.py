"""Finding hashes that occur in more than one place, without a row per hash.

Documents are dealt into chunks by their id and text, so rows without an id, or with one id, are spread. A chunk sends each of its distinct hashes once, packed into one row per
bucket of the hash space; a bucket answers each row with one bit per hash. So a hash that a third of all documents
hold is sent once per chunk, memory is bounded by a chunk or a bucket, and the answers are a small part of the requests.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardwatch.llm.tables import text_bytes, texts

#: Bytes of text of a chunk, and of a bucket's share of the corpus: both are held by one task at a time.
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
REQUEST_DDL = "bucket long, chunk long, hashes binary"
REQUEST_NAMES = ["bucket", "chunk", "hashes"]


@dataclass
class Dealt:
    """Documents with their chunk (doc_id, text, chunk), and into how many buckets hashes are dealt."""

    docs: DataFrame
    buckets: int


def dealt(docs: DataFrame, *more: str, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> Dealt:
    docs = texts(docs, *more)
    _, size = text_bytes(docs)
    chunks = max(1, -(-size // chunk_bytes))
    return Dealt(docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))), max(1, -(-size // bucket_bytes)))


def in_order(table: pa.Table) -> pa.Table:
    """Rows of a chunk by doc_id (null first), then tie where there is one, then text: the same order each time it is read."""
    columns = [c for c in ("doc_id", "tie", "text") if c in table.column_names]
    return table.sort_by([(c, "ascending") for c in columns], null_placement="at_start") if table.num_rows > 1 else table


def order_ids(table: pa.Table) -> np.ndarray:
    """doc_id as numbers; null before all others."""
    return table.column("doc_id").combine_chunks().fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """By the upper half of the hash, so sorted hashes have sorted buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def runs(sorted_values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of each run of equal values."""
    if not len(sorted_values):
        return []
    cut = np.flatnonzero(np.diff(sorted_values)) + 1
    edges = [0, *cut.tolist(), len(sorted_values)]
    return [(int(sorted_values[a]), a, b) for a, b in zip(edges, edges[1:])]


def requests_of(distinct: np.ndarray, chunk: int, buckets: int) -> pa.Table:
    """One row per bucket: the lower halves of a chunk's sorted distinct hashes. The bucket is most of the upper half."""
    low = (distinct & np.uint64(0xFFFFFFFF)).astype("<u4")
    rows = [(k, chunk, low[a:b].tobytes()) for k, a, b in runs(bucket_of(distinct, buckets))]
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ([], [], []), (pa.int64(), pa.int64(), pa.binary()))], names=REQUEST_NAMES)


def twice(values: np.ndarray) -> np.ndarray:
    """For each value whether it occurs again."""
    order = np.argsort(values, kind="stable")
    same = np.diff(values[order]) == 0
    found = np.zeros(len(values), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return found


def answers(requests: DataFrame) -> DataFrame:
    """For each request row, a bit per hash: whether another request of the bucket has it."""

    def answer(key, table):
        hashes = table.column("hashes").to_pylist()
        sizes = [len(x) // 4 for x in hashes]
        found = twice(np.frombuffer(b"".join(hashes), "<u4"))
        edges = np.cumsum([0, *sizes])
        bits = [np.packbits(found[a:b]).tobytes() for a, b in zip(edges, edges[1:])]
        return pa.table([table.column("bucket"), table.column("chunk"), pa.array(bits, pa.binary())], names=["bucket", "chunk", "bits"])

    return requests.groupBy("bucket").applyInArrow(answer, "bucket long, chunk long, bits binary")


def flags_of(distinct: np.ndarray, buckets: int, answered: pa.Table) -> np.ndarray:
    """The answers to ``requests_of`` put back in the order of the distinct hashes."""
    bits = dict(zip(answered.column("bucket").to_pylist(), answered.column("bits").to_pylist()))
    found = np.zeros(len(distinct), bool)
    for bucket, a, b in runs(bucket_of(distinct, buckets)):
        found[a:b] = np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=b - a).astype(bool)
    return found
