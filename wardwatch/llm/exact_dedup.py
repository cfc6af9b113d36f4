"""Exact de-duplication against a minimal perfect hash over the digests seen before.

The index has one row per shard of the digest space. A shard's distinct digests get a minimal perfect hash: each
level hashes the digests that are left into a bit array, digests alone on their bit stay there, the others go to the
next level; a digest's slot is the rank of its bit. The slot holds the full digest and the locator of the winner, so
a lookup reads one slot and compares all 32 bytes: equal is a repeat, unequal was never seen. Digests that were
never seen are grouped among themselves.

Rows are combined per digest before any shuffle by shard, so a text that a third of all rows carry is one row there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wardwatch.llm.tables import stored

#: Digests per shard: 32 bytes each plus locators, so a shard takes a few MB in its task.
SHARD_DIGESTS = 40_000
#: Bits per digest left, at each level of the hash.
SPARSENESS = 2
INDEX_DDL = "shard long, n long, levels binary, bits binary, digests binary, keep_ids binary, points binary, sizes binary"
GROUP_DDL = "digest binary, keep_id long, points long, size long, seen boolean"
SPACE = "[\\x20\\x09-\\x0D]+"
_NULL_ID = (1 << 63) - 1


def digests(docs: DataFrame) -> DataFrame:
    """One narrow row per document: the SHA-256 of its text without ASCII white space, and its code points."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.unhex(F.sha2(F.regexp_replace(text, SPACE, "").cast("binary"), 256)).alias("digest"),
        F.length(text).cast("bigint").alias("points"),
    )


def groups_of(rows: DataFrame) -> DataFrame:
    """Rows combined per digest: the winner has the most code points, then the smallest doc_id.

    A null doc_id counts as the largest number, and is that number in the groups.
    """
    rows = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(_NULL_ID)))
    order = F.col("points").cast("decimal(12,0)") * F.lit("1e20").cast("decimal(21,0)") - F.col("doc_id").cast("decimal(19,0)")
    return (
        rows.withColumn("order", order.cast("decimal(38,0)"))
        .groupBy("digest")
        .agg(F.max_by("doc_id", "order").alias("keep_id"), F.max("points").alias("points"), F.count("*").alias("size"))
    )


def _words(digest_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = np.ascontiguousarray(digest_bytes).view("<u8").reshape(-1, 4)
    return words[:, 1].copy(), words[:, 2] | np.uint64(1)


def _position(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    x = a + b * np.uint64(level * 2 + 1)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(32)) % np.uint64(size)).astype(np.int64)


def perfect_hash(digest_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level sizes, bits of all levels, and the slot of each digest (rows of 32 bytes, all distinct)."""
    a, b = _words(digest_bytes)
    left, sizes, bits, where = np.arange(len(a)), [], [], np.zeros(len(a), np.int64)
    base = 0
    while len(left):
        size = max(SPARSENESS * len(left), 8)
        at = _position(a[left], b[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        placed = alone[at]
        where[left[placed]] = base + at[placed]
        bits.append(alone)
        sizes.append(size)
        base += size
        left = left[~placed]
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    return np.array(sizes, np.int64), flat, (np.cumsum(flat) - 1)[where]


def slots_of(digest_bytes: np.ndarray, sizes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The slot each digest would have; -1 where no level has its bit."""
    a, b = _words(digest_bytes)
    ranks, slot, left, base = np.cumsum(bits) - 1, np.full(len(a), -1, np.int64), np.arange(len(a)), 0
    for level, size in enumerate(sizes):
        at = base + _position(a[left], b[left], level, int(size))
        hit = bits[at]
        slot[left[hit]] = ranks[at[hit]]
        left, base = left[~hit], base + int(size)
    return slot


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    head = F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("bigint")
    return groups.withColumn("shard", F.pmod(head, F.lit(shards)))


def build_index(groups: DataFrame, shards: int) -> DataFrame:
    """The index of digest groups (columns of ``groups_of``): one row per shard that has digests."""

    def build(key, part):
        rows = _matrix(part["digest"])
        sizes, bits, slot = perfect_hash(rows)
        order = np.argsort(slot)
        packed = [part[c].to_numpy(np.int64)[order].tobytes() for c in ("keep_id", "points", "size")]
        row = (key[0], len(part), sizes.tobytes(), np.packbits(bits).tobytes(), rows[order].tobytes(), *packed)
        return pd.DataFrame([row], columns=[c.split()[0] for c in INDEX_DDL.split(", ")])

    return _sharded(groups, shards).groupBy("shard").applyInPandas(build, INDEX_DDL)


def merge_groups(index: DataFrame, groups: DataFrame, shards: int) -> DataFrame:
    """All groups after new ones arrive: those of the index, updated by repeats, and those never seen.

    ``seen`` tells whether the digest was in the index. The better of two winners stays.
    """

    def merge(key, held, new):
        found = []
        member = np.zeros(len(new), bool)
        if len(held):
            h = held.iloc[0]
            sizes, table = np.frombuffer(h["levels"], np.int64), np.frombuffer(h["digests"], np.uint8).reshape(-1, 32)
            bits = np.unpackbits(np.frombuffer(h["bits"], np.uint8), count=int(sizes.sum())).astype(bool)
            keep, points, size = (np.frombuffer(h[c], np.int64).copy() for c in ("keep_ids", "points", "sizes"))
            if len(new):
                rows = _matrix(new["digest"])
                slot = slots_of(rows, sizes, bits)
                member = (slot >= 0) & (table[np.maximum(slot, 0)] == rows).all(axis=1)
                at, ids, n = slot[member], new["keep_id"].to_numpy(np.int64)[member], new["points"].to_numpy(np.int64)[member]
                better = (n > points[at]) | ((n == points[at]) & (ids < keep[at]))
                keep[at[better]], points[at[better]] = ids[better], n[better]
                size[at] += new["size"].to_numpy(np.int64)[member]
            found.append(pd.DataFrame({"digest": [r.tobytes() for r in table], "keep_id": keep, "points": points, "size": size, "seen": True}))
        if len(new):
            found.append(new.loc[~member, ["digest", "keep_id", "points", "size"]].assign(seen=False))
        return pd.concat(found, ignore_index=True)

    held = index.groupBy("shard")
    return held.cogroup(_sharded(groups, shards).groupBy("shard")).applyInPandas(merge, GROUP_DDL)


def exact_dedup(docs: DataFrame, history_until: int | None = None, shard_digests: int = SHARD_DIGESTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, seen.

    Documents with ``doc_id <= history_until`` came first and fill the index; the others are looked up in it. By
    default the first half of the range of ids is the history. The result does not depend on this split.

    A null text is an empty text, and empty texts are equal to each other. A null doc_id loses against every other
    at equal length. Rows that repeat a doc_id with the same text are one document: they are kept or dropped
    together, and all count. An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    rows = stored(digests(docs), "digests")
    if history_until is None:
        low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
        history_until = 0 if low is None else (low + high) // 2
    early = F.coalesce(F.col("doc_id") <= F.lit(history_until), F.lit(False))
    shards = max(1, -(-rows.count() // shard_digests))
    index = stored(build_index(groups_of(rows.where(early)), shards), "digest-index")
    groups = merge_groups(index, groups_of(rows.where(~early)), shards)
    keep_id = F.when(F.col("keep_id") != _NULL_ID, F.col("keep_id"))
    return rows.join(groups.drop("points"), "digest").select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.col("size").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "seen",
    )
