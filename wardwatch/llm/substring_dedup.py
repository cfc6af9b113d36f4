"""Repeated word windows by level-wise doubling.

Level one looks for windows of ``first`` words that occur more than once. A window of twice the length is looked at
only where both of its halves were repeated, and so on until the length is ``width``; where nothing survives, the
work ends. At each level a chunk of documents sends its distinct surviving hashes to the buckets of the hash space, see
``shared``. At the last level a chunk also sends where it has the window first, and learns whether that is
the first place in all documents: every other place is removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardwatch.llm import hashing
from wardwatch.llm.shared import Dealt, answers, bucket_of, dealt, flags_of, in_order, order_ids, requests_of, runs

WIDTH = 20
FIRST = 10
PLACE = np.dtype([("hash", "<u8"), ("more", "<u4"), ("doc", "<i8"), ("tie", "<i8"), ("at", "<u4")])


class Levels:
    """The windows of a chunk, level by level."""

    def __init__(self, table: pa.Table, first: int, width: int):
        self.table = in_order(table)
        self.data, self.at = hashing.joined(self.table.column("text"))
        self.words = hashing.words_of(self.data, self.at)
        self.first, self.width = first, width
        self.length = first
        self.hashes = hashing.window_hashes(self.words.hashes, first)
        self.alive = self.words.whole(first)[: len(self.hashes)]

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct hashes of the windows alive, the place of each alive window among them, and the count of each."""
        return np.unique(self.hashes[self.alive], return_inverse=True, return_counts=True)[0:3]

    def keep(self, answered: pa.Table, buckets: int) -> None:
        """Windows that occur elsewhere stay; the next length is looked at where both halves stayed."""
        distinct, place, counts = self.distinct()
        repeated = flags_of(distinct, buckets, answered) | (counts > 1)
        alive = np.zeros(len(self.hashes), bool)
        alive[np.flatnonzero(self.alive)] = repeated[place]
        n = max(0, len(alive) - self.length)
        self.hashes = hashing.combined(self.hashes[:n], self.hashes[self.length :][:n])
        self.alive = alive[:n] & alive[self.length :][:n]
        self.length *= 2
        self.alive &= self.words.whole(self.length)[:n]

    def replay(self, answered: pa.Table, buckets: int) -> None:
        """Bring the chunk to its next level from the answers of all levels before."""
        levels = answered.column("level").to_numpy()
        while self.length < self.width:
            self.keep(answered.filter(pa.array(levels == self.length)), buckets)

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For windows alive: sorted distinct hashes, the word where each begins first, the place of each window."""
        where = np.flatnonzero(self.alive)
        distinct, begin, place = np.unique(self.hashes[where], return_index=True, return_inverse=True)
        return distinct, where[begin], place


def _requests(dealt_docs: Dealt, known: DataFrame | None, length: int, first: int, width: int) -> DataFrame:
    buckets = dealt_docs.buckets
    ddl = "bucket long, chunk long, hashes binary"
    if known is None:
        def start(key, table):
            return requests_of(Levels(table, first, width).distinct()[0], key[0].as_py(), buckets)

        return dealt_docs.docs.groupBy("chunk").applyInArrow(start, ddl)

    def further(key, table, answered):
        if not table.num_rows:
            return requests_of(np.zeros(0, np.uint64), 0, buckets)
        levels = Levels(table, first, length)
        levels.replay(answered, buckets)
        return requests_of(levels.distinct()[0], key[0].as_py(), buckets)

    return dealt_docs.docs.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(further, ddl)


def _last_requests(dealt_docs: Dealt, known: DataFrame, first: int, width: int) -> DataFrame:
    buckets = dealt_docs.buckets

    def send(key, table, answered):
        rows = []
        if table.num_rows:
            levels = Levels(table, first, width)
            levels.replay(answered, buckets)
            distinct, begin, _ = levels.places()
            ids, ties, words = order_ids(levels.table), levels.table.column("tie").to_numpy(), levels.words
            more = hashing.window_hashes(words.hashes, width, salt=1)
            sent = np.zeros(len(distinct), PLACE)
            sent["hash"], sent["more"] = distinct, more[begin] >> np.uint64(32)
            sent["doc"], sent["tie"] = ids[words.text[begin]], ties[words.text[begin]]
            sent["at"] = begin - np.searchsorted(words.text, words.text[begin])
            for bucket, a, b in runs(bucket_of(distinct, buckets)):
                part = sent[a:b]
                rows.append((bucket, key[0].as_py(), b"".join(np.ascontiguousarray(part[c]).tobytes() for c in PLACE.names)))
        columns = zip(*rows) if rows else ([], [], [])
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["bucket", "chunk", "hashes"])

    return dealt_docs.docs.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(send, "bucket long, chunk long, hashes binary")


def _first_places(requests: DataFrame) -> DataFrame:
    """For each request row, a bit per window: whether no other chunk has the window earlier."""

    def unpacked(raw: bytes) -> np.ndarray:
        n = len(raw) // PLACE.itemsize
        out, at = np.zeros(n, PLACE), 0
        for c in PLACE.names:
            size = n * PLACE[c].itemsize
            out[c] = np.frombuffer(raw[at : at + size], PLACE[c])
            at += size
        return out

    def answer(key, table):
        parts = [unpacked(x) for x in table.column("hashes").to_pylist()]
        edges = np.cumsum([0, *map(len, parts)])
        every = np.concatenate(parts) if parts else np.zeros(0, PLACE)
        order = np.lexsort((every["at"], every["tie"], every["doc"], every["more"], every["hash"]))
        s = every[order]
        begins = np.ones(len(s), bool)
        begins[1:] = (s["hash"][1:] != s["hash"][:-1]) | (s["more"][1:] != s["more"][:-1])
        earliest = np.zeros(len(s), bool)
        earliest[order] = begins
        bits = [np.packbits(earliest[a:b]).tobytes() for a, b in zip(edges, edges[1:])]
        return pa.table([table.column("bucket"), table.column("chunk"), pa.array(bits, pa.binary())], names=["bucket", "chunk", "bits"])

    return requests.groupBy("bucket").applyInArrow(answer, "bucket long, chunk long, bits binary")


def _covered(levels: Levels, answered: pa.Table, buckets: int) -> np.ndarray:
    """For each word of the chunk whether a window that also begins earlier covers it."""
    distinct, begin, place = levels.places()
    last = answered.filter(pa.array(answered.column("level").to_numpy() == levels.width))
    earliest = flags_of(distinct, buckets, last)
    where = np.flatnonzero(levels.alive)
    stays = earliest[place] & (where == begin[place])
    steps = np.zeros(len(levels.words.text) + 1, np.int64)
    np.add.at(steps, where[~stays], 1)
    np.subtract.at(steps, where[~stays] + levels.width, 1)
    return np.cumsum(steps)[:-1] > 0


def remove_repeats(docs: DataFrame, width: int = WIDTH, first: int = FIRST, keep_text: bool = True) -> DataFrame:
    """Documents without words of windows of ``width`` words that also begin earlier.

    Earlier means a smaller doc_id or, in one document, an earlier start; a null doc_id is before all others, and rows
    of equal doc_id are ordered by a hash of their text. ``width`` is ``first`` times a power of two. Columns: doc_id, n_words,
    n_removed, and kept (the words left, joined by one space), or with ``keep_text`` off its SHA-256 as kept_sha256. A
    null or empty text has no words. Repeated rows all come back, the later ones without the windows. An empty table
    gives no rows.
    """
    if first < 1 or width % first or (width // first) & (width // first - 1):
        raise ValueError("width must be first times a power of two")
    parts = dealt(docs)
    # Rows of one doc_id in several chunks are told apart by this; equal ones are in one chunk.
    parts = Dealt(parts.docs.withColumn("tie", F.xxhash64("doc_id", "text")), parts.buckets)
    buckets, known, length = parts.buckets, None, first
    while length < width:
        found = answers(_requests(parts, known, length, first, width)).withColumn("level", F.lit(length))
        known = found if known is None else known.unionByName(found)
        length *= 2
    if known is None:
        known = docs.sparkSession.createDataFrame([], "bucket long, chunk long, bits binary, level int")
    last = _first_places(_last_requests(parts, known, first, width)).withColumn("level", F.lit(width))
    names = ["doc_id", "n_words", "n_removed", "kept" if keep_text else "kept_sha256"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())

    def finish(key, table, answered):
        rows = []
        if table.num_rows:
            levels = Levels(table, first, width)
            levels.replay(answered, buckets)
            gone = _covered(levels, answered, buckets)
            words, data = levels.words, levels.data.tobytes()
            edges = np.searchsorted(words.text, np.arange(levels.table.num_rows + 1))
            for doc_id, a, b in zip(levels.table.column("doc_id").to_pylist(), edges, edges[1:]):
                stay = np.flatnonzero(~gone[a:b]) + a
                kept = b" ".join([data[i:j] for i, j in zip(words.start[stay].tolist(), words.end[stay].tolist())])
                rows.append((doc_id, b - a, b - a - len(stay), kept.decode() if keep_text else hashlib.sha256(kept).hexdigest()))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=names)

    every = known.unionByName(last)
    ddl = ", ".join(f"{c} {t}" for c, t in zip(names, ("long", "long", "long", "string")))
    return parts.docs.groupBy("chunk").cogroup(every.groupBy("chunk")).applyInArrow(finish, ddl)
