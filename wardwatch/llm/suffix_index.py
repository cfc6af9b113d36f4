"""Repeated byte strings by a logarithmic family of suffix arrays.

**Suffixes.** Only suffixes at anchors are indexed. Of the 8-byte grams in the first ``reach`` bytes of a window of
``span`` bytes, the one with the smallest hash is the window's anchor; equal windows have their anchor at the same place, so
every repeat of ``span`` bytes shows up at an anchor. An anchor's entry holds the name of the bytes every one of its windows
shares (the ``span - reach`` bytes from the anchor on) and the name of its context, which is all bytes of all its windows.
Names are hashes, as in suffix sorting by naming: entries are ordered by name, so equal prefixes are neighbours,
and the order among different names does not matter for finding repeats.

**Family.** Entries are dealt into buckets of the name space; a level is one sorted array per bucket. A new batch of
documents gets its own arrays, which are merged in a scan with each level; neighbours with equal names are matches.
Before the next batch comes, levels of equal size are merged into one of twice the size, so a batch meets at most a
logarithm of the number of batches.

**Windows.** An anchor whose name nobody shares has no repeated window. If all that share its name have the same context,
all its windows are repeated. Else each window of its context is looked up: a chunk sends the hash of each distinct one once, to a bucket
by window and name, so the contexts of a name that a third of all documents have are spread over all buckets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardwatch.llm import hashing
from wardwatch.llm.shared import bucket_of, dealt, in_order, runs, twice
from wardwatch.llm.tables import stored

SPAN = 200
GRAM = 8
BATCHES = 4
ENTRY = np.dtype([("name", "<u4"), ("context", "<u8")])
PLACED = np.dtype([("name", "<u4"), ("context", "<u8"), ("chunk", "<u4"), ("at", "<u4")])
_RAW_DDL = "kind string, bucket long, chunk long, x binary, y binary"
_RAW_NAMES = ["kind", "bucket", "chunk", "x", "y"]
_RAW_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())


def _raw(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows) if rows else [[]] * 5
    return pa.table([pa.array(x, t) for x, t in zip(columns, _RAW_TYPES)], names=_RAW_NAMES)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value (leftmost of equals) in each run of ``width``; values are below 2**32."""
    n = len(values) - width + 1
    keyed = (values << np.uint64(32)) | np.arange(len(values), dtype=np.uint64)
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = keyed
    table = padded.reshape(-1, width)
    forward = np.minimum.accumulate(table, axis=1).ravel()
    backward = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(backward[:n], forward[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Anchors:
    """Anchors of a chunk in order: their place, first and last start of their windows, name, and context name."""

    def __init__(self, table: pa.Table, span: int):
        self.table, self.span = in_order(table), span
        self.data, self.at = hashing.joined(self.table.column("text"))
        reach = self.reach = max(1, min(3 * span // 4, span - GRAM + 1))
        parts = [self._block(a, b, reach) for a, b in hashing.blocks(self.at)]
        self.place, self.first, self.last, self.name, self.context = (
            (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
        )
        #: Distinct entries in order of names, how often each occurs, and the entry of each anchor.
        order = np.lexsort((self.context, self.name))
        name, context = self.name[order], self.context[order]
        new = np.ones(len(order), bool)
        new[1:] = (name[1:] != name[:-1]) | (context[1:] != context[:-1])
        self.entry = np.zeros(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.names, self.contexts = name[new], context[new]
        self.counts = np.bincount(self.entry, minlength=len(self.names))
        self.example = order[new]

    def _block(self, a: int, b: int, reach: int):
        raw, edges = self.data[self.at[a] : self.at[b]], self.at[a : b + 1] - self.at[a]
        none = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
        n = len(raw) - self.span + 1
        if n <= 0:
            return none
        steps = np.zeros(n + 1, np.int32)
        has = np.diff(edges) >= self.span
        np.add.at(steps, edges[:-1][has], 1)
        np.subtract.at(steps, edges[1:][has] - self.span + 1, 1)
        start = np.flatnonzero(np.cumsum(steps[:-1]))
        if not len(start):
            return none
        gram = min(GRAM, self.span)
        views = np.ndarray((len(raw) - 7,), "<u8", raw.tobytes(), strides=(1,)) if gram == 8 else None
        grams = hashing.mixed(views.copy() * np.uint64(0x9E3779B97F4A7C15)) if gram == 8 else hashing.window_hashes(hashing.mixed(hashing.BYTE_VALUES[raw]), gram)
        anchor = sliding_argmin(grams >> np.uint64(32), reach)[start]
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
        head = np.flatnonzero(new)
        first, last, place = start[head], start[np.append(head[1:], len(start)) - 1], anchor[head]
        named = hashing.Spans(raw).of
        name = named(place, place + self.span - reach + 1)
        end = last + self.span
        shape = (place - first).astype(np.uint64) << np.uint64(32) | (end - place).astype(np.uint64)
        context = hashing.combined(named(first, end), shape)
        base = self.at[a]
        return place + base, first + base, last + base, name, context

    def requests(self, chunk: int, buckets: int) -> pa.Table:
        packed = np.zeros(len(self.names), ENTRY)
        packed["name"], packed["context"] = self.names & np.uint64(0xFFFFFFFF), self.contexts
        rows = [("entries", k, chunk, packed["name"][a:b].tobytes(), packed["context"][a:b].tobytes()) for k, a, b in runs(bucket_of(self.names, buckets))]
        return _raw(rows)

    def marks(self, answered: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """For each distinct entry: whether another place has the same name and context, and the same name with another."""
        same, other = np.zeros(len(self.names), bool), np.zeros(len(self.names), bool)
        begin = {k: a for k, a, _ in runs(bucket_of(self.names, buckets))}
        for bucket, x, y in zip(*(answered.column(c).to_pylist() for c in ("bucket", "x", "y"))):
            same[begin[bucket] + np.frombuffer(x, "<u4")] = True
            other[begin[bucket] + np.frombuffer(y, "<u4")] = True
        return same | (self.counts > 1), other


def _flags(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted entries: whether a neighbour has the same name and context, and whether the name has other contexts."""
    n = len(entries)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool)
    name = entries["name"][1:] == entries["name"][:-1]
    both = name & (entries["context"][1:] == entries["context"][:-1])
    same = np.zeros(n, bool)
    same[1:] |= both
    same[:-1] |= both
    group = np.concatenate([[0], np.cumsum(~name)])
    kinds = np.bincount(group, minlength=group[-1] + 1, weights=np.concatenate([[1], ~both]).astype(np.float64))
    return same, (kinds > 1)[group]


def _merged(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted arrays merged into one, and the order that did it."""
    every = np.concatenate(parts) if parts else np.zeros(0, PLACED)
    order = np.lexsort((every["context"], every["name"]))
    return every[order], order


class IndexFamily:
    """Levels of sorted entries; a level of size ``n`` holds ``n`` batches."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: list[tuple[int, DataFrame]] = []

    def settle(self) -> None:
        """Merge levels of equal size until all sizes differ."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, new), (_, old) = self.levels.pop(), self.levels.pop()

            def merge(key, table):
                entries, _ = _merged([np.frombuffer(x, PLACED) for x in table.column("x").to_pylist()])
                return _raw([("level", key[0].as_py(), 0, entries.tobytes(), b"")])

            merged = stored(old.unionByName(new).groupBy("bucket").applyInArrow(merge, _RAW_DDL), "suffix-level")
            self.levels.append((2 * n, merged))

    def add(self, requests: DataFrame) -> DataFrame:
        """Sort a batch into arrays, scan them with every level, keep them as a new level; the answers to both sides."""
        self.settle()

        def insert(key, table):
            bucket = key[0].as_py()
            kinds, chunks, xs, ys = (table.column(c).to_pylist() for c in ("kind", "chunk", "x", "y"))
            batch, held = [np.zeros(0, PLACED)], []
            for kind, chunk, x, y in zip(kinds, chunks, xs, ys):
                if kind == "level":
                    held.append(np.frombuffer(x, PLACED))
                else:
                    part = np.zeros(len(x) // 4, PLACED)
                    part["name"], part["context"] = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u8")
                    part["chunk"], part["at"] = chunk, np.arange(len(part))
                    batch.append(part)
            array, _ = _merged(batch)
            told = [np.zeros((len(array), 2), bool), *(np.stack(_flags(h), 1) for h in held)]
            rows = []
            every, order = _merged([array, *held])
            found = np.zeros((len(every), 2), bool)
            found[order] = np.stack(_flags(every), 1)
            found &= ~np.concatenate(told)
            whole = np.concatenate([array, *held])
            hit = np.flatnonzero(found.any(axis=1))
            hit = hit[np.argsort(whole["chunk"][hit], kind="stable")]
            for chunk, a, b in runs(whole["chunk"][hit].astype(np.int64)):
                at = hit[a:b]
                x, y = (whole["at"][at[found[at, c]]].tobytes() for c in (0, 1))
                rows.append(("answer", bucket, chunk, x, y))
            if len(array):
                rows.append(("level", bucket, 0, array.tobytes(), b""))
            return _raw(rows)

        scanned = requests
        for _, level in self.levels:
            scanned = scanned.unionByName(level)
        out = stored(scanned.groupBy("bucket").applyInArrow(insert, _RAW_DDL), "suffix-batch")
        self.levels.append((1, out.where("kind = 'level'")))
        return out.where("kind = 'answer'")


class Windows:
    """Windows of the distinct entries whose name others have with other contexts; distinct ones in order of (bucket, hash)."""

    def __init__(self, found: Anchors, other: np.ndarray, buckets: int):
        self.which = np.flatnonzero(other)
        example = found.example[self.which]
        first = found.first[example]
        self.count = found.last[example] - first + 1
        self.begin = np.cumsum(self.count) - self.count
        start = np.repeat(first - self.begin, self.count) + np.arange(self.count.sum())
        hashes = np.zeros(len(start), np.uint64)
        for a, b in hashing.blocks(found.at):
            low, high = found.at[a], found.at[b]
            mine = np.flatnonzero((start >= low) & (start < high))
            if not len(mine):
                continue
            raw, at = found.data[low:high], start[mine] - low
            hashes[mine] = hashing.Spans(raw).of(at, at + found.span)
        bucket = bucket_of(hashing.combined(hashes, np.repeat(found.names[self.which], self.count)), buckets)
        order = np.lexsort((hashes, bucket))
        hashes, bucket = hashes[order], bucket[order]
        new = np.ones(len(order), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (bucket[1:] != bucket[:-1])
        #: For each window of ``which`` its distinct one, and of these hash, bucket, and whether the chunk has it more than once.
        self.place = np.zeros(len(order), np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.hashes, self.bucket = hashes[new], bucket[new]
        self.again = np.bincount(self.place, minlength=len(self.hashes)) > 1

    def requests(self, chunk: int) -> list[tuple]:
        return [("hashes", k, chunk, self.hashes[a:b].tobytes(), b"") for k, a, b in runs(self.bucket)]


def _windows_answer(key, table):
    """For each request row, a bit per window: whether another chunk has it."""
    hashes = [np.frombuffer(x, np.uint64) for x in table.column("x").to_pylist()]
    found = twice(np.concatenate(hashes))
    edges = np.cumsum([0, *map(len, hashes)])
    return _raw([("windows", key[0].as_py(), c, np.packbits(found[a:b]).tobytes(), b"") for c, a, b in zip(table.column("chunk").to_pylist(), edges, edges[1:])])


def _covered(found: Anchors, answered: pa.Table, buckets: int) -> np.ndarray:
    """For each byte of the chunk whether a repeated window covers it."""
    kinds = np.array(answered.column("kind").to_pylist(), object)
    same, other = found.marks(answered.filter(pa.array(kinds == "answer")), buckets)
    steps = np.zeros(len(found.data) + 1, np.int32)
    whole = same & ~other
    anchors = np.flatnonzero(whole[found.entry])
    np.add.at(steps, found.first[anchors], 1)
    np.subtract.at(steps, found.last[anchors] + found.span, 1)
    bits = {b: x for k, b, x in zip(kinds, answered.column("bucket").to_pylist(), answered.column("x").to_pylist()) if k == "windows"}
    windows = Windows(found, other, buckets)
    told = windows.again.copy()
    for bucket, a, b in runs(windows.bucket):
        told[a:b] |= np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=b - a).astype(bool)
    repeated = told[windows.place]
    of_entry = np.full(len(found.names), -1, np.int64)
    of_entry[windows.which] = np.arange(len(windows.which))
    anchors = np.flatnonzero(of_entry[found.entry] >= 0)
    nth = of_entry[found.entry[anchors]]
    n = windows.count[nth]
    offset = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else np.zeros(0, np.int64)
    # A context that occurs more than once in the chunk was sent once: all its windows are repeated.
    hit = repeated[np.repeat(windows.begin[nth], n) + offset] | np.repeat(found.counts[found.entry[anchors]] > 1, n)
    start = (np.repeat(found.first[anchors], n) + offset)[hit]
    np.add.at(steps, start, 1)
    np.subtract.at(steps, start + found.span, 1)
    return np.cumsum(steps)[:-1] > 0


def remove_repeated_bytes(docs: DataFrame, span: int = SPAN, batches: int = BATCHES, keep_text: bool = True, more: tuple[str, ...] = ()) -> DataFrame:
    """Documents without the bytes of strings of ``span`` bytes that also start elsewhere in the corpus.

    All places of a repeat go, the first one too; overlapping ones and those in one document count; no match crosses
    documents. Columns: doc_id, the columns named in ``more``, n_bytes, n_removed, n_spans (maximal removed runs), and kept (the bytes left;
    characters cut apart leave invalid bytes out) or with ``keep_text`` off kept_sha256 of the exact bytes. A null or empty text
    has no bytes. Rows that repeat, also with a null doc_id, are documents of their own and so lose what they share.
    An empty table gives no rows. The documents come in ``batches`` batches, which does not change the result.
    """
    parts = dealt(docs, *more)
    buckets = parts.buckets
    family = IndexFamily(docs.sparkSession)
    answered = None

    def send(key, table):
        return Anchors(table, span).requests(key[0].as_py(), buckets)

    for k in range(batches):
        batch = parts.docs.select("doc_id", "text", "chunk").where(F.col("chunk") % batches == k)
        got = family.add(batch.groupBy("chunk").applyInArrow(send, _RAW_DDL))
        answered = got if answered is None else answered.unionByName(got)

    def compare(key, table, told):
        if not table.num_rows:
            return _raw([])
        found = Anchors(table, span)
        _, other = found.marks(told, buckets)
        return _raw(Windows(found, other, buckets).requests(key[0].as_py()))

    narrow = parts.docs.select("doc_id", "text", "chunk", *more)
    asked = narrow.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(compare, _RAW_DDL)
    windows = asked.groupBy("bucket").applyInArrow(_windows_answer, _RAW_DDL)
    extra = [f for f in narrow.schema.fields if f.name in more]
    last = ("kept string" if keep_text else "kept_sha256 string")
    ddl = ", ".join(["doc_id long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in extra), "n_bytes long, n_removed long, n_spans long", last])

    def finish(key, table, told):
        found = Anchors(table, span)
        gone = _covered(found, told, buckets)
        data, counts, kept = found.data.tobytes(), [], []
        for a, b in zip(found.at.tolist(), found.at[1:].tolist()):
            cut = gone[a:b]
            edges = np.flatnonzero(np.diff(cut.astype(np.int8), prepend=0, append=0))
            keep = [a, *(edges + a).tolist(), b]
            raw = b"".join([data[i:j] for i, j in zip(keep[::2], keep[1::2])])
            counts.append((b - a, int(cut.sum()), len(edges) // 2))
            kept.append(raw.decode("utf-8", "ignore") if keep_text else hashlib.sha256(raw).hexdigest())
        ordered = found.table
        columns = [ordered.column("doc_id"), *(ordered.column(f.name) for f in extra)]
        columns += [pa.array(x, pa.int64()) for x in (zip(*counts) if counts else [[]] * 3)]
        return pa.table([*columns, pa.array(kept, pa.string())], names=[x.split()[0].strip("`") for x in ["doc_id", *more, "n_bytes", "n_removed", "n_spans", last]])

    every = answered.unionByName(windows)
    return narrow.groupBy("chunk").cogroup(every.groupBy("chunk")).applyInArrow(finish, ddl)
