"""Hard negatives by filtering on segment summaries.

**Summaries.** A vector is cut into segments; of each its mean and its deviation (the length of what is left without the mean) are stored. With ``m`` the
length of a segment, the product of two vectors over it lies within ``m * mean * mean`` plus or minus ``deviation * deviation``, and the sums
over all segments bound the score. ``LEVELS`` cut ever finer; a pair that a coarse level cannot decide goes to the next one, and what is left after
the last is scored exactly, in whole numbers.

**Positives.** Anchors meet the rows of their label. The ``k``-th best lower bound met so far is a floor: a row whose upper bound is below it is out.

**Negatives.** An anchor has a band of scores per positive. A row of another label goes on while its bounds meet a band and may still be among
the first ``k`` of it.

**Work.** The anchors are a stated query set and meet all rows in cells of a block of anchors and a block of rows; a block is bounded in bytes, and rows are
dealt into blocks by their number in the stored table, so no label, id, or vector is hot. Every cell answers with at most ``k`` rows for an anchor or band, and
a window takes the first ``k`` of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from wardwatch.llm.tables import stored

#: Numbers of segments, coarse to fine; levels with no fewer segments than components are left out.
LEVELS = (1, 4, 16)
#: Bytes of a block of rows with components of 8 bytes, and rows below which no block is split.
BLOCK_BYTES = 16 << 20
LEAST_ROWS = 1024
#: Blocks that rows are at least dealt into while they hold more than ``LEAST_ROWS``.
SPREAD = 32
#: Anchors whose bounds over a block are held at once.
ANCHORS_AT_ONCE = 16
#: Bounds are widened by this share of the product of the lengths: more than single and double precision lose.
SLACK = 2.0**-18
ROW_DDL = "row long, vec_id long, label string, dim int, vector binary, summary binary"
_LAST = np.iinfo(np.int64)


def segments(dim: int) -> list[list[np.ndarray]]:
    """Component numbers of each segment, by level."""
    return [np.array_split(np.arange(dim), n) for n in LEVELS if n < dim]


def summarised(q: np.ndarray) -> np.ndarray:
    """Mean times the root of the length, and deviation, of all segments of all levels, in single precision: so both bounds are plain products."""
    parts = []
    for level in segments(q.shape[1]):
        means = np.stack([q[:, s].mean(axis=1) for s in level], 1)
        rests = [np.linalg.norm(q[:, s] - means[:, [k]], axis=1) for k, s in enumerate(level)]
        parts += [means * np.sqrt([len(s) for s in level]), np.stack(rests, 1)]
    parts.append(np.linalg.norm(q, axis=1, keepdims=True))
    return np.concatenate(parts, 1).astype("<f4")


def whole_products(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers; one beyond 64 bits counts as the nearest that fits."""
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    most = float(np.abs(rows.astype(np.float64)).max()) * float(np.abs(anchor.astype(np.float64)).max()) * len(anchor)
    if most < 2.0**53:
        return (rows.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return rows.astype(np.int64) @ anchor.astype(np.int64)
    exact = rows.astype(object) @ anchor.astype(object)
    return np.array([min(max(int(x), _LAST.min), _LAST.max) for x in exact], np.int64)


def _prepared(table: DataFrame, scale: int) -> DataFrame:
    """Usable rows with a number, whole components, and summaries."""
    usable = (
        F.col("label").isNotNull()
        & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    )
    rows = table.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast(ArrayType(DoubleType())).alias("vector"),
    ).where(usable)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "vector")

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            flat, size = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            edges = np.concatenate([[0], np.cumsum(size)])
            vectors, sums = np.empty(len(size), object), np.empty(len(size), object)
            for dim in np.unique(size):
                which = np.flatnonzero(size == dim)
                v = np.stack([flat[edges[k] : edges[k + 1]] for k in which]).astype(np.float64)
                with np.errstate(over="ignore"):
                    # Components beyond 62 bits count as the nearest that fits.
                    q = np.clip(np.floor(scale * v), -(2.0**62), 2.0**62)
                kind = "<i2" if not q.size or np.abs(q).max() < 2**15 else "<i8"
                s = summarised(q)
                for k, one, two in zip(which, q.astype(kind), s):
                    vectors[k], sums[k] = one.tobytes(), two.tobytes()
            columns = [*batch.columns[:3], pa.array(size, pa.int32()), pa.array(vectors, pa.binary()), pa.array(sums, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ROW_DDL.split(", ")])

    return rows.mapInArrow(run, ROW_DDL)


class Block:
    """Rows of one dimension in numpy."""

    def __init__(self, table: pa.Table, dim: int):
        ids = table.column("vec_id").combine_chunks()
        self.null = np.asarray(ids.is_null())
        #: A null id comes after all others.
        self.ids = ids.fill_null(_LAST.max).to_numpy(zero_copy_only=False)
        self.row = table.column("row").to_numpy()
        raw = table.column("vector").to_pylist()
        self.q = np.zeros((len(raw), dim), np.int16 if all(len(x) == 2 * dim for x in raw) else np.int64)
        for k, x in enumerate(raw):
            self.q[k] = np.frombuffer(x, "<i2" if len(x) == 2 * dim else "<i8")
        s = np.frombuffer(b"".join(table.column("summary").to_pylist()), "<f4").reshape(len(raw), -1).astype(np.float64)
        self.norm, self.levels, at = s[:, -1] if len(raw) else np.zeros(0), [], 0
        for level in segments(dim):
            n = len(level)
            self.levels.append((s[:, at : at + n], s[:, at + n : at + 2 * n]))
            at += 2 * n

    def order(self) -> np.ndarray:
        return np.lexsort((self.row, self.null, self.ids))


def bounds(anchors: Block, who, rows: Block, which, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of anchors ``who`` and rows ``which``."""
    (am, ad), (rm, rd) = anchors.levels[level], rows.levels[level]
    middle, spread = am[who] @ rm[which].T, ad[who] @ rd[which].T
    spread = spread + SLACK * np.multiply.outer(anchors.norm[who], rows.norm[which])
    # Scores are 64 bits wide, and so are their bounds.
    return np.clip(middle - spread, -(2.0**63), 2.0**63), np.clip(middle + spread, -(2.0**63), 2.0**63)


def refined(anchors: Block, rows: Block, allowed, keep, stats: list[int] | None = None):
    """(anchor, rows left, exact scores) per anchor: ``keep(anchor, lower, upper)`` says level by level which rows go on."""
    n = len(anchors.ids)
    for a in range(0, n, ANCHORS_AT_ONCE):
        who = np.arange(a, min(a + ANCHORS_AT_ONCE, n))
        first = bounds(anchors, who, rows, slice(None), 0) if anchors.levels else None
        for x in who:
            left = np.flatnonzero(allowed(x))
            for level in range(len(anchors.levels)):
                if not len(left):
                    break
                low, high = (b[x - a, left] for b in first) if level == 0 else bounds(anchors, x, rows, left, level)
                left = left[keep(x, low, high)]
            if stats is not None:
                stats.append(len(left))
            if len(left):
                yield x, left, whole_products(rows.q[left], anchors.q[x])


def best(scores: np.ndarray, rows: Block, which: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` by score, then id, then number."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= floor)
    else:
        some = np.arange(len(scores))
    w = which[some]
    return some[np.lexsort((rows.row[w], rows.null[w], rows.ids[w], -scores[some].astype(object) if (scores == _LAST.min).any() else -scores[some]))][:k]


def top_rows(anchors: Block, rows: Block, k: int, stats: list[int] | None = None):
    """(anchor, row, score) of each anchor's first ``k`` other rows."""

    def keep(x, low, high):
        if len(low) <= k:
            return np.ones(len(low), bool)
        return high >= np.partition(low, len(low) - k)[len(low) - k]

    for x, left, scores in refined(anchors, rows, lambda x: rows.row != anchors.row[x], keep, stats):
        for p in best(scores, rows, left, k):
            yield x, left[p], scores[p]


def in_bands(anchors: Block, rows: Block, different, bands: list[list[tuple[int, int, int]]], k: int, stats: list[int] | None = None):
    """(anchor, band, row, score) of the first ``k`` rows in each band (number, from, to) of each anchor."""

    def keep(x, low, high):
        some = np.zeros(len(low), bool)
        for _, least, most in bands[x]:
            may = (high >= least) & (low <= most)
            sure = low[(low >= least) & (high <= most)]
            if len(sure) >= k:
                may &= high >= np.partition(sure, len(sure) - k)[len(sure) - k]
            some |= may
        return some

    for x, left, scores in refined(anchors, rows, different, keep, stats):
        for number, least, most in bands[x]:
            inside = np.flatnonzero((scores >= least) & (scores <= most))
            for p in inside[best(scores[inside], rows, left[inside], k)]:
                yield x, number, left[p], scores[p]


def _blocks(n: Column, dim: Column) -> Column:
    """How many blocks ``n`` rows are dealt into."""
    most = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (8 * F.greatest(dim, F.lit(1)))))
    return F.greatest(F.ceil(n / most), F.least(F.lit(SPREAD), F.ceil(n / LEAST_ROWS)))


def _cells(rows: DataFrame, anchors: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows and anchors dealt into cells (keys, row block, anchor block); keys without anchors have none."""
    count = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    sizes = anchors.groupBy(*keys).agg(F.count("*").alias("m")).join(count, keys)
    most = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (8 * F.greatest(F.col("dim"), F.lit(1)))))
    sizes = sizes.select(*keys, _blocks(F.col("n"), F.col("dim")).alias("rbs"), F.ceil(F.col("m") / most).alias("abs"))
    mine = F.pmod(F.xxhash64("row"), F.col("rbs"))
    theirs = F.pmod(F.xxhash64("row"), F.col("abs"))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    left = rows.join(sizes, keys).withColumn("rb", mine).withColumn("ab", every("abs")).drop("rbs", "abs")
    right = anchors.join(sizes, keys).withColumn("ab", theirs).withColumn("rb", every("rbs")).drop("rbs", "abs")
    # Both come from one table: new columns for one of them keep the two apart.
    return left, right.toDF(*right.columns)


def _first(frame: DataFrame, by: list[str], id_column: str, k: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col(id_column).asc_nulls_last(), "row")
    return frame.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def positives_of(rows: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """anchor (row number), anchor_id, positive (1 to k), positive_id, positive_score: the first ``k`` other rows of an anchor's label."""
    keys = ["label", "dim", "rb", "ab"]
    left, right = _cells(rows, anchors, ["label", "dim"])

    def search(key, table, asked):
        found = []
        if table.num_rows and asked.num_rows:
            dim = key[1].as_py()
            r, a = Block(table, dim), Block(asked, dim)
            found = [(int(a.row[x]), int(a.ids[x]), None if r.null[y] else int(r.ids[y]), int(r.row[y]), int(s)) for x, y, s in top_rows(a, r, k)]
        columns = [pa.array(c, pa.int64()) for c in (zip(*found) if found else [[]] * 5)]
        return pa.table(columns, names=["anchor", "anchor_id", "positive_id", "row", "score"])

    ddl = "anchor long, anchor_id long, positive_id long, row long, score long"
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, ddl)
    return _first(met, ["anchor"], "positive_id", k, "positive").select(
        "anchor", "anchor_id", "positive", "positive_id", F.col("score").alias("positive_score")
    )


def negatives_of(rows: DataFrame, anchors: DataFrame, positives: DataFrame, low: int, high: int, k: int) -> DataFrame:
    """anchor, positive, rank, negative_id, negative_score: the first ``k`` rows of other labels in each positive's band."""
    bands = positives.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.struct("positive", "positive_score")).alias("bands"))
    asked = anchors.join(bands, "row").withColumns(
        {"numbers": F.transform("bands", lambda b: b["positive"]), "scores": F.transform("bands", lambda b: b["positive_score"])}
    )
    keys = ["dim", "rb", "ab"]
    left, right = _cells(rows, asked.drop("bands"), ["dim"])

    def search(key, table, asked):
        found = []
        if table.num_rows and asked.num_rows:
            dim = key[0].as_py()
            r, a = Block(table, dim), Block(asked, dim)
            both = pa.chunked_array([*asked.column("label").chunks, *table.column("label").chunks]).combine_chunks().dictionary_encode()
            codes = both.indices.to_numpy(zero_copy_only=False)
            mine, theirs = codes[: len(a.ids)], codes[len(a.ids) :]
            # Whole numbers of any size: no bound of a band overflows.
            limits = [
                [(int(n), -(-low * int(s) // 100), high * int(s) // 100) for n, s in zip(ns, ss)]
                for ns, ss in zip(asked.column("numbers").to_pylist(), asked.column("scores").to_pylist())
            ]
            limits = [[(n, max(x, _LAST.min), min(y, _LAST.max)) for n, x, y in b if x <= y and x <= _LAST.max and y >= _LAST.min] for b in limits]
            hits = in_bands(a, r, lambda x: theirs != mine[x], limits, k)
            found = [(int(a.row[x]), n, None if r.null[y] else int(r.ids[y]), int(r.row[y]), int(s)) for x, n, y, s in hits]
        columns = [pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
        return pa.table(columns, names=["anchor", "positive", "negative_id", "row", "score"])

    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "anchor long, positive int, negative_id long, row long, score long")
    return _first(met, ["anchor", "positive"], "negative_id", k, "rank").select(
        "anchor", "positive", "rank", "negative_id", F.col("score").alias("negative_score")
    )


def hard_negatives(
    table: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become ``floor(scale * x)``; a score is the whole inner product. Anchors are rows whose vec_id is divisible by ``every``; an
    anchor's positives are its first ``positives`` other rows of its label (higher scores first, ties by smaller vec_id), and a positive's negatives are the
    first ``negatives`` rows of other labels with ``low`` to ``high`` percent of its score, a ratio in whole numbers. All of them, where there are fewer.

    Rows with a null label or vector, or with a component that is null or not finite, take no part. A null vec_id is no anchor and comes after all ids
    in ties. Rows that repeat are rows of their own: one with an anchor's id is another row, and each anchor row has its own answer.
    Vectors of different length have no score; empty ones score 0. Components beyond 62 bits and scores beyond 64 bits count as the nearest that
    fits. Other columns are left out. An empty table gives no rows.
    """
    rows = stored(_prepared(table, scale), "mining-rows")
    anchors = rows.where(F.col("vec_id") % every == 0)
    found = stored(positives_of(rows, anchors, positives), "mining-positives")
    mined = negatives_of(rows, anchors, found, low, high, negatives)
    return mined.join(found, ["anchor", "positive"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
