"""Near-duplicate embeddings by spherical-cap filters from structured random product codes.

**Filters.** A vector is turned by a random rotation and cut into ``PARTS`` parts. Each part has a code of ``words`` random
directions; a filter is one direction per part, so there are ``words ** PARTS`` filters and no list of them. The response of a
vector to a filter is the sum over the parts. A vector goes to every filter whose response exceeds its best
possible response less ``margin``. These are list-decoded: parts are ordered by how far each direction falls short of the best,
and only combinations whose shortfalls stay in the margin are looked at. ``ROTATIONS`` independent codes are used.

**Verification.** Vectors of one label meet in the filters they share; cosines are taken in double precision. A pair that meets in
several filters counts in the smallest one. Equal vectors are one member with a weight. A filter of many members is
dealt out as pairs of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from wardwatch.llm.graph import components
from wardwatch.llm.hashing import combined
from wardwatch.llm.ngram_join import spanning
from wardwatch.llm.tables import stored

COSINE = 0.98
PARTS = 4
ROTATIONS = 2
MARGIN = 0.035
#: Members of a filter that is not split.
BLOCK = 1024
_CODES: dict[tuple[int, int, int], tuple[np.ndarray, list[np.ndarray]]] = {}
_ROW_DDL = "cell long, side int, id long, weight long, kind long, vector binary"
_ROW_NAMES = [c.split()[0] for c in _ROW_DDL.split(", ")]


def _code(dim: int, words: int, turn: int) -> tuple[np.ndarray, list[np.ndarray]]:
    if (dim, words, turn) not in _CODES:
        r = np.random.default_rng([dim, words, turn])
        rotation, _ = np.linalg.qr(r.normal(size=(dim, dim)))
        parts = []
        for size in [len(x) for x in np.array_split(np.arange(dim), min(PARTS, dim))]:
            c = r.normal(size=(words, size))
            parts.append(c / np.linalg.norm(c, axis=1, keepdims=True) * np.sqrt(size / dim))
        _CODES[dim, words, turn] = rotation, parts
    return _CODES[dim, words, turn]


def decoded(vectors: np.ndarray, words: int, turn: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(vector, filter) of all filters each unit vector exceeds, for one rotation."""
    n, dim = vectors.shape
    rotation, parts = _code(dim, words, turn)
    turned = vectors @ rotation
    who, name, short = np.arange(n), np.zeros(n, np.int64), np.zeros(n)
    at = 0
    for code in parts:
        response = turned[:, at : at + code.shape[1]] @ code.T
        at += code.shape[1]
        lacks = response.max(axis=1, keepdims=True) - response
        order = np.argsort(lacks, axis=1)
        lacks = np.take_along_axis(lacks, order, axis=1)
        total = short[:, None] + lacks[who]
        row, k = np.nonzero(total <= margin)
        name = name[row] * words + order[who[row], k]
        short, who = total[row, k], who[row]
    return who, name


def cells_of(vectors: np.ndarray, kind: np.ndarray, words: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(vector, cell) of all filters of all rotations, sorted by vector and cell; a cell is a filter of one kind."""
    who, cell = [], []
    for turn in range(ROTATIONS):
        w, name = decoded(vectors, words, turn, margin)
        who.append(w)
        cell.append(combined(kind[w].astype(np.uint64), (name * ROTATIONS + turn).astype(np.uint64)).astype(np.int64))
    who, cell = np.concatenate(who), np.concatenate(cell)
    order = np.lexsort((cell, who))
    return who[order], cell[order]


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, as a norm of very large numbers would be no double."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _prepared(table: DataFrame) -> DataFrame:
    """vec_id, label, vector in double precision, and whether the vector can link."""
    vector = F.col("embedding").cast(ArrayType(DoubleType()))
    usable = (
        F.col("label").isNotNull()
        & (F.size("vector") > 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("vector", lambda x: x != 0)
    )
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", vector.alias("vector"))
    return rows.withColumn("usable", F.coalesce(usable, F.lit(False)))


def _cells(words: int, margin: float, number: str):
    def deal(batches):
        for batch in batches:
            ids, weight, label = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            lists = batch.column(3)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.cumsum(size)])
            for dim in np.unique(size):
                which = np.flatnonzero(size == dim)
                v = np.stack([flat[edges[k] : edges[k + 1]] for k in which]).astype(number)
                kind = combined(label[which].astype(np.int64).astype(np.uint64), np.full(len(which), dim, np.uint64)).astype(np.int64)
                for k in range(0, len(which), 512):
                    who, cell = cells_of(_unit(v[k : k + 512]), kind[k : k + 512], words, margin)
                    who += k
                    raw = [v[w].tobytes() for w in range(k, min(k + 512, len(which)))]
                    at = which[who]
                    columns = [pa.array(cell), pa.array(np.full(len(who), -1, np.int32)), pa.array(ids[at]), pa.array(weight[at]), pa.array(kind[who]), pa.array([raw[w - k] for w in who], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=_ROW_NAMES)

    return deal


def _search(words: int, margin: float, cosine: float, number: str):
    """Links of the cells of a partition sorted by (cell, part); a cell may continue in the next batch."""

    def links_of(cell, key, side, ids, weight, kind, raw):
        edges = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(key) != 0)) + 1).tolist(), len(key)]
        ends, add = [], []
        for x, y in zip(edges, edges[1:]):
            if y - x < 2:
                continue
            v, s = _unit(np.frombuffer(b"".join(raw[x:y]), number).reshape(y - x, -1)), side[x:y]
            near = v @ v.T >= cosine
            near &= (s[:, None] < 0) | (s[:, None] != s[None, :])
            np.fill_diagonal(near, False)
            some = np.flatnonzero(near.any(axis=1))
            if not len(some):
                continue
            near = near[np.ix_(some, some)]
            who, where = cells_of(v[some], kind[x:y][some], words, margin)
            earlier = where < cell[x]
            names, column = np.unique(where[earlier], return_inverse=True)
            if len(names):
                member = np.zeros((len(some), len(names)), np.float32)
                member[who[earlier], column] = 1
                near &= member @ member.T < 0.5
            a, b = np.nonzero(np.triu(near))
            if not len(a):
                continue
            keep = spanning(a, b, len(some))
            i, w = ids[x:y][some], weight[x:y][some]
            ends.append(np.stack([i[a[keep]], i[b[keep]]], 1))
            add.append(np.stack([i, near @ w], 1))
        ends = np.concatenate(ends) if ends else np.zeros((0, 2), np.int64)
        add = np.concatenate(add) if add else np.zeros((0, 2), np.int64)
        add = add[add[:, 1] > 0]
        a = pa.array(np.concatenate([ends[:, 0], add[:, 0]]))
        b = pa.concat_arrays([pa.array(ends[:, 1].copy()), pa.nulls(len(add), pa.int64())])
        n = pa.array(np.concatenate([np.zeros(len(ends), np.int64), add[:, 1]]))
        return pa.RecordBatch.from_arrays([a, b, n], names=["a", "b", "links"])

    def run(batches):
        held = None
        for batch in batches:
            arrays = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            raw = np.empty(len(arrays[0]), object)
            raw[:] = batch.column(6).to_pylist()
            arrays.append(raw)
            if held is not None:
                arrays = [np.concatenate(x) for x in zip(held, arrays)]
            if not len(arrays[0]):
                continue
            last = (arrays[0] == arrays[0][-1]) & (arrays[1] == arrays[1][-1])
            cut = int(np.argmax(last))
            if cut:
                yield links_of(*(x[:cut] for x in arrays))
            held = [x[cut:] for x in arrays]
        if held is not None:
            yield links_of(*held)

    return run


def near_duplicates(
    table: DataFrame, cosine: float = COSINE, margin: float = MARGIN, words: int | None = None, block: int = BLOCK
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null and their cosine is ``cosine`` or more. Vectors that are null, empty,
    zero, or hold a null or a number that is not finite link with nothing, and so do vectors of different length. Rows
    that repeat are vectors of their own. A null vec_id has no component_id and is kept; it still counts as a link of others. No pair below ``cosine`` is
    reported; how many above are found is set by ``margin`` (see the tests). An empty table gives no rows.
    """
    rows = stored(_prepared(table), "vectors")
    # Vectors travel as they are stored: single precision takes half the room, and is exact in double precision.
    number = "<f4" if dict(table.dtypes)["embedding"] == "array<float>" else "<f8"
    if words is None:
        # About as many filters as vectors.
        words = int(np.clip(np.ceil(max(rows.count(), 16) ** (1 / PARTS)), 4, 256))
    usable = rows.where("usable")
    first = usable.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    first = stored(first.where("id is not null"), "distinct-vectors")
    dealt = first.select("id", "weight", F.hash("label").cast("bigint").alias("label"), "vector").mapInArrow(_cells(words, margin, number), _ROW_DDL)
    dealt = stored(dealt, "filters")
    large = dealt.groupBy("cell").count().where(F.col("count") > block)
    large = stored(large.select("cell", F.ceil(F.col("count") / block).alias("blocks")), "large-filters")
    pieces = dealt.withColumn("part", F.lit(0).cast("long"))
    if not large.isEmpty():
        # A member of block m meets every block k in the part of (m, k).
        split = dealt.join(large, "cell").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")))
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        low, high = F.least("mine", "other"), F.greatest("mine", "other")
        side = F.when(F.col("mine") == F.col("other"), -1).otherwise((F.col("mine") > F.col("other")).cast("int"))
        split = split.select("cell", (low * F.col("blocks") + high + 1).alias("part"), side.alias("side"), "id", "weight", "kind", "vector")
        small = dealt.join(large, "cell", "left_anti").withColumn("part", F.lit(0).cast("long"))
        pieces = small.unionByName(split)
    pieces = pieces.select("cell", "part", "side", "id", "weight", "kind", "vector")
    sorted_ = pieces.repartition("cell", "part").sortWithinPartitions("cell", "part", "id")
    found = stored(sorted_.mapInArrow(_search(words, margin, cosine, number), "a long, b long, links long"), "vector-links")
    links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    joined = components(found.where("b is not null").select("a", "b"))
    facts = first.join(links, "id", "left").join(joined, "id", "left").select(
        "label",
        "vector",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component"),
    )
    out = usable.join(facts, ["label", "vector"], "left").select("vec_id", "n_links", "component")
    out = out.unionByName(rows.where(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component")))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
