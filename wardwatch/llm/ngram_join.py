"""Near-duplicate join on word shingles by count-vector R-trees.

**Points.** The shingles of a document are hashed into ``GROUPS`` groups; its point is the number of its shingles in each
group. The overlap of two documents is at most the sum over the groups of the smaller count, and the same holds for a
tree node with the largest count of its members in each group: a node whose bound is under the overlap that a link
needs is left out with all its members. A count is held as at most ``MOST``, and where both have that many their bound is
open. Pairs that pass are verified on the whole sets.

**Forest.** One tree over all documents would compare everything with everything near its root, so there is a tree
for each shingle that can prove a link. Shingles in one document only are found first (see ``shared``) and cannot be
in an overlap. The others are ordered by how many documents have them, rare ones first. Two documents that
link share one of the first ``size - needed + 1`` shingles of this order, so a document goes into the trees of those and no others;
nothing is lost. In the tree of the first shingle that two documents share, their overlap is at most what either has left from
there on; a pair that this rules out in a later tree was held against it in its first. A tree over many documents is split into pairs of blocks.

**Links.** Equal sets are one member. First each tree gives a spanning forest of its candidate pairs, and the pairs are verified.
Where all pairs of a candidate component hold, its documents are connected and nothing else can be learned there. In
the components where some pair fails, the trees are searched again, for pairs of documents that are not yet connected. A tree leaves a pair to an earlier
one when both have one of the first ``EARLY`` shingles in common. The members that still have a pair, and only
these, bring their whole sets to the tree; every pair is verified there, and a spanning forest of the links comes out. So no tree answers
with more rows than it has members, however many pairs it looks at, and no link between components is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardwatch.llm import hashing
from wardwatch.llm.graph import components
from wardwatch.llm.shared import bucket_of, dealt, in_order, runs
from wardwatch.llm.tables import stored

SHINGLE, PERCENT = 5, 80
GROUPS = 32
#: Largest count of a point, which stands for itself and all larger ones.
MOST = 65535
LEAF = 16
#: Documents of a tree that is not split.
BLOCK = 1024
#: Shingles by which a tree sees that a pair met before.
EARLY = 16
#: Bytes of the sets that are verified at once; a tree with more is split into pairs of blocks again.
CELL_BYTES = 16 << 20
_SETS_DDL = "doc_id long, n long, d1 long, d2 long, shared binary, levels binary"
_CELL_DDL = "cell long, side int, id long, n long, label long, rest long, point binary, early binary"
_CELL_NAMES = [c.split()[0] for c in _CELL_DDL.split(", ")]


def _ceil(a, b):
    return -(-a // b)


def needed(a, b, percent: int):
    """Least overlap of linked sets of sizes a and b."""
    return _ceil(percent * (a + b), 100 + percent)


class Shingles:
    """Distinct shingles of each document of a chunk, in order of (document, hash)."""

    def __init__(self, table: pa.Table, width: int):
        self.table = in_order(table)
        words = hashing.words_of(*hashing.joined(self.table.column("text")), fold=True)
        n = self.table.num_rows
        full = hashing.window_hashes(words.hashes, width)
        at = np.flatnonzero(words.whole(width)[: len(full)])
        hashes, text = [full[at]], [words.text[at]]
        size = np.bincount(words.text, minlength=n)
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        for k in range(1, width):
            few = np.flatnonzero(size == k)
            hashes.append(hashing.window_hashes(words.hashes, k, salt=k)[begin[few]] if len(few) else np.zeros(0, np.uint64))
            text.append(few)
        hashes, text = np.concatenate(hashes), np.concatenate(text)
        order = np.lexsort((hashes, text))
        hashes, text = hashes[order], text[order]
        new = np.ones(len(order), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        self.hashes, self.text = hashes[new], text[new]
        self.size = np.bincount(self.text, minlength=n)
        self.edges = np.concatenate([[0], np.cumsum(self.size)])
        self.distinct, self.place, self.counts = np.unique(self.hashes, return_inverse=True, return_counts=True)


def _requests(width: int, buckets: int):
    def send(key, table):
        found = Shingles(table, width)
        low = (found.distinct & np.uint64(0xFFFFFFFF)).astype("<u4")
        rows = []
        for bucket, a, b in runs(bucket_of(found.distinct, buckets)):
            many = np.flatnonzero(found.counts[a:b] > 1)
            more = np.stack([many, found.counts[a:b][many]], 1).astype("<u4")
            rows.append((bucket, key[0].as_py(), low[a:b].tobytes(), more.tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=["bucket", "chunk", "hashes", "more"])

    return send


def _answers(requests: DataFrame) -> DataFrame:
    """For each hash of a request, a byte: 0 for one document in all, else the logarithm of the number, rounded up."""

    def answer(key, table):
        hashes = [np.frombuffer(x, "<u4") for x in table.column("hashes").to_pylist()]
        counts = []
        for h, x in zip(hashes, table.column("more").to_pylist()):
            n = np.ones(len(h), np.int64)
            many = np.frombuffer(x, "<u4").reshape(-1, 2)
            n[many[:, 0]] = many[:, 1]
            counts.append(n)
        every, n = np.concatenate(hashes), np.concatenate(counts)
        order = np.argsort(every, kind="stable")
        new = np.concatenate([[True], np.diff(every[order]) != 0])
        total = np.add.reduceat(n[order], np.flatnonzero(new))
        level = np.zeros(len(every), np.uint8)
        level[order] = np.ceil(np.log2(total)).astype(np.uint8)[np.cumsum(new) - 1]
        edges = np.cumsum([0, *map(len, hashes)])
        return pa.table(
            [table.column("bucket"), table.column("chunk"), pa.array([level[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())],
            names=["bucket", "chunk", "levels"],
        )

    return requests.groupBy("bucket").applyInArrow(answer, "bucket long, chunk long, levels binary")


def shingle_sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per document: size and digest of its set, and where it can link at all, its shared shingles, rare ones first."""
    parts = dealt(docs)
    buckets = parts.buckets
    answered = _answers(parts.docs.groupBy("chunk").applyInArrow(_requests(width, buckets), "bucket long, chunk long, hashes binary, more binary"))
    names = [c.split()[0] for c in _SETS_DDL.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())

    def collect(key, table, told):
        found = Shingles(table, width)
        level = np.zeros(len(found.distinct), np.uint8)
        given = dict(zip(told.column("bucket").to_pylist(), told.column("levels").to_pylist()))
        for bucket, a, b in runs(bucket_of(found.distinct, buckets)):
            level[a:b] = np.frombuffer(given[bucket], np.uint8)
        level = level[found.place]
        shared = level > 0
        order = np.lexsort((found.hashes, level, found.text))
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (found.hashes, hashing.mixed(found.hashes))]
        digests = [np.diff(s[found.edges]).astype(np.int64).tolist() for s in sums]
        rows = []
        for k, doc_id in enumerate(found.table.column("doc_id").to_pylist()):
            a, b = found.edges[k], found.edges[k + 1]
            mine = order[a:b]
            mine = mine[shared[mine]]
            can = b > a and len(mine) >= _ceil(percent * (b - a), 100)
            rows.append((doc_id, b - a, digests[0][k], digests[1][k], found.hashes[mine].tobytes() if can else None, level[mine].tobytes() if can else None))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=names)

    return parts.docs.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(collect, _SETS_DDL)


def _cells(percent: int, groups: int, block: int, early: int):
    """Rows (id, n, label, shared, levels) dealt to the trees of their first shingles, with the first ``early`` of those before each."""

    def deal(batches):
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            points, before = [], []
            for doc_id, n, label, shared, levels in zip(*(batch.column(k).to_pylist() for k in range(5))):
                tokens, level = np.frombuffer(shared, "<u8"), np.frombuffer(levels, np.uint8)
                point = np.minimum(np.bincount((hashing.mixed(tokens) % np.uint64(groups)).astype(np.int64), minlength=groups), MOST).astype("<u2")
                first = n - _ceil(percent * n, 100) + 1 - (n - len(tokens))
                keys, level, place = tokens[:first], level[:first], np.arange(len(tokens[:first]))
                blocks = np.maximum(1, (1 << np.minimum(level, 62).astype(np.int64)) // block)
                whole = blocks == 1
                cells, sides, places = [keys[whole]], [np.full(whole.sum(), -1)], [place[whole]]
                for token, k, at in zip(keys[~whole], blocks[~whole], place[~whole]):
                    mine = int(hashing.mixed(np.array([doc_id], np.int64).astype(np.uint64))[0] % np.uint64(k))
                    other = np.arange(k)
                    low, high = np.minimum(other, mine), np.maximum(other, mine)
                    cells.append(hashing.combined(np.full(k, token), (low * k + high + 1).astype(np.uint64)))
                    sides.append(np.where(other == mine, -1, (mine > other).astype(np.int64)))
                    places.append(np.full(k, at))
                cells, places = np.concatenate(cells), np.concatenate(places)
                for column, value in zip(out, (cells.astype(np.int64), np.concatenate(sides), doc_id, n, label, len(tokens) - places)):
                    column.append(value if isinstance(value, np.ndarray) else np.full(len(cells), value, np.int64))
                points += [point.tobytes()] * len(cells)
                before += [shared[: 8 * min(at, early)] for at in places.tolist()]
            arrays = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
            columns = [pa.array(arrays[0]), pa.array(arrays[1].astype(np.int32)), *(pa.array(x) for x in arrays[2:])]
            columns += [pa.array(points, pa.binary()), pa.array(before, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=_CELL_NAMES)

    return deal


def leaves_of(points: np.ndarray) -> list[np.ndarray]:
    """Members packed into leaves: sorted by the widest coordinate into slabs, each slab by the next widest."""
    spread = np.argsort(points.std(axis=0))
    order = np.argsort(points[:, spread[-1]], kind="stable")
    slab = LEAF * max(1, int(np.sqrt(len(points) / LEAF)))
    packed = []
    for k in range(0, len(order), slab):
        part = order[k : k + slab]
        part = part[np.argsort(points[part, spread[-2]], kind="stable")]
        packed += [part[j : j + LEAF] for j in range(0, len(part), LEAF)]
    return packed


def overlap_bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Most overlap of the points of each row."""
    least = np.minimum(x, y)
    bound = least.sum(axis=1, dtype=np.int64)
    if least.size and least.max() >= MOST:
        bound[(least >= MOST).any(axis=1)] = np.iinfo(np.int64).max
    return bound


def tree_pairs(points: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members that pass the bound of their nodes and their own bound."""
    leaves = leaves_of(points) if len(points) > LEAF else [np.arange(len(points))]
    high = np.stack([points[m].max(axis=0) for m in leaves]).astype(np.int32)
    small, large = np.array([size[m].min() for m in leaves]), np.array([size[m].max() for m in leaves])
    left, right = [], []
    for k, members in enumerate(leaves):
        bound = overlap_bound(high[k], high[k:])
        passes = (bound >= needed(small[k], small[k:], percent)) & (large[k] * 100 >= percent * small[k:]) & (large[k:] * 100 >= percent * small[k])
        for j in np.flatnonzero(passes) + k:
            a, b = np.repeat(members, len(leaves[j])), np.tile(leaves[j], len(members))
            if j == k:
                a, b = a[a < b], b[a < b]
            left.append(a)
            right.append(b)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    good = []
    for k in range(0, len(a), 1 << 16):
        i, j = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
        good.append(overlap_bound(points[i], points[j]) >= needed(size[i], size[j], percent))
    keep = np.concatenate(good) if good else np.zeros(0, bool)
    return a[keep], b[keep]


def spanning(a: np.ndarray, b: np.ndarray, members: int) -> np.ndarray:
    """Which of the pairs make a spanning forest; the first of a member count first."""
    up = list(range(members))
    keep = np.zeros(len(a), bool)

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    order = np.lexsort((b, a))
    for k, i, j in zip(order.tolist(), a[order].tolist(), b[order].tolist()):
        i, j = top(i), top(j)
        if i != j:
            up[max(i, j)] = min(i, j)
            keep[k] = True
    return keep


class Members:
    """Rows of one or more trees in numpy, sorted by tree."""

    def __init__(self, table: pa.Table):
        self.table = table
        self.cell, self.side, self.id, self.n, self.label, self.rest = (table.column(k).to_numpy() for k in range(6))
        self.point = np.frombuffer(b"".join(table.column("point").to_pylist()), "<u2").reshape(table.num_rows, -1)
        self.early = [np.frombuffer(x, "<u8") for x in table.column("early").to_pylist()]
        self.parts = [table.column(k).to_numpy() for k in ("part", "part_side") if k in table.column_names]

    def trees(self):
        """Ranges of rows of one tree, or of one part of a tree."""
        new = np.diff(self.cell) != 0
        if self.parts:
            new |= np.diff(self.parts[0]) != 0
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(self.cell)]
        return zip(edges, edges[1:])

    def pairs(self, x: int, y: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the candidate pairs of unlike labels of one tree."""
        none = np.zeros(0, np.int64)
        if y - x < 2 or (self.label[x:y] == self.label[x]).all():
            return none, none
        order = np.argsort(self.id[x:y], kind="stable") + x
        a, b = tree_pairs(self.point[order], self.n[order], percent)
        a, b = order[np.minimum(a, b)], order[np.maximum(a, b)]
        good = (self.label[a] != self.label[b]) & (np.minimum(self.rest[a], self.rest[b]) >= needed(self.n[a], self.n[b], percent))
        for side in (self.side, *self.parts[1:]):
            good &= (side[a] < 0) | (side[a] != side[b])
        a, b = a[good], b[good]
        new = ~self.met(x, y, a, b)
        return a[new], b[new]

    def met(self, x: int, y: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether both rows of a pair have an early shingle in common."""
        found = np.zeros(len(a), bool)
        most = max(map(len, self.early[x:y]), default=0)
        if not most or not len(a):
            return found
        held = np.zeros((y - x, most), np.uint64)
        there = np.zeros((y - x, most), bool)
        for k, tokens in enumerate(self.early[x:y]):
            held[k, : len(tokens)], there[k, : len(tokens)] = tokens, True
        for k in range(0, len(a), 1 << 14):
            i, j = a[k : k + (1 << 14)] - x, b[k : k + (1 << 14)] - x
            same = (held[i][:, :, None] == held[j][:, None, :]) & there[i][:, :, None] & there[j][:, None, :]
            found[k : k + (1 << 14)] = same.any(axis=(1, 2))
        return found


def by_tree(work, names: list[str]):
    """Rows sorted by tree (and part), given to ``work`` in whole trees. A tree may continue in the next batch."""

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None and held.num_rows:
                table = pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            keys = [table.column(k).to_numpy() for k in names if k in table.column_names]
            last = np.logical_and.reduce([k == k[-1] for k in keys])
            cut = int(np.argmax(last))
            if cut:
                yield from work(Members(table.slice(0, cut).combine_chunks()))
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield from work(Members(held.combine_chunks()))

    return run


def _forest(percent: int):
    """A spanning forest of the candidate pairs."""

    def work(members: Members):
        found = [members.pairs(x, y, percent) for x, y in members.trees()]
        a, b = (np.concatenate(x) for x in zip(*found))
        keep = spanning(a, b, len(members.cell))
        a, b = members.id[a[keep]], members.id[b[keep]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    return by_tree(work, ["cell"])


def _open(percent: int):
    """The members of a tree that have a candidate pair there."""

    def work(members: Members):
        keep = np.zeros(len(members.cell), bool)
        for x, y in members.trees():
            a, b = members.pairs(x, y, percent)
            keep[a] = keep[b] = True
        yield from members.table.filter(pa.array(keep)).to_batches()

    return by_tree(work, ["cell"])


def _links(percent: int):
    """A spanning forest of the links of each tree, by whole sets."""

    def work(members: Members):
        ends = []
        for x, y in members.trees():
            a, b = members.pairs(x, y, percent)
            if not len(a):
                continue
            sets = [np.frombuffer(t, "<u8") for t in members.table.column("shared").slice(x, y - x).to_pylist()]
            edges = np.concatenate([[0], np.cumsum([len(t) for t in sets])])
            names, codes = np.unique(np.concatenate(sets), return_inverse=True)
            mark = np.zeros(len(names), bool)
            up: dict[int, int] = {}

            def top(v):
                while up.get(v, v) != v:
                    v = up[v]
                return v

            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            for lo, hi in runs_of(a):
                i = int(a[lo])
                mine = codes[edges[i - x] : edges[i - x + 1]]
                mark[mine] = True
                for j in b[lo:hi].tolist():
                    p, q = top(int(members.label[i])), top(int(members.label[j]))
                    if p == q:
                        continue
                    both = int(np.count_nonzero(mark[codes[edges[j - x] : edges[j - x + 1]]]))
                    if 100 * both >= percent * (int(members.n[i]) + int(members.n[j]) - both):
                        up[max(p, q)] = min(p, q)
                        ends.append((int(members.id[i]), int(members.id[j])))
                mark[mine] = False
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*ends) if ends else ([], []))], names=["a", "b"])

    return by_tree(work, ["cell", "part"])


def runs_of(values: np.ndarray):
    """(from, to) of each run of equal values."""
    edges = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return zip(edges, edges[1:])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with whether their whole sets link."""
    side = {c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("shared").alias(f"s_{c}")) for c in ("a", "b")}
    joined = pairs.join(side["a"], "a").join(side["b"], "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")

    def check(batches):
        for batch in batches:
            good = []
            for na, nb, x, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                both = len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
                good.append(100 * both >= percent * (na + nb - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["a", "b", "linked"])

    return joined.mapInArrow(check, "a long, b long, linked boolean")


def near_duplicates(
    docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, groups: int = GROUPS, block: int = BLOCK
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z as a-z. Two documents link when ``100 * intersection >= percent * union`` of
    their sets of distinct ``width``-word shingles; a document of fewer words has its whole sequence as its one shingle.
    Null, empty and white-space texts have no shingles and link with nothing. A null doc_id has no component_id and
    gives nobody one, though links through its text still count if another document has the same set. Rows that repeat a doc_id are one
    document that has the links of all of them. An empty table gives no rows.
    """
    rows = stored(shingle_sets(docs, width, percent), "shingle-sets")
    named = rows.where("n > 0 and doc_id is not null")
    # A set is a member under a number of its own: one doc_id may stand for several sets.
    first = named.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("first_id"))
    first = stored(first.withColumn("id", F.monotonically_increasing_id()), "first-of-set")
    one = named.where("shared is not null").join(first, ["n", "d1", "d2"]).where(F.col("doc_id") == F.col("first_id"))
    sets = stored(one.select("id", "n", "shared", "levels").dropDuplicates(["id"]), "linkable-sets")

    def dealt_to_trees(members: DataFrame, early: int) -> DataFrame:
        cells = members.select("id", "n", "label", "shared", "levels").mapInArrow(_cells(percent, groups, block, early), _CELL_DDL)
        return cells.repartition("cell").sortWithinPartitions("cell")

    pairs = dealt_to_trees(sets.withColumn("label", F.col("id")), 0).mapInArrow(_forest(percent), "a long, b long").distinct()
    tried = stored(_verified(pairs, sets, percent), "tried-pairs")
    links = tried.where("linked").select("a", "b")
    if not tried.where("not linked").isEmpty():
        real, loose = components(links), components(tried.select("a", "b")).withColumnRenamed("component", "loose")
        labelled = loose.join(real, "id", "left").select("id", "loose", F.coalesce("component", "id").alias("label"))
        open_ = labelled.groupBy("loose").agg((F.min("label") < F.max("label")).alias("open")).where("open").select("loose")
        members = stored(sets.join(labelled.join(open_, "loose").select("id", "label"), "id"), "open-sets")
        met = stored(dealt_to_trees(members, EARLY).mapInArrow(_open(percent), _CELL_DDL), "open-trees")
        links = links.unionByName(_verified_in_trees(met, members.select("id", "shared"), percent))
    same = stored(named.join(first, ["n", "d1", "d2"]).select("doc_id", "id").distinct(), "sets-of-ids")
    several = same.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a < last").select("doc_id", "a")
    links = stored(links.unionByName(several.join(same, "doc_id").select("a", F.col("id").alias("b"))), "links")
    placed = first.select("id", "first_id").join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    lowest = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_id = same.join(placed.select("id", "component"), "id").join(lowest, "component").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = rows.where("doc_id is not null").join(of_id, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = out.unionByName(rows.where("doc_id is null").withColumn("component_id", F.lit(None).cast("long")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _verified_in_trees(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members that met in a tree: a spanning forest for each tree, or each pair of blocks of a large one."""
    large = met.groupBy("cell").agg(F.ceil(F.sum("n") * 8 / CELL_BYTES).alias("blocks")).where("blocks > 1")
    split = met.join(large, "cell").withColumn("mine", F.pmod(F.xxhash64("id"), "blocks"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), -1).otherwise((F.col("mine") > F.col("other")).cast("int"))
    split = split.withColumns({"part": low * F.col("blocks") + high + 1, "part_side": side}).drop("blocks", "mine", "other")
    small = met.join(large, "cell", "left_anti").withColumns({"part": F.lit(0).cast("long"), "part_side": F.lit(-1)})
    whole = small.unionByName(split).join(sets, "id").select(*_CELL_NAMES, "part", "part_side", "shared")
    return whole.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(_links(percent), "a long, b long").distinct()
