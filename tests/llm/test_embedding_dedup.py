import numpy as np
import pytest
from llm.test_ngram_join import union

from wardwatch.llm.embedding_dedup import near_duplicates

DDL = "vec_id long, embedding array<float>, label int, cell string, weight double"


def corpus(seed=0, dim=64):
    r = np.random.default_rng(seed)
    rows = []

    def add(v, label):
        rows.append((len(rows), None if v is None else [None if x is None else float(np.float32(x)) for x in v], label))

    for k in range(150):
        v = r.normal(size=dim)
        for _ in range(r.integers(1, 6)):
            add(v + r.normal(size=dim) * r.choice([0.02, 0.1, 0.14, 0.2]), int(k % 3))
    center = r.normal(size=dim)
    for _ in range(120):
        add(center + r.normal(size=dim) * 0.11, 1)
    for _ in range(40):
        add(center, 1)
    add(None, 1)
    add([0.0] * dim, 1)
    add([0.0] * dim, 1)
    add([float("nan")] + [1.0] * (dim - 1), 1)
    add([float("inf")] + [1.0] * (dim - 1), 1)
    add([None] + [1.0] * (dim - 1), 1)
    add(center, None)
    add(center[:5], 1)
    add(center[:5] * 3, 1)
    add([], 1)
    add(center * 1e30, 1)
    return rows


def by_hand(rows, cosine=0.98):
    ok = {}
    for i, v, label in rows:
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            ok.setdefault((label, len(v)), []).append((i, np.array(v, float)))
    pairs = []
    for members in ok.values():
        m = np.array([v for _, v in members])
        m = m / np.abs(m).max(axis=1, keepdims=True)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        a, b = np.nonzero(np.triu(m @ m.T >= cosine, 1))
        pairs += [(members[x][0], members[y][0]) for x, y in zip(a, b)]
    return pairs


@pytest.mark.parametrize("block", [1024, 16])
def test_recall_and_counts(spark, block):
    rows = corpus()
    frame = spark.createDataFrame([(*r, "x", 1.0) for r in rows], DDL)
    got = {r["vec_id"]: r for r in near_duplicates(frame, block=block).collect()}
    pairs = by_hand(rows)
    links = {i: 0 for i, _, _ in rows}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    assert len(got) == len(rows)
    assert all(got[i]["n_links"] <= n for i, n in links.items())
    assert sum(r["n_links"] for r in got.values()) >= 0.995 * sum(links.values())
    top = union(pairs, links)
    same = sum(got[i]["component_id"] == top[i] for i in top)
    assert same >= 0.995 * len(top)
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_empty_and_repeated(spark):
    assert near_duplicates(spark.createDataFrame([], DDL)).collect() == []
    rows = [(1, [1.0, 2.0], 5, "", 0.0), (1, [1.0, 2.0], 5, "", 0.0), (None, [1.0, 2.0], 5, "", 0.0), (0, [2.0, 4.0], 5, "", 0.0)]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, DDL)).collect()), key=str)
    assert got == sorted([(1, 3, 0, False), (1, 3, 0, False), (None, 3, None, True), (0, 3, 0, True)], key=str)
