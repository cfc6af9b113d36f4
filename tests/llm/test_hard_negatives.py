from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from wardwatch.llm import hard_negatives as hn

DDL = "vec_id long, embedding array<double>, label string, row string, dim double"


def corpus(seed=0, n=400, dim=24):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(30, dim))
    rows = []
    for i in range(n):
        v = centers[r.integers(30)] + r.normal(size=dim) * r.choice([0.0, 0.05, 0.3])
        rows.append((i, [float(x) for x in v], str(int(r.integers(0, 3))) if r.random() < 0.9 else "hot"))
    some = rows[40][1]
    rows += [(1000, None, "0"), (1001, [float("nan")] * dim, "0"), (1002, [float("inf")] + some[1:], "0"), (1010, [None] + some[1:], "0")]
    rows += [(1020, some, None), (None, some, "0"), (None, some, "1"), rows[40], rows[40], (30, [0.0] * dim, "1"), (1030, [], "0"), (1031, [], "1")]
    rows += [(1040, some[:3], "0"), (1041, some[:3], "0"), (1042, some[:3], "1"), (-40, some, "2"), (-41, some, "0")]
    return rows


def by_hand(rows, every=20, positives=5, negatives=5, low=80, high=100, scale=256):
    ok = []
    for i, v, label in rows:
        if label is not None and v is not None and None not in v and np.isfinite(v).all():
            ok.append((i, [min(max(int(np.floor(scale * x)), -(2**62)), 2**62) for x in v], label))
    out = []
    for a, (i, v, label) in enumerate(ok):
        if i is None or i % every:
            continue
        same, other = [], []
        for b, (j, w, its) in enumerate(ok):
            if b == a or len(w) != len(v):
                continue
            score = min(max(sum(x * y for x, y in zip(v, w)), -(2**63)), 2**63 - 1)
            (same if its == label else other).append((-score, j is None, j or 0, j))
        for p in sorted(same)[:positives]:
            band = [n for n in sorted(other) if low * -p[0] <= 100 * -n[0] <= high * -p[0]]
            out += [(i, p[3], k + 1, n[3], -p[0], -n[0]) for k, n in enumerate(band[:negatives])]
    return sorted(out, key=str)


def mined(spark, rows, **more):
    frame = spark.createDataFrame([(*r, "x", 0.5) for r in rows], DDL)
    return sorted(map(tuple, hn.hard_negatives(frame, every=20, **more).collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_against_all_pairs(spark, monkeypatch, small):
    if small:  # blocks of a few rows
        monkeypatch.setattr(hn, "BLOCK_BYTES", 24 * 8 * 20)
        monkeypatch.setattr(hn, "LEAST_ROWS", 16)
    rows = corpus()
    assert mined(spark, rows) == by_hand(rows)
    assert mined(spark, rows, low=-50, high=130, negatives=3) == by_hand(rows, low=-50, high=130, negatives=3)


def test_long_components_and_empty_table(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(size=5) * 10.0 ** r.integers(0, 30)], str(i % 2)) for i in range(60)]
    assert mined(spark, rows) == by_hand(rows)
    assert mined(spark, []) == []


def test_bounds_hold_and_leave_little_to_score():
    r = np.random.default_rng(1)
    base = np.repeat(r.normal(size=(40, 16)) * 200, 4, axis=1)
    q = np.floor(base[r.integers(0, 40, 600)] + r.normal(size=(600, 64)) * 4).astype(np.int64)
    table = pa.table(
        {
            "row": np.arange(600),
            "vec_id": np.arange(600),
            "vector": [x.astype("<i2").tobytes() for x in q],
            "summary": [x.tobytes() for x in hn.summarised(q.astype(float))],
        }
    )
    rows, anchors = hn.Block(table, 64), hn.Block(table.slice(0, 20), 64)
    exact = q[:20] @ q.T
    width = []
    for level in range(len(hn.LEVELS)):
        low, high = hn.bounds(anchors, np.arange(20), rows, slice(None), level)
        assert (low <= exact).all() and (exact <= high).all()
        width.append((high - low).mean())
    assert width == sorted(width, reverse=True)
    scored: list[int] = []
    found = defaultdict(list)
    for a, row, score in hn.top_rows(anchors, rows, 5, scored):
        found[a].append((-score, row))
    for a in range(20):
        want = sorted((-exact[a, b], b) for b in range(600) if b != a)[:5]
        assert sorted(found[a]) == want
    # Most rows are out before the exact scores.
    assert sum(scored) < 0.2 * 20 * 600


def test_every_row_meets_every_anchor_once(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_BYTES", 24 * 8 * 30)
    monkeypatch.setattr(hn, "LEAST_ROWS", 16)
    frame = spark.createDataFrame([(k, 24, "a") for k in range(500)], "row long, dim int, label string")
    left, right = hn._cells(frame, frame.where("row % 5 = 0"), ["dim"])
    met = left.join(right.withColumnRenamed("row", "anchor"), ["dim", "rb", "ab"])
    assert met.count() == met.select("row", "anchor").distinct().count() == 500 * 100
    assert left.groupBy("dim", "rb", "ab").count().agg({"count": "max"}).first()[0] < 60
