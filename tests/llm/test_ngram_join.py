import random
import re

import numpy as np
import pytest
from llm.corpus import awkward, frame, thue_morse

from wardwatch.llm import ngram_join, shared
from wardwatch.llm.graph import components
from wardwatch.llm.ngram_join import near_duplicates, needed, tree_pairs


def union(pairs, ids):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def by_hand(rows, width=5, percent=80):
    sets = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        full = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}
        sets.append((doc_id, full or ({tuple(words)} if words else set())))
    pairs = []
    known = [(i, s) for i, s in sets if i is not None and s]
    for k, (i, s) in enumerate(known):
        for j, t in known[:k]:
            if 100 * len(s & t) >= percent * len(s | t):
                pairs.append((i, j))
    top = union(pairs, [i for i, _ in sets if i is not None])
    return sorted(((i, len(s), None if i is None else top[i]) for i, s in sets), key=str)


def near_copies(seed=1, n=80):
    r = random.Random(seed)
    base = [f"v{r.randrange(500)}" for _ in range(120)]
    out = []
    for k in range(n):
        text = list(base)
        for _ in range(r.randint(0, 6)):
            text[r.randrange(len(text))] = f"e{r.randrange(10**6)}"
        out.append((2000 + k, " ".join(text).replace("v1", "V1") if k % 5 == 0 else " ".join(text)))
    for k in range(40):  # a chain: each text is near the one before only
        text = [f"c{j}" for j in range(60 + 4 * k, 160 + 4 * k)]
        out.append((3000 - k, " ".join(text)))
    return out


@pytest.mark.parametrize(
    ("chunk_bytes", "block", "width", "percent"), [(1 << 20, 1024, 4, 85), (1500, 8, 4, 85), (1500, 8, 5, 80), (4000, 1024, 2, 50)]
)
def test_equals_brute_force(spark, monkeypatch, chunk_bytes, block, width, percent):
    monkeypatch.setattr(ngram_join, "dealt", lambda d: shared.dealt(d, chunk_bytes=chunk_bytes, bucket_bytes=chunk_bytes))
    rows = awkward(seed=9, n=90) + near_copies()
    got = near_duplicates(frame(spark, rows), width, percent, block=block).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(rows, width, percent)


def test_empty_and_tiny(spark):
    assert near_duplicates(frame(spark, [])).collect() == []
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  B"), (5, "a b c d"), (6, "a")]
    got = near_duplicates(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(rows)


def test_tree_loses_no_pair():
    r = np.random.default_rng(2)
    size, points = [], []
    for _ in range(300):
        base = r.poisson(r.choice([1, 3, 9]), 32)
        points.append(base)
        size.append(base.sum() + r.integers(0, 3))
    for k in range(0, 300, 3):
        points[k] = points[(k + 1) % 300] + r.integers(0, 2, 32)
    points, size = np.array(points, "<u2"), np.array(size)
    want = {
        (i, j)
        for i in range(300)
        for j in range(i)
        if np.minimum(points[i], points[j]).sum() >= needed(size[i], size[j], 85)
        and 100 * size[i] >= 85 * size[j] and 100 * size[j] >= 85 * size[i]
    }
    a, b = tree_pairs(points, size, 85)
    assert want <= {(max(i, j), min(i, j)) for i, j in zip(a.tolist(), b.tolist())}


def test_very_long_texts_keep_their_links(spark):
    # Two groups hold some 75,000 shingles each, more than a point's count can say.
    words = [f"w{k}" for k in range(150_000)]
    rows = [(k, " ".join([*words[: 1000 * k], f"changed{k}", *words[1000 * k + 1 :]])) for k in (7, 9)] + [(8, " ".join(f"x{k}" for k in range(150_000)))]
    got = near_duplicates(frame(spark, rows), groups=2).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == {7: 7, 9: 7, 8: 8}


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 460)] + [(7, None)]
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    assert got == union(real, {i for e in real for i in e})


def test_one_id_with_two_texts_of_equal_size(spark):
    a, b = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    near = [[*x[:30], "other", *x[31:]] for x in (a, b)]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a[:59], "z"])), (3, " ".join([*b[:59], "z"])), (1, ""), (4, " ".join(near[0]))]
    got = near_duplicates(frame(spark, rows), 4, 85).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(rows, 4, 85)
    assert {r["doc_id"]: r["component_id"] for r in got}[3] == 1


def test_rows_out_of_the_trees_are_linear(spark, monkeypatch):
    """Copies whose similarity lies around the threshold: nearly all pairs are candidates, few rows may come out."""
    r = random.Random(3)
    base = [f"v{k}" for k in range(110)]
    rows = []
    for k in range(150):
        text = list(base)
        for _ in range(r.randint(1, 4)):
            text[r.randrange(len(text))] = f"e{r.randrange(10**6)}"
        rows.append((k, " ".join(text)))
    made = []
    real = ngram_join.stored

    def counted(table, name):
        out = real(table, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(ngram_join, "stored", counted)
    got = near_duplicates(frame(spark, rows), 4, 85).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(rows, 4, 85)
    # Members times the shingles they can meet in first, not pairs.
    assert max(n for name, n in made if name in ("tried-pairs", "open-trees", "links")) < 20 * len(rows)
    monkeypatch.setattr(ngram_join, "CELL_BYTES", 8 * 110 * 20)
    got = near_duplicates(frame(spark, rows), 4, 85).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(rows, 4, 85)


def test_words_that_a_polynomial_cannot_tell_apart(spark):
    word, other = thue_morse()
    rows = [(1, word), (2, other), (3, f"{word.upper()} ")]
    got = near_duplicates(frame(spark, rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 1}
