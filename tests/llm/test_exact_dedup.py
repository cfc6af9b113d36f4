import hashlib
import re

import numpy as np
import pytest
from llm.corpus import awkward, frame

from wardwatch.llm.exact_dedup import build_index, digests, exact_dedup, groups_of, merge_groups, perfect_hash, slots_of


def by_hand(rows):
    groups = {}
    for doc_id, text in rows:
        sha = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text or "").encode()).hexdigest()
        groups.setdefault(sha, []).append((-len(text or ""), doc_id is None, doc_id))
    out = []
    for sha, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
        out += [(m[2], keep, len(members), m[2] == keep, sha) for m in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("history", [None, -1000, 5000, 40])
def test_equals_brute_force(spark, history):
    rows = awkward(seed=1) + [(7000 + k, "same  text" + " " * (k % 3)) for k in range(50)]
    got = exact_dedup(frame(spark, rows), history, shard_digests=10).drop("seen").collect()
    assert sorted(map(tuple, got), key=str) == by_hand(rows)


def test_perfect_hash_is_minimal_and_checked():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 500, 20_000):
        keys = r.integers(0, 256, (n, 32), dtype=np.uint8)
        sizes, bits, slot = perfect_hash(keys)
        assert sorted(slot.tolist()) == list(range(n)) and bits.sum() == n
        assert (slots_of(keys, sizes, bits) == slot).all()
    other = r.integers(0, 256, (1000, 32), dtype=np.uint8)
    found = slots_of(other, sizes, bits)
    assert ((found == -1) | ((found >= 0) & (found < n))).all()


def test_batches_against_an_index(spark):
    old = frame(spark, [(5, "a b"), (6, "c")])
    new = frame(spark, [(1, "ab"), (2, "a  b"), (3, "new"), (4, "new")])
    index = build_index(groups_of(digests(old)), 3)
    got = {r["digest"].hex(): r for r in merge_groups(index, groups_of(digests(new)), 3).collect()}
    seen = {k: (r["keep_id"], r["size"], r["seen"]) for k, r in got.items()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert seen == {sha("ab"): (2, 3, True), sha("c"): (6, 1, True), sha("new"): (3, 2, False)}


def test_empty(spark):
    assert exact_dedup(frame(spark, [])).collect() == []
