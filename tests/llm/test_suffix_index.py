import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm.corpus import awkward, frame, thue_morse

from wardwatch.llm import hashing, shared, suffix_index
from wardwatch.llm.suffix_index import remove_repeated_bytes, sliding_argmin


def by_hand(rows, span):
    raw = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(t[k : k + span] for _, t in raw for k in range(len(t) - span + 1))
    out = []
    for i, t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - span + 1):
            if counts[t[k : k + span]] > 1:
                gone[k : k + span] = True
        spans = int((gone[:-1] & ~gone[1:]).sum())
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 2500])
@pytest.mark.parametrize(("span", "batches"), [(200, 4), (60, 1), (60, 5)])
def test_equals_brute_force(spark, monkeypatch, span, batches, chunk_bytes):
    monkeypatch.setattr(suffix_index, "dealt", lambda d, *m: shared.dealt(d, *m, chunk_bytes=chunk_bytes, bucket_bytes=chunk_bytes * 2))
    rows = awkward(seed=span)
    r = random.Random(5)
    base = "".join(r.choice("abcdefgh ") for _ in range(1500))
    for k in range(30):
        text = list(base)
        for _ in range(r.randint(0, 14)):
            text[r.randrange(len(text))] = "#"
        rows.append((5000 + k, "".join(text)[r.randint(0, 300) : r.randint(400, 1500)]))
    rows += [(6000, "a" * 700), (6001, "ab" * 150), (6002, base[:span]), (6003, "x" + base[700 : 700 + span] + "y")]
    got = remove_repeated_bytes(frame(spark, rows), span, batches, keep_text=False)
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(rows, span)


def test_a_name_with_many_contexts_is_spread():
    r = random.Random(3)

    def noise():
        return "".join(r.choice("abcdefgh ") for _ in range(150))

    line = noise()[:120]
    found = suffix_index.Anchors(pa.table({"doc_id": list(range(300)), "text": [noise() + line + noise() for _ in range(300)]}), 200)
    name, n = Counter(found.names.tolist()).most_common(1)[0]
    assert n > 50
    sizes = [len(row[3]) for row in suffix_index.Windows(found, found.names == np.uint64(name), 16).requests(0)]
    assert len(sizes) == 16 and max(sizes) < sum(sizes) / 8


def test_spans_that_a_polynomial_cannot_tell_apart(spark):
    rows = [(k, f"{'x' * 60}{word}{'y' * 60}") for k, word in enumerate(thue_morse())]
    raw = np.frombuffer(rows[0][1].encode() + rows[1][1].encode(), np.uint8)
    spans = hashing.Spans(raw)
    half, start = len(raw) // 2, np.arange(0, 120)
    assert (spans.of(start, start + 1024) != spans.of(start + half, start + half + 1024))[60:61].all()
    for span in (200, 1100):
        got = remove_repeated_bytes(frame(spark, rows), span, keep_text=False)
        assert sorted(map(tuple, got.collect()), key=str) == by_hand(rows, span)


def test_sliding_argmin():
    values = np.random.default_rng(0).integers(0, 9, 500).astype(np.uint64)
    want = [k + int(np.argmin(values[k : k + 7])) for k in range(494)]
    assert sliding_argmin(values, 7).tolist() == want


def test_levels_merge_geometrically(spark, monkeypatch):
    sizes = []

    class Watched(suffix_index.IndexFamily):
        def add(self, requests):
            out = super().add(requests)
            sizes.append([n for n, _ in self.levels])
            return out

    monkeypatch.setattr(suffix_index, "IndexFamily", Watched)
    remove_repeated_bytes(frame(spark, awkward(n=12)), batches=5).collect()
    assert sizes == [[1], [1, 1], [2, 1], [2, 1, 1], [4, 1]]


def test_text_and_empty(spark):
    rows = [(1, "é" * 150 + "one"), (2, "é" * 150 + "two"), (3, None)]
    got = {r["doc_id"]: r["kept"] for r in remove_repeated_bytes(frame(spark, rows)).collect()}
    assert got == {1: "one", 2: "two", 3: ""}
    assert remove_repeated_bytes(frame(spark, []), more=("level",)).collect() == []
