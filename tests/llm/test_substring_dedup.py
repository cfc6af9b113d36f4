import hashlib
import re
import struct

import pytest
import xxhash
from llm.corpus import awkward, frame, thue_morse

from wardwatch.llm.substring_dedup import remove_repeats

LOWEST = -(1 << 63)


def tie(row):
    """Spark's hash of (doc_id, text); a null doc_id leaves the seed."""
    seed = 42 if row[0] is None else xxhash.xxh64_intdigest(struct.pack("<q", row[0]), 42)
    n = xxhash.xxh64_intdigest((row[1] or "").encode(), seed)
    return n - (1 << 64) if n >> 63 else n


def by_hand(rows, width):
    rows = sorted(rows, key=lambda r: (LOWEST if r[0] is None else r[0], tie(r)))
    seen, out = set(), []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            window = tuple(words[i : i + width])
            if window in seen:
                gone[i : i + width] = [True] * width
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc_id, len(words), sum(gone), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize(("width", "first"), [(20, 10), (20, 5), (8, 2), (3, 3)])
def test_equals_brute_force(spark, width, first):
    rows = awkward(seed=width + first)
    assert sorted(map(tuple, remove_repeats(frame(spark, rows), width, first).collect()), key=str) == by_hand(rows, width)


def test_many_chunks_and_buckets(spark, monkeypatch):
    from wardwatch.llm import substring_dedup as module
    from wardwatch.llm.shared import dealt

    monkeypatch.setattr(module, "dealt", lambda docs: dealt(docs, chunk_bytes=700, bucket_bytes=900))
    rows = awkward(seed=3)
    assert sorted(map(tuple, remove_repeats(frame(spark, rows)).collect()), key=str) == by_hand(rows, 20)


def test_digest_and_empty(spark):
    rows = [(1, "a b c"), (2, None)]
    found = {r["doc_id"]: r["kept_sha256"] for r in remove_repeats(frame(spark, rows), keep_text=False).collect()}
    assert found == {1: hashlib.sha256(b"a b c").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
    assert remove_repeats(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        remove_repeats(frame(spark, rows), 20, 7)


def test_words_that_a_polynomial_cannot_tell_apart(spark):
    rows = [(k, " ".join([*[f"w{j}" for j in range(25)], word, *[f"x{j}" for j in range(25)]])) for k, word in enumerate(thue_morse())]
    assert sorted(map(tuple, remove_repeats(frame(spark, rows)).collect()), key=str) == by_hand(rows, 20)


def test_one_id_or_none_for_many_texts(spark, monkeypatch):
    """Rows without an id are spread over chunks; of equal windows the first by the tie stays."""
    from wardwatch.llm import shared
    from wardwatch.llm import substring_dedup as module

    monkeypatch.setattr(module, "dealt", lambda docs: shared.dealt(docs, chunk_bytes=4000, bucket_bytes=4000))
    rows = awkward(seed=8, n=80, words=12)
    rows = [(None if k % 2 else 5, t) for k, (_, t) in enumerate(rows)]
    assert sorted(map(tuple, remove_repeats(frame(spark, rows)).collect()), key=str) == by_hand(rows, 20)
    many = spark.range(10_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat('text ', id) AS text")
    parts = shared.dealt(many, chunk_bytes=1000)
    assert parts.docs.groupBy("chunk").count().agg({"count": "max"}).first()[0] < 200
