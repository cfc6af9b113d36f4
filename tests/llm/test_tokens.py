import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from llm.corpus import awkward, frame
from tokenizers import Tokenizer

from wardwatch.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
SPECIAL = ["don't<|endoftext|>it's", "<|ENDOFTEXT|>", "İstanbul ΣΑΣ", "éa ́", "a b c\x1cd", "x" * 5000, "ab" * 700, "12 3%%%&&& 5,6", "日本語 🎉", "﻿"]


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24FF, exclude_categories=("Cs", "Cn")), max_size=60))
def test_encoding_equals_the_library(text):
    assert bpe.encode(PATH, text) == ids_of(text)
    assert bpe.decode(PATH, ids_of(text)) == LIBRARY.decode(ids_of(text), skip_special_tokens=False)


@pytest.mark.parametrize("text", SPECIAL)
def test_special_texts(text):
    assert bpe.encode(PATH, text) == ids_of(text)


def test_long_words_merge_as_short_ones():
    model, r = bpe.WordBpe(PATH), random.Random(0)
    for n in (2, 3, 50, 64, 65, 300):
        parts = [model.ids[r.choice("abehtin")] for _ in range(n)]
        assert model._merge(list(parts)) == model._merge_long(list(parts))


def test_memory_keeps_values_when_it_turns_over():
    memory = bpe.Remembered(lambda k: k * 2, limit=3)
    for k in [1, 2, 3, 4, 1, 5, 6, 7, 2, 1]:
        assert memory.one(k) == 2 * k
    assert memory.all([1, 9, 9, 2]) == [2, 18, 18, 4] and len(memory.new) <= 3


def test_encoded_documents(spark):
    rows = awkward(seed=4, n=20) + [(9000 + k, t) for k, t in enumerate(SPECIAL)]
    got = sorted(map(tuple, bpe.encoded(frame(spark, rows), PATH, keep_text=False).collect()), key=str)
    want = []
    for doc_id, text in rows:
        ids = ids_of(text or "")
        back = LIBRARY.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), back))))
    assert got == sorted(want, key=str)
    assert bpe.encoded(frame(spark, []), PATH).collect() == []


def check_packing(rows, got, size):
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    want = Counter()
    for doc_id, text in rows:
        ids = np.array([*ids_of(text or ""), 1], "<u4")
        for k in range(0, len(ids), size):
            part = ids[k : k + size]
            want[doc_id, k, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    return len(sequences)


@pytest.mark.parametrize("size", [64, 2048])
def test_packed_documents(spark, size):
    rows = awkward(seed=6, n=150) + [(9000 + k, t) for k, t in enumerate(SPECIAL)]
    got = packing.packed(frame(spark, rows), PATH, size).collect()
    n = check_packing(rows, got, size)
    assert sum(r["length"] for r in got) >= (0.97 if size == 64 else 0.8) * n * size
    assert packing.packed(frame(spark, []), PATH).collect() == []


def test_ids_come_with_pieces(spark):
    got = packing.packed(frame(spark, [(1, "one two three")]), PATH, 3, with_ids=True).collect()
    assert [i for r in sorted(got, key=lambda r: r["start"]) for i in r["ids"]] == [*ids_of("one two three"), 1]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 10**9), max_size=40))
def test_patterns_use_every_length_once(counts):
    patterns = packing.pack_lengths(counts, 64)
    used = Counter()
    for n, lengths in patterns:
        assert n > 0 and sum(lengths) <= 64
        for length in lengths:
            used[length] += n
    assert used == Counter({k: v for k, v in counts.items() if v})
    assert len(patterns) <= 64 * 64


def test_memory_is_bounded_on_texts_without_spaces(spark):
    r = random.Random(1)
    texts = ["".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(800)) for _ in range(40)]
    memory = bpe.Remembered(lambda key: key * 5, longest=bpe.LONGEST)
    for text in texts:
        assert memory.all([text.encode(), b"short"]) == [text.encode() * 5, b"short" * 5]
    assert set(memory.new) == {b"short"} and not memory.old
    library = Tokenizer.from_file(PATH)
    rows = [(k, t) for k, t in enumerate(texts[:5])]
    got = {x["doc_id"]: x["ids"] for x in bpe.encoded(frame(spark, rows), PATH).collect()}
    assert got == {k: " ".join(map(str, library.encode(t, add_special_tokens=False).ids)) for k, t in rows}
