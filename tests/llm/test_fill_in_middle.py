import hashlib

import numpy as np
from llm.corpus import awkward, frame

from wardwatch.llm import fill_in_middle as fim


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_hand(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(text)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text), text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, a, b - a, sha(out), sha(text), out)


def test_against_slices(spark):
    rows = awkward(n=200) + [(k, "héλ😀<P <S M> >S>" * k) for k in range(2000, 2040)]
    rows += [(3000 + k, t) for k, t in enumerate(["a<P>b", "<S>", "x<M>", "<", ">", "<P", "é" * 70000, "a" * 70000 + "é<"])]
    got = [tuple(r) for r in fim.fill_in_middle(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted((by_hand(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_digests_alone_and_empty_table(spark):
    rows = awkward(n=30)
    got = fim.fill_in_middle(frame(spark, rows), keep_output=False)
    assert got.columns == [c.split()[0] for c in fim.DDL.split(", ")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((by_hand(*r)[:-1] for r in rows), key=str)
    assert fim.fill_in_middle(frame(spark, [])).collect() == []


def test_cutting_splits_only_the_piece_at_the_cut():
    pieces = [fim.Piece(0, 0, 5), fim.Piece(1, 3, 3), fim.Piece(0, 5, 4)]
    for at in range(13):
        before, after = fim.cut(pieces, at)
        assert sum(p.length for p in before) == min(at, 12) and all(p.length for p in before + after)
        data = b"".join(map(bytes, fim.spans(before + after, b"abcdefghi", fim.MARK_BUFFER)))
        assert data == b"abcde<S>fghi"


def test_texts_that_end_in_parts_of_sentinels_are_read_back():
    ends = ["<", "<P", "<S", "<M", ">", "P>", "<<", "<P<"]
    for form in fim.FORMS:
        for a in ends:
            for b in ends:
                for c in ends:
                    text = (a + b + c).encode()
                    if any(m in text for m in (fim.PREFIX, fim.SUFFIX, fim.MIDDLE)):
                        continue
                    head, suffix = fim.cut([fim.Piece(0, 0, len(text))], len(a + b))
                    prefix, middle = fim.cut(head, len(a))
                    out = b"".join(fim.spans(fim.arranged((prefix, middle, suffix), form), text, fim.MARK_BUFFER))
                    assert b"".join(fim.spans(fim.read_back(out, form), out)) == text


def test_positions_of_code_points():
    text = "aé😀" * 40000
    data = np.frombuffer(text.encode(), np.uint8)
    for point in (0, 1, 2, 3, 4, 59999, 60001, 119999, 120000):
        assert fim.byte_at(data, len(text), point) == len(text[:point].encode())
