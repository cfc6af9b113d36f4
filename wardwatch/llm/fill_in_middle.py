"""Fill-in-middle by a piece table.

A document is a list of descriptors (buffer, start, length) over two buffers that never change: the UTF-8 bytes of its text and
the sentinels. Cutting splits a descriptor in two, an arrangement permutes the descriptors of prefix, middle, and suffix and
puts sentinels between them, and the inverse permutation gives the text back. Hashes run over the descriptors' bytes, so no arrangement has to be
copied to be hashed. The output, which is one join of the descriptors, is read back by looking for the sentinels in it: that gives descriptors over the
output, and the inverse permutation of those is the text.

Cuts are drawn from a hash of the doc_id, so a document is cut alike in every run. Everything happens row by row without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from wardwatch.llm.hashing import joined
from wardwatch.llm.tables import texts

#: The sentinels before prefix, suffix, and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Order of the parts in the output of each form, each with the sentinel before it. Parts: 0 prefix, 1 middle, 2 suffix.
FORMS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
TEXT, MARKS = 0, 1
MARK_BUFFER = PREFIX + SUFFIX + MIDDLE
#: Of 100 documents, how many are rearranged, and how many of those begin with the suffix.
RATE, SPM_RATE = 90, 20
DDL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
#: Code points are counted in blocks of this many bytes.
BLOCK = 1 << 16


class Piece(NamedTuple):
    buffer: int
    start: int
    length: int


def byte_at(data: np.ndarray, n: int, point: int) -> int:
    """Byte position of a code point in UTF-8 bytes that hold ``n`` of them."""
    if n == len(data) or point == 0:
        return point
    if point == n:
        return len(data)
    for start in range(0, len(data), BLOCK):
        first = np.flatnonzero((data[start : start + BLOCK] & 0xC0) != 0x80)
        if point < len(first):
            return start + int(first[point])
        point -= len(first)
    return len(data)


def cut(pieces: list[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """The pieces before and after byte ``at``; the piece over it is split."""
    before, after = [], []
    for p in pieces:
        left = min(max(at, 0), p.length)
        if left:
            before.append(Piece(p.buffer, p.start, left))
        if left < p.length:
            after.append(Piece(p.buffer, p.start + left, p.length - left))
        at -= p.length
    return before, after


def arranged(parts: tuple[list[Piece], list[Piece], list[Piece]], form: str) -> list[Piece]:
    """Prefix, middle, and suffix in the order of the form, with sentinels."""
    out = []
    for mark, part in FORMS[form]:
        out += [Piece(MARKS, MARK_BUFFER.index(mark), len(mark)), *parts[part]]
    return out


def read_back(output: bytes, form: str) -> list[Piece]:
    """The text as pieces of an output: sentinels found in their order, and the permutation undone.

    No sentinel can lie across a border of text and sentinel, as each begins with ``<``, ends with ``>``, and has neither inside.
    """
    if form == "plain":
        return [Piece(TEXT, 0, len(output))]
    found, at = [], 0
    for mark, part in FORMS[form]:
        at = output.index(mark, at)
        found.append((part, at, at + len(mark)))
        at += len(mark)
    ends = [start for _, start, _ in found[1:]] + [len(output)]
    by_part = sorted((part, Piece(TEXT, begin, end - begin)) for (part, _, begin), end in zip(found, ends))
    return [p for _, p in by_part]


def spans(pieces: Iterable[Piece], *buffers) -> Iterable:
    """The bytes of each piece, without a copy where the buffer is a view."""
    views = [memoryview(b) for b in buffers]
    return (views[p.buffer][p.start : p.start + p.length] for p in pieces)


def digest(pieces: Iterable[Piece], *buffers) -> str:
    h = hashlib.sha256()
    for span in spans(pieces, *buffers):
        h.update(span)
    return h.hexdigest()


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits from the seed and the doc_id; a null doc_id counts as empty."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(h[k : k + 4], "big") for k in range(0, 16, 4)]


def chosen(doc_id: int | None, n: int, marked: bool, seed: int, rate: int, spm_rate: int) -> tuple[str, int, int]:
    """Form, and code points before the first and the second cut."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not n or marked or h3 % 100 >= rate:
        return "plain", 0, 0
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    return "spm" if h4 % 100 < spm_rate else "psm", low, high


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = RATE, spm_rate: int = SPM_RATE, keep_output: bool = True) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, and with ``keep_output`` output.

    A text that is null or empty, or holds a sentinel, stays as it is (form ``plain``, with null prefix_chars and middle_chars). Rows
    that repeat a doc_id are drawn alike and cut by their own length; a null doc_id is drawn like an empty one. The output can be read back with ``read_back``.
    Other columns of the table are left out. An empty table gives no rows.
    """
    ddl = DDL + ", output string" * keep_output
    names = [c.split()[0] for c in ddl.split(", ")]

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            whole, at = joined(column)
            points = pc.utf8_length(column).to_pylist()
            marked = np.zeros(len(column), bool)
            for mark in (PREFIX, SUFFIX, MIDDLE):
                marked |= pc.match_substring(column, mark.decode()).to_numpy(zero_copy_only=False)
            rows, outputs = [], []
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                data, n = whole[at[k] : at[k + 1]], points[k]
                form, low, high = chosen(doc_id, n, bool(marked[k]), seed, rate, spm_rate)
                pieces = [Piece(TEXT, 0, len(data))] if len(data) else []
                if form != "plain":
                    head, suffix = cut(pieces, byte_at(data, n, high))
                    prefix, middle = cut(head, byte_at(data, n, low))
                    pieces = arranged((prefix, middle, suffix), form)
                output = b"".join(spans(pieces, data, MARK_BUFFER))
                cuts = (None, None) if form == "plain" else (low, high - low)
                rows.append((doc_id, n, form, *cuts, digest(pieces, data, MARK_BUFFER), digest(read_back(output, form), output)))
                if keep_output:
                    outputs.append(output)
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * len(types), types)]
            if keep_output:
                columns.append(pa.array(outputs, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts(docs).mapInArrow(run, ddl)
