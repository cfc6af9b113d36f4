"""Packing token pieces into sequences: shortest pack first over the histogram of lengths.

Documents are cut into full pieces and one rest. The histogram of rest lengths has at most ``size`` bins, however
many documents there are, so the driver plans on counts alone: lengths are placed longest first, each onto the
open patterns with the most room (the shortest packs), and a pattern's count is split when only part of it takes the
length. The result is a list of patterns with counts and consecutive sequence numbers. Each pattern slot takes a run
of ranks of its length; pieces are ranked within their length and find their slot by that rank.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wardwatch.llm.bpe import LONGEST, REMEMBERED, Remembered, byte_letters, pieces_of
from wardwatch.llm.tables import stored, texts
from wardwatch.llm.worker import hold

SIZE = 2048
END_ID = 1
PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Groups that ranks are counted in before they are summed; spreads a length that very many pieces have.
RANK_GROUPS = 256


def _token_bytes(path: str) -> Remembered:
    """Per worker: the memory of pieces of text with their ids as little-endian 32-bit words, by the tokenizers library.

    A piece of letters, with a comma or full stop at most, is one word for the library's model; words are remembered
    in lower case. Every other piece goes through the whole tokenizer.
    """

    def load() -> Remembered:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        model, letters = tokenizer.model, byte_letters()

        def whole(piece: str) -> bytes:
            return np.array(tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

        def make_word(word: str) -> bytes:
            name = word if word.isascii() else "".join([letters[b] for b in word.encode()])
            return np.array([t.id for t in model.tokenize(name)], "<u4").tobytes()

        words = Remembered(make_word, REMEMBERED // 2, LONGEST)
        marks = {mark: whole(mark) for mark in ",."}

        def make(piece: bytes) -> bytes:
            text = piece.decode()
            core, mark = (text[:-1], text[-1]) if text[-1] in marks else (text, "")
            if not core.isalpha() or not (core.isascii() or (core.isprintable() and max(core) < "\u0250")):
                return whole(text)
            low = core.lower()
            return words.one(low) + marks.get(mark, b"") if len(low) == len(core) else whole(text)

        return Remembered(make, longest=LONGEST)

    return hold(f"library ids {path}", load)


def pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces of ``size`` ids and a rest. No shuffle.

    The library encodes each distinct piece of text between ASCII white space, which no token of a vocabulary that
    drops white space crosses. A null or empty text has the end id alone. ``with_ids`` adds the ids of each piece.
    """
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * size
    names = [c.split()[0] for c in PIECE_DDL.split(", ")] + ["ids"] * with_ids

    def run(batches):
        memory = _token_bytes(path)
        for batch in batches:
            ids, rows, cut = batch.column(0).to_pylist(), [], []
            for doc_id, words in zip(ids, pieces_of(batch.column(1))):
                whole = b"".join(memory.all(words)) + end
                for at in range(0, len(whole), step):
                    part = whole[at : at + step]
                    rows.append((doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(whole) // 4))
                    if with_ids:
                        cut.append(np.frombuffer(part, "<u4").astype(np.int64))
            columns = [pa.array(x, pa.int64()) for x in zip(*rows)] or [pa.array([], pa.int64())] * 5
            if with_ids:
                columns.append(pa.array(cut, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts(docs).mapInArrow(run, PIECE_DDL + ", ids array<long>" * with_ids)


def pack_lengths(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """Patterns as (count, lengths) with every length used as often as it occurs.

    Longest length first; each goes to the open pattern with the most room, and opens new sequences only when
    none has room. Every step uses up a pattern or a length, so the number of patterns follows from the lengths.
    """
    heap: list[tuple[int, int, tuple[int, ...]]] = []
    full: list[tuple[int, list[int]]] = []

    def put(room: int, n: int, lengths: tuple[int, ...]) -> None:
        if room:
            heapq.heappush(heap, (-room, n, lengths))
        else:
            full.append((n, list(lengths)))

    for length in sorted((n for n in counts if counts[n] > 0), reverse=True):
        left = counts[length]
        while left and heap and -heap[0][0] >= length:
            room, n, lengths = heapq.heappop(heap)
            take = min(n, left)
            if n > take:
                heapq.heappush(heap, (room, n - take, lengths))
            put(-room - length, take, (*lengths, length))
            left -= take
        fit = size // length
        if left >= fit:
            put(size - fit * length, left // fit, (length,) * fit)
        if left % fit:
            put(size - (left % fit) * length, 1, (length,) * (left % fit))
    return full + [(n, list(lengths)) for _, n, lengths in heap]


def slot_runs(patterns: list[tuple[int, list[int]]], first: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(length, rank_from, rank_to, sequence of rank_from, offset): which ranks of a length go where."""
    used: dict[int, int] = defaultdict(int)
    runs, sequence = [], first
    for n, lengths in sorted(patterns, key=lambda p: (p[1], p[0]), reverse=True):
        offset = 0
        for length in lengths:
            runs.append((length, used[length], used[length] + n, sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return runs


def _ranked(rows: DataFrame) -> DataFrame:
    """Rank of each piece within its length, by groups: counts per (length, group) are summed, then added."""
    grouped = rows.withColumn("rank_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(RANK_GROUPS)))
    before = (
        grouped.groupBy("length", "rank_group")
        .agg(F.count("*").alias("n"))
        .withColumn(
            "before",
            F.sum("n").over(Window.partitionBy("length").orderBy("rank_group").rowsBetween(Window.unboundedPreceding, -1)),
        )
        .select("length", "rank_group", F.coalesce("before", F.lit(0)).alias("before"))
    )
    inner = Window.partitionBy("length", "rank_group").orderBy("doc_id", "start", "ids_crc32")
    return grouped.withColumn("in_group", F.row_number().over(inner) - 1).join(before, ["length", "rank_group"]).withColumn(
        "rank", F.col("before") + F.col("in_group")
    )


def pack(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """Pieces (columns of ``pieces``) with sequence_id and offset; offsets of a sequence are gapless from 0.

    Sequences may be padded to ``size``. Rows that repeat are packed one by one. Lengths must lie in 1 to ``size``. An
    empty table gives no rows.
    """
    spark = rows.sparkSession
    rows = stored(rows, "pieces")
    # At most ``size`` rows: one per length.
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = slot_runs(pack_lengths(counts, size))
    # Bounded by lengths and splits of the plan (thousands of rows), whatever the number of pieces.
    table = spark.createDataFrame(runs or [(0, 0, 0, 0, 0)], "run_length long, rank_from long, rank_to long, first long, offset long")
    fits = (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    return (
        _ranked(rows)
        .join(F.broadcast(table), fits)
        .withColumn("sequence_id", F.col("first") + F.col("rank") - F.col("rank_from"))
        .drop("rank_group", "in_group", "before", "rank", "run_length", "rank_from", "rank_to", "first")
    )


def packed(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """All documents cut and packed: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Null and empty texts give one piece with the end id. Null and repeated doc_ids are packed like any other row.
    """
    return pack(pieces(docs, path, size, end_id, with_ids), size)
