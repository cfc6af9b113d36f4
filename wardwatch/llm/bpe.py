"""Byte-pair encoding with word ends, and decoding, by the contiguous rank array.

A word is held as two arrays: the parts between its boundaries, and the merge rank of each part with its right
neighbour. The smallest rank is looked for by scanning; the boundary there is deleted and the ranks of the two
neighbours are refreshed. That is fastest for short words, which nearly all are. A word of more than
``SCAN_PARTS`` characters keeps the same merge order with a heap, so its time does not grow with the square of its length.

The text is cut at ASCII white space first: no token crosses it. Each distinct piece is encoded once per worker and
remembered in two generations, so the memory is bounded and frequent pieces stay.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from wardwatch.llm.tables import texts
from wardwatch.llm.worker import hold

SCAN_PARTS = 64
REMEMBERED = 300_000
#: Longer pieces and words are not remembered, so a memory is bounded in bytes, also on texts without spaces.
LONGEST = 48
_NO_RANK = 1 << 30
# The white space of the vocabulary's normaliser, and its word pattern.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 bytes stand for themselves, the rest follow 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class WordBpe:
    """A vocabulary file of the kind "BPE with word ends; lower case, white space dropped"."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids = model["vocab"]
        self.names = {i: name for name, i in self.ids.items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: name for name, i in special.items()})
        self.special = special
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.letters = byte_letters()
        self.words = regex.compile(WORD)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")
        self.known = Remembered(self._word, REMEMBERED // 2, LONGEST)

    def _merge(self, parts: list[int]) -> list[int]:
        merges = self.merges
        none = (_NO_RANK, -1)
        found = [merges.get(pair, none) for pair in zip(parts, parts[1:])]
        ranks = [r for r, _ in found]
        while ranks:
            low = min(ranks)
            if low == _NO_RANK:
                break
            i = ranks.index(low)
            parts[i] = merges[(parts[i], parts[i + 1])][1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = merges.get((parts[i], parts[i + 1]), none)[0]
            if i:
                ranks[i - 1] = merges.get((parts[i - 1], parts[i]), none)[0]
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, merges = len(parts), self.merges
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (hit := merges.get((parts[i], parts[after[i]]))):
                heapq.heappush(heap, (hit[0], i, parts[i], parts[after[i]], hit[1]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or parts[i] != left or parts[j] != right:
                continue
            parts[i], gone[j], after[i] = made, True, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p, dead in zip(parts, gone) if not dead]

    def word(self, word: str) -> list[int]:
        """Ids of one word of the pattern."""
        return self.known.one(word)

    def _word(self, word: str) -> list[int]:
        letters = [self.letters[b] for b in word.encode()]
        letters[-1] += self.suffix
        parts = [self.ids[x] for x in letters]
        return self._merge(parts) if len(parts) <= SCAN_PARTS else self._merge_long(parts)

    def piece(self, piece: str) -> list[int]:
        """Ids of a text; special tokens in it are those tokens."""
        if piece.isascii() and piece.isalpha():
            return self.word(piece.lower())
        out: list[int] = []
        for k, part in enumerate(self.cut.split(piece)):
            if k % 2:
                out.append(self.special[part])
                continue
            part = unicodedata.normalize("NFC", part)
            low = "".join(map(str.lower, part)) if "Σ" in part else part.lower()
            for w in self.words.findall(low):
                out += self.word(w)
        return out


class Remembered:
    """``make(key)`` for each key, kept in two generations of at most ``limit`` keys; keys of over ``longest`` bytes or letters are not kept."""

    def __init__(self, make, limit: int = REMEMBERED, longest: int | None = None):
        self.make, self.limit, self.longest, self.new, self.old = make, limit, longest, {}, {}

    def one(self, key):
        if self.longest is not None and len(key) > self.longest:
            return self.make(key)
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is None:
                value = self.make(key)
            if len(self.new) >= self.limit:
                self.old, self.new = self.new, {}
            self.new[key] = value
        return value

    def all(self, keys: list) -> list:
        found = list(map(self.new.get, keys))
        for i in [i for i, value in enumerate(found) if value is None]:
            found[i] = self.one(keys[i])
        return found


def pieces_of(column):
    """The pieces between ASCII white space of each text of an Arrow column."""
    for text in column:
        yield text.as_buffer().to_pybytes().split()


def model(path: str) -> tuple[WordBpe, Remembered]:
    """The vocabulary and its memory of (count, ids as text, tokens as text) per piece, one per worker process."""

    def load() -> tuple[WordBpe, Remembered]:
        bpe = WordBpe(path)

        def make(piece: bytes) -> tuple[int, bytes, bytes]:
            ids = bpe.piece(piece.decode())
            return len(ids), b" ".join([b"%d" % i for i in ids]), " ".join([bpe.names[i] for i in ids]).encode()

        return bpe, Remembered(make, longest=LONGEST)

    return hold(f"own ids {path}", load)


def encode(path: str, text: str) -> list[int]:
    """Ids of one text."""
    bpe, _ = model(path)
    return [i for piece in text.encode().split() for i in bpe.piece(piece.decode())]


def decode(path: str, ids: list[int]) -> str:
    """Token strings joined by one space: the vocabulary has no decoder of its own."""
    bpe, _ = model(path)
    return " ".join(bpe.names[i] for i in ids)


def encoded(docs: DataFrame, path: str, keep_text: bool = True) -> DataFrame:
    """Documents with their ids and the text decoded from them.

    Columns: doc_id, n_tokens, ids (decimal, joined by one space) and decoded, or with ``keep_text`` off their SHA-256
    as ids_sha256 and decoded_sha256. A null or empty text, or one of white space only, has no ids and decodes to an
    empty text. Rows stay as they are: repeated ids and null ids are not looked at. No shuffle.
    """

    def run(batches):
        _, memory = model(path)
        for batch in batches:
            n, ids, back = [], [], []
            for pieces in pieces_of(batch.column(1)):
                got = [x for x in memory.all(pieces) if x[0]]
                n.append(sum(x[0] for x in got))
                ids.append(b" ".join([x[1] for x in got]))
                back.append(b" ".join([x[2] for x in got]))
            if not keep_text:
                ids, back = ([hashlib.sha256(x).hexdigest().encode() for x in xs] for xs in (ids, back))
            columns = [batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()).cast(pa.string()) for x in (ids, back))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_tokens", *(("ids", "decoded") if keep_text else ("ids_sha256", "decoded_sha256"))]
    return texts(docs).mapInArrow(run, ", ".join(f"{c} {t}" for c, t in zip(names, ("long", "long", "string", "string"))))
