"""Hashes of words and of word windows over the raw bytes of many texts at once, in numpy.

A word is ``[^\\x20\\x09-\\x0D]+``. Its hash is a polynomial over its bytes with a random 64-bit value per byte,
finished by a mixer; windows combine the hashes of their words, so equal windows have equal hashes and any two others
differ but for chance (64 bits; two independent windows hashes give 128). A polynomial modulo a power of two cannot tell
some long words of two letters apart, whatever its base, so words of over ``LONG`` bytes have a BLAKE2 digest.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from wardwatch.llm.worker import hold

#: Texts are hashed in blocks of about this many bytes; one text is never cut.
BLOCK = 1 << 20
#: Bytes of a word whose hash is a polynomial.
LONG = 32
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUES = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[ord("A") : ord("Z") + 1] = BYTE_VALUES[ord("a") : ord("z") + 1]
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    held = hold("powers", dict)
    if not held or len(held["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(max(n, BLOCK + 1), base, np.uint64)
            steps[0] = 1
            held[name] = np.multiply.accumulate(steps)
    return held["up"][:n], held["down"][:n]


#: Prime field of the second hash of byte spans.
_PRIME = (1 << 31) - 1
_PRIME_VALUES = BYTE_VALUES >> np.uint64(34)
_PRIME_BASE = 1_137_549_271


def _prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    held = hold("powers", dict)
    if "prime up" not in held or len(held["prime up"]) < n:
        n = max(n, BLOCK + 1)
        for name, base in (("prime up", _PRIME_BASE), ("prime down", pow(_PRIME_BASE, -1, _PRIME))):
            out = np.ones(n, np.uint64)
            size = 1
            while size < n:
                more = min(size, n - size)
                out[size : size + more] = out[:more] * np.uint64(pow(base, size, _PRIME)) % np.uint64(_PRIME)
                size *= 2
            held[name] = out
    return held["prime up"][:n], held["prime down"][:n]


class Spans:
    """Hashes of any spans of some bytes: equal spans have equal hashes.

    Two polynomials with random values per byte, modulo 2**64 and modulo a prime. The first alone cannot tell some spans of two letters
    apart, whatever its base, and keeps few of its bits on others; the second has no such spans.
    """

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[raw] * up[:n], out=self.sums[1:])
        up, self.prime_down = _prime_powers(n + 1)
        terms = _PRIME_VALUES[raw] * up[:n]
        # Reduced to 32 bits; sums of any text in memory fit.
        terms = (terms & np.uint64(_PRIME)) + (terms >> np.uint64(31))
        self.prime_sums = np.zeros(n + 1, np.uint64)
        np.cumsum(terms, out=self.prime_sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        first = mixed((self.sums[end] - self.sums[start]) * self.down[start])
        second = (self.prime_sums[end] - self.prime_sums[start]) % np.uint64(_PRIME) * self.prime_down[start] % np.uint64(_PRIME)
        return combined(first, second)


def mixed(x: np.ndarray) -> np.ndarray:
    """A new array with every bit of the input spread over all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def combined(left: np.ndarray, right: np.ndarray, salt: int = 0) -> np.ndarray:
    return mixed(left * np.uint64(0xD6E8FEB86659FD93 + 2 * salt) + right)


def window_hashes(hashes: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of ``length`` hashes, by halves."""
    if length == 1:
        return hashes
    if len(hashes) < length:
        return hashes[:0]
    half = length // 2
    part = window_hashes(hashes, half, salt)
    out = combined(part[: len(part) - half], part[half:], salt)
    if length % 2:
        out = combined(out[: len(out) - 1], hashes[2 * half :], salt)
    return out


def joined(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column without nulls, and where each text begins (one more at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    large = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, starts, data = column.buffers()
    at = np.frombuffer(starts, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def blocks(at: np.ndarray, size: int = BLOCK):
    """Ranges (a, b) of texts with about ``size`` bytes each."""
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


@dataclass
class Words:
    """Words of many texts in order: hash, first and last byte + 1 in the joined bytes, and number of the text."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray

    def whole(self, length: int) -> np.ndarray:
        """For each word, whether ``length`` words of its text begin there."""
        ok = np.zeros(len(self.text), bool)
        n = len(ok) - length + 1
        if n > 0:
            ok[:n] = self.text[:n] == self.text[length - 1 :]
        return ok


def words_of(data: np.ndarray, at: np.ndarray, fold: bool = False) -> Words:
    """Words of the joined texts; with ``fold``, A-Z hash as a-z."""
    values = FOLDED_VALUES if fold else BYTE_VALUES
    parts = []
    for a, b in blocks(at):
        raw, bounds = data[at[a] : at[b]], at[a : b + 1] - at[a]
        if not len(raw):
            continue
        inside = ~SPACES[raw]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = bounds[(bounds > 0) & (bounds < len(raw))]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(values[raw] * up[: len(raw)], out=sums[1:])
        hashes = mixed((sums[end] - sums[start]) * down[start])
        for k in np.flatnonzero(end - start > LONG).tolist():
            word = raw[start[k] : end[k]].tobytes()
            hashes[k] = int.from_bytes(hashlib.blake2b(word.lower() if fold else word, digest_size=8).digest(), "little")
        text = np.searchsorted(bounds, start, "right") - 1 + a
        parts.append((hashes, start + at[a], end + at[a], text))
    if not parts:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, none)
    return Words(*(np.concatenate(x) for x in zip(*parts)))
