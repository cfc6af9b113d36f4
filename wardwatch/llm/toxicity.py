"""Toxicity by a small convolutional network over hashed word embeddings, trained in numpy.

A word (letters and bytes above ASCII; A-Z as a-z) is hashed to a row of the embedding table, and so is its stem, the first
``STEM`` bytes of a longer word; the two rows are added. Filters of one, two and three words
slide over the text, the largest response of each filter is taken, and a linear layer turns these into a logit. Rows
of words that no training text has stay zero, so unknown words do not respond.

The logit is shifted by a threshold of the language, which is guessed from function words in the text, so that 0.5 is
the best cut for each language on texts kept out of the training.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardwatch.llm import hashing
from wardwatch.llm.labelled import remainder, sample
from wardwatch.llm.tables import texts

MODULUS, HELD_OUT, THRESHOLD = 5, 0, 0.5
#: The bound of the training sample: rows of each class, and bytes of a row.
PER_CLASS = {1: 3000, 0: 6000}
MAX_BYTES = 60_000
BITS = 18
STEM = 7
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 16
EPOCHS = 5
BATCH = 32
# Frequent function words.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are with as be by this",
    "de": "der die das und ist in zu den von mit sich des auf für nicht ein eine",
    "fr": "le la les de des et du un une est que qui dans pour pas sur au",
    "es": "el la los las de del y que en un una es por con para se no",
}
LANGUAGES = (*FUNCTION_WORDS, "")

_LETTERS = np.full(256, 32, np.uint8)
for _b in (*range(ord("a"), ord("z") + 1), *range(128, 256)):
    _LETTERS[_b] = _b
for _b in range(ord("A"), ord("Z") + 1):
    _LETTERS[_b] = _b + 32


def word_rows(data: np.ndarray, at: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding rows of each word and its stem (the row after all others: none), edges of the texts, and their languages."""
    folded = _LETTERS[data]
    words = hashing.words_of(folded, at)
    edges = np.searchsorted(words.text, np.arange(len(at)))
    counts = np.zeros((len(at) - 1, len(LANGUAGES)), np.int64)
    counts[:, -1] = 1
    for k, known in enumerate(_function_hashes()):
        counts[:, k] = np.diff(np.concatenate([[0], np.cumsum(np.isin(words.hashes, known))])[edges]) * 2
    head = np.ndarray((len(folded),), "<u8", folded.tobytes() + bytes(8), strides=(1,))[words.start] & np.uint64((1 << 8 * STEM) - 1)
    stem = (hashing.mixed(head + np.uint64(1)) >> np.uint64(64 - bits)).astype(np.int64)
    rows = np.stack([(words.hashes >> np.uint64(64 - bits)).astype(np.int64), np.where(words.end - words.start > STEM, stem, 1 << bits)], axis=1)
    return rows.astype(np.int32), edges, counts.argmax(axis=1)


def _function_hashes() -> list[np.ndarray]:
    found = []
    for listed in FUNCTION_WORDS.values():
        raw = np.frombuffer(listed.encode(), np.uint8)
        found.append(hashing.words_of(raw, np.array([0, len(raw)])).hashes)
    return found


def _joined(texts_: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return hashing.joined(pa.array(texts_, pa.string()))


class Network:
    def __init__(self, bits: int = BITS, seed: int = 7):
        r = np.random.default_rng(seed)
        self.bits = bits
        self.table = np.zeros(((1 << bits) + 1, DIM), np.float32)
        self.kernels = [r.normal(0, 0.3, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        for kernel in self.kernels:
            # Filters begin by looking at the first two coordinates, which begin as evidence for and against.
            kernel[:, 0, :] = np.abs(kernel[:, 0, :]) + 0.3
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = r.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32) + np.float32(0.1)
        self.shift = np.float32(-1.0)
        self.cuts = np.zeros(len(LANGUAGES), np.float32)

    def pooled(self, rows: np.ndarray, edges: np.ndarray, places: bool = False):
        """Largest response (0 at least) of each filter in each text, and with ``places`` where it is (-1: nowhere)."""
        n = len(edges) - 1
        x = self.table[rows[:, 0]] + self.table[rows[:, 1]]
        size = np.diff(edges)
        every, where = np.zeros((n, len(WIDTHS) * FILTERS), np.float32), []
        for c, (k, kernel, bias) in enumerate(zip(WIDTHS, self.kernels, self.bias)):
            at = np.full((n, FILTERS), -1, np.int64)
            m = len(rows) - k + 1
            if m > 0:
                z = x[:m] @ kernel[0]
                for j in range(1, k):
                    z += x[j : j + m] @ kernel[j]
                z += bias
                fits = np.flatnonzero(size >= k)
                if len(fits):
                    # A text's windows begin at its words but the last k - 1; runs between texts are left out.
                    cut = np.stack([edges[fits], edges[fits] + size[fits] - k + 1], 1).ravel()
                    cut_in = cut[:-1] if cut[-1] >= m else cut
                    best = np.maximum.reduceat(z, cut_in, axis=0)[::2]
                    every[fits, c * FILTERS : (c + 1) * FILTERS] = np.maximum(best, 0)
                    if places:
                        for t, top in zip(fits, best):
                            a, b = edges[t], edges[t] + size[t] - k + 1
                            at[t] = np.where(top > 0, z[a:b].argmax(axis=0) + a, -1)
            where.append(at)
        return (every, np.concatenate(where, axis=1)) if places else every

    def logits(self, rows: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Logit of each text; about 100,000 words at a time, so memory does not grow with the number of texts."""
        found = []
        for a, b in hashing.blocks(edges, 100_000):
            found.append(self.pooled(rows[edges[a] : edges[b]], edges[a : b + 1] - edges[a]) @ self.out + self.shift)
        return np.concatenate(found) if found else np.zeros(0, np.float32)

    def begin(self, rows: np.ndarray, edges: np.ndarray, label: np.ndarray) -> None:
        """The first coordinate of a word begins as the log odds of the texts that have it; the others at random."""
        size = (1 << self.bits) + 1
        good, bad = np.zeros(size, np.int32), np.zeros(size, np.int32)
        for k in range(len(edges) - 1):
            (bad if label[k] == 1 else good)[np.unique(rows[edges[k] : edges[k + 1]])] += 1
        bad[-1] = good[-1] = 0
        total_bad, total_good = max(1, (label == 1).sum()), max(1, (label == 0).sum())
        odds = np.log((bad + 0.5) / (total_bad + 1)) - np.log((good + 0.5) / (total_good + 1))
        seen = bad + good
        self.table[:, 0] = np.where(seen > 1, np.clip(odds * np.minimum(1, seen / 4), -2, 4) / 2, 0)
        self.table[:, 1:] = np.where((seen > 1)[:, None], np.random.default_rng(11).normal(0, 0.05, (size, DIM - 1)), 0)

    def train(self, rows: np.ndarray, edges: np.ndarray, label: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        n = len(edges) - 1
        dense = [*self.kernels, *self.bias, self.out]
        squares = [np.full_like(p, 1e-3) for p in dense]
        shift_square = 1e-3
        table_squares = np.full(len(self.table), 1e-3, np.float32)
        known = np.any(self.table != 0, axis=1)
        for epoch in range(epochs):
            rate = 0.05 / (1 + epoch)
            order = r.permutation(n)
            for k in range(0, n, BATCH):
                some = order[k : k + BATCH]
                part = np.concatenate([rows[edges[t] : edges[t + 1]] for t in some])
                bounds = np.concatenate([[0], np.cumsum([edges[t + 1] - edges[t] for t in some])])
                features, where = self.pooled(part, bounds, places=True)
                p = 1 / (1 + np.exp(-np.clip(features @ self.out + self.shift, -30, 30)))
                error = ((p - label[some]) * weight[some] / len(some)).astype(np.float32)
                slopes = [np.zeros_like(x) for x in dense]
                slopes[-1] = features.T @ error + 1e-4 * self.out
                back = error[:, None] * self.out[None, :]
                touched, moved = [], []
                for c, width in enumerate(WIDTHS):
                    span = slice(c * FILTERS, (c + 1) * FILTERS)
                    text, f = np.nonzero(where[:, span] >= 0)
                    at, g = where[:, span][text, f], back[:, span][text, f]
                    np.add.at(slopes[len(WIDTHS) + c], f, g)
                    for j in range(width):
                        both, pull = part[at + j], g[:, None] * self.kernels[c][j].T[f]
                        np.add.at(slopes[c][j].T, f, g[:, None] * (self.table[both[:, 0]] + self.table[both[:, 1]]))
                        touched += [both[:, 0], both[:, 1]]
                        moved += [pull, pull]
                for x, s, q in zip(dense, slopes, squares):
                    q += s * s
                    x -= rate * s / np.sqrt(q)
                s = float(error.sum())
                shift_square += s * s
                self.shift -= np.float32(rate * s / np.sqrt(shift_square))
                row, moved = np.concatenate(touched), np.concatenate(moved)
                row, inverse = np.unique(row, return_inverse=True)
                total = np.zeros((len(row), DIM), np.float32)
                np.add.at(total, inverse, moved)
                total[~known[row]] = 0
                table_squares[row] += (total * total).mean(axis=1)
                self.table[row] -= rate * total / np.sqrt(table_squares[row])[:, None]

    def calibrate(self, logits: np.ndarray, language: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        """The cut of least weighted errors for each language; with few texts of a language, that of all texts."""

        def best(chosen: np.ndarray) -> float:
            order = np.argsort(logits[chosen])
            s, y, w = logits[chosen][order], label[chosen][order], weight[chosen][order]
            # Errors with the cut below position k: toxic texts before k, clean ones from k on.
            errors = np.concatenate([[0], np.cumsum(w * y)]) + np.concatenate([np.cumsum((w * (1 - y))[::-1])[::-1], [0]])
            low = np.flatnonzero(errors <= errors.min() + 1e-9)
            k = low[len(low) // 2]
            return float((s[max(k - 1, 0)] + s[min(k, len(s) - 1)]) / 2)

        if len(logits):
            everything = best(np.ones(len(logits), bool)) if 0 < label.sum() < len(label) else 0.0
            self.cuts[:] = everything
            for k in range(len(LANGUAGES)):
                chosen = language == k
                if label[chosen].sum() >= 20 and (1 - label[chosen]).sum() >= 20:
                    self.cuts[k] = best(chosen)

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        found = []
        for a, b in hashing.blocks(at, 1 << 19):
            rows, edges, language = word_rows(data[at[a] : at[b]], at[a : b + 1] - at[a], self.bits)
            found.append(self.logits(rows, edges) - self.cuts[language])
        s = np.concatenate(found) if found else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(s.astype(np.float64), -30, 30)))


def train(texts_: list[str], label: list[int], toxic_share: float, bits: int = BITS) -> Network:
    """A network of the texts; every fifth is kept out of the training to set the thresholds."""
    net = Network(bits)
    y = np.array(label, np.float64)
    if not 0 < y.sum() < len(y):
        odds = min(max(toxic_share, 1e-3), 1 - 1e-3)
        net.out[:], net.shift = 0, np.float32(np.log(odds / (1 - odds)))
        return net
    found = [word_rows(*_joined(texts_[k : k + 200]), bits) for k in range(0, len(texts_), 200)]
    rows, language = np.concatenate([x[0] for x in found]), np.concatenate([x[2] for x in found])
    edges = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[1]) for x in found]))])
    apart = np.zeros(len(y), bool)
    apart[::5] = True
    used = np.flatnonzero(~apart)
    part = np.concatenate([rows[edges[t] : edges[t + 1]] for t in used])
    bounds = np.concatenate([[0], np.cumsum(np.diff(edges)[used])])
    share = np.where(y == 1, toxic_share / y.mean(), (1 - toxic_share) / (1 - y.mean()))
    net.begin(part, bounds, y[used])
    net.train(part, bounds, y[used], np.sqrt(share[used]))
    logits = net.logits(rows, edges)
    tuned = apart if y[apart].sum() >= 20 else np.ones(len(y), bool)
    net.calibrate(logits[tuned], language[tuned], y[tuned], share[tuned])
    return net


def fit(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] | None = None, max_bytes: int = MAX_BYTES) -> Network:
    """The network of a bounded sample of labelled rows, see ``labelled.sample``."""
    found, label, counts = sample(docs, labels, "toxic", MODULUS, HELD_OUT, per_class or PER_CLASS, max_bytes)
    return train(found, label, (counts.get(1, 0) + 1) / (sum(counts.values()) + 2))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    The whole text is read. Null and empty texts have no words and get the score of no evidence. Without labels of both
    classes every score is the share of toxic labels. Rows stay as they are; the scoring has no shuffle.
    """
    spark = docs.sparkSession
    net = spark.sparkContext.broadcast(fit(docs, labels))  # 2**BITS rows of DIM floats: 8 MB, whatever the input

    def run(batches):
        for batch in batches:
            scores = net.value.scores(*hashing.joined(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores)], names=["doc_id", "held_out", "score"])

    with_fold = texts(docs).withColumn("held_out", remainder(MODULUS) == HELD_OUT)
    out = with_fold.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
