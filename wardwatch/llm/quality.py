"""Text quality from compressed sizes under two dictionaries.

A zstandard dictionary is built from good labelled texts and one from bad ones. A text like the good ones gets smaller
with the first, one like the bad ones with the second. The difference of the two sizes, over their sum and over the
length of the text, with how far the text shrinks at all, is turned into a probability by a logistic curve that is
fitted on labelled texts that are in neither dictionary and weighted to the classes of all labels.
"""

from __future__ import annotations

import pickle

import numpy as np
import zstandard
from pyspark.sql import DataFrame, functions as F

from wardwatch.llm.labelled import remainder, sample
from wardwatch.llm.tables import texts

MODULUS, HELD_OUT, THRESHOLD = 4, 2, 0.7
#: The bound of the training sample: rows of each class, and bytes of a row.
PER_CLASS = 4000
MAX_BYTES = 60_000
DICTIONARY_BYTES = 1 << 16
LEVEL = 3
PIECE = 2000


def _compressor(dictionary: bytes | None) -> zstandard.ZstdCompressor:
    more = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False, **more)


def build_dictionary(texts_: list[str]) -> bytes | None:
    """A dictionary from pieces of the texts; None where there is too little text for one."""
    raw = [t.encode() for t in texts_]
    pieces = [x[i : i + PIECE] for x in raw for i in range(0, len(x), PIECE)]
    pieces = [p for p in pieces if len(p) >= 8]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):
        content = b"".join(pieces)[-DICTIONARY_BYTES:]
        return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT).as_bytes() if len(content) >= 8 else None


class Model:
    def __init__(self, good: list[str], bad: list[str], good_share: float):
        """Every second text goes into the dictionaries, the others fit the curve."""
        self.good, self.bad = build_dictionary(good[::2]), build_dictionary(bad[::2])
        kept = good[1::2] + bad[1::2]
        label = np.array([1.0] * len(good[1::2]) + [0.0] * len(bad[1::2]))
        self.center, self.scale = 0.0, 1.0
        self.weights = np.zeros(1)
        if 0 < label.sum() < len(label):
            raw = self._sizes(kept)
            self.center, self.scale = raw.mean(axis=0), raw.std(axis=0) + 1e-6
            weight = np.where(label == 1, good_share / label.mean(), (1 - good_share) / (1 - label.mean()))
            self._fit(self._features(raw), label, weight)
        else:
            odds = min(max(good_share, 0.01), 0.99)
            self.weights = np.array([np.log(odds / (1 - odds))])

    def _sizes(self, texts_: list[str]) -> np.ndarray:
        good, bad = _compressor(self.good), _compressor(self.bad)
        rows = []
        for text in texts_:
            raw = text.encode()
            n, a, b = len(raw) + 20, len(good.compress(raw)), len(bad.compress(raw))
            rows.append(((b - a) / (a + b), (b - a) / n, a / n, np.log(min(a, b) / n), np.log(n)))
        return np.array(rows)

    def _features(self, raw: np.ndarray) -> np.ndarray:
        z = np.clip((raw - self.center) / self.scale, -6, 6)
        pairs = [z[:, i] * z[:, j] for i in range(z.shape[1]) for j in range(i, z.shape[1])]
        return np.stack([np.ones(len(z)), *z.T, *pairs], axis=1)

    def _fit(self, x: np.ndarray, label: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> None:
        """Newton steps, each shortened until the penalised loss falls."""
        w = np.zeros(x.shape[1])
        penalty = np.full(x.shape[1], ridge)
        penalty[0] = 0.0

        def loss(w):
            s = x @ w
            return float(np.sum(weight * (np.logaddexp(0, s) - label * s)) + 0.5 * np.sum(penalty * w * w))

        now = loss(w)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            slope = x.T @ (weight * (p - label)) + penalty * w
            curve = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty + 1e-6)
            step, size = np.linalg.solve(curve, slope), 1.0
            while size > 1e-4 and loss(w - size * step) > now:
                size /= 2
            w = w - size * step
            before, now = now, loss(w)
            if before - now < 1e-7 * (1 + abs(now)):
                break
        self.weights = w

    def scores(self, texts_: list[str]) -> np.ndarray:
        if not texts_:
            return np.zeros(0)
        if len(self.weights) == 1:
            s = np.full(len(texts_), self.weights[0])
        else:
            s = self._features(self._sizes(texts_)) @ self.weights
        return 1 / (1 + np.exp(-np.clip(s, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Model:
    """The model of a bounded sample of labelled rows, see ``labelled.sample``."""
    found, label, counts = sample(docs, labels, "quality", MODULUS, HELD_OUT, {0: per_class, 1: per_class}, max_bytes)
    good = [t for t, y in zip(found, label) if y == 1]
    bad = [t for t, y in zip(found, label) if y == 0]
    return Model(good, bad, (counts.get(1, 0) + 1) / (sum(counts.values()) + 2))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of the documents with held_out, score and predicted; columns of these names are replaced.

    The whole text is compressed. Null and empty texts are scored like any other text, by their sizes. Without labels
    of both classes every score is the share of good labels. Rows stay as they are; no shuffle.
    """
    docs = docs.drop("held_out", "score", "predicted")
    packed = pickle.dumps(model)

    @F.pandas_udf("double")
    def score(text):
        return text.__class__(pickle.loads(packed).scores([t or "" for t in text]))

    return docs.withColumn("held_out", remainder(MODULUS) == HELD_OUT).withColumn("score", score(F.coalesce(F.col("text").cast("string"), F.lit("")))).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by a model fitted on the labels."""
    model = fit(docs, labels)
    return scored(texts(docs), model).select("doc_id", "held_out", "score", "predicted")
