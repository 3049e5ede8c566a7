"""Quality: supervised subword embeddings, averaged per document, with a softmax output.

A document's features are its words, pairs of neighbouring words and character n-grams (within a word and
the space on either side), hashed into 2**bits vectors. Training is plain stochastic gradient descent in
numpy over a bounded labelled sample. For scoring, a vector matters only through its product with the
output layer, so the model that goes to the executors is one float for each bucket: 4 * 2**bits bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.labelled import class_sizes, features_of, fold, prior_shift, sample_ids, scored
from quillon.llm.textcode import _SPACE, Coded, mix, pieces

#: The feature of a word that follows itself, whichever it is: words that are repeated are a trait of their own, which hashed pairs alone cannot pass on to words never seen.
TWICE = np.uint64(0x9D39247E33776D41)
_TO_SPACE = bytes(32 if _SPACE[i] else i for i in range(256))


@dataclass(frozen=True)
class Settings:
    bits: int = 16
    grams: tuple[int, ...] = (2, 3, 4)
    dim: int = 8
    rate: float = 1.0
    epochs: int = 12
    repeats: bool = True  # all pairs of a word and itself are one feature
    per_class: int = 2000  # bound of the labelled sample, for each of the two classes


def hashed(text: str, s: Settings) -> np.ndarray:
    """The buckets of all features of text, with repeats."""
    out = []
    for p in pieces(b" " + text.encode("utf-8", "replace").translate(_TO_SPACE) + b" "):
        c = Coded(p, space_only=True)
        w = c.words()
        out.append(w)
        with np.errstate(over="ignore"):
            pair = mix(w[:-1] * np.uint64(3) + mix(w[1:], 9), 8)
        out.append(np.where(w[:-1] == w[1:], TWICE, pair) if s.repeats else pair)
        blank = np.concatenate(([0], np.cumsum(c.bytes == 32)))
        for n in s.grams:
            if len(p) >= n:
                at = np.arange(len(p) - n + 1)
                inner = at[blank[at + n - 1] == blank[at + 1]] if n > 2 else at[c.bytes[at] + c.bytes[at + 1] != 64]
                out.append(mix(c.between(inner, inner + n), n))
    return (np.concatenate(out) >> np.uint64(64 - s.bits)).astype(np.int64)


def encode(s: Settings):
    def run(text: str) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(hashed(text, s), return_counts=True)

    return run


def sgd(rows: list[tuple[int, np.ndarray, np.ndarray]], s: Settings) -> tuple[np.ndarray, float]:
    """For each bucket its part in the log odds of class 1, and the intercept."""
    rng = np.random.default_rng(11)
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (1 << s.bits, s.dim)).astype(np.float32)
    output, bias = np.zeros((s.dim, 2), np.float32), np.zeros(2, np.float32)
    steps, done = s.epochs * len(rows), 0
    for _ in range(s.epochs):
        for k in rng.permutation(len(rows)):
            y, places, counts = rows[k]
            share = counts / max(counts.sum(), 1)
            hidden = share @ vectors[places] if len(places) else np.zeros(s.dim, np.float32)
            z = hidden @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            rate = s.rate * (1 - done / steps)
            back = output @ p
            output -= rate * np.outer(hidden, p)
            bias -= rate * 0.1 * p
            if len(places):
                vectors[places] -= rate * share[:, None] * back * 32
            done += 1
    return (vectors @ (output[:, 1] - output[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def scorer(model: tuple[np.ndarray, float], s: Settings):
    parts, bias = model

    def run(text: str) -> float:
        h = hashed(text, s)
        z = parts[h].sum(dtype=np.float64) / max(len(h), 1) + bias
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))

    return run


def fit(docs: DataFrame, labels: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", settings: Settings = Settings()) -> tuple[np.ndarray, float]:
    """A model from at most settings.per_class labelled rows of each class among those that keep allows.

    Its intercept follows the classes of all of them, so that scores mean the same whatever share the sample is."""
    rows = features_of(docs, sample_ids(labels, id_col, label_col, keep, settings.per_class), id_col, text_col, encode(settings))
    parts, bias = sgd(rows, settings)
    return parts, bias + prior_shift(class_sizes(labels, id_col, label_col, keep), rows)


def quality(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, settings: Settings = Settings()) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= threshold) for each row of docs.

    Null and empty texts have no features but two spaces and get about the intercept's score. Repeated
    rows are scored each. Without labelled rows every score is 0.5. Columns not named do not matter; an
    empty table gives no rows."""
    return scored(docs, id_col, text_col, scorer(model, settings)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(folds: int = 5, id_col: str = "doc_id") -> Column:
    return fold(id_col, folds) == 0
