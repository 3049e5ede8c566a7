"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are present or not (no counts): words, word stems of 4 to 6 bytes, pairs of neighbours and pairs
with one or two words between them, hashed into 2**bits places. Per-coordinate learning rates and the L1
term leave few weights that are not 0, so the model is a short list of places, which goes to the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.labelled import class_sizes, features_of, fold, prior_shift, sample_ids, score_of, scored
from quillon.llm.textcode import Coded, mix, pieces


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    stems: tuple[int, ...] = (4, 5, 6)
    skips: tuple[int, ...] = (1, 2, 3)
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.1
    epochs: int = 4
    per_class: int = 3000  # bound of the labelled sample, for each of the two classes


#: The model of no labels: every score is 0.5.
NOTHING = (np.empty(0, np.int32), np.empty(0, np.float32), 0.0)


def hashed(text: str, s: Settings) -> np.ndarray:
    """The places of all features of text, with repeats."""
    words, stems = [], []
    for p in pieces(text.lower().encode("utf-8", "replace")):
        c = Coded(p, space_only=False)
        words.append(c.words())
        for n in s.stems:
            long = c.ends - c.starts >= n
            stems.append(mix(c.between(c.starts[long], c.starts[long] + n), n))
    w = words[0] if len(words) == 1 else np.concatenate(words)
    with np.errstate(over="ignore"):
        pairs = [mix(w[:-k] * np.uint64(3) + mix(w[k:], 100 + k), k) for k in s.skips if len(w) > k]
    return (np.concatenate([w, *stems, *pairs]) >> np.uint64(64 - s.bits)).astype(np.int64)


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], s: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Places, weights (not 0) and intercept, learned from (label, distinct places, _) rows."""
    z, n = np.zeros((1 << s.bits) + 1), np.zeros((1 << s.bits) + 1)
    bias = 1 << s.bits

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - s.l1 * (i != bias), 0)
        return -shrunk / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2)

    order = np.random.default_rng(7)
    for _ in range(s.epochs):
        for k in order.permutation(len(rows)):
            y, places, _ = rows[k]
            i = np.append(places, bias)
            w = weight(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            before = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - before) / s.alpha * w
    full = weight(np.arange((1 << s.bits) + 1))
    places = np.flatnonzero(full[:bias])
    return places.astype(np.int32), full[places].astype(np.float32), float(full[bias])


def encode(s: Settings):
    def run(text: str) -> tuple[np.ndarray, np.ndarray]:
        places = np.unique(hashed(text, s))
        return places, np.empty(0)

    return run


def scorer(model: tuple[np.ndarray, np.ndarray, float], s: Settings):
    places, weights, bias = model
    table: list[np.ndarray] = []

    def run(text: str) -> float:
        if not table:
            table.append(np.zeros(1 << s.bits, np.float32))
            table[0][places] = weights
        h = hashed(text, s)
        told = np.unique(h[table[0][h] != 0])
        return float(1 / (1 + np.exp(-np.clip(table[0][told].sum(dtype=np.float64) + bias, -35, 35))))

    return run


def fit(docs: DataFrame, labels: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, float]:
    """A model from at most settings.per_class labelled rows of each class among those that keep allows.

    Its intercept follows the classes of all of them, so that scores mean the same whatever share the sample is.
    Where no document of one of the classes is labelled there is nothing to tell apart: the model is empty (NOTHING)."""
    rows = features_of(docs, sample_ids(labels, id_col, label_col, keep, settings.per_class), id_col, text_col, encode(settings))
    if len({y for y, _, _ in rows}) < 2:
        return NOTHING
    places, weights, bias = ftrl(rows, settings)
    return places, weights, bias + prior_shift(class_sizes(labels, id_col, label_col, keep), rows)


def score_column(text: Column, model: tuple[np.ndarray, np.ndarray, float], settings: Settings = Settings()) -> Column:
    """The toxicity score of a text column."""
    return score_of(text, scorer(model, settings))


def toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, settings: Settings = Settings()) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= threshold) for each row of docs.

    Null and empty texts get the intercept's score. Repeated rows are scored each. Without labelled rows
    of both classes the model is empty and every score is 0.5. Columns not named do not matter; an empty table gives no rows."""
    return scored(docs, id_col, text_col, scorer(model, settings)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(folds: int = 5, id_col: str = "doc_id") -> Column:
    return fold(id_col, folds) == 0
