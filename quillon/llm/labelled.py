"""Bounded, deterministic samples of labelled rows, and per-document scoring in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.scratch import cut

#: Bytes of features of a sample that come to the driver at most; labelled rows beyond, in the order of their hashes, are not learned from.
SAMPLE_BYTES = 128 << 20


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))


def labelled_rows(labels: DataFrame, id_col: str, label_col: str, keep: Column) -> DataFrame:
    """doc_id and y of the labelled ids that keep allows.

    Null ids and labels are left out; an id with several labels counts once, with the largest."""
    rows = labels.where(keep & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    return rows.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("y"))


def class_sizes(labels: DataFrame, id_col: str, label_col: str, keep: Column) -> tuple[int, int]:
    """How many labelled ids there are of class 0 and of class 1."""
    found = {r.y: r.n for r in labelled_rows(labels, id_col, label_col, keep).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    return found.get(0, 0), found.get(1, 0)


def prior_shift(sizes: tuple[int, int], rows: list[tuple[int, np.ndarray, np.ndarray]]) -> float:
    """What the intercept of a model learned from rows lacks in log odds, so that scores follow the whole table's classes, not the sample's."""
    ones = sum(y for y, _, _ in rows)
    if not min(*sizes, ones, len(rows) - ones):
        return 0.0
    return float(np.log(sizes[1] / sizes[0]) - np.log(ones / (len(rows) - ones)))


def sample_ids(labels: DataFrame, id_col: str, label_col: str, keep: Column, per_class: int) -> DataFrame:
    """Of each class (0 and 1) the per_class labelled ids with the smallest hashes: at most 2 * per_class rows."""
    rows = labelled_rows(labels, id_col, label_col, keep)
    part = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return part[0].unionByName(part[1])


def features_of(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, encode: Callable[[str], tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, feature indices, feature weights) of the chosen documents, in the order of their ids' hashes.

    chosen has a fixed largest size, so it is broadcast, and features of at most SAMPLE_BYTES come to the driver.
    Of an id with several texts the one with the smallest hash counts."""
    each = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    some = each.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "y", "t.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                pairs = [encode(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("y"), pa.array([i.astype(np.int32).tobytes() for i, _ in pairs], pa.binary()), pa.array([w.astype(np.float32).tobytes() for _, w in pairs], pa.binary())],
                    names=["doc_id", "y", "idx", "val"],
                )

    kind = some.schema["doc_id"].dataType.simpleString()
    rows = cut(some.mapInArrow(run, f"doc_id {kind}, y int, idx binary, val binary").withColumn("o", F.xxhash64("doc_id")).select("o", "y", "idx", "val"), "features")
    sizes = sorted(map(tuple, rows.select("o", "y", (F.length("idx") + F.length("val")).alias("n")).collect()))
    within = sum(np.cumsum([n for _, _, n in sizes]) <= SAMPLE_BYTES)
    last = sizes[within - 1][0] if within else None
    got = rows.where(F.col("o") <= F.lit(last)).toArrow() if within < len(sizes) else rows.toArrow()
    told = sorted(zip(got.column("o").to_pylist(), got.column("y").to_pylist(), got.column("idx").to_pylist(), got.column("val").to_pylist()))
    return [(y, np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for _, y, i, v in told]


def score_of(text: Column, score: Callable[[str], float]) -> Column:
    """The score of a text column; score is pickled with what it closes over, so that must be bounded."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([score(t or "") for t in texts], dtype="float64")

    return run(text)


def scored(docs: DataFrame, id_col: str, text_col: str, score: Callable[[str], float]) -> DataFrame:
    """doc_id and score of every row of docs."""
    return docs.select(F.col(id_col).alias("doc_id"), score_of(F.col(text_col), score).alias("score"))
