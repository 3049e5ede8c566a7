"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before kept, and returns those
that it keeps with the columns of `documents`; the last returns token ids. Between stages the documents are
written as Parquet and read again. Where an id is null or occurs with several texts, each text is judged for
itself; of rows with equal text (up to white space) and id one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import near_dedup, pieces, toxicity
from quillon.llm.decontaminate import contaminated
from quillon.llm.exact_dedup import exact_dedup, normalised
from quillon.llm.queries import TOKENIZERS
from quillon.llm.scratch import cut, table

#: Documents at and over this toxicity score go.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the threshold; the model learns from a bounded sample of all labelled rows.

    Where no document of either class is labelled nothing is learned, and all documents stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    if model is toxicity.NOTHING:
        return docs
    score = toxicity.score_column(F.col("text"), model)
    return docs.where(score < TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    told = exact_dedup(docs).where("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha")).distinct()
    named = docs.withColumn("own_sha", F.sha2(normalised(F.col("text")), 256))
    left = named.join(told, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("own_sha") == F.col("gone_sha")), "left_anti")
    return left.dropDuplicates(["doc_id", "own_sha"]).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (shingles of five words) the document with the smallest id."""
    gone = near_dedup.told(docs).where("NOT kept").select("doc_id", "th").distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["th"]), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "th").distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]) & (F.xxhash64(docs["text"]) == found["th"]), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of each document that is left."""
    return pieces.encode(docs, pieces.read_model(f"{TOKENIZERS}/piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: The stages score with learned models and tokenise, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
