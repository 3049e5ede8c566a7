"""Small tables that hold the odd cases."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("quillon.llm.queries")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the quiet river bank at dawn"


def docs(spark, texts, ids=None):
    """A documents table of texts."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def odd(spark):
    """Null, empty, blank, long, repeated and id-less rows, and extra columns with names that operators use."""
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "Hello"), (4, "Hello"), (5, "x" * 300_000), (6, long), (None, "no id here at all"), (None, None), (7, "emoji 😀 ünïcödé 日本語 \x00 end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(0).cast("long"))
    for name in ("score", "node", "h", "chunks", "keep_id", "nid", "words", "y", "item_id", "ids", "th", "kept", "label", "sig"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
