"""Exact deduplication by content-defined chunk recipes, in DataFrame operations alone.

A text is cut at places that its content defines (characters that come back after a few others, in any script), so
that equal stretches give equal chunks wherever they stand. The chunk table has one row for each distinct
64-bit identifier, with the least and greatest SHA-256 of the chunks that it stands for: where these are one, the
identifier is verified; chunks of the others are named by their SHA-256. Two texts are equal when their ordered
lists of identifiers are, and they are grouped by these alone; the SHA-256 of the whole texts is only held
against each group as proof. Only recipes move between executors (about 5 % of the text), never the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.scratch import cut

#: Runs of white space that are not one plain space already.
ODD_SPACE = r"\x20*+[\x09-\x0D][\x20\x09-\x0D]*+|\x20{2,}+"
def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), ODD_SPACE, " ")


#: Two characters that both come back, in their order, within a few others.
MARK = r"(\S)(\S).{1,3}\1.{1,3}\2"


def chunk_pattern(least: int = 256, most: int = 4096, mark: str = MARK) -> str:
    """least to most characters, up to the first place where mark matches; the rest of the text as the last chunk.

    Marks are some 50 to 1000 characters apart in the scripts of letters and of words, whatever the alphabet, so that
    cuts fall in step again soon after a difference. Texts without it are cut by length, which is as right for equality."""
    return rf"(?s).{{{least},{most}}}?{mark}|.{{1,{most}}}"


def recipes(docs: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    """rid, doc_id, text_sha256, chunks: the ordered (identifier, digest) pairs of each text. rid names the row."""
    chunk = F.regexp_extract_all("norm", F.lit(pattern), F.lit(0))
    return docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm")).select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        F.sha2("norm", 256).alias("text_sha256"),
        F.transform(chunk, lambda c: F.struct(F.xxhash64(c).alias("h"), F.unhex(F.sha2(c, 256)).alias("d"))).alias("chunks"),
    )


def chunk_table(found: DataFrame) -> DataFrame:
    """h, lo, hi, times: one row for each distinct identifier; it is verified where lo = hi."""
    each = found.select(F.explode("chunks").alias("c")).select("c.h", "c.d")
    return each.groupBy("h").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count(F.lit(1)).alias("times"))


def listed(found: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, text_sha256 and recipe, the ordered verified identifiers of each text.

    Recipes with an unverified identifier have the chunk's SHA-256 in its place; as identifiers of 64 bits hardly ever
    collide, the join that finds them is left out where there are none."""
    doubtful = table.where("lo <> hi").select(F.col("h").alias("bad"))
    if doubtful.isEmpty():
        return found.select("doc_id", "text_sha256", F.transform("chunks", lambda c: c.h).alias("recipe"))
    places = found.select("rid", F.explode("chunks.h").alias("h")).join(doubtful, F.col("h") == F.col("bad"))
    told = places.groupBy(F.col("rid").alias("r")).agg(F.collect_set("bad").alias("bad"))
    ident = lambda c: F.when(F.array_contains("bad", c.h), c.d).otherwise(F.to_binary(F.hex(c.h), F.lit("hex")))
    return found.join(told, F.col("rid") == F.col("r"), "left").withColumn("bad", F.coalesce("bad", F.array().cast("array<bigint>"))).select("doc_id", "text_sha256", F.transform("chunks", ident).alias("recipe"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when identical after each run of ASCII white space became one space; of equal texts
    the smallest id stays. Null text is the empty text, so null and empty texts are one group. Of repeated
    rows with the smallest id all are kept (they are one document). A null id is never the smallest,
    unless the group has no other; then keep_id is null and kept is true. An empty table gives no rows.
    Columns of docs other than the two named do not matter, whatever their names. Very long texts are cut
    as any other. A group whose texts differ in SHA-256 would raise an error.
    """
    found = cut(recipes(docs, id_col, text_col, pattern or chunk_pattern()), "recipes")
    rows = listed(found, cut(chunk_table(found), "chunks"))
    proven = F.when(F.min("text_sha256") == F.max("text_sha256"), F.min("doc_id")).otherwise(F.raise_error(F.lit("texts of one recipe differ")))
    groups = rows.groupBy("recipe").agg(proven.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    several = cut(groups.where("group_size > 1"), "copies")  # a table: both sides of the join are then exchanges, which AQE can split
    joined = rows.alias("l").join(several.alias("s"), on="recipe", how="left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
        F.size("recipe").alias("n_chunks"),
    )
