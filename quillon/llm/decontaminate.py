"""Benchmark decontamination with SimHash windows, in DataFrame operations alone.

A window of a document is as many words as a benchmark item has. A window as alike as asked holds at least
similarity times as many shingles of items as the item has shingles, so windows are laid at every start where
that many stand. Each window gets a 64-bit SimHash of its shingles. Fingerprints are cut into radius + 1
blocks: two that differ in at most radius bits agree in one block whole, so an equi-join on (size, block,
value) finds every pair within the radius. What it finds is checked on the shingles themselves: the sum of
the smaller counts over the sum of the larger ones, exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.scratch import cut

WORD = r"[\p{L}\p{M}\p{N}]+"
#: Benchmarks of up to this many shingles in all are broadcast (each is held once for each block, 8 bytes a time); larger ones are joined by shuffle.
BROADCAST_SHINGLES = 500_000


def words_of(text: Column) -> Column:
    """Runs of letters, marks and digits in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def shingles_of(words: str, n: int) -> Column:
    """Hashes of all runs of n words, in order, of a column of word hashes."""
    w = F.col(words)
    return F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *(F.get(w, i + k) for k in range(1, n))))


def simhash(shingles: Column) -> Column:
    """Bit b is set where most of the hashes have it set; repeated shingles count repeatedly."""

    def bit(b: Column) -> Column:
        votes = F.aggregate(shingles, F.lit(0), lambda s, h: s + (F.call_function("shiftright", h, b).bitwiseAND(1) * 2 - 1).cast("int"))
        return F.call_function("shiftleft", F.when(votes > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"), b)

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(bit(b)))


def masks(radius: int) -> list[tuple[int, int]]:
    """First bit and width of each of radius + 1 blocks of 64 bits."""
    n = radius + 1
    at = [64 * j // n for j in range(n + 1)]
    return [(a, b - a) for a, b in zip(at[:-1], at[1:])]


def blocks_of(fp: str, radius: int) -> Column:
    """(block, value) of each block of a fingerprint."""
    return F.array(*(F.struct(F.lit(j).alias("j"), F.shiftright(fp, lo).bitwiseAND((1 << width) - 1).alias("v")) for j, (lo, width) in enumerate(masks(radius))))


def first_equal(xor: Column, radius: int) -> Column:
    """The first block in which two fingerprints agree."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return F.coalesce(*(F.when(xor.bitwiseAND(signed(((1 << width) - 1) << lo)) == 0, F.lit(j)) for j, (lo, width) in enumerate(masks(radius))))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller counts over the sum of the larger ones, of two lists of shingles."""
    times = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(times(a, x), times(b, x)))
    return both / (F.size(a) + F.size(b) - both)


def starts(at: str, k: str, similarity: float) -> Column:
    """Every start of k places that hold at least similarity * k of the places at (sorted, distinct).

    Of window and item the sum of the larger counts is at least k and that of the smaller ones at most the places, so no other window is alike."""
    need = F.greatest(F.ceil(F.col(k) * similarity - 1e-9), F.lit(1)).cast("int")
    firsts = F.slice(at, F.lit(1), F.greatest(F.size(at) - need + 1, F.lit(0)))

    def around(p: Column, i: Column) -> Column:
        last = F.get(F.col(at), i + need - 1)
        return F.when(last - p < F.col(k), F.sequence(F.greatest(last - F.col(k) + 1, F.lit(0)), p)).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.flatten(F.transform(firsts, around)))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 24) -> DataFrame:
    """doc_id, th (hash of the text), item_id, similarity, start, n_words, hamming: the best window of each item in each document that has one.

    Words are runs of letters, marks and digits, in lower case. An item of fewer words than a shingle is one
    shingle. Items without words match nothing, nor do null and empty texts. Repeated items and repeated
    rows are each reported; of equally good windows the first counts. Empty tables give no rows; columns not
    named do not matter. Documents without an item are not in the result."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.transform(words_of(F.col(item_text_col)), lambda w: F.xxhash64(w)).alias("iw")).where("size(iw) > 0")
    items = cut(items.withColumn("n", F.least(F.size("iw"), F.lit(shingle))), "items")
    held = {r.n: r.k for r in items.groupBy("n").agg(F.sum(F.size("iw")).alias("k")).collect()}  # a row for each length of a shingle
    hint = F.broadcast if sum(held.values()) <= BROADCAST_SHINGLES else (lambda df: df)
    sizes = sorted(held)
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    hashed = text.select("doc_id", "th", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    found = [_matches(hashed, items.where(F.col("n") == n), n, hint, similarity, radius) for n in sizes]
    if not found:
        kind = items.schema["item_id"].dataType
        return text.limit(0).select("doc_id", "th", F.lit(None).cast(kind).alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("start"), F.lit(0).alias("n_words"), F.lit(0).alias("hamming"))
    best = F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("back"), F.col("n_words"), (-F.col("hamming")).alias("h"))).alias("b")
    every = reduce(DataFrame.unionByName, found).groupBy("doc_id", "th", "item_id").agg(best)
    return every.select("doc_id", "th", "item_id", "b.similarity", (-F.col("b.back")).alias("start"), "b.n_words", (-F.col("b.h")).alias("hamming"))


def _matches(hashed: DataFrame, items: DataFrame, n: int, hint, similarity: float, radius: int) -> DataFrame:
    coded = items.withColumn("ish", shingles_of("iw", n)).select("item_id", "ish", F.size("ish").alias("k"))
    anchors = coded.select(F.explode("ish").alias("h"), "k").distinct()
    hits = hashed.select("doc_id", "th", F.posexplode(shingles_of("w", n)).alias("p", "h")).join(hint(anchors), "h")
    held = hits.groupBy("doc_id", "th", "k").agg(F.sort_array(F.collect_set("p")).alias("at"))
    places = held.select("doc_id", "th", F.explode(starts("at", "k", similarity)).alias("start"), "k")
    laid = cut(places.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "k")).alias("windows")), "windows")
    keyed = laid.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "windows")
    with_text = hashed.join(keyed, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
    rows = with_text.select("doc_id", "th", shingles_of("w", n).alias("sh"), "windows").select("doc_id", "th", "sh", F.explode("windows").alias("x"))
    cut_out = rows.select("doc_id", "th", F.col("x.k").alias("k"), F.col("x.start").alias("start"), F.expr("slice(sh, x.start + 1, x.k)").alias("wsh"))
    windows = cut_out.withColumn("fp", simhash(F.col("wsh"))).withColumn("z", F.explode(blocks_of("fp", radius))).select("doc_id", "th", "k", "start", "wsh", "fp", "z.j", "z.v")
    index = coded.withColumn("ifp", simhash(F.col("ish"))).withColumn("z", F.explode(blocks_of("ifp", radius))).select("item_id", "k", "ish", "ifp", "z.j", "z.v")
    xor = F.col("fp").bitwiseXOR(F.col("ifp"))
    near = windows.join(hint(index), ["k", "j", "v"]).where((F.col("j") == first_equal(xor, radius)) & (F.bit_count(xor) <= radius) & F.arrays_overlap("wsh", "ish"))
    scored = near.select("doc_id", "th", "item_id", weighted_similarity(F.col("wsh"), F.col("ish")).alias("similarity"), "start", (F.col("k") + n - 1).alias("n_words"), F.bit_count(xor).cast("int").alias("hamming"))
    return scored.where(F.col("similarity") >= similarity)
