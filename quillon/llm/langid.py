"""Language identification by compression: the language whose dictionary packs a text smallest.

Each learned language has one raw-content zstandard dictionary, a bounded sample of its labelled texts in
lower case. A text is compressed in blocks, each with every dictionary, and the sizes are summed over the whole text:
the differences between languages add up instead of fading as a compressor adapts to a long text. Where
the smallest size leads by less than a margin, the decision is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.labelled import fold

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    buckets: int = 20  # bound of the sample: so many passages for each language
    passage: int = 500  # characters of a passage at most, taken at a place that the id's hash gives
    block: int = 2048  # bytes that are compressed at a time
    margin: float = 0.01  # a lead under this share of the smallest size is rejected
    least: int = 2  # or one of fewer bytes


def fit(docs: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> dict[str, bytes]:
    """A dictionary for each language among the rows that keep allows, the most frequent first.

    One pass: ids are hashed into buckets, and each bucket of a language gives the passage with the smallest
    hash. Partial aggregation leaves at most buckets passages a language and task, however skewed languages are.
    Every language is learned; each takes some 10 KB, here and on the executors. Ties of frequency go by name."""
    s = settings
    key = F.xxhash64(F.col(id_col), F.length(text_col))
    start = F.pmod(key, F.greatest(F.length(text_col) - s.passage, F.lit(0)) + 1) + 1
    some = docs.where(keep & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    each = some.select(F.col(lang_col).cast("string").alias("lang"), F.pmod(F.xxhash64(key), F.lit(s.buckets)).alias("bucket"), key.alias("key"), F.col(text_col).substr(start.cast("int"), F.lit(s.passage)).alias("passage"))
    picked = each.groupBy("lang", "bucket").agg(F.min(F.struct("key", "passage")).alias("p"), F.count(F.lit(1)).alias("n"))
    per_lang = picked.groupBy("lang").agg(F.sort_array(F.collect_list("p")).alias("ps"), F.sum("n").alias("n"))
    rows = per_lang.orderBy(F.desc("n"), "lang").collect()
    return {r.lang: letters("\n".join(p.passage for p in r.ps)) for r in rows}


_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def letters(text: str) -> bytes:
    """The text in lower case, with one space for each run of anything but letters and the marks that combine with them."""
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "replace")


def parameters() -> zstandard.ZstdCompressionParameters:
    """Short offsets and lazy matching: a small dictionary whose matches of 4 bytes and more are all found.

    Sizes must differ by what the dictionaries hold, so frames have no size field and no checksum."""
    return zstandard.ZstdCompressionParameters(window_log=17, chain_log=16, hash_log=16, search_log=4, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False)


class Packer:
    """Sizes of texts under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], s: Settings):
        self.langs, self.s, self.packers = [*dictionaries], s, []
        for raw in dictionaries.values():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=parameters())
            self.packers.append(zstandard.ZstdCompressor(compression_params=parameters(), dict_data=d))

    def sizes(self, text: str) -> np.ndarray:
        data = letters(text)
        blocks = [data[i : i + self.s.block] for i in range(0, len(data), self.s.block)]
        return np.array([sum(len(p.compress(b)) for b in blocks) for p in self.packers])

    def decide(self, text: str | None) -> tuple[str, float, bool, int]:
        """Language, its share of the likelihood that the sizes imply, whether rejected, and the lead in bytes."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True, 0
        sizes = self.sizes(text)
        best = int(sizes.argmin())  # of equal sizes the most frequent language
        lead = int(np.partition(sizes, 1)[1] - sizes[best]) if len(sizes) > 1 else int(sizes[best])
        share = float(1 / np.exp2(-np.minimum(sizes - sizes[best], 60.0)).sum())
        return self.langs[best], share, lead < self.s.least or lead < self.s.margin * int(sizes[best]), lead


def language_id(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc_id, lang_pred, score, rejected and lead for each row of docs.

    lang_pred is always a learned language, unless the text is null or has no letter, or nothing was learned:
    then it is `und` with score 0. Equal sizes go to the language with the most learned rows (then the first by
    name) and are rejected. Repeated rows are decided each; columns not named do not matter; an empty table gives none."""
    some = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = some.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(dictionaries, settings)
        for b in batches:
            lang, score, rejected, lead = zip(*[packer.decide(t.as_py()) for t in b.column("text")]) if b.num_rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()), pa.array(lead, pa.int64())], names=["doc_id", "lang_pred", "score", "rejected", "lead"])

    return some.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean, lead long")


def held_out(folds: int = 4, id_col: str = "doc_id") -> Column:
    return fold(id_col, folds) == 2
