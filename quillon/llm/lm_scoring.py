"""Language-model scoring by cross-entropy difference.

Two bigram models of one form, with one vocabulary, are counted: the target's on the texts that a rule
picks, the background's on all texts. A document's score is its mean loss per token under the target model
less that under the background model, in bits; low scores are like the target. A document that a model has
counted is scored without its own counts.

Counts cover the whole corpus and are exact: every word and every (previous, word) pair has a count of its
own, by 64-bit hash, in a table that grows with the input. Nothing but four totals goes to the driver.
Documents are gathered into chunks of about a fixed number of tokens, which are kept as packed arrays; a chunk
has each of its words and pairs once, in the order of their hashes. Ranges of the hashes are the buckets: each
chunk sends each bucket its part, the bucket sums what it gets and answers each chunk with the sums alone, in the
order asked. So a frequent word or pair is one entry a chunk, and moves as a few bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.scratch import cut
from quillon.llm.textcode import mix, word_hashes


@dataclass(frozen=True)
class Settings:
    weight: float = 0.7  # of the pair's estimate; the rest is the single word's
    add: float = 0.5  # to each word's count
    chunk: int = 1_000_000  # tokens of a chunk, from which on it takes no further document
    bucket: int = 2_000_000  # tokens of the corpus for each bucket at most; a bucket gets fewer entries than twice that from all chunks, about


def tokens(text: str | None) -> np.ndarray:
    """64-bit hashes of the words (runs of letters and digits, lower case) of a text."""
    return word_hashes((text or "").lower().encode("utf-8", "replace"), space_only=False)


def pack(a: np.ndarray) -> bytes:
    """Whole numbers as byte planes, as few as the largest needs, compressed."""
    a = np.ascontiguousarray(a).astype("<u8", copy=False)
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.reshape(-1).view("<u8")


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def word_keys(words: np.ndarray) -> np.ndarray:
    """Keys of words are even, those of pairs odd."""
    return mix(words, 31) & np.uint64(2**64 - 2)


def pair_keys(prev: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(prev, 32) * np.uint64(3) + word, 33) | np.uint64(1)


class Chunk:
    """The tokens of some documents, their words and pairs each once, and all keys in order."""

    def __init__(self, words: np.ndarray, at: np.ndarray, sizes: np.ndarray):
        """words: distinct; at: the word of each token; sizes: tokens of each document."""
        self.words, self.at, self.sizes = words, at.astype(np.int32), sizes
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        second = np.ones(len(at), bool)
        second[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
        self.second = np.flatnonzero(second).astype(np.int32)  # tokens that have one before them in their document
        pairs, pair = np.unique(pair_keys(words[at[self.second - 1]], words[at[self.second]]), return_inverse=True)
        self.pair = pair.astype(np.int32)
        keys = np.concatenate((word_keys(words), pairs))
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.place = np.empty(len(keys), np.int32)  # in keys: of each word, then of each pair
        self.place[order] = np.arange(len(keys))

    def counts(self, chosen: np.ndarray) -> np.ndarray:
        """How often each key occurs in the chosen documents."""
        w = np.bincount(self.at[chosen[self.doc]], minlength=len(self.words))
        p = np.bincount(self.pair[chosen[self.doc[self.second]]], minlength=len(self.keys) - len(self.words))
        out = np.empty(len(self.keys), np.int64)
        out[self.place] = np.concatenate((w, p))
        return out

    def own(self, kind: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """For each token, how often its kind occurs in its document."""
        if not len(kind):
            return np.zeros(0, np.int64)
        _, at, times = np.unique(doc.astype(np.int64) * (int(kind.max()) + 1) + kind, return_inverse=True, return_counts=True)
        return times.astype(np.int32)[at]

    def losses(self, sums: np.ndarray, total: int, distinct: int, counted: np.ndarray, s: Settings) -> np.ndarray:
        """Bits of each document: each token's loss is that of a mix of the pair's share of its context and the single word's; the first has no context.

        sums: count of each key in the model; counted: documents that the model has counted, whose own counts are taken out: a text is no evidence for itself."""
        size, k = self.sizes[self.doc], len(self.words)
        mine = counted[self.doc]
        single = sums[self.place[:k]][self.at] - np.where(mine, self.own_words, 0)
        p = (single + s.add) / (total - np.where(mine, size, 0) + s.add * (distinct + 1))
        if len(self.second):
            context = single[self.second - 1]
            pair = sums[self.place[k:]][self.pair] - np.where(mine[self.second], self.own_pairs, 0)
            share = pair / np.maximum(context, 1)
            p[self.second] = np.where(context > 0, s.weight * share + (1 - s.weight) * p[self.second], p[self.second])
        return np.bincount(self.doc, weights=-np.log2(p), minlength=len(self.sizes))

    def prepared(self) -> Chunk:
        self.own_words = self.own(self.at, self.doc)
        self.own_pairs = self.own(self.pair, self.doc[self.second])
        return self


def restored(words: bytes, at: bytes, sizes: bytes) -> Chunk:
    return Chunk(unpack_sorted(words), unpack(at).astype(np.int32), unpack(sizes).astype(np.int64))


def chunks(texts: DataFrame, s: Settings) -> DataFrame:
    """Rows of texts (doc_id, text, target) as chunks; ids, sizes and targets in the order of documents, the rest packed."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    fields = [("chunk", pa.int64()), ("ids", None), ("target", pa.list_(pa.bool_())), *((x, pa.binary()) for x in ("sizes", "words", "at")), *((x, pa.int64()) for x in ("n_tokens", "t_tokens"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        held: list[np.ndarray] = []
        ids: list = []
        target: list[bool] = []
        made = size = 0

        def out() -> pa.RecordBatch:
            words, at = np.unique(np.concatenate(held), return_inverse=True)
            sizes = np.array([len(h) for h in held])
            row = [first + made, pa.concat_arrays(ids), target, pack(sizes), pack_sorted(words), pack(at), size, int(sizes[np.array(target, bool)].sum())]
            row[1] = pa.ListArray.from_arrays(pa.array([0, len(row[1])], pa.int32()), row[1])
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array([x], k) for x, (_, k) in zip(row, fields)], names=[x for x, _ in fields])

        for b in batches:
            for k, (text, chosen) in enumerate(zip(b.column("text"), b.column("target"))):
                held.append(tokens(text.as_py()))
                ids.append(b.column("doc_id").slice(k, 1))
                target.append(bool(chosen.as_py()))
                size += len(held[-1])
                if size >= s.chunk or len(held) >= s.chunk:
                    yield out()
                    held, ids, target, made, size = [], [], [], made + 1, 0
        if held:
            yield out()

    return texts.mapInArrow(run, f"chunk long, ids array<{kind}>, target array<boolean>, sizes binary, words binary, at binary, n_tokens long, t_tokens long")


MESSAGE = "bucket long, chunk long, keys binary, n binary, t binary"


def messages(made: DataFrame, buckets: int) -> DataFrame:
    """For each chunk and bucket the keys in the bucket's range of hashes, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(1 << 64) * k // buckets for k in range(buckets)], np.uint64)
        for b in batches:
            for chunk, target, *packed in zip(*(b.column(x) for x in ("chunk", "target", "words", "at", "sizes"))):
                c, target = restored(*(x.as_py() for x in packed)), np.array(target.as_py(), bool)
                keys, n, t = c.keys, c.counts(np.ones(len(target), bool)), c.counts(target)
                at = np.append(np.searchsorted(keys, edges), len(keys))
                some = np.flatnonzero(np.diff(at))
                for lo in range(0, len(some), 1000):
                    part = some[lo : lo + 1000]
                    cells = [[f(x[at[k] : at[k + 1]]) for k in part] for f, x in ((pack_sorted, keys), (pack, n), (pack, t))]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([chunk.as_py()] * len(part), pa.int64()), *(pa.array(x, pa.binary()) for x in cells)], names=["bucket", "chunk", "keys", "n", "t"])

    return made.select("chunk", "target", "words", "at", "sizes").mapInArrow(run, MESSAGE)


def _summed(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a bucket's messages and their sums."""
    keys, at = np.unique(np.concatenate([unpack_sorted(r["keys"]) for r in rows]), return_inverse=True)
    n, t = (np.bincount(at, weights=np.concatenate([unpack(r[x]) for r in rows]), minlength=len(keys)).astype(np.uint64) for x in ("n", "t"))  # sums under 2**53
    return keys, n, t


@dataclass
class Counts:
    """Exact counts of both models: all texts (n) and the target's (t)."""

    table: DataFrame  # bucket, keys, n, t: one row a bucket
    buckets: int
    n: int
    t: int
    distinct: int  # words


def _totals(made: DataFrame, s: Settings) -> tuple[int, int, int]:
    """Buckets, and tokens of all texts and of the target's."""
    total = made.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("n_tokens", "t_tokens"))).first()
    least = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2 * least, -(-total.n_tokens // s.bucket)), total.n_tokens, total.t_tokens


def fit(texts: DataFrame, settings: Settings = Settings()) -> Counts:
    """Exact counts over all rows of texts (text, target)."""
    made = cut(chunks(texts.select(F.lit(0).alias("doc_id"), "text", "target"), settings), "chunks")
    buckets, n, t = _totals(made, settings)

    def run(rows: pa.Table) -> pa.Table:
        keys, a, b = _summed(rows.to_pylist())
        return pa.table({"bucket": rows.column("bucket").slice(0, 1), "keys": pa.array([pack_sorted(keys)], pa.binary()), "n": pa.array([pack(a)], pa.binary()), "t": pa.array([pack(b)], pa.binary()), "words": pa.array([int((keys & np.uint64(1) == 0).sum())], pa.int64())})

    table = cut(messages(made, buckets).groupBy("bucket").applyInArrow(run, "bucket long, keys binary, n binary, t binary, words long"), "counts")
    return Counts(table, buckets, n, t, table.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0])


def _answers(asked: DataFrame, table: DataFrame | None) -> DataFrame:
    """chunk, bucket and the sums n and t of the keys that the chunk asked for, in order; chunk null: the number of distinct words of a bucket, in words.

    table: the model's rows; None: the messages themselves are what is counted."""
    own = table is None
    rows = asked if own else asked.unionByName(table.select("bucket", F.lit(None).cast("long").alias("chunk"), "keys", "n", "t"))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        known = rows if own else [r for r in rows if r["chunk"] is None]
        keys, *sums = _summed(known) if known else [np.zeros(0, np.uint64)] * 3
        out = {"chunk": [], "bucket": [], "n": [], "t": [], "words": []}
        for r in rows:
            if r["chunk"] is not None:
                mine = unpack_sorted(r["keys"])
                at = np.minimum(np.searchsorted(keys, mine), max(len(keys) - 1, 0))
                found = keys[at] == mine if len(keys) else np.zeros(len(mine), bool)
                cells = [pack(np.where(found, x[at], 0)) if len(keys) else pack(np.zeros(len(mine))) for x in sums]
                for name, x in zip(out, (r["chunk"], r["bucket"], *cells, None)):
                    out[name].append(x)
        for name, x in zip(out, (None, rows[0]["bucket"], None, None, int((keys & np.uint64(1) == 0).sum()))):
            out[name].append(x)
        return pa.table({"chunk": pa.array(out["chunk"], pa.int64()), "bucket": pa.array(out["bucket"], pa.int64()), "n": pa.array(out["n"], pa.binary()), "t": pa.array(out["t"], pa.binary()), "words": pa.array(out["words"], pa.int64())})

    return rows.groupBy("bucket").applyInArrow(run, "chunk long, bucket long, n binary, t binary, words long")


def lm_scores(docs: DataFrame, target: Column | None = None, fitted: Counts | None = None, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_tokens, target_bits, background_bits (per token) and score, their difference, for each row of docs.

    target: which rows of docs the target model learns from (null counts as false); or fitted: models made
    before. Null texts and texts without words have no tokens and null bits and score. Repeated rows count
    and are scored each. Without target rows the target model knows no word. Columns not named do not
    matter; an empty table gives no rows."""
    s, own = settings, fitted is None
    some = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(target if own else F.lit(False), F.lit(False)).alias("target"))
    kind = some.schema["doc_id"].dataType.simpleString()
    made = cut(chunks(some, s), "chunks")
    if own:
        buckets, n, t = _totals(made, s)
    else:
        buckets, n, t = fitted.buckets, fitted.n, fitted.t
    told = cut(_answers(messages(made, buckets), None if own else fitted.table), "told")
    distinct = (told.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]) if own else fitted.distinct

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        r = next(x for x in rows if x["bucket"] is None)
        parts = sorted((x for x in rows if x["bucket"] is not None), key=lambda x: x["bucket"])
        c = restored(r["words"], r["at"], r["sizes"]).prepared()
        chosen = np.array(r["target"], bool)
        bits = []
        for x, total, counted in (("t", t, chosen & own), ("n", n, np.full(len(chosen), own))):
            sums = np.concatenate([unpack(p[x]) for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
            loss = c.losses(sums, total, distinct, counted, s)
            bits.append([float(y) if k else None for y, k in zip(loss / np.maximum(c.sizes, 1), c.sizes)])
        score = [None if x is None else x - y for x, y in zip(*bits)]
        return pa.table({"doc_id": pa.array(r["ids"], ids), "n_tokens": pa.array(c.sizes, pa.int64()), **{k: pa.array(v, pa.float64()) for k, v in zip(("target_bits", "background_bits", "score"), (*bits, score))}})

    ids = _arrow_type(some)
    nothing = F.lit(None)
    blank = lambda names, df: [nothing.cast(df.schema[x].dataType).alias(x) for x in names]
    head = made.select("chunk", nothing.cast("long").alias("bucket"), *blank("nt", told), "ids", "target", "sizes", "words", "at")
    answers = told.where("chunk IS NOT NULL").select("chunk", "bucket", "n", "t", *blank(("ids", "target", "sizes", "words", "at"), made))
    return head.unionByName(answers).groupBy("chunk").applyInArrow(run, f"doc_id {kind}, n_tokens long, target_bits double, background_bits double, score double")


def _arrow_type(some: DataFrame) -> pa.DataType:
    """The Arrow type of doc_id."""
    return some.select("doc_id").limit(0).toArrow().schema.field("doc_id").type
