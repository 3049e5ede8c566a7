"""Near-duplicate detection with an LSH forest over MinHash signatures.

Documents with one shingle set are one node. Each of several trees orders all nodes by their own sequence
of MinHash values, and candidates are neighbours in that order by the length of their common prefix: all
pairs of a region (the nodes under one prefix) while it has few nodes, and only the closest neighbours,
those with the longest prefixes, where a region is dense. The order is cut into blocks of equal length with an
overlap, so neither a hot prefix nor a large group makes a large task. Candidates are confirmed on the full
shingle sets: first the most alike of each node, then all whose nodes are not connected yet. Connected
components come from label propagation with pointer jumping. A dense region whose nodes are then in several
components is gone through whole: each node outside its largest component against all others, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.scratch import cut, settled
from quillon.llm.textcode import mix, shingles, word_hashes


@dataclass(frozen=True)
class Settings:
    words: int = 5  # of a shingle
    percent: int = 80  # link: 100 * intersection >= percent * union
    trees: int = 16
    depth: int = 12  # values of a tree's order
    least: int = 3  # common values that make a candidate
    reach: int = 48  # largest region all of whose pairs are candidates, and the furthest neighbours in the order
    close: int = 2  # neighbours in denser regions
    first: int = 3  # candidates of each node, the most alike, that are confirmed first
    alike: int = 5  # equal values of a tree's that a candidate has at least
    spread: float = 6.0  # in dense regions: standard errors below the threshold at which a signature still counts
    side: int = 1024  # nodes of a block there
    block: int = 8192  # nodes of one block of a tree's order


_A = mix(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(1, 4097, dtype=np.uint64), 5)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted 64-bit hashes of the text's distinct shingles; A-Z are lower-cased, words end at ASCII white space."""
    return np.unique(shingles(word_hashes((text or "").encode("utf-8", "replace").lower()), words))


def set_key(u: np.ndarray) -> bytes:
    """128 bits that name a shingle set."""
    return b"".join(int(mix(u, seed).sum(dtype=np.uint64)).to_bytes(8, "big") for seed in (21, 22))


def signature(u: np.ndarray, n: int) -> bytes:
    """n MinHash values of 16 bits, big-endian."""
    low = np.full(n, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(u), 512):
            part = u[at : at + 512]
            for k in range(0, n, 64):
                low[k : k + 64] = np.minimum(low[k : k + 64], (part[None, :] * _A[k : k + 64, None][: n - k] + _B[k : k + 64, None][: n - k]).min(1))
    return (mix(low) >> np.uint64(48)).astype(">u2").tobytes()


def coded(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, node, sig of each row; node is null where there are no words."""
    some = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    kind = some.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, node, sig = [], [], []
            for t in b.column("text"):
                u = shingle_set(t.as_py(), s.words)
                n.append(len(u))
                node.append(set_key(u) if len(u) else None)
                sig.append(signature(u, s.trees * s.depth) if len(u) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "th", "n_shingles", "node", "sig"])

    return some.mapInArrow(run, f"doc_id {kind}, th long, n_shingles long, node binary, sig binary")


def first_of(id_col: str) -> Column:
    """Orders rows by id, nulls last; the text's hash decides between equal ids."""
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("th").alias("th"))


def candidates(nodes: DataFrame, s: Settings) -> DataFrame:
    """a < b, alike (equal values) and dense of the neighbours in each tree's order; and a and region of each node in a dense region.

    Nodes with one key come in another order in each tree, so that their neighbours are others."""
    width = 2 * s.depth
    trees = F.explode(F.transform(F.sequence(F.lit(0), F.lit(s.trees - 1)), lambda t: F.struct(t.alias("tree"), F.substring("sig", t * width + 1, F.lit(width)).alias("key"))))
    spark = nodes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("t.tree"), F.col("t.key"), F.xxhash64("t.tree", "nid"), F.col("nid")]
    ranged = nodes.select("nid", trees.alias("t")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = cut(ranged.select("nid", "t.tree", "t.key", F.monotonically_increasing_id().alias("at")), "forest")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # one number a partition
    before, starts = 0, {}
    for r in sorted(sizes):
        starts[r.part], before = before, before + r.n
    if not starts:
        return spark.createDataFrame([], "a long, b long, alike int, dense boolean, region long")
    known = spark.createDataFrame([*starts.items()], "part long, start long")
    ranks = rows.withColumn("part", part).join(F.broadcast(known), "part").select("nid", "tree", "key", (row + F.col("start")).alias("rank"))
    block = (F.col("rank") / s.block).cast("long")
    # the first rows of a block are also the last ones of the block before it
    blocks = ranks.select("nid", "tree", "key", "rank", F.explode(F.when((F.col("rank") % s.block < s.reach) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))).alias("block"))

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        own = int((pdf["rank"] // s.block == pdf["block"]).sum())  # pairs of two overlapping rows are the next block's
        keys = np.frombuffer(b"".join(pdf["key"]), ">u2").reshape(len(pdf), s.depth)
        tree, nid = pdf["tree"].to_numpy(), pdf["nid"].to_numpy()
        prefix = np.where(tree[1:] == tree[:-1], np.cumprod(keys[1:] == keys[:-1], axis=1).sum(1), 0)
        edge = np.concatenate(([0], np.flatnonzero(prefix < s.least) + 1, [len(pdf)]))
        region = np.repeat(np.diff(edge), np.diff(edge))  # nodes under the prefix that a candidate needs, in this block
        found, common = [], prefix
        for o in range(1, min(s.reach, len(pdf) - 1) + 1):
            if o > 1:
                common = np.minimum(common[:-1], prefix[o - 1 :])
            i = np.flatnonzero((common >= s.least) & (np.arange(len(common)) < own))
            if o > s.close:
                i = i[region[i] <= s.reach]
            if not (common >= s.least).any():
                break
            same = (keys[i] == keys[i + o]).sum(1)
            i, same = i[same >= s.alike], same[same >= s.alike]
            found.append((np.minimum(nid[i], nid[i + o]), np.maximum(nid[i], nid[i + o]), same, region[i] > s.reach))
        a, b, alike, crowded = (np.concatenate(x) for x in zip(*found)) if found else ([], [], [], [])
        dense = np.flatnonzero((region > s.reach) & (np.arange(len(pdf)) < own))
        with np.errstate(over="ignore"):
            name = mix(mix(keys[dense, : s.least].astype(np.uint64) + np.uint64(1)) @ (np.uint64(3) ** np.arange(s.least, dtype=np.uint64)) + tree[dense].astype(np.uint64)).view(np.int64)
        told = pd.DataFrame({"a": a, "b": b, "alike": alike, "dense": crowded, "region": pd.array([None] * len(a), "Int64")})
        return pd.concat([told, pd.DataFrame({"a": nid[dense], "b": pd.array([None] * len(dense), "Int64"), "alike": 0, "dense": True, "region": name})]) if len(dense) else told

    return blocks.groupBy("block").applyInPandas(pairs, "a long, b long, alike int, dense boolean, region long")


def sets_of(asked: DataFrame, nodes: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """nid and u, the full shingle set, of the nodes in asked (nid, distinct); one text of each moves."""
    asked = asked.join(nodes.select("nid", "node", "rep"), "nid").select("nid", "node", F.coalesce(F.col("rep.id").cast("string"), F.lit("")).alias("key"), F.col("rep.th").alias("th"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.xxhash64("text").alias("th"), "text")
    some = texts.join(asked, ["key", "th"]).select("nid", "node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for nid, node, text in zip(b.column("nid"), b.column("node"), b.column("text")):
                u = shingle_set(text.as_py(), s.words)
                if set_key(u) == node.as_py():  # another text may have the id and the hash
                    yield pa.RecordBatch.from_arrays([pa.array([nid.as_py()], pa.int64()), pa.array([u.tobytes()], pa.binary())], names=["nid", "u"])

    return cut(some.mapInArrow(sets, "nid long, u binary").dropDuplicates(["nid"]), "sets")


def alike_enough(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    same = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * same >= percent * (len(x) + len(y) - same)


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are alike enough."""
    full = sets_of(pairs.select(F.col("a").alias("nid")).union(pairs.select("b")).distinct(), nodes, docs, s)
    both = pairs.select("a", "b").join(full.select(F.col("nid").alias("a"), F.col("u").alias("ua")), "a").join(full.select(F.col("nid").alias("b"), F.col("u").alias("ub")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [alike_enough(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), s.percent) for x, y in zip(b.column("ua"), b.column("ub"))]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ua", "ub").mapInArrow(check, "a long, b long")


def components(links: DataFrame, weights: DataFrame) -> DataFrame:
    """nid and label (the smallest weight, a struct that ends with nid) of the component of each node in links (a, b).

    weights: nid, w. Each round takes the smallest label among the neighbours, then the label of the label's node."""
    edges = cut(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).toDF("src", "dst").distinct(), "edges")
    labels = cut(edges.select(F.col("src").alias("nid")).distinct().join(weights, "nid").select("nid", F.col("w").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("nid").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("nid")).agg(F.min("label").alias("near"))
        taken = cut(labels.join(near, "nid").select("nid", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved")), "labels")
        if not taken.where("moved").limit(1).count():
            return taken.select("nid", "label")
        of = taken.select(F.col("nid").alias("to"), F.col("label").alias("further"))
        labels = cut(taken.join(of, F.col("label.nid") == F.col("to")).select("nid", F.least("label", "further").alias("label")), "labels")


def across(members: DataFrame, found: DataFrame, nodes: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) between different components within the dense regions (members: nid, region), one at least of any two that have some.

    Regions of different trees that share nodes are first put together, as far as three rounds go. In each
    group, nodes outside its largest component are compared with all that are in another component, in
    blocks of bounded size: by signature, and on the full sets where that leaves any doubt."""
    of = found.select(F.col("nid").alias("n"), F.col("label.nid").alias("label"))
    placed = members.join(of, F.col("nid") == F.col("n"), "left").select("nid", "region", F.coalesce("label", "nid").alias("label"))
    for _ in range(3):
        placed = cut(placed, "dense")
        by_node = placed.groupBy("nid").agg(F.min("region").alias("least"))
        by_region = cut(placed.join(by_node, "nid").groupBy("region").agg(F.min("least").alias("least")), "regions")
        placed = placed.join(by_region, "region").select("nid", F.col("least").alias("region"), "label").distinct()
    placed = cut(placed, "dense")
    sizes = placed.groupBy("region", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("region").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("parts"))
    mixed = sizes.where("parts > 1").select("region", F.col("main.label").alias("main"), F.ceil(F.col("n") / s.side).cast("int").alias("m"), F.ceil((F.col("n") - F.col("main.n")) / s.side).cast("int").alias("o"))
    mixed = cut(mixed, "mixed")  # a table: both sides of the join are then exchanges, which AQE can split
    rows = cut(placed.join(mixed, "region"), "mixed")
    full = sets_of(rows.select("nid").distinct(), nodes, docs, s).join(nodes.select("nid", "sig"), "nid")
    rows = cut(rows.join(full, "nid"), "mixed")
    place = lambda n: F.pmod(F.xxhash64("nid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("label <> main").select("region", "nid", "label", "sig", "u", place("o").alias("ob"), every("m").alias("mb"))
    right = rows.select("region", "nid", "label", "sig", "u", place("m").alias("mb"), every("o").alias("ob"))
    total = s.trees * s.depth
    p = s.percent / 100
    least = int(total * p - s.spread * (total * p * (1 - p)) ** 0.5)

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        if len(x) and len(y):
            sig = np.frombuffer(b"".join(y["sig"]), ">u2").reshape(len(y), total)
            nid, label, full = y["nid"].to_numpy(), y["label"].to_numpy(), [np.frombuffer(u, np.uint64) for u in y["u"]]
            for n, l, one, u in zip(x["nid"], x["label"], x["sig"], x["u"]):
                same = (sig == np.frombuffer(one, ">u2")).sum(1)
                done, u = {l}, np.frombuffer(u, np.uint64)
                for k in np.argsort(-same, kind="stable"):
                    if same[k] < least:
                        break
                    if label[k] not in done and alike_enough(u, full[k], s.percent):
                        done.add(label[k])  # another link to that component would change nothing
                        a.append(n)
                        b.append(nid[k])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    keys = ("region", "mb", "ob")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "a long, b long")


def linked(nodes: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """Components of the nodes that have a partner: nid, label."""
    weights = nodes.select("nid", F.struct("rep.no_id", "rep.id", "rep.th", "nid").alias("w"))
    made = settled(lambda: candidates(nodes, s), "candidates")
    pairs = made.where("region IS NULL").groupBy("a", "b").agg(F.sum("alike").alias("alike"), F.min("dense").alias("dense"))
    either = pairs.select(F.col("a").alias("x"), F.struct("alike", "a", "b").alias("p")).union(pairs.select("b", F.struct("alike", "a", "b")))
    best = either.groupBy("x").agg(F.slice(F.sort_array(F.collect_list("p"), asc=False), 1, s.first).alias("ps")).select(F.explode("ps").alias("p"))
    links = settled(lambda: confirmed(cut(best.select("p.a", "p.b").distinct(), "best"), nodes, docs, s), "links")
    found = settled(lambda: components(links, weights), "components")

    la, lb = (found.select(F.col("nid").alias(x), F.col("label.nid").alias(f"l{x}")) for x in ("a", "b"))
    both = pairs.where("NOT dense").select("a", "b").join(la, "a", "left").join(lb, "b", "left")
    rest = cut(both.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b"), "rest")  # the others can't change a component; what dense regions leave comes last
    for ask in (lambda: confirmed(rest, nodes, docs, s), lambda: across(made.where("region IS NOT NULL").select(F.col("a").alias("nid"), "region").distinct(), found, nodes, docs, s)):
        more = settled(ask, "links")
        if more.limit(1).count():
            links = links.unionByName(more)
            found = settled(lambda: components(links, weights), "components")
    return found


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Null and empty texts and texts without words have no shingles: they are linked with nothing, so
    component_id is their id and they are kept. Repeated rows and rows with equal shingle sets are one
    component. Where an id occurs with several texts each text is a document; ids that are null are the
    last to name a component. kept: the row's id is the component's. Texts are read whole; columns not
    named do not matter; an empty table gives no rows."""
    return told(docs, id_col, text_col, settings).drop("th")


def told(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of near_dedup with th, the hash of the text, which tells apart the texts of one id."""
    s = settings
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(coded(plain, s), "signatures")

    def names() -> DataFrame:
        each = rows.where("node IS NOT NULL").groupBy("node").agg(F.min(first_of("doc_id")).alias("rep"), F.max("sig").alias("sig"), F.count(F.lit(1)).alias("copies"))
        nodes = cut(each.withColumn("nid", F.monotonically_increasing_id()), "nodes")
        grouped = nodes.join(linked(nodes, plain, s), "nid", "left").where("copies > 1 OR label IS NOT NULL")
        return grouped.select("node", F.when(F.col("label").isNull(), F.col("rep.id")).otherwise(F.col("label.id")).alias("component_id"), F.lit(True).alias("several"))

    named = settled(names, "named")
    out = rows.select("doc_id", "th", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("several"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "th", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
