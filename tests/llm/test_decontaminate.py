"""Decontamination against brute force."""

from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from quillon.llm import decontaminate as dc
from quillon.llm.scratch import table
from tests.llm.helpers import PROSE, docs, odd


def words(text):
    return regex.findall(r"[\p{L}\p{M}\p{N}]+", (text or "").lower())


def brute(documents, items, least=0.8):
    """{(doc, item): best similarity} over all windows."""
    out = {}
    for i, text in documents:
        w = words(text)
        for j, item in items:
            v = words(item)
            n = min(5, len(v))
            if not n:
                continue
            a = Counter(tuple(v[k : k + n]) for k in range(len(v) - n + 1))
            s = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
            size = len(v) - n + 1
            if not set(s) & a.keys():
                continue
            best = 0
            for k in range(max(1, len(s))):
                b = Counter(s[k : k + size])
                both = sum((a & b).values())
                best = max(best, both / (size + sum(b.values()) - both))
            if best >= least:
                out[i, j] = best
    return out


def check(documents, items, **more):
    got = {(r.doc_id, r.item_id): r.similarity for r in dc.contaminated(documents, items, **more).collect()}
    want = brute([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got == pytest.approx(want)
    return got


def test_equals_brute_force_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    assert check(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def items(spark, texts):
    return spark.createDataFrame([*enumerate(texts)], "item_id long, text string")


def test_edits_ends_and_short_items(spark):
    w = PROSE.split()
    longer = " ".join(f"{x}{k}" for k in range(4) for x in w)
    v = longer.split()
    texts = [
        f"before {PROSE} after", PROSE.upper().replace(" ", "\n, "), " ".join(w[1:]), " ".join(w[:-1]), " ".join(w[4:]), "noise " * 50 + longer, " ".join([*v[:50], "CHANGED", *v[51:]]), " ".join([*v[:50], "ins", *v[50:]]),
        " ".join([*v[:30], *v[31:]]), " ".join([*v[:30], "a", *v[31:60], "b", *v[61:]]), "unrelated text", None, "", "owls watch", "owls", PROSE + " " + PROSE,
    ]
    got = check(docs(spark, texts), items(spark, [PROSE, longer, "Owls, watch!", "", None, "...", "the the the the the the the"]))
    assert {(0, 0), (1, 0), (2, 0), (3, 0), (5, 1), (6, 1), (7, 1), (8, 1), (13, 2), (15, 0)} <= set(got) and not {i for i, _ in got} & {10, 11, 12}


def test_large_benchmarks_are_not_broadcast(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(dc, "BROADCAST_SHINGLES", 3)
    check(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def test_blocks_cover_all_bits_and_find_all_within_the_radius(spark):
    for radius in (0, 3, 20, 63):
        cuts = dc.masks(radius)
        assert len(cuts) == radius + 1 and sum(n for _, n in cuts) == 64 and cuts[0][0] == 0
    import random

    rng = random.Random(1)
    pairs = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(0, 24)):
            b ^= 1 << bit
        pairs.append((a - (1 << 64) * (a >> 63), b - (1 << 64) * (b >> 63), bin(a ^ b).count("1")))
    df = spark.createDataFrame(pairs, "a long, b long, d int")
    same = F.size(F.array_intersect(dc.blocks_of("a", 20), dc.blocks_of("b", 20)))
    out = df.select("d", same.alias("same"), dc.first_equal(F.col("a").bitwiseXOR(F.col("b")), 20).alias("first"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("n")).collect()
    for r in out:
        assert r.n == r.d and (r.same > 0 or r.d > 20) and (r.first is None) == (r.same == 0)


def test_odd_rows(spark):
    benchmark = items(spark, ["hello", "no id here at all"]).withColumn("doc_id", F.lit("clash"))
    got = dc.contaminated(odd(spark), benchmark).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=repr) == [(4, 0), (None, 1)]
    assert dc.contaminated(docs(spark, []), benchmark).count() == 0
    assert dc.contaminated(docs(spark, ["hello"]), benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("n", [59, 64])
def test_best_window_between_the_shifts_of_shared_shingles(spark, n):
    """First and last word changed, two words inserted in the middle: the best window starts at no shared shingle's shift."""
    v = [f"word{k}" for k in range(n)]
    text = " ".join(["noise"] * 20 + ["first", *v[1 : n // 2], "ins", "erted", *v[n // 2 : -1], "last"] + ["noise"] * 20)
    assert set(check(docs(spark, [text]), items(spark, [" ".join(v)]))) == {(0, 0)}


def test_reordered_passage(spark):
    """The halves of an item change places: similar at a start that no shared shingle's shift gives."""
    v, rest = [f"word{k}" for k in range(200)], [f"own{k}" for k in range(800)]
    texts = [" ".join([*rest[:400], *v[100:], *v[:100], *rest[400:]]), " ".join([*rest[:400], *v[150:], *v[50:150], *v[:50], *rest[400:]])]
    got = check(docs(spark, texts), items(spark, [" ".join(v)]))
    assert got[0, 0] > 0.9 and got[1, 0] > 0.9


def test_sql_twin_slides_over_all_windows(spark, tmp_path):
    import duckdb

    from quillon.llm import queries

    v = [f"word{k}" for k in range(60)]
    texts = [" ".join(["x"] * 9 + [*v[30:], *v[:30]] + ["y"] * 9), " ".join(["first", *v[1:30], "ins", "erted", *v[30:-1], "last"]), "nothing of it", None]
    d, b = docs(spark, texts).toPandas(), items(spark, [" ".join(v)]).toPandas()
    c = duckdb.connect()
    c.register("documents", d)
    c.register("benchmark", b)
    want = sorted(c.sql(queries.OP9_SQL).fetchall())
    got = dc.contaminated(docs(spark, texts), items(spark, [" ".join(v)])).select("doc_id", "item_id", "similarity", "start", "n_words")
    assert sorted(map(tuple, got.collect())) == [pytest.approx(r) for r in want] and [r[0] for r in want] == [0, 1]


def test_starts_are_all_windows_that_hold_enough(spark):
    import random

    rng = random.Random(3)
    rows = [(sorted(rng.sample(range(60), rng.randrange(60))), rng.randrange(1, 30)) for _ in range(200)]
    got = spark.createDataFrame(rows, "at array<int>, k int").select("at", "k", dc.starts("at", "k", 0.8).alias("s")).collect()
    for r in got:
        assert sorted(r.s) == [s for s in range(60) if 10 * sum(s <= p < s + r.k for p in r.at) >= 8 * r.k]
