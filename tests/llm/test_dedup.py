"""Exact and near deduplication against brute force."""

import hashlib
import random
import re

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from quillon.llm import exact_dedup as ed
from quillon.llm import near_dedup as nd
from quillon.llm import queries
from quillon.llm.scratch import table
from tests.llm.helpers import PROSE, docs, odd, rows


def test_exact_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = c.sql(queries.OP7_SQL)
    got = queries.op7_exact_dedup(spark, sf).select(*want.columns)
    assert rows(got) == sorted(want.fetchall(), key=repr)


def test_exact_white_space_and_odd_rows(spark):
    texts = ["a b", "a  b", "a\tb", "a\n\x0b\x0c\r b", " a b", "a b ", "", None, " ", "\n\n", "a b", "A b"]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in ed.exact_dedup(docs(spark, texts)).collect()}
    assert got == {0: (0, 4), 1: (0, 4), 2: (0, 4), 3: (0, 4), 4: (4, 1), 5: (5, 1), 6: (6, 2), 7: (6, 2), 8: (8, 2), 9: (8, 2), 10: (10, 1), 11: (11, 1)}
    out = ed.exact_dedup(odd(spark)).collect()
    assert len(out) == 10
    for r in out:
        assert r.kept == (r.doc_id == r.keep_id)
    assert [(r.keep_id, r.group_size, r.kept) for r in out if r.doc_id == 4] == [(4, 2, True)] * 2
    assert {(r.doc_id, r.keep_id) for r in out if r.text_sha256 == hashlib.sha256(b"").hexdigest()} == {(1, 1), (2, 1), (None, 1)}
    assert [(r.keep_id, r.kept) for r in out if r.doc_id is None and r.group_size == 1] == [(None, True)]
    assert ed.exact_dedup(docs(spark, [])).count() == 0


def test_chunks_cover_the_text_and_repeat(spark):
    text = " ".join(f"{PROSE} {k}" for k in range(300))
    df = docs(spark, [text, "prefix of its own " + text])
    found = df.select(F.regexp_extract_all("text", F.lit(ed.chunk_pattern()), F.lit(0)).alias("c")).collect()
    assert "".join(found[0].c) == text and all(len(x) <= 4200 for x in found[0].c)
    assert len(set(found[0].c) & set(found[1].c)) > 0.8 * len(found[0].c)  # cuts follow the content


def test_colliding_identifiers_are_told_apart(spark, monkeypatch):
    real = ed.recipes
    monkeypatch.setattr(ed, "recipes", lambda *a: real(*a).withColumn("chunks", F.transform("chunks", lambda c: F.struct(F.lit(7).cast("long").alias("h"), c.d.alias("d")))))
    df = docs(spark, ["one", "two", "one", "three"])
    assert {r.doc_id: r.keep_id for r in ed.exact_dedup(df).collect()} == {0: 0, 1: 1, 2: 0, 3: 3}


def test_some_identifiers_collide(spark, monkeypatch):
    """Only recipes with a doubtful identifier are named by digests; the others keep theirs."""
    real = ed.recipes
    low = lambda c: F.struct(F.pmod(c.h, F.lit(3)).alias("h"), c.d.alias("d"))
    monkeypatch.setattr(ed, "recipes", lambda *a: real(*a).withColumn("chunks", F.transform("chunks", lambda c: F.when(F.size("chunks") > 1, low(c)).otherwise(c))))
    text = lambda k: " ".join(f"{PROSE} {j * k}" for j in range(20))
    df = docs(spark, ["one", text(1), "two", text(2), text(1), "one", text(3), text(2)])
    assert {r.doc_id: r.keep_id for r in ed.exact_dedup(df).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 1, 5: 0, 6: 6, 7: 3}


@pytest.mark.parametrize("letters, gap", [("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэф", 6), ("".join(map(chr, range(0x4E00, 0x4E00 + 400))), 0), ("".join(map(chr, range(0x905, 0x939))), 6), ("etaoinshrdlucmfwypvbgkjqxz", 6)])
def test_cuts_fall_in_step_again_in_any_script(spark, letters, gap):
    rng = random.Random(2)
    weights = [1 / (k + 2) for k in range(len(letters))]
    text = "".join(rng.choices(letters, weights)[0] if not gap or rng.random() > 1 / gap else " " for _ in range(20_000))
    found = docs(spark, [text, letters[:7] + " " + text]).select(F.regexp_extract_all(ed.normalised(F.col("text")), F.lit(ed.chunk_pattern()), F.lit(0)).alias("c")).collect()
    assert len(set(found[0].c) & set(found[1].c)) > 0.8 * len(found[0].c) > 20


def shingle_words(text, n=5):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(pairs, n=5):
    """{id: component} by comparing all with all."""
    sets = {i: shingle_words(t, n) for i, t in pairs}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                label[hi] = lo
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def check(df, s=nd.Settings()):
    want, sizes = brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], s.words)
    got = nd.near_dedup(df, settings=s).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == sizes[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_equals_brute_force_on_the_table(spark):
    for words in (4, 5):
        check(table(spark, "/root/testdata/sf0.001", "documents"), nd.Settings(words=words))


def test_five_words_unless_told_otherwise(spark):
    """One inner word of 40 differs: 33 of 41 shingles of four words are common, 31 of 41 of five."""
    w = [f"d{k}" for k in range(40)]
    df = docs(spark, [" ".join(w), " ".join([*w[:20], "other", *w[21:]])])
    assert [r.kept for r in nd.near_dedup(df).collect()] == [True, True]
    assert sorted(r.kept for r in nd.near_dedup(df, settings=nd.Settings(words=4)).collect()) == [False, True]


def test_very_long_texts_without_spaces(spark):
    """Words over several pieces are one word, and any white space parts words."""
    long = "".join(f"{k:07d}" for k in range(400_000))
    tabs = "\t".join(f"t{k}" for k in range(200_000))
    got = {r.doc_id: r for r in nd.near_dedup(docs(spark, [long, long[:-1] + "x", tabs, tabs.replace("\t", "\r\n ")])).collect()}
    assert [got[k].n_shingles for k in range(4)] == [1, 1, 199_996, 199_996]
    assert [got[k].component_id for k in range(4)] == [0, 1, 2, 2]


def variants(n, words, edits, seed):
    rng = random.Random(seed)
    base = [f"v{rng.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = base[:]
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_dense_regions_and_blocks(spark):
    """A group far larger than the regions all of whose pairs are compared, over several blocks, at the threshold."""
    texts = variants(150, 90, 5, 1) + variants(80, 60, 3, 2) + [" ".join(f"u{k}x{j}" for j in range(40)) for k in range(30)]
    random.Random(4).shuffle(texts)
    check(docs(spark, texts), nd.Settings(reach=6, close=1, block=64, side=16))


def test_near_odd_rows(spark):
    df = odd(spark)
    got = nd.near_dedup(df).collect()
    assert len(got) == 10
    assert [(r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id == 4] == [(1, 4, True)] * 2
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id and r.kept for r in got if r.doc_id in (1, 2, 3))
    assert nd.near_dedup(docs(spark, [])).count() == 0
    assert nd.near_dedup(docs(spark, [None, ""])).count() == 2
    same = nd.near_dedup(docs(spark, [PROSE, PROSE.upper(), PROSE.replace(" ", "\n")], [9, 5, 7])).collect()
    assert {r.component_id for r in same} == {5}
    nameless = nd.near_dedup(docs(spark, [PROSE, PROSE], [None, 3])).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in nameless} == {(None, 3, False), (3, 3, True)}


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="aAbB \t\n\x0b é", max_size=40))
def test_shingle_sets(text):
    assert len(nd.shingle_set(text, 4)) == len(shingle_words(text, 4))


def test_minhash_estimates():
    a, b = (nd.shingle_set(" ".join(f"w{k}" for k in r), 4) for r in (range(0, 1000), range(100, 1100)))
    import numpy as np

    x, y = (np.frombuffer(nd.signature(u, 1024), ">u2") for u in (a, b))
    assert (x == y).mean() == pytest.approx(897 / 1097, abs=0.05)
