"""Cross-entropy difference against counts by hand."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import lm_scoring as lm
from quillon.llm.scratch import table
from tests.llm.helpers import docs, odd


def test_texts_like_the_target_score_low(spark):
    texts = ["red green blue " * 20] * 5 + ["one two three " * 20] * 30 + ["blue red green " * 3, "two three one " * 3]
    out = {r.doc_id: r.score for r in lm.lm_scores(docs(spark, texts), F.col("doc_id") < 5).collect()}
    assert out[35] < out[36]


def test_equals_counts_by_hand(spark):
    """Small chunks and buckets, so that documents of many chunks meet."""
    df = table(spark, "/root/testdata/sf0.001", "documents")
    target = F.col("source").isin("src1", "src2", "src3")
    rows = [tuple(r) for r in df.select("doc_id", "text", target).collect()]
    want = exact_by_hand(rows, lm.Settings())
    got = lm.lm_scores(df, target, settings=lm.Settings(chunk=2000, bucket=500)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.target_bits, r.background_bits) == pytest.approx(want[r.doc_id])
        assert r.score == pytest.approx(want[r.doc_id][0] - want[r.doc_id][1])


def test_packed_numbers_come_back():
    rng = np.random.default_rng(1)
    for a in (np.zeros(0, np.uint64), np.array([0]), np.array([2**64 - 1, 0, 255, 256], np.uint64), rng.integers(0, 2**64, 1000, np.uint64)):
        assert lm.unpack(lm.pack(a)).tolist() == a.tolist()
        assert lm.unpack_sorted(lm.pack_sorted(np.sort(a))).tolist() == np.sort(a).tolist()


def test_odd_rows(spark):
    df = odd(spark)
    got = lm.lm_scores(df, F.col("doc_id") == 6).collect()
    assert len(got) == 10
    assert all((r.score is None) == (r.n_tokens == 0) for r in got)
    fitted = lm.fit(df.select("text", F.lit(False).alias("target")))
    assert lm.lm_scores(docs(spark, ["hello"]), fitted=fitted).first().n_tokens == 1
    assert lm.lm_scores(docs(spark, []), F.lit(True)).count() == 0


def exact_by_hand(rows, s):
    """{id: (target bits, background bits)} with every word and every pair counted for itself."""
    toks = {i: lm.tokens(t).tolist() for i, t, _ in rows}
    distinct = len({w for ws in toks.values() for w in ws})
    out = {i: [] for i in toks}
    for chosen in (lambda target: target, lambda target: True):
        model = {i for i, _, target in rows if chosen(target)}
        one, two = Counter(w for i in model for w in toks[i]), Counter(p for i in model for p in zip(toks[i], toks[i][1:]))
        for i, ws in toks.items():
            c1, c2 = Counter(ws if i in model else []), Counter(zip(ws, ws[1:]) if i in model else [])
            total, bits = one.total() - c1.total(), 0.0
            for k, w in enumerate(ws):
                p = (one[w] - c1[w] + s.add) / (total + s.add * (distinct + 1))
                if k and one[ws[k - 1]] - c1[ws[k - 1]]:
                    p = s.weight * (two[ws[k - 1], w] - c2[ws[k - 1], w]) / (one[ws[k - 1]] - c1[ws[k - 1]]) + (1 - s.weight) * p
                bits -= math.log2(p)
            out[i].append(bits / len(ws) if ws else None)
    return out


def test_every_word_and_pair_is_counted_for_itself(spark):
    """More words than 50,000, whose pairs outnumber 2**16 places, and repeated words."""
    texts = [" ".join(f"w{(k * k + 7 * d) % 3000 if k % 3 else 60_000 * d + k}" for k in range(6000)) for d in range(30)] + ["w1 w1 w1 w2 w1 w1", "", None, "alone"]
    df = docs(spark, texts).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "t").otherwise("s"))
    rows = [(r.doc_id, r.text, r.source == "t") for r in df.collect()]
    assert len({w for _, t, _ in rows for w in (t or "").split()}) > 50_000
    want = exact_by_hand(rows, lm.Settings())
    got = lm.lm_scores(df, F.col("source") == "t").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_tokens == len((texts[r.doc_id] or "").split())
        assert [r.target_bits, r.background_bits] == (pytest.approx(want[r.doc_id]) if r.n_tokens else [None, None])


def test_models_made_before_know_unseen_pairs(spark):
    fitted = lm.fit(docs(spark, ["a b a b", "b a c"]).select("text", (F.col("doc_id") == 0).alias("target")))
    got = lm.lm_scores(docs(spark, ["c b"]), fitted=fitted).first()
    alone = [(0 + 0.5) / (4 + 2), (1 + 0.5) / (7 + 2)], [(2 + 0.5) / (4 + 2), (3 + 0.5) / (7 + 2)]
    want = [-(math.log2(alone[0][k]) + math.log2(alone[1][k] * (0.3 if k else 1))) / 2 for k in (0, 1)]
    assert [got.target_bits, got.background_bits] == pytest.approx(want)
