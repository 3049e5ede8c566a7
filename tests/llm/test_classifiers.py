"""Toxicity and quality: held-out accuracy, bounds of the samples, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import labelled, quality, queries, toxicity
from quillon.llm.scratch import table
from tests.llm.helpers import docs, odd

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("query, label, least, catch", [(queries.op4_toxicity, "toxic", 0.95, 0.6), (queries.op6_quality, "quality", 0.97, 0.95)])
def test_held_out(spark, query, label, least, catch):
    got = query(spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out")
    assert got.agg(F.avg(F.expr(f"int(predicted = {label})"))).first()[0] > least
    assert got.where(f"{label} = 1").agg(F.avg("predicted")).first()[0] > catch
    assert got.where("score < 0 OR score > 1").count() == 0


def test_ftrl_is_sparse_and_finds_the_features():
    rng = np.random.default_rng(0)
    s = toxicity.Settings(bits=12)
    rows = []
    for k in range(400):
        places = rng.choice(4000, 40, replace=False) + 10
        rows.append((k % 2, np.append(places, 3) if k % 2 else places, None))
    places, weights, bias = toxicity.ftrl(rows, s)
    assert len(places) < 400 and places[weights.argmax()] == 3 and bias < 0


def test_ftrl_equals_one_with_dictionaries():
    """Coordinates as a dictionary of plain numbers, one at a time."""
    rng = np.random.default_rng(1)
    s = toxicity.Settings(bits=8, epochs=2, l1=0.5)
    rows = [(int(k % 3 == 0), np.unique(rng.integers(0, 256, 12) // (1 + k % 3)), None) for k in range(120)]
    z, n, order = {}, {}, np.random.default_rng(7)
    bias = 256

    def weight(i):
        over = abs(z.get(i, 0.0)) - (s.l1 if i != bias else 0)
        return -np.sign(z.get(i, 0.0)) * max(over, 0) / ((s.beta + n.get(i, 0.0) ** 0.5) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for k in order.permutation(len(rows)):
            y, places, _ = rows[k]
            mine = [*places.tolist(), bias]
            w = {i: weight(i) for i in mine}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in mine:
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / s.alpha
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    places, weights, intercept = toxicity.ftrl(rows, s)
    want = {i: weight(i) for i in z if i != bias and weight(i)}
    assert dict(zip(places.tolist(), weights.tolist())) == pytest.approx(want, rel=1e-4) and intercept == pytest.approx(weight(bias))


def test_quality_features_equal_a_plain_loop():
    from quillon.llm import textcode as tc

    def code(b):
        return int(tc.mix(np.array([sum((x + 1) * pow(tc.BASE, j, 1 << 64) for j, x in enumerate(b)) % (1 << 64)], np.uint64))[0])

    def mixed(h, seed):
        return int(tc.mix(np.array([h % (1 << 64)], np.uint64), seed)[0])

    s = quality.Settings()
    for text in ("The the owl, owl!\nsaw\t\té 12", "", "a", "  x  yz yz "):
        data = b" " + text.encode().translate(quality._TO_SPACE) + b" "
        words = data.split()
        want = [code(w) for w in words]
        want += [int(quality.TWICE) if a == b else mixed(code(a) * 3 + mixed(code(b), 9), 8) for a, b in zip(words, words[1:])]
        for n in s.grams:
            for i in range(len(data) - n + 1):
                gram = data[i : i + n]
                if (b" " not in gram[1:-1]) and gram.strip():
                    want.append(mixed(code(gram), n))
        assert sorted(quality.hashed(text, s).tolist()) == sorted(h >> (64 - s.bits) for h in want)


def test_scores_do_not_follow_the_share_of_the_sample(spark):
    """One bound takes all labelled rows and the other as many of each class: mean scores stay near the whole table's share."""
    import dataclasses

    sf = "/root/testdata/sf0.1"
    df, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    share = labels.agg(F.avg("toxic")).first()[0]
    for per_class in (3000, 300):
        s = dataclasses.replace(toxicity.Settings(), per_class=per_class)
        model = toxicity.fit(df, labels, F.lit(True), settings=s)
        got = toxicity.toxicity(df.join(labels, "doc_id"), model, settings=s).agg(F.avg("predicted")).first()[0]
        assert abs(got - share) < 0.05
    rows = [(1, None, None)] * 5 + [(0, None, None)] * 5
    assert labelled.prior_shift((90, 10), rows) == pytest.approx(np.log(1 / 9)) and labelled.prior_shift((0, 10), rows) == 0


def test_features_are_bounded_in_bytes_and_ids_count_once(spark, monkeypatch):
    df = docs(spark, ["a b c d"] * 6 + ["zz"], [0, 1, 2, 3, 3, 3, 3])
    chosen = spark.createDataFrame([(k, k % 2) for k in range(4)], "doc_id long, y int")
    found = labelled.features_of(df, chosen, "doc_id", "text", toxicity.encode(toxicity.Settings()))
    assert len(found) == 4
    monkeypatch.setattr(labelled, "SAMPLE_BYTES", 2 * found[0][1].nbytes)
    assert len(labelled.features_of(df, chosen, "doc_id", "text", toxicity.encode(toxicity.Settings()))) in (2, 3)


def test_features_cross_pieces():
    s = toxicity.Settings()
    long = "word " * 200_000
    assert len(toxicity.hashed(long, s)) == 5 * 200_000 - (1 + 2 + 3)  # words, one stem each, pairs at three distances
    assert len(toxicity.hashed("", s)) == 0


def test_quality_collapses_to_one_number_a_bucket():
    s = quality.Settings(bits=10, epochs=5)
    e = quality.encode(s)
    rows = [(y, *e(t)) for y, t in ((1, "good clean text here"), (0, "BAD!! BAD!! BAD!!")) for _ in range(20)]
    parts, bias = quality.sgd(rows, s)
    score = quality.scorer((parts, bias), s)
    assert score("good clean text") > 0.5 > score("BAD!! BAD!!")
    places, counts = e("some text")
    z = (parts[places].astype(float) * counts).sum() / counts.sum() + bias
    assert score("some text") == pytest.approx(1 / (1 + np.exp(-z)))


def test_sample_is_bounded_and_deterministic(spark):
    rows = [(k, int(k % 4 == 0)) for k in range(400)] + [(1, 1), (None, 1), (7, None), (8, 5)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    got = labelled.sample_ids(labels, "doc_id", "toxic", F.lit(True), 10)
    first = sorted(map(tuple, got.collect()))
    assert len(first) == 20 and sum(y for _, y in first) == 10
    assert first == sorted(map(tuple, labelled.sample_ids(labels.orderBy(F.rand(3)), "doc_id", "toxic", F.lit(True), 10).collect()))


def test_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, 0), (1, 1)], "doc_id long, toxic int").withColumn("quality", F.col("toxic"))
    df = odd(spark)
    for m in (toxicity, quality):
        out = getattr(m, m.__name__.rpartition(".")[2])
        model = m.fit(df, labels, F.lit(True))
        got = out(df, model).collect()
        assert len(got) == 10 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1  # null is empty
        empty = m.fit(docs(spark, []), labels.limit(0), F.lit(True))
        assert [r.score for r in out(docs(spark, ["a b"]), empty).collect()] == [0.5]
        assert out(docs(spark, []), model).count() == 0


def test_folds_are_crc32_of_the_id_as_text(spark):
    import zlib

    got = spark.range(300).select("id", labelled.fold("id", 5).alias("a"), labelled.fold("id", 4).alias("b")).collect()
    assert all((r.a, r.b) == (zlib.crc32(str(r.id).encode()) % 5, zlib.crc32(str(r.id).encode()) % 4) for r in got)
