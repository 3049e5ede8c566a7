"""Edit-aware counts against a full recount."""

import random

import regex
from pyspark.sql import functions as F

from quillon.llm import queries, token_counts as tc
from quillon.llm.scratch import cut, table
from tests.llm.helpers import docs, odd

with open(f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
    VOCABULARY = f.read()
COUNTER = tc.Counter(VOCABULARY)


def check(tree, text):
    assert tree.text == text
    words = COUNTER.pattern.findall(text)
    assert tree.total == len(COUNTER.encode(text)) and tree.chars[1] == len(text)
    assert [n for l, _ in tree.leaves for n in l] == [*map(len, words)]
    for i in range(1, tree.size):
        assert tree.tokens[i] == tree.tokens[2 * i] + tree.tokens[2 * i + 1]


def test_random_edits():
    rng = random.Random(5)
    parts = ["a", "'", "ll", " ", "  ", "\n", "x1", "!", "é", "'s ", "", "12"]
    make = lambda n: "".join(rng.choice(parts) for _ in range(rng.randrange(0, n)))
    for _ in range(3000):
        text = make(60)
        tree = tc.Tree(text, COUNTER, block=rng.choice([2, 3, 64]))
        for _ in range(2):
            at = sorted(rng.randrange(0, len(tree.text) + 1) for _ in range(2 * rng.randrange(0, 5)))
            edits = tc.legal_edits([(a, b, make(4)) for a, b in zip(at[::2], at[1::2])], len(tree.text))
            want = tree.text
            for a, b, new in reversed(edits):
                want = want[:a] + new + want[b:]
            tree.edit(edits)
            check(tree, want)


def test_only_the_neighbourhood_is_encoded():
    text = "some words and more words " * 4000
    tree = tc.Tree(text, COUNTER)
    tree.edit([(50_000, 50_003, "<X>")])
    assert tree.encoded < 12
    check(tree, text[:50_000] + "<X>" + text[50_003:])


def test_rules_on_the_table(spark):
    df = table(spark, "/root/testdata/sf0.001", "documents")
    got = {r.doc_id: r for r in tc.token_counts(df, VOCABULARY, rules=tc.REDACTIONS).collect()}
    rules = [(regex.compile(p), new) for p, new in tc.REDACTIONS]
    assert sum(r.n_edits for r in got.values()) > 10
    for r in df.select("doc_id", "text").collect():
        text = r.text
        for a, b, new in reversed(tc.found_edits(text, rules)):
            text = text[:a] + new + text[b:]
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_tokens_edited) == (len(COUNTER.encode(r.text)), len(COUNTER.encode(text)))


def test_given_edits_and_odd_rows(spark):
    edit = lambda a, b, new: F.struct(F.lit(a).cast("int").alias("start"), F.lit(b).cast("int").alias("end"), F.lit(new).cast("string").alias("new"))
    df = odd(spark).withColumn("e", F.array(edit(0, 2, "Ye"), edit(1, 3, "overlaps"), edit(None, 3, "x"), edit(90_000_000, 90_000_001, "!")))
    got = [(r.doc_id, r.n_tokens, r.n_edits, r.n_tokens_edited) for r in tc.token_counts(df, VOCABULARY, edits_col="e").collect()]
    assert got.count((4, 1, 2, len(COUNTER.encode("Yello!")))) == 2
    assert (1, 0, 3, len(COUNTER.encode("!Yeoverlaps"))) in got  # beyond the end means at the end
    assert len(got) == 10 and tc.token_counts(docs(spark, []), VOCABULARY).count() == 0


def test_stored_trees_take_later_edits(spark, monkeypatch):
    """Trees go to a table and back; what an edit does not touch is not encoded again."""
    text = "some words and more words " * 2000
    df = docs(spark, [text, None, "", "Hello world"])
    trees = cut(tc.token_trees(df, VOCABULARY), "trees")
    assert {r.doc_id: r.n_tokens for r in trees.collect()} == {0: len(COUNTER.encode(text)), 1: 0, 2: 0, 3: 2}
    edit = "array(named_struct('start', {}, 'end', {}, 'new', '{}'))"
    once = cut(tc.edited_trees(trees.withColumn("edits", F.expr(edit.format(5, 7, "XY"))), VOCABULARY), "trees")
    twice = {r.doc_id: r for r in tc.edited_trees(once.withColumn("edits", F.expr(edit.format(0, 1, "Q"))), VOCABULARY).collect()}
    want = {k: "Q" + (t[:5] + "XY" + t[7:])[1:] for k, t in enumerate([text, "", "", "Hello world"])}
    for k, r in twice.items():
        assert (r.text, r.n_tokens, sum(r.lens)) == (want[k], len(COUNTER.encode(want[k])), len(want[k]))
        assert r.n_reencoded < 8 and len(r.lens) == len(COUNTER.pattern.findall(want[k]))
    assert tc.token_trees(docs(spark, []), VOCABULARY).count() == 0
