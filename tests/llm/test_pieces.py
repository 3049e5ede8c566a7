"""SentencePiece against the library and against brute force."""

import struct

import numpy as np
import pytest
import sentencepiece

from quillon.llm import pieces, queries
from quillon.llm.scratch import table
from tests.llm.helpers import docs, odd

PATH = f"{queries.TOKENIZERS}/piece_bpe_32k.model"


def ids(data):
    return np.frombuffer(data, "<i4").tolist()


def field(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram(scores):
    """A model file with <unk> and these pieces."""
    out = field(1, field(1, b"<unk>") + field(2, 0.0) + field(3, 2))
    for p, s in scores.items():
        out += field(1, field(1, p.encode()) + field(2, float(s)))
    return out + field(2, field(3, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))


def test_bpe_equals_the_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    model = pieces.Model(pieces.read_model(PATH))
    texts = [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").select("text").collect()]
    texts += ["", " ", "  a  b ", "日本語 😀 \t tabs\n\n\nend ", "a" * 2000, "-----=====", "▁▁x ▁", "def f(x):\n        return  x", "\x00 ́"]
    got = model.encode(texts)
    assert [ids(g) for g in got] == lib.encode(texts)
    assert [model.decode(g) for g in got] == [t.replace("▁", " ") for t in texts]


def test_long_words_equal_the_library_and_one_pass(spark, monkeypatch):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    data = pieces.read_model(PATH)
    rng = np.random.default_rng(11)
    prose = "".join(r.text for r in table(spark, "/root/testdata/sf0.001", "documents").where("text IS NOT NULL").limit(40).select("text").collect()).replace("\n", "").replace(" ", "")
    letters = lambda of, n: "".join(rng.choice(list(of), n))
    texts = [prose[:30_000], "a" * 5001, "ab" * 3000, "-=" * 2048 + "-" * 4000, letters("abcdefghijklmnopqrstuvwxyz", 9000), letters("aAbB01+/", 7777), letters("日本語の文字列é😀x", 6000), letters("ton", 2049), "x" * 2048 + letters("er", 513)]
    want = [ids(x) for x in pieces.Model(data).encode(texts)]
    assert want == lib.encode(texts)
    monkeypatch.setattr(pieces, "LONG", 10**9)
    assert [ids(x) for x in pieces.Model(data).encode(texts[3:6])] == want[3:6]


def test_unigram_equals_brute_force_and_the_library():
    rng = np.random.default_rng(3)
    parts = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab", "bb", "▁bca", "aa"]
    data = unigram({p: -float(s) for p, s in zip(parts, rng.uniform(1, 9, len(parts)))})
    model, lib = pieces.Model(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    assert model.kind == pieces.UNIGRAM

    def best(word):
        found = {0: (0.0, [])}
        for end in range(1, len(word) + 1):
            ways = [(found[s][0] + model.scores[model.ids[word[s:end]]], [*found[s][1], model.ids[word[s:end]]]) for s in range(end) if word[s:end] in model.ids]
            found[end] = max(ways, key=lambda w: w[0])
        return found[len(word)][1]

    texts = ["".join(rng.choice(list("abc "), rng.integers(1, 30))) for _ in range(300)]
    got = [ids(g) for g in model.encode(texts)]
    total = lambda path: sum(model.scores[i] for i in path)
    for path, t in zip(got, texts):
        word = "▁" + t.replace(" ", "▁")
        assert "".join(model.pieces[i] for i in path) == word and total(path) == pytest.approx(total(best(word)))  # ways may tie
    want = lib.encode(texts)
    assert [total(x) for x in got] == pytest.approx([total(x) for x in want]) and sum(x == y for x, y in zip(got, want)) > 270
    assert ids(model.encode(["xx a"])[0]) == lib.encode("xx a")  # neighbouring unknown characters are one


def test_cache_turns_change_nothing():
    model = pieces.Model(pieces.read_model(PATH))
    texts = [f"word{k} other{k % 7} again" for k in range(500)]
    want = model.encode(texts)
    model.cache, model.older, model.cache_limit = {}, {}, 20
    assert [x for k in range(0, 500, 10) for x in model.encode(texts[k : k + 10])] == want


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Model(unigram({"a": -1.0}).replace(b"identity", b"nmt_nfkc"))


def test_operator(spark):
    model = pieces.read_model(PATH)
    df = odd(spark)
    got = {(r.doc_id, r.n_tokens): r for r in pieces.encode(df, model).collect()}
    assert all(r.round_trip for r in got.values())
    assert got[1, 0].ids == [] and len(got[4, 1].ids) == 1
    back = pieces.decode(pieces.encode(df.where("doc_id IS NOT NULL"), model), model)
    want = {r.doc_id: r.text or "" for r in df.where("doc_id IS NOT NULL").collect()}
    assert {r.doc_id: r.text for r in back.collect()} == want
    assert pieces.encode(docs(spark, []), model).count() == 0
    assert pieces.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), model).collect() == [(1, None), (2, "")]
