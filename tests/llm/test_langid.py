"""Language identification: held-out accuracy and odd rows."""

from pyspark.sql import functions as F

from quillon.llm import langid, queries
from quillon.llm.scratch import table
from tests.llm.helpers import docs, odd


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = table(spark, sf, "documents").select("doc_id", "lang", F.length("text").alias("n"))
    got = queries.op3_language_id(spark, sf).join(truth, "doc_id").where("held_out AND n > 40")
    assert got.agg(F.avg(F.expr("int(lang = lang_pred)"))).first()[0] > 0.97
    assert got.where("score < 0 OR score > 1").count() == 0
    assert got.where("NOT rejected").agg(F.avg(F.expr("int(lang = lang_pred)"))).first()[0] > 0.98


def test_whole_text_decides():
    packer = langid.Packer({"de": b"der und nicht schon gewesen " * 20, "en": b"the and not already been " * 20}, langid.Settings())
    english, german = "the and not been already " * 100, "der und nicht gewesen schon " * 300
    assert packer.decide(english + german)[0] == "de"  # not the first block
    assert packer.decide(english)[0] == "en"


def test_odd_rows(spark):
    learned = {"en": b"hello the world and", "fr": b"bonjour le monde et"}
    got = {(r.doc_id, r.lang_pred) for r in langid.language_id(odd(spark), learned).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "und")} <= got
    assert langid.language_id(docs(spark, []), learned).count() == 0
    none = langid.language_id(docs(spark, ["text", "123 !?"]), {}).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)] * 2
    assert langid.fit(docs(spark, []), F.lit(True)) == {}
    assert set(langid.fit(odd(spark), F.lit(True))) == {"en"}


def test_ties_go_to_the_frequent_language(spark):
    df = docs(spark, ["abcdefgh"] * 5).withColumn("lang", F.when(F.col("doc_id") == 0, "aa").otherwise("zz"))
    learned = langid.fit(df, F.lit(True))
    assert [*learned] == ["zz", "aa"]
    r = langid.language_id(docs(spark, ["q"]), learned).first()
    assert (r.lang_pred, r.rejected) == ("zz", True)


def test_sizes_equal_plain_compression_of_each_block():
    import unicodedata

    import zstandard

    raw = {"hi": "हिन्दी में यह एक वाक्य है ".encode() * 9, "fr": "bonjour à tous les élèves ".encode() * 9}
    packer = langid.Packer(raw, langid.Settings(block=64))
    for text in ("हिन्दी में 12 लिखा है! " * 9, "Les élèves, bonjour. " * 20, "x"):
        kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
        data = "".join(c for k, c in enumerate(kept) if c != " " or k == 0 or kept[k - 1] != " ").encode()
        assert data == langid.letters(text)
        for lang, size in zip(raw, packer.sizes(text)):
            d = zstandard.ZstdCompressionDict(raw[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            assert size == sum(len(zstandard.ZstdCompressor(compression_params=langid.parameters(), dict_data=d).compress(data[i : i + 64])) for i in range(0, len(data), 64))
    assert langid.letters("हिन्दी में") == "हिन्दी में".encode()
    assert packer.decide("हिन्दी में 12 लिखा है")[0] == "hi"


def test_every_language_is_learned(spark):
    df = docs(spark, [f"text {k}" for k in range(1200)]).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id").cast("string")))
    assert len(langid.fit(df, F.lit(True))) == 1200
