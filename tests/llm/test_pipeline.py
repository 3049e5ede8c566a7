"""The pipeline: each stage on its own input, and the entry without the subpackage."""

import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillon.llm.scratch import cut, table
from tests.llm.helpers import PROSE, docs, odd
from tests.llm.test_decontaminate import brute as contaminated_by_brute_force
from tests.llm.test_dedup import brute as near_by_brute_force

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    df = table(spark, SF, "documents")
    columns = df.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = df
        df = cut(stage(spark, df, SF), name)
        kept[name] = df
        if name != "sentencepiece":
            assert df.columns == columns
            assert df.exceptAll(before).count() == 0  # rows are as they were
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}

    after = ids(kept["toxicity"])
    norm = lambda i: re.sub("[\x20\x09-\x0d]+", " ", texts[i])
    first = {}
    for i in sorted(after):
        first.setdefault(norm(i), i)
    assert ids(kept["exact_dedup"]) == set(first.values())
    component, _ = near_by_brute_force([(i, texts[i]) for i in ids(kept["exact_dedup"])])
    assert ids(kept["near_dedup"]) == {i for i, c in component.items() if i == c}
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    bad = {i for i, _ in contaminated_by_brute_force([(i, texts[i]) for i in ids(kept["near_dedup"])], items)}
    assert bad and ids(kept["decontamination"]) == ids(kept["near_dedup"]) - bad
    assert ids(kept["sentencepiece"]) == ids(kept["decontamination"])
    assert kept["sentencepiece"].where("NOT round_trip OR n_tokens <> size(ids)").count() == 0
    labels = table(spark, SF, "labels").where("toxic = 1")
    gone = labels.join(kept["toxicity"], "doc_id", "left_anti").count()
    assert gone > 0.8 * labels.count() and len(after) > 0.8 * len(texts)


def test_odd_rows(spark):
    df = docs(spark, [PROSE, PROSE, None, "", "x", PROSE + " more"], [3, 3, 4, 5, None, 9])
    out = corpus_pipeline.drop_copies(spark, df, SF)
    assert sorted((r.doc_id or -1, r.text or "") for r in out.collect()) == [(-1, "x"), (3, PROSE), (4, ""), (9, PROSE + " more")]
    assert corpus_pipeline.drop_near_copies(spark, out, SF).count() == 3
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs(spark, []), SF).count() == 0, name


def test_each_text_of_an_id_and_of_null_ids_is_judged_for_itself(spark):
    other = " ".join(f"o{k}" for k in range(30))
    df = docs(spark, [PROSE, PROSE, "a", "b", "b", other, other + " tail", "own text of nine", PROSE, "a  b", "a b"], [3, 3, None, None, None, 4, 9, 9, 9, 5, 5])
    out = cut(corpus_pipeline.drop_copies(spark, df, SF), "out")
    got = sorted((r.doc_id or -1, " ".join(r.text.split())) for r in out.collect())
    assert got == sorted([(3, PROSE), (-1, "a"), (-1, "b"), (4, other), (9, other + " tail"), (9, "own text of nine"), (5, "a b")])
    near = corpus_pipeline.drop_near_copies(spark, out, SF).collect()
    assert sorted((r.doc_id or -1, " ".join(r.text.split())) for r in near) == [x for x in got if x != (9, other + " tail")]


def test_without_labels_all_documents_stay(spark, monkeypatch):
    df = table(spark, SF, "documents")
    labels = {"none": "false", "null only": "true", "one class": "toxic = 0"}
    for rule in labels.values():
        some = table(spark, SF, "labels").where(rule)
        some = some.withColumn("toxic", F.lit(None).cast("int")) if rule == "true" else some
        monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, n, some=some: some)
        assert corpus_pipeline.drop_toxic(spark, df, SF).count() == df.count()


def test_clashing_columns_and_long_texts(spark):
    """Extra columns with names that stages use; a very long text; nulls."""
    df = odd(spark)
    for name, stage in corpus_pipeline.STAGES:
        if name != "toxicity":  # its model of the table's labels knows other ids
            out = cut(stage(spark, df, SF), name)
            if name != "sentencepiece":
                assert out.columns == df.columns and out.exceptAll(df).count() == 0
                df = out
            assert out.where("doc_id = 6").count() == 1
    assert {(r.doc_id, (r.text or "")[:5]) for r in df.collect()} == {(1, ""), (4, "Hello"), (5, "xxxxx"), (6, "w0 w1"), (None, "no id"), (7, "emoji"), (3, " \t\n")}  # the null text without id is a copy of the empty ones


def test_rest_of_the_library_does_not_import_it():
    root = Path(corpus_pipeline.__file__).parent
    for path in (root / "quillon").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text().replace("quillon.llm", "llm"), path
    code = "import sys, importlib.abc\nclass No(importlib.abc.MetaPathFinder):\n  def find_spec(self, n, p=None, t=None):\n    if n.startswith(('quillon.llm', 'corpus_pipeline')): raise ModuleNotFoundError(n)\nsys.meta_path.insert(0, No())\n"
    assert subprocess.run([sys.executable, "-c", code + "import quillon.session, quillon.registry as r; assert len(r.queries()) > 100"], cwd=root).returncode == 0
