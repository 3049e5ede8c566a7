"""The registered queries of this subpackage: queries() and oracle_sql()."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import chat, langid, pieces, token_counts
from quillon.llm import quality as quality_model
from quillon.llm import toxicity as toxicity_model
from quillon.llm.decontaminate import contaminated
from quillon.llm.exact_dedup import exact_dedup
from quillon.llm.lm_scoring import lm_scores
from quillon.llm.near_dedup import Settings, near_dedup
from quillon.llm.scratch import table


#: Where the public tokenizers' files are; each query takes another folder as a parameter.
TOKENIZERS = "/opt/tokenizers"


def op1_sentencepiece(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    model = pieces.read_model(f"{tokenizers}/piece_bpe_32k.model")
    return pieces.encode(table(spark, sf_dir, "documents"), model).select("doc_id", "n_tokens", "ids_sha256", "round_trip")


def op2_token_counts(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    with open(f"{tokenizers}/byte_bpe_50k.tiktoken", "rb") as f:
        vocabulary = f.read()
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary, rules=token_counts.REDACTIONS)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out()
    out = langid.language_id(docs, langid.fit(docs, ~held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = toxicity_model.held_out()
    out = toxicity_model.toxicity(docs, toxicity_model.fit(docs, labels, ~held))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def op5_lm_scoring(spark: SparkSession, sf_dir: str, target_source: str = "src3") -> DataFrame:
    """The target is one source's documents, as a curated source would be."""
    docs = table(spark, sf_dir, "documents")
    return lm_scores(docs, F.col("source") == target_source)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = quality_model.held_out()
    out = quality_model.quality(docs, quality_model.fit(docs, labels, ~held))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.format_chats(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "role_out", "action", "inserted", F.length("rendered").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "start", "n_words")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), settings=Settings(words=4))  # what its contract fixes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


OP7_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


OP9_SQL = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS w FROM benchmark),
i AS (SELECT item_id, w, least(len(w), 5) AS n FROM iw WHERE len(w) > 0),
il AS (SELECT item_id, n, len(w) - n + 1 AS k, list_transform(generate_series(1, len(w) - n + 1), lambda x: array_to_string(w[x:x + n - 1], ' ')) AS l FROM i),
it AS (SELECT item_id, n, k, unnest(l) AS sh, generate_subscripts(l, 1) AS q FROM il),
itc AS (SELECT item_id, sh, count(*) AS c FROM it GROUP BY ALL),
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS w FROM documents),
dl AS (SELECT doc_id, n, list_transform(generate_series(1, len(w) - n + 1), lambda x: array_to_string(w[x:x + n - 1], ' ')) AS l FROM dw, (SELECT DISTINCT n FROM i)),
pos AS (SELECT doc_id, n, unnest(l) AS sh, generate_subscripts(l, 1) AS p FROM dl),
place AS (SELECT DISTINCT doc_id, item_id, n, k, unnest(generate_series(greatest(p - k + 1, 1), p)) AS s FROM pos JOIN it USING (n, sh)),
near AS (SELECT DISTINCT doc_id, n FROM place),
part AS (SELECT pos.* FROM pos JOIN near USING (doc_id, n)),
win AS (SELECT doc_id, item_id, n, k, s, sh, count(*) AS c FROM place JOIN part USING (doc_id, n) WHERE p BETWEEN s AND s + k - 1 GROUP BY ALL),
sim AS (SELECT doc_id, item_id, n, k, s, sum(win.c) AS size, sum(least(win.c, coalesce(itc.c, 0))) AS common FROM win LEFT JOIN itc USING (item_id, sh) GROUP BY ALL),
best AS (SELECT doc_id, item_id, common / (k + size - common) AS similarity, s - 1 AS start, k + n - 1 AS n_words FROM sim
         QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY common / (k + size - common) DESC, s) = 1)
SELECT doc_id, item_id, CAST(similarity AS DOUBLE) AS similarity, CAST(start AS INTEGER) AS start, CAST(n_words AS INTEGER) AS n_words FROM best WHERE similarity >= 0.8
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, CASE WHEN len(ws) = 0 THEN 0 ELSE greatest(len(ws) - 3, 1) END), lambda i: array_to_string(ws[i:i + 3], ' '))) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 80 * (a.n + b.n - common)),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, y FROM reach JOIN edge ON r = x),
comp AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.c, documents.doc_id) AS component_id, documents.doc_id = coalesce(comp.c, documents.doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": OP7_SQL, "op9_decontaminate": OP9_SQL, "op10_near_dedup": OP10_SQL}
