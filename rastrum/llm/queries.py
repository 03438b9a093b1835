"""One query for each operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html_extract, langid, mixing, neardup, ngram_join, packing, secrets, suffix, topk, toxicity

#: A word as rastrum.llm.text cuts it, in RE2 syntax.
WORD = r"[0-9A-Za-z_\x{AA}\x{B5}\x{BA}\x{C0}-\x{1FFF}\x{2040}-\x{2FFF}\x{3040}-\x{10FFFF}]+"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in the blocks that bring sources to their target weights."""
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret in every document, by format likelihood."""
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op3_toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that an induced lexicon finds toxic."""
    return toxicity.toxic_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that share most with each benchmark item."""
    return topk.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_related_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows that related documents fill."""
    return packing.pack(_read(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of the documents that are linked: whose sets of word trigrams have Jaccard similarity 0.5 or more."""
    return ngram_join.similar_documents(_read(spark, sf_dir, "documents"))


def op7_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every embedding, linked where the cosine similarity is 0.95 or more."""
    return neardup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op8_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language spans of every document and whether the document is accepted."""
    docs = _read(spark, sf_dir, "documents")
    return langid.spans(docs, langid.train(docs))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages of 50 words or more that documents share."""
    return suffix.repeats(_read(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(_read(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixture": op1_source_mixture,
    "op2_secret_scan": op2_secret_scan,
    "op3_toxic_documents": op3_toxic_documents,
    "op4_exact_topk": op4_exact_topk,
    "op5_related_packing": op5_related_packing,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_embedding_near_duplicates": op7_embedding_near_duplicates,
    "op8_language_spans": op8_language_spans,
    "op9_repeated_passages": op9_repeated_passages,
    "op10_html_text": op10_html_text,
}



def _grams(table: str, key: str) -> str:
    """SQL for the distinct word trigrams of each text."""
    return f"""SELECT DISTINCT {key} AS id, unnest(CASE WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS gram
  FROM (SELECT {key}, regexp_extract_all(lower(text), '{WORD}') AS ws FROM {table} WHERE {key} IS NOT NULL) WHERE len(ws) > 0"""


ORACLE_SQL: dict[str, str] = {
    "op1_source_mixture": mixing.oracle(),
    "op4_exact_topk": f"""
WITH g AS ({_grams("documents", "doc_id")}),
q AS ({_grams("benchmark", "item_id")}),
n AS (SELECT count(DISTINCT doc_id) AS n FROM documents WHERE text IS NOT NULL),
w AS (SELECT gram, greatest(1, CAST(round(1000 * ln(any_value(n.n) / count(*))) AS BIGINT)) AS weight FROM g, n WHERE gram IN (SELECT gram FROM q) GROUP BY gram),
s AS (SELECT q.id AS item_id, g.id AS doc_id, CAST(sum(weight) AS BIGINT) AS score FROM q JOIN w USING (gram) JOIN g USING (gram) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place, doc_id, score FROM s QUALIFY place <= 10""",
    "op6_ngram_jaccard_join": f"""
WITH RECURSIVE g AS ({_grams("documents", "doc_id")}),
n AS (SELECT id, count(*) AS size FROM g GROUP BY id),
o AS (SELECT x.id AS a, y.id AS b, count(*) AS overlap FROM g x JOIN g y ON x.gram = y.gram AND x.id < y.id GROUP BY ALL),
p AS (SELECT o.a, o.b FROM o JOIN n x ON x.id = o.a JOIN n y ON y.id = o.b WHERE overlap / (x.size + y.size - overlap) >= 0.5),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT DISTINCT a AS doc_id, a AS m FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.m),
c AS (SELECT doc_id, min(m) AS class_id FROM r GROUP BY doc_id)
SELECT doc_id, class_id, n_links FROM c JOIN (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a) USING (doc_id)""",
    "op7_embedding_near_duplicates": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id, vec_id AS m FROM v UNION SELECT r.vec_id, p.b FROM r JOIN p ON p.a = r.m),
c AS (SELECT vec_id, min(m) AS class_id FROM r GROUP BY vec_id)
SELECT vec_id, class_id, coalesce(n, 0) AS n_links FROM c LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a) USING (vec_id)""",
    "op9_repeated_passages": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT doc_id, unnest(range(len(ws) - 49)) AS p, unnest(list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i : i + 49], ' ')))) AS h FROM d WHERE len(ws) >= 50),
g AS (SELECT h, min(doc_id) AS a, max(doc_id) AS z, count(DISTINCT doc_id) AS n FROM s GROUP BY h HAVING a <> z),
b AS (SELECT s.h, min(s.doc_id) AS b FROM s JOIN g ON g.h = s.h AND s.doc_id > g.a GROUP BY s.h),
w AS (SELECT s.doc_id, s.p, n, CASE WHEN s.doc_id = a THEN b ELSE a END AS other FROM s JOIN g ON g.h = s.h JOIN b ON b.h = s.h),
r AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, other ORDER BY p) AS run FROM w)
SELECT doc_id, min(p) AS start_word, max(p) - min(p) + 50 AS n_words, other AS other_doc, max(n) AS n_docs FROM r GROUP BY doc_id, other, run""",
}
