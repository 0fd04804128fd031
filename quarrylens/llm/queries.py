"""Registered queries of the corpus operators: each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.bpe import bpe_encode
from quarrylens.llm.ctw import code_lengths
from quarrylens.llm.jaccard import jaccard_classes
from quarrylens.llm.langid import identify, train_pieces
from quarrylens.llm.licences import license_spans
from quarrylens.llm.mixing import EPOCHS, mix_sources, temperature_weights
from quarrylens.llm.passages import substring_repeats
from quarrylens.llm.perplexity import perplexity_bands
from quarrylens.llm.permutation import nearest
from quarrylens.llm.quality import classify


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and the text they decode to."""
    return bpe_encode(_read(spark, sf_dir, "documents"), keep=["doc_id"])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, score, margin and acceptance of every document."""
    docs = _read(spark, sf_dir, "documents")
    return identify(docs, train_pieces(docs), keep=["doc_id"])


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of every document that repeat a paragraph another place keeps."""
    return substring_repeats(_read(spark, sf_dir, "documents"))


def op4_perplexity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document, the band of its language and length, and whether it lies in it."""
    return perplexity_bands(_read(spark, sf_dir, "documents"))


def op5_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality posterior of every document from its own evidence and its host's and path's shares."""
    return classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all sources at flattened weights: every document, whole, with its shard, block and place, those of scarce sources repeated."""
    docs = _read(spark, sf_dir, "documents")
    return mix_sources(docs, temperature_weights(docs, nulls=True), epochs=EPOCHS)


def op7_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest neighbours, among all vectors, of each whose id is divisible by 20."""
    return nearest(_read(spark, sf_dir, "embeddings"), queries=F.col("id") % 20 == 0)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document, by links of Jaccard 0.6 or more between sets of word 3-grams."""
    return jaccard_classes(_read(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices and texts in all documents."""
    return license_spans(_read(spark, sf_dir, "documents"))


def op10_context_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code length a byte of every document under the corpus's context trees."""
    return code_lengths(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_language_id": op2_language_id,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_perplexity_bands": op4_perplexity_bands,
    "op5_quality_bayes": op5_quality_bayes,
    "op6_source_mixing": op6_source_mixing,
    "op7_permutation_index": op7_permutation_index,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_license_scan": op9_license_scan,
    "op10_context_trees": op10_context_trees,
}

ORACLE_SQL: dict[str, str] = {
    "op8_ngram_jaccard": """
WITH RECURSIVE t AS (
  SELECT doc_id, text, list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0b\\f\\r\\x1c-\\x1f]+'), lambda x: x <> '') AS w
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
held AS (SELECT text, any_value(w) AS w, count(*) AS copies, min(doc_id) AS first FROM t WHERE len(w) > 0 GROUP BY text),
g AS (
  SELECT DISTINCT text, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
  FROM held),
n AS (SELECT text, count(*) AS n FROM g GROUP BY text),
p AS (SELECT a.text AS a, b.text AS b, count(*) AS both_n FROM g a JOIN g b ON a.g = b.g AND a.text <> b.text GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN n x ON x.text = a JOIN n y ON y.text = b
  WHERE CAST(both_n AS DOUBLE) / CAST(x.n + y.n - both_n AS DOUBLE) >= 0.6),
reach AS (SELECT text AS a, text AS b FROM held UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
class AS (SELECT r.a AS text, min(h.first) AS class_id FROM reach r JOIN held h ON h.text = r.b GROUP BY r.a),
also AS (SELECT l.a AS text, sum(h.copies) AS n FROM links l JOIN held h ON h.text = l.b GROUP BY l.a)
SELECT i.doc_id, min(coalesce(c.class_id, i.doc_id)) AS class_id, CAST(sum(coalesce(h.copies - 1 + coalesce(o.n, 0), 0)) AS BIGINT) AS links
FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL) i
LEFT JOIN held h ON h.text = i.text LEFT JOIN class c ON c.text = i.text LEFT JOIN also o ON o.text = i.text
GROUP BY i.doc_id
""",
}
