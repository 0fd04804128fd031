"""Queries of evaluation: precision, label coverage, review samples, density, overlap with another tool, scorecards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators import evaluate as E
from quarrylens.plans.base import RAW_SQL, Query, event_findings, table

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def doc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as findings of a rule by language, of a project by source."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("fingerprint"), "doc_id", F.col("lang").alias("ci_id"), F.col("source").alias("project"), F.format_string("d%09d", "doc_id").alias("target_file"), F.lit(1).alias("line"), F.col("doc_id").alias("emitted"))


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("fingerprint"), F.when(F.col("toxic") == 1, "skip").when(F.col("quality") == 1, "true-positive").otherwise("false-positive").alias("label"), F.lit("").alias("notes"))


_L = "lb AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'skip' WHEN quality = 1 THEN 'true-positive' ELSE 'false-positive' END AS label FROM labels)"


@query(f"""WITH {_L}, x AS (SELECT d.lang AS ci_id, coalesce(label, '') AS label FROM documents d LEFT JOIN lb USING (doc_id)), a AS (SELECT ci_id, CAST(grouping(ci_id) AS INTEGER) AS is_total, count(*) FILTER (label = 'true-positive') AS true_positive, count(*) FILTER (label = 'false-positive') AS false_positive, count(*) FILTER (label = 'skip') AS skipped, count(*) FILTER (label = '') AS unlabeled, count(*) AS total FROM x GROUP BY ROLLUP (ci_id))
SELECT *, CASE WHEN true_positive + false_positive > 0 THEN CAST(true_positive AS DOUBLE) / CAST(true_positive + false_positive AS DOUBLE) END AS precision, CAST(total - unlabeled AS DOUBLE) / CAST(total AS DOUBLE) AS label_coverage FROM a""")
def labeled_precision(spark, sf_dir):
    return E.precision(doc_rows(spark, sf_dir), doc_labels(spark, sf_dir)).withColumn("is_total", F.col("is_total").cast("int"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabeled(spark, sf_dir):
    return E.unlabelled(doc_rows(spark, sf_dir), doc_labels(spark, sf_dir), None).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY source, doc_id LIMIT 10")
def unlabeled_samples(spark, sf_dir):
    return E.unlabelled(doc_rows(spark, sf_dir), doc_labels(spark, sf_dir)).select("doc_id")


@query("SELECT CAST(c_custkey AS VARCHAR) AS fingerprint FROM customer WHERE c_custkey NOT IN (SELECT doc_id FROM documents)")
def unknown_labels(spark, sf_dir):
    """Labels that no finding has: customers' numbers against documents'."""
    return E.unknown_labels(doc_rows(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("fingerprint")))


@query(f"WITH {_L} SELECT CAST(d.doc_id AS VARCHAR) AS fingerprint, d.source AS project, coalesce(label, '') AS label FROM documents d LEFT JOIN lb USING (doc_id)")
def label_template(spark, sf_dir):
    return E.label_template(doc_rows(spark, sf_dir), doc_labels(spark, sf_dir)).select("fingerprint", "project", "label")


@query("""WITH t AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS turn FROM documents) SELECT doc_id, lang FROM t QUALIFY row_number() OVER (PARTITION BY lang ORDER BY turn, source) <= 25""")
def round_robin_review(spark, sf_dir):
    return E.round_robin(doc_rows(spark, sf_dir), 25).select("doc_id", F.col("ci_id").alias("lang"))


@query("""WITH k AS (SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 3), s AS (SELECT lang, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS samples FROM k GROUP BY 1)
SELECT lang AS ci_id, count(*) AS n, count(DISTINCT source || '/' || doc_id) AS files, any_value(samples) AS samples FROM documents JOIN s USING (lang) GROUP BY 1""")
def density_samples(spark, sf_dir):
    return E.density(doc_rows(spark, sf_dir)).withColumn("samples", F.array_join(F.transform("samples", lambda x: x["emitted"].cast("string")), ","))


_CODES = {"F": "CI-07", "S": "CI-14", "B": "CI-21", "TD": "CI-03", "PLW": "CI-02"}


@query(f"""WITH {RAW_SQL}, o AS (SELECT 'src/pkg/m' || (6 * (s_suppkey % 25)) || '.py' AS p, s_suppkey % 100 + 1 AS l, CASE s_suppkey % 5 WHEN 0 THEN 'F' WHEN 1 THEN 'S' WHEN 2 THEN 'B' WHEN 3 THEN 'TD' ELSE 'PLW' END AS letters FROM supplier),
h AS (SELECT event_id, ci_id, letters || '101' AS code, CASE letters {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _CODES.items())} END = ci_id AS same FROM raw JOIN o ON p = path AND abs(l - line) <= 1),
m AS (SELECT ci_id, count(*) AS colocated, count(*) FILTER (same) AS duplicates FROM (SELECT ci_id, event_id, bool_or(same) AS same FROM h GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT ci_id, code, count(*) AS n, min(event_id) AS first FROM h GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY ci_id ORDER BY count(*) DESC, min(event_id), code) <= 4),
g AS (SELECT ci_id, string_agg(code, ',' ORDER BY n DESC, first, code) AS top_codes FROM t GROUP BY 1)
SELECT ci_id, count(*) AS total, coalesce(any_value(colocated), 0) AS colocated, coalesce(any_value(duplicates), 0) AS duplicates, CAST(round_even(100.0::DOUBLE * (count(*) - coalesce(any_value(duplicates), 0)) / count(*), 0) AS INTEGER) AS unique_category_pct, coalesce(any_value(top_codes), '') AS top_codes
FROM raw LEFT JOIN m USING (ci_id) LEFT JOIN g USING (ci_id) GROUP BY 1""")
def differentiation_pct(spark, sf_dir):
    rows = event_findings(spark, sf_dir).select("ci_id", F.col("event_id").alias("emitted"), F.col("path").alias("target_file"), "line")
    k = F.col("s_suppkey")
    code = F.element_at(F.array(*[F.lit(f"{c}101") for c in _CODES]), (k % 5 + 1).cast("int"))
    others = table(spark, sf_dir, "supplier").select(F.format_string("src/pkg/m%d.py", (k % 25) * 6).alias("target_file"), (k % 100 + 1).cast("int").alias("line"), code.alias("code"))
    return E.differentiation(rows, others).withColumn("top_codes", F.array_join("top_codes", ","))


@query("""WITH e AS (SELECT n_name AS signal, n_regionkey < 3 AS wanted FROM nation), d AS (SELECT DISTINCT n_name AS signal FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000))
SELECT count(*) FILTER (wanted AND signal IN (FROM d)) AS met, coalesce(string_agg(signal, ',' ORDER BY signal) FILTER (wanted AND signal NOT IN (FROM d)), '') AS missed, coalesce(string_agg(signal, ',' ORDER BY signal) FILTER (NOT wanted AND signal IN (FROM d)), '') AS unwanted FROM e""")
def scorecard(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    expected = n.select(F.col("n_name").alias("signal"), (F.col("n_regionkey") < 3).alias("wanted"))
    seen = n.join(s.where("s_acctbal > 5000"), F.col("n_nationkey") == F.col("s_nationkey"), "left_semi").select(F.col("n_name").alias("signal"))
    return E.scorecard(expected, seen).withColumns({c: F.array_join(c, ",") for c in ("missed", "unwanted")})


@query("""SELECT *, CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) AS recall, CAST(fp AS DOUBLE) / CAST(fp + tn AS DOUBLE) AS false_positive_rate FROM (
SELECT count(*) FILTER (quality = 1 AND n_chars > 2000) AS tp, count(*) FILTER (quality = 1 AND NOT n_chars > 2000) AS fn, count(*) FILTER (quality = 0 AND n_chars > 2000) AS fp, count(*) FILTER (quality = 0 AND NOT n_chars > 2000) AS tn FROM labels JOIN documents USING (doc_id))""")
def confusion(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return E.confusion(rows.select(F.col("doc_id").alias("case_id"), (F.col("quality") == 1).alias("positive"), (F.col("n_chars") > 2000).alias("hit")))


@query("SELECT count(*) AS findings, (SELECT CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) FROM documents) AS lines, CAST(count(*) * 1000 AS DOUBLE) / CAST((SELECT sum(len(string_split(text, chr(10)))) FROM documents) AS DOUBLE) AS per_1000_lines FROM events")
def noise_per_1000_lines(spark, sf_dir):
    return E.noise(table(spark, sf_dir, "events"), table(spark, sf_dir, "documents"))
