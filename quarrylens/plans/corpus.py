"""Queries over the text tables: secrets, addresses, repeats across files, scattered values, unused names, cycles, the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions.columns import HTTP_URL, SECRET_TEXT, fingerprint, host_of, inert_host, low_value_number, squash
from quarrylens.operators.graph import strong_components
from quarrylens.operators.rules import by_value
from quarrylens.plans.base import Query, table

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def lines_of(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """lines(key, line, text), from 1."""
    return docs.select(key, F.posexplode(F.split("text", "\n")).alias("k", "text")).select(key, (F.col("k") + 1).alias("line"), "text")


def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of secrets in documents, the first of each identity. The file is filtered before it is cut into lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where(F.col("text").rlike(SECRET_TEXT))
    hits = lines_of(docs).where(F.col("text").rlike(SECRET_TEXT))
    rows = hits.select("doc_id", "line", F.lit("CI-14").alias("ci_id"), F.lit("critical").alias("severity"), F.concat(F.lit("documents/"), "doc_id").alias("path"), squash(F.col("text")).alias("content"))
    rows = rows.withColumn("fingerprint", fingerprint(F.col("ci_id"), F.lit("CI14_PLAINTEXT_SECRET"), F.col("path"), F.lit(""), F.col("content")))
    return rows.groupBy("fingerprint", "doc_id", "ci_id", "severity").agg(F.min("line").alias("line"))


_SECRET = r"""(?i)\b(?:api[_-]?key|secret|token|password)\b\s*[=:]\s*(?:''|")[0-9A-Za-z_-]{8,}(?:''|")"""
_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"
_SECRETS = f"""{_LINES},
h AS (SELECT doc_id, line, substr(sha256(concat_ws('|', 'CI-14', 'CI14_PLAINTEXT_SECRET', 'documents/' || doc_id, '', trim(regexp_replace(text, '\\s+', ' ', 'g')))), 1, 16) AS fingerprint FROM l WHERE regexp_matches(text, '{_SECRET}')),
g AS (SELECT fingerprint, doc_id, 'CI-14' AS ci_id, 'critical' AS severity, CAST(min(line) AS INTEGER) AS line FROM h GROUP BY 1, 2)"""


@query(f"WITH {_SECRETS} SELECT * FROM g")
def secret_lines_fingerprint(spark, sf_dir):
    return secret_findings(spark, sf_dir)


@query(f"WITH {_SECRETS} SELECT g.*, CASE WHEN count(*) OVER () > 0 THEN 'fail' ELSE 'pass' END AS decision FROM g")
def secret_gate(spark, sf_dir):
    """Which documents leak a secret, and does the gate fail?"""
    rows = secret_findings(spark, sf_dir)
    verdict = rows.agg(F.when(F.count_if(F.col("severity").isin("high", "critical")) > 0, "fail").otherwise("pass").alias("decision"))
    return rows.crossJoin(F.broadcast(verdict))


@query(r"""WITH u AS (SELECT page_id, unnest(list_concat(regexp_extract_all(url, '(?i)http://[\w.:/-]+'), regexp_extract_all(coalesce(html, ''), '(?i)http://[\w.:/-]+'))) AS url FROM pages), h AS (SELECT page_id, url, lower(regexp_extract(url, '(?i)^http://([^/:?#]*)', 1)) AS host FROM u)
SELECT page_id, url, host FROM h WHERE host NOT IN ('example.com', 'example.org', 'example.net', 'localhost') AND NOT regexp_matches(host, '\.(w3\.org|xmlsoap\.org|local|test|invalid|example|localhost)$')""")
def insecure_http_urls(spark, sf_dir):
    """Plain addresses of pages, their own and those in their text."""
    found = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(HTTP_URL), F.lit(0))
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.concat(found("url"), found("html"))).alias("url")).withColumn("host", host_of(F.col("url")))
    return rows.where(~inert_host(F.col("host")))


@query(f"""WITH {_LINES}, b AS (SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS shape, doc_id, line FROM l),
s AS (SELECT shape, list_sort(list(DISTINCT doc_id)) AS files, min(doc_id * 1000000 + line) AS pos FROM b WHERE length(shape) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2)
SELECT len(files) AS n_files, list_aggregate(files[1:3], 'string_agg', ',') AS files, count(*) AS shapes, min(pos) // 1000000 AS doc_id, CAST(min(pos) % 1000000 AS INTEGER) AS line FROM s GROUP BY files""")
def duplicate_file_sets(spark, sf_dir):
    """Lines of one shape in two documents or more, one row for each set of documents, at its first line."""
    b = lines_of(table(spark, sf_dir, "documents")).select(F.lower(squash(F.col("text"))).alias("value"), F.col("doc_id").alias("path"), "line").where(F.length("value") >= 40)
    none = F.lit(None).cast("string")
    rows = b.select("value", "path", "line", F.col("line").alias("ord"), *[none.alias(c) for c in ("excerpt", "symbol", "content", "name")], F.lit(None).cast("boolean").alias("flag"))
    sets = by_value(rows, 2).groupBy("n_files", "mark1", "mark2")
    out = sets.agg(F.first("files").alias("files"), F.count("*").alias("shapes"), F.min(F.struct("first.path", "first.line")).alias("at"))
    return out.select("n_files", F.array_join("files", ",").alias("files"), "shapes", F.col("at.path").alias("doc_id"), "at.line")


@query(r"""WITH n AS (SELECT doc_id, CAST(unnest(regexp_extract_all(text, '\b[0-9]{3,9}\b')) AS BIGINT) AS n FROM documents)
SELECT n AS number, count(DISTINCT doc_id) AS files, min(doc_id) AS first_doc FROM n WHERE n >= 256 AND n <> 1000 AND n & (n - 1) <> 0 AND n & (n + 1) <> 0 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3""")
def scattered_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b[0-9]{3,9}\b"), F.lit(0))).alias("number"))
    rows = rows.withColumn("number", F.col("number").cast("long"))
    return rows.where(~low_value_number(F.col("number"))).groupBy("number").agg(F.count_distinct("doc_id").alias("files"), F.min("doc_id").alias("first_doc")).where("files >= 3")


@query(r"""WITH n AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"\s]{7,})"', 1)) AS value FROM pages)
SELECT value, count(DISTINCT page_id) AS files, count(*) AS refs, min(page_id) AS first_page FROM n WHERE NOT starts_with(value, '/api/') GROUP BY 1 HAVING count(DISTINCT page_id) >= 3""")
def scattered_path_literals(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="(/[^"\s]{7,})"'), F.lit(1))).alias("value"))
    return rows.where(~F.col("value").startswith("/api/")).groupBy("value").agg(F.count_distinct("page_id").alias("files"), F.count("*").alias("refs"), F.min("page_id").alias("first_page")).where("files >= 3")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def dead_symbols(spark, sf_dir):
    """Definitions that nothing refers to: customers who are no user of an event."""
    uses = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(uses, "c_custkey", "left_anti")


_EDGES = "ed AS (SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events WHERE event_type = 'purchase') WHERE src <> dst)"


@query(f"""WITH RECURSIVE {_EDGES}, c AS (SELECT src, dst FROM ed UNION SELECT c.src, ed.dst FROM c JOIN ed ON c.dst = ed.src)
SELECT a.src AS node, least(min(a.dst), a.src) AS component FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src""")
def import_cycles(spark, sf_dir):
    """Strongly connected users, from each purchase to the next."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    # one order over all purchases is the table's own; the sequence is the example's stand-in for a graph, not part of the operator
    e = e.select(F.col("user_id").alias("src"), F.lead("user_id").over(Window.orderBy("ts", "event_id")).alias("dst"))
    return strong_components(e.where("src <> dst").distinct())
