"""How the driver's tables stand in for scans: events become findings, suppliers become entries, spans and hunks, nations suppressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


KINDS = {
    "click": ("CI-03", "CI03_TODO_HACK", "low", "human-judgment"),
    "error": ("CI-21", "CI21_BROAD_EXCEPTION_SWALLOW", "medium", "native-static"),
    "purchase": ("CI-14", "CI14_INSECURE_HTTP", "critical", "native-static"),
    "signup": ("CI-22", "EXT_RUFF", "high", "external-analyzer"),
    "view": ("CI-21", "EXT_RUFF", "medium", "external-analyzer"),
}
FOLDERS = ("src/pkg/m%d.py", "tests/test_%d.py", "docs/n%d.md", "examples/e%d.py", "src/vendor/v%d.py", "notes%d.txt")


def user_path(user: Column) -> Column:
    out = None
    for k, shape in enumerate(FOLDERS):
        made = F.format_string(shape, user)
        out = F.when(user % 6 == k, made) if out is None else out.when(user % 6 == k, made)
    return out


def event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a raw finding."""
    kind = F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.struct(*[F.lit(y).alias(n) for y, n in zip(v, ("ci_id", "signal", "severity", "owner_lane"))]))])
    rows = table(spark, sf_dir, "events").select("event_id", user_path(F.col("user_id")).alias("path"), "event_type", (F.get_json_object("props", "$.k").cast("int") + 1).alias("line"), kind[F.col("event_type")].alias("f"), "user_id", "ts")
    ranks = F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type")).cast("int")
    return rows.select(
        "event_id", "path", "line", "f.*", F.lit("medium").alias("confidence"), F.lit("P2").alias("priority"), F.concat(F.lit("call "), F.col("event_id") % 7).alias("content"), F.lit("").alias("symbol"),
        F.concat(F.lit("seen: "), "event_type", F.lit(", 100% of "), F.col("user_id")).alias("reason"), F.concat(F.lit("x = "), "line").alias("excerpt"), F.lit("Mend it.").alias("recommended_action"),
        F.lit(0).alias("phase"), ranks.alias("rule_rank"), F.col("event_id").alias("ord"), "ts",
    )


def _case(k: int) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{t}' THEN '{v[k]}'" for t, v in KINDS.items()) + " END"


PATH_SQL = "CASE {u} % 6 " + " ".join(f"WHEN {k} THEN '{s.split('%d')[0]}' || {{u}} || '{s.split('%d')[1]}'" for k, s in enumerate(FOLDERS)) + " END"
CLASS_SQL = "CASE {u} % 6 WHEN 0 THEN 'runtime-source' WHEN 1 THEN 'tests' WHEN 2 THEN 'docs-evidence' WHEN 3 THEN 'fixtures' WHEN 4 THEN 'generated' ELSE 'support' END"
RAW_SQL = f"""raw AS (
  SELECT event_id, user_id, event_type, ts, {PATH_SQL.format(u="user_id")} AS path, {CLASS_SQL.format(u="user_id")} AS scope_class, CAST(json_extract(props, '$.k') AS INTEGER) + 1 AS line,
    {_case(0)} AS ci_id, {_case(1)} AS signal, {_case(2)} AS severity, {_case(3)} AS owner_lane, 'call ' || (event_id % 7) AS content,
    'seen: ' || event_type || ', 100% of ' || user_id AS reason, 'x = ' || (CAST(json_extract(props, '$.k') AS INTEGER) + 1) AS excerpt
  FROM events),
f AS (SELECT *, substr(sha256(concat_ws('|', ci_id, signal, path, '', content)), 1, 16) AS fingerprint FROM raw)"""
UNIQUE_SQL = f"""{RAW_SQL},
u AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY event_id) = 1)"""
SETTLED_SQL = f"""{UNIQUE_SQL},
s AS (
  SELECT * FROM u a
  WHERE NOT (owner_lane = 'native-static' AND EXISTS (
      SELECT 1 FROM u b WHERE b.owner_lane = 'external-analyzer' AND b.ci_id = a.ci_id AND b.path = a.path AND abs(b.line - a.line) <= 1))
    AND NOT (signal = 'CI14_INSECURE_HTTP' AND scope_class IN ('docs-evidence', 'tests', 'support')))"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A baseline entry for each supplier: by place, by file and rule, by file and line, or by the three; one by rule alone."""
    k, n = F.col("s_suppkey"), F.col("s_suppkey") % 4
    path = user_path(k % 150)
    line = (k % 100 + 1).cast("int")
    rows = table(spark, sf_dir, "supplier").select(
        k.cast("int").alias("ordinal"),
        F.when(n == 0, F.concat_ws("|", F.lit("CI-22"), path, line.cast("string"))).alias("fingerprint"),
        F.when(k == 1, "CI-03").when(n == 1, "CI-21").when(n == 3, "CI-14").alias("ci_id"),
        F.when((n > 0) & (k != 1), path).alias("target_file"),
        F.when(n >= 2, line).alias("line"),
    )
    return rows


ENTRIES_SQL = f"""e AS (
  SELECT CAST(s_suppkey AS INTEGER) AS ordinal,
    CASE WHEN s_suppkey % 4 = 0 THEN concat_ws('|', 'CI-22', {PATH_SQL.format(u="(s_suppkey % 150)")}, s_suppkey % 100 + 1) END AS e_fingerprint,
    CASE WHEN s_suppkey = 1 THEN 'CI-03' WHEN s_suppkey % 4 = 1 THEN 'CI-21' WHEN s_suppkey % 4 = 3 THEN 'CI-14' END AS e_ci,
    CASE WHEN s_suppkey % 4 > 0 AND s_suppkey <> 1 THEN {PATH_SQL.format(u="(s_suppkey % 150)")} END AS e_path,
    CASE WHEN s_suppkey % 4 >= 2 THEN CAST(s_suppkey % 100 + 1 AS INTEGER) END AS e_line
  FROM supplier)"""
MEANS_SQL = """(e_fingerprint IN (s.fingerprint, concat_ws('|', s.ci_id, s.path, s.line)) OR (
    (e_ci IS NULL OR e_ci = s.ci_id) AND (e_path IS NULL OR e_path = s.path) AND (e_line IS NULL OR e_line = s.line)
    AND (e_ci IS NOT NULL OR e_path IS NOT NULL OR e_line IS NOT NULL)))"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A definition for each supplier, in the file of a user."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(user_path(k % 15).alias("path"), (k % 40 + 1).cast("int").alias("line"), (k % 40 + 1 + k % 60).cast("int").alias("end_line"), "s_name", k.alias("ord")).withColumnRenamed("s_name", "name")


SPANS_SQL = f"sp AS (SELECT {PATH_SQL.format(u='(s_suppkey % 15)')} AS p, s_suppkey % 40 + 1 AS a, s_suppkey % 40 + 1 + s_suppkey % 60 AS b, s_name AS n, s_suppkey AS o FROM supplier)"
