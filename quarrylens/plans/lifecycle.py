"""Queries of the findings' life: identity, dedup, baseline, waivers, suppression, diff scope, summaries, gate, ratchet, emitters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions.columns import scope_class, severity_rank
from quarrylens.operators import findings as L
from quarrylens.operators import report as R
from quarrylens.plans.base import ENTRIES_SQL, MEANS_SQL, RAW_SQL, SETTLED_SQL, SPANS_SQL, UNIQUE_SQL, CLASS_SQL, PATH_SQL, Query, entries, event_findings, spans, table, user_path
from quarrylens.sinks import emit
from quarrylens.sources.settings import Operations

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def operations(spark: SparkSession, sf_dir: str) -> Operations:
    e = entries(spark, sf_dir)
    terms = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ordinal"), F.concat(F.lit("/m"), F.col("n_nationkey") * 18, F.lit(".py")).alias("match"))
    late = e.where(F.col("ordinal") >= 50).withColumn("waiver_id", F.concat(F.lit("W-"), "ordinal"))
    return Operations(e, late, terms)


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.settle(event_findings(spark, sf_dir))


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled findings under all operations, as a report has them; emitted is the event's number."""
    rows = L.apply_operations(settled(spark, sf_dir), operations(spark, sf_dir))
    external = F.col("owner_lane") == "external-analyzer"
    return rows.withColumns({"finding_id": F.concat(F.lit("F-"), "event_id"), "actor_label": F.when(external, "external-analyzer").otherwise("native-detected"), "target_file": F.col("path"), "emitted": F.col("event_id")})


OPERATED_SQL = f"""{SETTLED_SQL}, {ENTRIES_SQL},
kept AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM nation WHERE contains(s.path, '/m' || (n_nationkey * 18) || '.py') OR contains(s.reason, '/m' || (n_nationkey * 18) || '.py'))),
r AS (
  SELECT s.*, 'F-' || event_id AS finding_id, CASE WHEN owner_lane = 'external-analyzer' THEN 'external-analyzer' ELSE 'native-detected' END AS actor_label, 'medium' AS confidence, 'P2' AS priority,
    CASE WHEN EXISTS (SELECT 1 FROM e WHERE {MEANS_SQL}) THEN 'existing-baseline' ELSE 'new' END AS baseline_status,
    CASE WHEN EXISTS (SELECT 1 FROM e WHERE ordinal >= 50 AND {MEANS_SQL}) THEN 'active-waiver' ELSE 'none' END AS waiver_status,
    CASE WHEN EXISTS (SELECT 1 FROM e WHERE ordinal >= 50 AND {MEANS_SQL}) THEN 'accepted' ELSE 'open' END AS lifecycle_state,
    CASE WHEN EXISTS (SELECT 1 FROM e WHERE ordinal >= 50 AND {MEANS_SQL}) THEN 'accepted-residual' ELSE 'review-first' END AS triage_state
  FROM kept s)"""


@query(f"WITH {RAW_SQL} SELECT event_id, fingerprint FROM f")
def stable_fingerprints(spark, sf_dir):
    return L.identified(event_findings(spark, sf_dir)).select("event_id", "fingerprint")


@query(f"WITH {UNIQUE_SQL} SELECT event_id, fingerprint FROM u")
def exact_dedup(spark, sf_dir):
    return L.first_of_each(L.identified(event_findings(spark, sf_dir))).select("event_id", "fingerprint")


@query(f"WITH {UNIQUE_SQL} SELECT event_id, ci_id, path, line FROM u a WHERE NOT (owner_lane = 'native-static' AND EXISTS (SELECT 1 FROM u b WHERE b.owner_lane = 'external-analyzer' AND b.ci_id = a.ci_id AND b.path = a.path AND abs(b.line - a.line) <= 1))")
def cross_lane_dedup(spark, sf_dir):
    return L.without_covered(L.first_of_each(L.identified(event_findings(spark, sf_dir)))).select("event_id", "ci_id", "path", "line")


@query(f"WITH {SETTLED_SQL} SELECT event_id, scope_class FROM s")
def settled_findings(spark, sf_dir):
    return settled(spark, sf_dir).select("event_id", "scope_class")


@query(f"SELECT {CLASS_SQL.format(u='user_id')} AS scope_class, count(*) AS n FROM events GROUP BY 1")
def scope_class_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").select(scope_class(user_path(F.col("user_id"))).alias("scope_class")).groupBy("scope_class").agg(F.count("*").alias("n"))


@query(f"WITH {SETTLED_SQL}, {ENTRIES_SQL} SELECT event_id FROM s WHERE EXISTS (SELECT 1 FROM e WHERE {MEANS_SQL})")
def baseline_match(spark, sf_dir):
    rows = settled(spark, sf_dir)
    return rows.join(L.matches(rows, entries(spark, sf_dir)), "fingerprint", "left_semi").select("event_id")


@query(f"WITH {SETTLED_SQL}, {ENTRIES_SQL} SELECT ordinal, e_ci AS ci_id, e_path AS target_file, e_line AS line, 'resolved' AS lifecycle_state FROM e WHERE e_path IN (SELECT path FROM raw) AND NOT EXISTS (SELECT 1 FROM s WHERE {MEANS_SQL})")
def baseline_resolved(spark, sf_dir):
    raw = event_findings(spark, sf_dir)
    return L.resolved(entries(spark, sf_dir), L.settle(raw), raw.select("path")).drop("fingerprint")


@query(f"WITH {SETTLED_SQL}, {ENTRIES_SQL} SELECT event_id, 'W-' || min(ordinal) AS waiver_id FROM s JOIN e ON {MEANS_SQL} GROUP BY 1")
def waiver_first_match(spark, sf_dir):
    rows = settled(spark, sf_dir)
    hits = L.matches(rows, entries(spark, sf_dir).withColumn("waiver_id", F.concat(F.lit("W-"), "ordinal")), "waiver_id")
    return rows.select("event_id", "fingerprint").join(hits, "fingerprint").select("event_id", "waiver_id")


@query(f"WITH {OPERATED_SQL} SELECT event_id, baseline_status, waiver_status, lifecycle_state, triage_state FROM r")
def operations_applied(spark, sf_dir):
    return reported(spark, sf_dir).select("event_id", "baseline_status", "waiver_status", "lifecycle_state", "triage_state")


@query(f"""WITH {RAW_SQL}, {SPANS_SQL}
SELECT event_id, coalesce((SELECT n FROM sp WHERE p = f.path AND f.line BETWEEN a AND b ORDER BY b - a, o LIMIT 1), '') AS symbol FROM f""")
def innermost_span(spark, sf_dir):
    return L.innermost(event_findings(spark, sf_dir).select("event_id", "path", "line"), spans(spark, sf_dir), ["event_id"]).select("event_id", "symbol")


@query(f"""WITH {RAW_SQL}, {SPANS_SQL},
h AS (SELECT {PATH_SQL.format(u="(s_suppkey % 30)")} AS hp, s_suppkey % 90 + 1 AS h1, s_suppkey % 90 + 1 + s_suppkey % 3 AS h2 FROM supplier),
d AS (SELECT p, a, max(b) AS last FROM sp GROUP BY 1, 2)
SELECT event_id FROM (SELECT f.*, coalesce(last, line) AS last FROM f LEFT JOIN d ON p = path AND a = line) x WHERE EXISTS (SELECT 1 FROM h WHERE hp = x.path AND x.line <= h2 AND h1 <= x.last)""")
def changed_span_overlap(spark, sf_dir):
    k = F.col("s_suppkey")
    hunks = table(spark, sf_dir, "supplier").select(user_path(k % 30).alias("path"), (k % 90 + 1).cast("int").alias("start"), (k % 90 + 1 + k % 3).cast("int").alias("end"))
    return L.changed_only(event_findings(spark, sf_dir), spans(spark, sf_dir), hunks).select("event_id")


_DIMS = ("severity", "confidence", "actor_label", "triage_state", "priority", "baseline_status", "lifecycle_state", "owner_lane", "scope_class")


@query(f"WITH {OPERATED_SQL} " + " UNION ALL ".join(f"SELECT 'by_{d}' AS dimension, {d} AS value, count(*) AS n FROM r GROUP BY 2" for d in _DIMS) + " UNION ALL SELECT 'by_scope_policy', CASE WHEN scope_class = 'runtime-source' THEN 'gated' ELSE 'advisory' END, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'advisory_by_scope_class', scope_class, count(*) FROM r WHERE scope_class <> 'runtime-source' GROUP BY 2")
def summary_counts(spark, sf_dir):
    return R.count_by(reported(spark, sf_dir))


@query(f"""WITH {OPERATED_SQL} SELECT count(*) AS total_findings, count(*) FILTER (waiver_status <> 'none') AS waived_count, count(*) FILTER (baseline_status = 'new') AS new_count, count(*) FILTER (baseline_status <> 'new') AS existing_baseline_count,
count(*) FILTER (severity IN ('high', 'critical') AND waiver_status = 'none' AND scope_class = 'runtime-source') AS blocker_count, count(*) FILTER (triage_state = 'accepted-residual') AS residual_count FROM r""")
def summary_totals(spark, sf_dir):
    return R.totals(reported(spark, sf_dir))


@query(f"""WITH {OPERATED_SQL}, g AS (SELECT * FROM r WHERE scope_class = 'runtime-source' AND waiver_status = 'none'),
w AS (SELECT 1 AS k, 'severity-threshold' AS reason, count(*) AS n FROM g WHERE severity IN ('high', 'critical') UNION ALL SELECT 2, 'new-findings-present', count(*) FROM g WHERE baseline_status = 'new'
  UNION ALL SELECT 3, 'unreviewed-review-required', count(*) FROM g WHERE baseline_status = 'new' AND owner_lane = 'human-judgment' UNION ALL SELECT 4, 'analyzer-runtime-error', 1)
SELECT CASE WHEN sum(n) > 0 THEN 'fail' ELSE 'pass' END AS decision, CAST(max(n) FILTER (k = 1) AS INTEGER) AS blocking_count, CAST(max(n) FILTER (k = 3) AS INTEGER) AS unreviewed, string_agg(reason || ':' || n, ', ' ORDER BY k) FILTER (n > 0) AS reasons FROM w""")
def gate_decision(spark, sf_dir):
    policy = R.GatePolicy("high", True, True, True)
    one = R.gate(reported(spark, sf_dir), policy, ["mypy"])
    said = F.array_join(F.transform("reason_details", lambda x: F.concat_ws(":", x["reason"], x["count"].cast("string"))), ", ")
    return one.select("decision", "blocking_count", F.col("unreviewed_review_required_count").alias("unreviewed"), said.alias("reasons"))


@query(f"WITH {OPERATED_SQL} SELECT 'B-' || finding_id AS blocker_id, severity, path AS target_file, line FROM r WHERE scope_class = 'runtime-source' AND waiver_status = 'none' AND severity IN ('high', 'critical')")
def blockers(spark, sf_dir):
    return R.blockers(reported(spark, sf_dir), R.GatePolicy()).select("blocker_id", "severity", "target_file", "line")


@query(f"WITH {OPERATED_SQL} SELECT 'R-' || finding_id AS residual_id, path AS target_file, line FROM r WHERE triage_state = 'accepted-residual'")
def residuals(spark, sf_dir):
    return R.residuals(reported(spark, sf_dir)).select("residual_id", "target_file", "line")


@query(f"WITH {OPERATED_SQL} SELECT path AS name, count(*) AS count FROM r GROUP BY 1 ORDER BY count(*) DESC, min(event_id) LIMIT 5")
def top_files(spark, sf_dir):
    return R.top_counts(reported(spark, sf_dir), "target_file")


@query(f"WITH {OPERATED_SQL} SELECT event_id, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS rank FROM r ORDER BY rank DESC, event_id")
def severity_order(spark, sf_dir):
    return R.by_severity(reported(spark, sf_dir)).select("event_id", severity_rank(F.col("severity")).alias("rank"))


@query(f"WITH {OPERATED_SQL} SELECT event_id FROM r WHERE scope_class IN ('tests', 'fixtures') AND owner_lane = 'external-analyzer'")
def report_view(spark, sf_dir):
    return R.view(reported(spark, sf_dir), ["tests", "fixtures"], ["external-analyzer"]).select("event_id")


@query(f"""WITH {RAW_SQL}, old AS (SELECT ci_id, count(*) AS n FROM raw WHERE ts < TIMESTAMP '2024-01-13' GROUP BY 1), new AS (SELECT ci_id, count(*) AS n FROM raw WHERE ts >= TIMESTAMP '2024-01-13' GROUP BY 1)
SELECT ci_id, coalesce(old.n, 0) AS previous, new.n AS current, new.n - coalesce(old.n, 0) AS delta FROM new LEFT JOIN old USING (ci_id) WHERE new.n > coalesce(old.n, 0)""")
def ratchet_violations(spark, sf_dir):
    rows = event_findings(spark, sf_dir).withColumn("waiver_status", F.lit("none"))
    cut = F.lit("2024-01-13").cast("timestamp_ntz")
    at = F.col("ts").cast("timestamp_ntz")
    return R.ratchet_violations(R.counts_by_rule(rows.where(at >= cut)), R.counts_by_rule(rows.where(at < cut)))


@query(f"""WITH {OPERATED_SQL} SELECT event_id, '::' || CASE WHEN scope_class <> 'runtime-source' THEN 'notice' WHEN severity IN ('high', 'critical') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'notice' END || ' file=' || path || ',line=' || line || ',title=' || ci_id || ' ' || signal || '::'
|| CASE WHEN scope_class <> 'runtime-source' THEN 'advisory-only (' || scope_class || '): ' ELSE '' END || replace(reason, '%', '%25') AS annotation FROM r""")
def annotations(spark, sf_dir):
    return emit.annotations(reported(spark, sf_dir)).withColumnRenamed("emitted", "event_id")


@query(f"""WITH {OPERATED_SQL} SELECT event_id, '  {{ fingerprint = "' || fingerprint || '", ci_id = "' || ci_id || '", target_file = "' || path || '" }},' AS entry FROM r""")
def baseline_toml(spark, sf_dir):
    rows = reported(spark, sf_dir)
    return emit.baseline_entries(rows).join(rows.select("fingerprint", "event_id"), "fingerprint").select("event_id", "entry")


@query(f"""WITH {OPERATED_SQL} SELECT event_id, signal AS rule_id, CASE WHEN scope_class <> 'runtime-source' THEN 'note' WHEN severity IN ('high', 'critical') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, path AS uri, CAST(line AS INTEGER) AS start_line FROM r""")
def sarif_results(spark, sf_dir):
    rows = emit.sarif_results(reported(spark, sf_dir))
    at = lambda p: F.get_json_object("result", p)
    return rows.select(F.col("emitted").alias("event_id"), "rule_id", at("$.level").alias("level"), at("$.locations[0].physicalLocation.artifactLocation.uri").alias("uri"), at("$.locations[0].physicalLocation.region.startLine").cast("int").alias("start_line"))


@query(f"WITH {OPERATED_SQL} SELECT signal AS rule_id, arg_min(ci_id, event_id) AS name, arg_min(reason, event_id) AS said FROM r GROUP BY 1")
def sarif_rules(spark, sf_dir):
    at = lambda p: F.get_json_object("rule", p)
    return emit.sarif_rules(reported(spark, sf_dir)).select("rule_id", at("$.name").alias("name"), at("$.shortDescription.text").alias("said"))
