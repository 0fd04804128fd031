"""Queries of what lies around the rules: trees, diffs, settings, domains, tools, views, checks of reports, sinks, streams."""

from __future__ import annotations

import ast
import json
import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators import catalog
from quarrylens.operators import findings as L
from quarrylens.operators import report as R
from quarrylens.operators.adapters import outcome, readiness
from quarrylens.operators.scan import scan_files
from quarrylens.plans.base import CLASS_SQL, PATH_SQL, Query, event_findings, table, user_path
from quarrylens.plans.lifecycle import OPERATED_SQL, SETTLED_SQL, reported
from quarrylens.runtime import materialize, shared_path
from quarrylens.sinks import emit, review
from quarrylens.sources import settings
from quarrylens.sources.diff import hunks_of
from quarrylens.sources.domains import load_domain
from quarrylens.sources.tree import ignore_patterns, preset_filters, read_tree, select_targets
from quarrylens.streaming.ratchet import ratchet_stream, scan_stream

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@contextmanager
def folder() -> Iterator[Path]:
    """A folder of the driver for the files of an example, which are read before it goes."""
    at = Path(tempfile.mkdtemp(prefix="ql-example-"))
    try:
        yield at
    finally:
        shutil.rmtree(at)


# Trees: a file or two for each supplier, of eleven kinds in turn.
KINDS = (
    ("src/a{k}.py", b"x = 1\r\ny = 2\r", None, 12), ("src/node_modules/b{k}.js", b"x\n", "generated-path-skipped", None), ("docs/c{k}.md", b"# c\n", "", None), ("src/d{k}.bin", b"d", "unsupported-suffix", None),
    ("src/e{k}.py", b"e" * 3000, "max-file-size-exceeded", None), ("src/f{k}.py", b"f\x00f", "binary-skipped", None), ("Dockerfile.{k}/Dockerfile", b"FROM a\n", None, 7), ("src/ignored/h{k}.py", b"h\n", "", None),
    ("src/i{k}.py", b"caf\xc3\xa9 \xff!", None, 6), ("src/.j{k}.toml", b"j = 1\n", None, 6), ("src/l{k}.py", None, "symlink-skipped", None),
)


@query("SELECT path, reason, n_chars FROM supplier JOIN (VALUES " + ", ".join(f"({i}, '{p.split('{k}')[0]}', '{p.split('{k}')[1]}', {'NULL' if r is None else repr(r)}, {'NULL' if n is None else n})" for i, (p, _, r, n) in enumerate(KINDS)) + ") v(i, a, b, reason, n_chars) ON i = s_suppkey % 11, LATERAL (SELECT a || s_suppkey || b AS path)")
def tree_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree on disk: which files are targets, why others are not, and how many signs the targets' texts have."""
    keys = [r[0] for r in table(spark, sf_dir, "supplier").select("s_suppkey").collect()]  # the example's files are the driver's
    with folder() as root:
        for k in keys:
            shape, data, _, _ = KINDS[k % len(KINDS)]
            at = root / shape.format(k=k)
            at.parent.mkdir(parents=True, exist_ok=True)
            if data is None:
                at.symlink_to("nowhere")
            else:
                at.write_bytes(data)
        (root / ".inspectignore").write_text("# not these\nsrc/ignored\n")
        include, exclude = preset_filters(str(root), "source-only", [], ignore_patterns(str(root)))
        rows = select_targets(read_tree(spark, str(root), maxbytes=2000), include, exclude, most_bytes=2000).where("path <> '.inspectignore'")
        return materialize(rows.select("path", F.col("skip_reason").alias("reason"), F.when(F.col("skip_reason").isNull(), F.length("text")).alias("n_chars")))


@query("SELECT path, reason FROM (SELECT 'm' || s_suppkey || '.py' AS path, CASE WHEN row_number() OVER (ORDER BY 'm' || s_suppkey || '.py') > 7 THEN 'scan-file-count-limit-exceeded' END AS reason FROM supplier)")
def tree_file_cap(spark, sf_dir):
    """A cap of seven files: the first by path are kept."""
    path = F.format_string("m%d.py", "s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(path.alias("path"), F.lit(1).cast("long").alias("size"), F.lit(False).alias("is_symlink"), F.lit(True).alias("is_file"), F.lit(False).alias("binary"))
    return select_targets(rows, most_files=7).select("path", F.col("skip_reason").alias("reason"))


@query("""SELECT o_orderkey AS diff_id, 'src/o' || o_custkey || '.py' AS path, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS end FROM (
  SELECT o_orderkey, o_custkey, greatest(o_orderkey % 50, 1) AS a, greatest(o_orderkey % 50 + greatest(o_orderkey % 4, 1) - 1, 1) AS b FROM orders UNION ALL
  SELECT o_orderkey, o_custkey, 90, 90 FROM orders WHERE o_orderkey % 3 = 0)""")
def diff_hunks(spark, sf_dir):
    """The changed ranges of a diff for each order; a deleted file has none."""
    k = F.col("o_orderkey")
    lines = F.array_compact(
        F.array(
            F.concat(F.lit("diff --git a/src/o"), "o_custkey"), F.lit("--- a/x.py"), F.concat(F.lit("+++ b/src/o"), "o_custkey", F.lit(".py")), F.format_string("@@ -1,2 +%d,%d @@ def f():", k % 50, k % 4), F.lit("+++x"), F.lit("-old"),
            F.when(k % 3 == 0, F.lit("@@ -3 +90 @@")), F.lit("--- a/gone.py"), F.lit("+++ /dev/null"), F.lit("@@ -1,9 +0,0 @@"),
        )
    )
    rows = table(spark, sf_dir, "orders").select(k.alias("diff_id"), F.posexplode(lines).alias("k", "line"))
    return hunks_of(rows)


_OPS_SQL = "SELECT 'baseline' AS kind, CAST(s_suppkey AS INTEGER) AS ordinal, 'fp-' || s_suppkey AS fingerprint, CAST(s_suppkey AS INTEGER) AS line, CAST(NULL AS VARCHAR) AS word FROM supplier UNION ALL SELECT 'waiver', s_suppkey, NULL, NULL, 'W-' || s_suppkey FROM supplier UNION ALL SELECT 'suppression', n_nationkey, NULL, NULL, n_name FROM nation"


@query(_OPS_SQL)
def settings_operations(spark, sf_dir):
    """Operations written as TOML and read again."""
    keys = sorted(r[0] for r in table(spark, sf_dir, "supplier").select("s_suppkey").collect())
    names = [r[0] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect()]
    with folder() as at:
        text = "[baseline]\nentries = [\n" + "".join(f'  {{ fingerprint = "fp-{k}", line = {k} }},\n' for k in keys) + "]\n[waiver]\nentries = [\n" + "".join(f'  {{ waiver_id = "W-{k}", ci_id = "CI-03" }},\n' for k in keys) + "]\n[suppression]\nentries = [\n" + "".join(f"  {{ match = {json.dumps(n)} }},\n" for n in names) + "]\n"
        (at / "ops.toml").write_text(text)
        ops = settings.load_operations(spark, str(at / "ops.toml"))
    none = F.lit(None)
    out = ops.baseline.select(F.lit("baseline").alias("kind"), "ordinal", "fingerprint", "line", none.cast("string").alias("word"))
    out = out.unionByName(ops.waiver.select(F.lit("waiver").alias("kind"), "ordinal", none.cast("string").alias("fingerprint"), none.cast("int").alias("line"), F.col("waiver_id").alias("word")))
    return out.unionByName(ops.suppression.select(F.lit("suppression").alias("kind"), "ordinal", none.cast("string").alias("fingerprint"), none.cast("int").alias("line"), F.col("match").alias("word")))


@query("SELECT n_name AS profile, CASE WHEN n_nationkey % 2 = 0 THEN 'low' ELSE 'critical' END AS severity_threshold, n_nationkey % 3 = 0 AS fail_on_new_findings, 'source-only' AS scope_mode, n_nationkey = 4 AS refused FROM nation")
def settings_config(spark, sf_dir):
    """A configuration file for each nation; the one with an unknown key is refused."""
    rows = []
    with folder() as at:
        for k, name in sorted(tuple(r) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()):
            text = f'profile = {json.dumps(name)}\nseverity_threshold = "{"critical" if k % 2 else "low"}"\nfail_on_new_findings = {str(k % 3 == 0).lower()}\n'
            (at / f"{k}.toml").write_text(text + "other = 1\n" * (k == 4))
            refused = False
            try:
                c = settings.load_config(str(at / f"{k}.toml"))
            except ValueError:
                refused = True
                (at / f"{k}.toml").write_text(text)
                c = settings.load_config(str(at / f"{k}.toml"))
            rows.append((c.profile, c.severity_threshold, c.fail_on_new_findings, c.scope_mode, refused))
    return spark.createDataFrame(rows, "profile string, severity_threshold string, fail_on_new_findings boolean, scope_mode string, refused boolean")


@query("SELECT s_name AS fingerprint, CASE s_suppkey % 3 WHEN 0 THEN 'true-positive' WHEN 1 THEN 'false-positive' ELSE 'skip' END AS label, 'of ' || s_name AS notes FROM supplier")
def settings_labels(spark, sf_dir):
    """Labels written as JSON and read again."""
    rows = table(spark, sf_dir, "supplier").select("s_name", "s_suppkey").collect()
    with folder() as at:
        (at / "labels.json").write_text(json.dumps([{"fingerprint": n, "label": settings.LABELS[k % 3], "notes": f"of {n}"} for n, k in rows]))
        return settings.load_labels(spark, str(at / "labels.json"))


@query(f"WITH {OPERATED_SQL}, p AS (SELECT scope_class AS project, ci_id, fingerprint, path, line FROM r) SELECT project, ci_id, count(*) AS n, count(DISTINCT path) AS files, CAST(sum(line) AS BIGINT) AS lines FROM p GROUP BY 1, 2")
def harness_findings(spark, sf_dir):
    """A corpus document with findings, written and read again, as projects by rule."""
    rows = reported(spark, sf_dir).select("fingerprint", F.col("scope_class").alias("project"), "ci_id", "signal", F.col("path").alias("target_file"), "line", "emitted", "severity", "confidence", "excerpt")
    with folder() as at:
        review.write_corpus(rows, str(at / "corpus.json"), with_findings=True, scope_mode="full-repo")
        back = settings.load_harness(spark, str(at / "corpus.json"))
        return materialize(back.groupBy("project", "ci_id").agg(F.count("*").alias("n"), F.count_distinct("target_file").alias("files"), F.sum("line").alias("lines")))


@query("SELECT n_name AS domain, 'authority ' || n_nationkey AS term FROM nation")
def domain_packs(spark, sf_dir):
    """A domain pack for each nation, read from a folder of packs."""
    rows = []
    with folder() as at:
        for k, name in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():
            pack = at / f"d{k}/python/d{k}_domain_rules.py"
            pack.parent.mkdir(parents=True)
            pack.write_text(f"from types import SimpleNamespace as N\nD{k}_DOMAIN_RULES = N(domain_id={name!r}, authority_terms=['authority {k}'])\n")
            rules = load_domain(f"d{k}", folder=str(at))
            rows += [(rules.domain_id, t) for t in rules.authority_terms]
    return spark.createDataFrame(rows, "domain string, term string")


_PATHS = f"p AS (SELECT DISTINCT {PATH_SQL.format(u='user_id')} AS path, {CLASS_SQL.format(u='user_id')} AS scope_class, user_id % 6 AS k FROM events)"


def _paths(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(user_path(F.col("user_id")).alias("path")).distinct()


@query(f"WITH {_PATHS} SELECT 'full-repo' AS scope_mode, path FROM p WHERE scope_class IN ('runtime-source', 'tests') UNION ALL SELECT 'source-only', path FROM p")
def lane_scope(spark, sf_dir):
    """The files that outside tools are asked about, in two scope modes."""
    out = None
    for mode in ("full-repo", "source-only"):
        rows = catalog.lane_files(_paths(spark, sf_dir), mode).select(F.lit(mode).alias("scope_mode"), "path")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH {SETTLED_SQL} SELECT event_id FROM raw WHERE owner_lane = 'external-analyzer' AND scope_class IN ('runtime-source', 'tests')")
def external_in_scope(spark, sf_dir):
    """Outside findings of the scanned files of the lane only."""
    raw = event_findings(spark, sf_dir).where("owner_lane = 'external-analyzer'")
    return raw.join(catalog.lane_files(_paths(spark, sf_dir), "full-repo"), "path", "left_semi").select("event_id")


_HAS = "h AS (SELECT s_nationkey, bool_or(s_suppkey % 5 = 0) AS py, bool_or(s_suppkey % 5 = 1) AS ts, bool_or(s_suppkey % 5 = 2) AS sh, bool_or(s_suppkey % 5 = 3) AS sqls FROM supplier GROUP BY 1)"


@query(f"WITH {_HAS} SELECT s_nationkey AS nation, tool FROM h, (VALUES ('ruff', 1), ('pyflakes', 1), ('mypy', 1), ('pytest', 1), ('semgrep', 0), ('eslint', 2), ('tsc', 2), ('shellcheck', 3), ('sqlfluff', 4)) v(tool, k) WHERE (k = 0 AND (py OR ts OR sh OR sqls OR true)) OR (k = 1 AND py) OR (k = 2 AND ts) OR (k = 3 AND sh) OR (k = 4 AND sqls)")
def tool_applicability(spark, sf_dir):
    """The tools that have something to read in a tree of a file for each supplier of a nation."""
    shape = F.element_at(F.array(*map(F.lit, ("src/a%d.py", "src/a%d.ts", "src/a%d.sh", "src/a%d.sql", "src/a%d.toml"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    files = materialize(table(spark, sf_dir, "supplier").select("s_nationkey", F.replace(shape, F.lit("%d"), F.col("s_suppkey").cast("string")).alias("path")))
    out = None
    for (nation,) in sorted(tuple(r) for r in files.select("s_nationkey").distinct().collect()):  # a tree each
        tools = catalog.tools_that_apply(catalog.tool_facts(files.where(F.col("s_nationkey") == nation)), "full", True).select(F.lit(nation).alias("nation"), "tool")
        out = tools if out is None else out.unionByName(tools)
    return out


_STATES = ("not-installed", "ready", "version-or-runtime-problem", "ready")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'not-installed' WHEN 2 THEN 'version-or-runtime-problem' ELSE 'ready' END AS readiness, CASE WHEN c_custkey % 7 < 2 AND c_custkey % 2 = 0 THEN 'executed' WHEN c_custkey % 7 < 2 THEN 'parse-failure' WHEN c_custkey % 7 = 5 AND c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'no-tests-collected' ELSE 'parse-failure' END WHEN c_custkey % 7 = 2 AND c_custkey % 3 = 1 THEN CASE WHEN c_custkey % 2 = 0 THEN 'executed' ELSE 'parse-failure' END ELSE 'runtime-failure' END AS outcome FROM customer")
def tool_states(spark, sf_dir):
    """Readiness from version texts and outcomes from exit codes, a tool for each customer."""
    k = F.col("c_custkey")
    said = F.when(k % 4 == 0, None).when(k % 4 == 1, F.format_string("tool 1.10.%d", k)).when(k % 4 == 2, F.format_string("tool 1.9.1, build %d", k)).otherwise("2.0.0-rc")
    tool = F.element_at(F.array(F.lit("pytest"), F.lit("tsc"), F.lit("ruff")), (k % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", said.alias("said"), tool.alias("tool"))
    return rows.select("c_custkey", readiness(F.col("said"), F.lit("1.9.2")).alias("readiness"), outcome(F.col("tool"), (k % 7).cast("int"), k % 2 == 0)["runtime_state"].alias("outcome"))


_SIGNAL_ROWS = ", ".join(f"('{p}', '{s}', {str(s in catalog.OPT_IN).lower()})" for p, ss in catalog.SIGNALS.items() for s in ss)


@query("WITH f AS (SELECT s.profile_id, count(*) AS signals, count(*) FILTER (opt_in) AS opt_in FROM (VALUES " + _SIGNAL_ROWS + ") s(profile_id, signal, opt_in) GROUP BY 1) SELECT profile_id, signals, opt_in, lanes FROM f JOIN (VALUES " + ", ".join(f"('{p}', {len(x)})" for p, x in catalog.LANES.items()) + ") l(profile_id, lanes) USING (profile_id)")
def profile_catalog(spark, sf_dir):
    """Signals, opt-in signals and lanes of each profile."""
    signals = catalog.profile_signals(spark).groupBy("profile_id").agg(F.count("*").alias("signals"), F.count_if("opt_in").alias("opt_in"))
    return signals.join(catalog.profile_lanes(spark).groupBy("profile_id").agg(F.count("*").alias("lanes")), "profile_id")


@query("SELECT profile_id, event_type, n FROM (VALUES ('quick-gate', 'click'), ('quick-gate', 'error'), ('quick-gate', 'purchase'), ('state-change', 'error'), ('startup', NULL)) v(profile_id, event_type) JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) e USING (event_type)")
def profile_activation(spark, sf_dir):
    """Findings that a profile's signals leave, by kind of event."""
    counts = table(spark, sf_dir, "events").join(event_findings(spark, sf_dir).select("event_id", "signal"), "event_id").groupBy("event_type", "signal").agg(F.count("*").alias("n"))
    wanted = catalog.profile_signals(spark).where(F.col("profile_id").isin("quick-gate", "state-change", "startup"))
    return counts.join(wanted, "signal").select("profile_id", "event_type", "n")


@query("SELECT profile_id, analyzer_id, CASE analyzer_id WHEN 'ruff' THEN 'ready' WHEN 'mypy' THEN 'version-or-runtime-problem' ELSE 'not-installed' END AS state, analyzer_id = 'ruff' AS runs FROM (VALUES " + ", ".join(f"('{p}', '{t}')" for p, ts in catalog.TOOLS.items() for t in ts) + ") v(profile_id, analyzer_id)")
def profile_plan(spark, sf_dir):
    """Which tools each profile would run."""
    return catalog.execution_plan(spark, {"ruff": "ready", "mypy": "version-or-runtime-problem"})


_VIEW = f"{OPERATED_SQL}, v AS (SELECT * FROM r WHERE scope_class IN ('runtime-source', 'tests'))"
_DIMS = ("severity", "confidence", "actor_label", "triage_state", "priority", "baseline_status", "lifecycle_state", "owner_lane", "scope_class")


@query(f"WITH {_VIEW} " + " UNION ALL ".join(f"SELECT 'by_{d}' AS dimension, {d} AS value, count(*) AS n FROM v GROUP BY 2" for d in _DIMS) + """ UNION ALL SELECT 'by_scope_policy', 'gated', count(*) FROM v HAVING count(*) > 0
UNION ALL SELECT 'total', k, n FROM (SELECT count(*) AS total_findings, count(*) FILTER (waiver_status <> 'none') AS waived_count, count(*) FILTER (baseline_status = 'new') AS new_count, count(*) FILTER (baseline_status <> 'new') AS existing_baseline_count,
count(*) FILTER (severity IN ('high', 'critical') AND waiver_status = 'none') AS blocker_count, count(*) FILTER (triage_state = 'accepted-residual') AS residual_count, 3::BIGINT AS suppressed_count, 0::BIGINT AS resolved_baseline_count FROM v) UNPIVOT (n FOR k IN (total_findings, waived_count, new_count, existing_baseline_count, blocker_count, residual_count, suppressed_count, resolved_baseline_count))""")
def view_summary(spark, sf_dir):
    """The summary of a view, under gate classes of its own."""
    return R.view_summary(R.view(reported(spark, sf_dir), ["runtime-source", "tests"]), ("runtime-source", "tests"), suppressed_count=3)


@query(f"WITH {_VIEW}, g AS (SELECT * FROM v WHERE waiver_status = 'none') SELECT 'fail' AS decision, CAST(count(*) FILTER (severity IN ('high', 'critical')) AS INTEGER) AS blocking_count, 1 AS analyzer_failure_count, 'severity-threshold,analyzer-runtime-error' AS reasons FROM g")
def view_gate(spark, sf_dir):
    """The gate of a view: a tool that isn't installed is no failure."""
    rows = R.view(reported(spark, sf_dir), ["runtime-source", "tests"])
    one = R.view_gate(rows, R.GatePolicy(fail_on_analyzer_errors=True), {"mypy": "not-installed", "ruff": "runtime-failure", "pytest": "executed"}, ("runtime-source", "tests"))
    return one.select("decision", "blocking_count", "analyzer_failure_count", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {OPERATED_SQL}, g AS (SELECT * FROM r WHERE scope_class = 'runtime-source' AND waiver_status = 'none') SELECT 'severity-threshold' AS reason, finding_id FROM g WHERE severity IN ('high', 'critical') UNION ALL SELECT 'new-findings-present', finding_id FROM g WHERE baseline_status = 'new' UNION ALL SELECT 'unreviewed-review-required', finding_id FROM g WHERE baseline_status = 'new' AND owner_lane = 'human-judgment'")
def gate_members(spark, sf_dir):
    return R.gate_members(reported(spark, sf_dir), R.GatePolicy())


@query(f"""WITH {OPERATED_SQL}, c AS (SELECT severity, count(*) AS n FROM r GROUP BY 1) SELECT 'by_severity ' || severity || ' does not add up' AS problem FROM c WHERE severity = 'high'
UNION ALL SELECT 'by_baseline_status other does not add up' UNION ALL SELECT 'new_count does not add up' UNION ALL SELECT 'waived_count does not add up' UNION ALL SELECT 'line is below 1' FROM r WHERE event_id % 1000 = 0 UNION ALL SELECT 'owner_lane: nobody' FROM r WHERE event_id % 1000 = 1""")
def report_recount(spark, sf_dir):
    """A report with wrong counts and rows: each is named, and nothing else."""
    rows = materialize(reported(spark, sf_dir))
    bad = rows.withColumn("line", F.when(F.col("event_id") % 1000 == 0, 0).otherwise(F.col("line"))).withColumn("owner_lane", F.when(F.col("event_id") % 1000 == 1, "nobody").otherwise(F.col("owner_lane")))
    summary: dict = R.totals(rows).first().asDict()
    for r in R.count_by(rows).collect():
        summary.setdefault(r["dimension"], {})[r["value"]] = r["n"]
    summary["by_severity"]["high"] += 1
    summary["by_baseline_status"]["other"] = 4
    summary["new_count"] += 2
    summary["waived_count"] = True
    return R.problems(bad, *R.stored_counts(spark, summary))


@query("SELECT 'gate.blocking_count does not add up' AS problem UNION ALL SELECT 'gate.reason_details lacks new-findings-present'")
def report_document(spark, sf_dir):
    """A report document whose gate doesn't match its blockers and details."""
    n = table(spark, sf_dir, "nation").count()
    report = {"summary": {}, "findings": [], "blockers": [{}] * n, "gate": {"decision": "fail", "blocking_count": n + 1, "reasons": ["severity-threshold", "new-findings-present"], "reason_details": [{"reason": "severity-threshold"}]}}
    return spark.createDataFrame([(x,) for x in R.document_problems(report)], "problem string")


@query("WITH c AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1), s AS (SELECT k, CASE WHEN k % 5 = 0 THEN n - 1 ELSE n END AS p FROM c WHERE k > 0) SELECT 'CI-' || c.k AS ci_id, coalesce(p, 0) AS previous, n AS current, n - coalesce(p, 0) AS delta, 'fail' AS decision FROM c LEFT JOIN s USING (k) WHERE n > coalesce(p, 0)")
def ratchet_file(spark, sf_dir):
    """Counts held against a stored state: what rose."""
    counts = {f"CI-{k}": n for k, n in table(spark, sf_dir, "supplier").groupBy("s_nationkey").count().collect()}
    with folder() as at:
        state = str(at / "state.json")
        old = {c: n - (int(c[3:]) % 5 == 0) for c, n in counts.items() if c != "CI-0"}
        emit.check_ratchet(old, state)
        out = emit.check_ratchet(counts, state)
    return spark.createDataFrame([(v["ci_id"], v["previous"], v["current"], v["delta"], out["decision"]) for v in out["violations"]], "ci_id string, previous long, current long, delta long, decision string")


@query("""WITH e AS (SELECT event_type, CAST(strftime(ts, '%d') AS INTEGER) % 3 AS b, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT DISTINCT event_type FROM events),
b0 AS (SELECT event_type, n FROM e WHERE b = 0), b1 AS (SELECT event_type, n FROM e WHERE b = 1), ok1 AS (SELECT count(*) = 0 AS ok FROM b1 LEFT JOIN b0 USING (event_type) WHERE b1.n > coalesce(b0.n, 0)),
s1 AS (SELECT event_type, n FROM b1 WHERE (SELECT ok FROM ok1) UNION ALL SELECT event_type, n FROM b0 WHERE NOT (SELECT ok FROM ok1))
SELECT 1 AS batch, event_type AS ci_id, coalesce(b0.n, 0) AS previous, b1.n AS current FROM b1 LEFT JOIN b0 USING (event_type) WHERE b1.n > coalesce(b0.n, 0)
UNION ALL SELECT 2, event_type, coalesce(s1.n, 0), e.n FROM e LEFT JOIN s1 USING (event_type) WHERE b = 2 AND e.n > coalesce(s1.n, 0)""")
def ratchet_over_stream(spark, sf_dir):
    """Three batches of a stream: what rose against the counts that the batches before left."""
    found = []
    with folder() as at:
        day = F.dayofmonth(F.col("ts").cast("timestamp_ntz")) % 3
        rows = materialize(table(spark, sf_dir, "events").select(F.col("event_type").alias("ci_id"), F.lit("none").alias("waiver_status"), day.alias("b")))
        for b in range(3):  # a file a batch, each an hour younger
            rows.where(F.col("b") == b).drop("b").coalesce(1).write.parquet(str(at / f"w{b}"))
            part = next((at / f"w{b}").glob("part-*"))
            (at / "in").mkdir(exist_ok=True)
            shutil.move(part, at / f"in/{b}.parquet")
            os.utime(at / f"in/{b}.parquet", (1_700_000_000 + 3600 * b,) * 2)
        stream = spark.readStream.schema("ci_id string, waiver_status string").option("maxFilesPerTrigger", 1).parquet(str(at / "in"))
        ratchet_stream(stream, str(at / "state"), str(at / "check"), lambda k, df: found.extend((k, r["ci_id"], r["previous"], r["current"]) for r in df.collect())).awaitTermination()
    return spark.createDataFrame(found, "batch int, ci_id string, previous long, current long")


def _module(k) -> F.Column:
    return F.concat(F.format_string("def f%d(x):\n", k), F.when(k % 4 == 0, "    return eval(x)\n").when(k % 4 == 1, "    # TODO later\n    return x\n").otherwise("    return x\n"))


@query("SELECT 'src/p' || p_partkey || '.py' AS path, CASE p_partkey % 4 WHEN 0 THEN 'CI14_DYNAMIC_CODE_EXECUTION' ELSE 'CI03_TODO_HACK' END AS signal, 2 AS line FROM part WHERE p_partkey % 4 < 2")
def scan_over_stream(spark, sf_dir):
    """A module for each part, in two batches of a stream, each inspected as it comes; its findings are written under its number."""
    at = shared_path(spark)
    k = F.col("p_partkey")
    files = table(spark, sf_dir, "part").select(F.format_string("src/p%d.py", k).alias("path"), _module(k).alias("text"), (k % 2).alias("b"))
    for b in range(2):
        files.where(F.col("b") == b).drop("b").write.mode("append").parquet(f"{at}/in")
        put = lambda n, scan: scan.findings.select(F.col("target_file").alias("path"), "signal", "line").write.mode("overwrite").parquet(f"{at}/found/{n}")
        scan_stream(spark, f"{at}/in", f"{at}/check", put).awaitTermination()
    return spark.read.schema("path string, signal string, line int").parquet(f"{at}/found/*")


def _lambdas(t) -> Iterator[dict]:
    if hasattr(t, "nodes"):
        yield from (t.fact("lambda", n.lineno) for n in t.nodes if isinstance(n, ast.Lambda))


def _lambda_rule(facts: DataFrame) -> DataFrame:
    fixed = {"ci_id": "CI-90", "signal": "OWN_LAMBDA", "severity": "low", "confidence": "low", "priority": "P3", "owner_lane": "native-static", "reason": "a lambda", "recommended_action": "name it"}
    return facts.where("kind = 'lambda'").select("path", "line", *[F.lit(v).alias(k) for k, v in fixed.items()], "excerpt", "symbol", "content", F.lit(1).alias("phase"), F.lit(99).alias("rule_rank"), "ord")


@query("SELECT 'src/s' || s_suppkey || '.py' AS target_file, CAST(2 + s_suppkey % 3 AS INTEGER) AS line FROM supplier WHERE s_suppkey % 2 = 0")
def own_rules(spark, sf_dir):
    """A fact and a rule of the user's own beside the others, over a module for each supplier."""
    k = F.col("s_suppkey")
    text = F.concat(F.lit("x = 1\n"), F.repeat(F.lit("y = x\n"), (k % 3).cast("int")), F.when(k % 2 == 0, "f = lambda: x\n").otherwise("f = x\n"))
    files = table(spark, sf_dir, "supplier").select(F.format_string("src/s%d.py", k).alias("path"), text.alias("text"))
    return scan_files(files, emitters=(_lambdas,), rules=(_lambda_rule,)).findings.where("signal = 'OWN_LAMBDA'").select("target_file", "line")


@query("SELECT 'src/s' || s_suppkey || '.py' AS path, CAST(2 AS INTEGER) AS line, 'Shop.pay' || s_suppkey AS symbol, CAST(3 + s_suppkey % 4 AS INTEGER) AS end_line FROM supplier")
def symbol_spans(spark, sf_dir):
    """The spans of methods, by qualified name."""
    from quarrylens.functions.facts import extract

    k = F.col("s_suppkey")
    text = F.concat(F.format_string("class Shop:\n    def pay%d(self):\n", k), F.repeat(F.lit("        x = 1\n"), (k % 4 + 1).cast("int")))
    files = table(spark, sf_dir, "supplier").select(F.format_string("src/s%d.py", k).alias("path"), text.alias("text"))
    return extract(files).where("kind = 'span' AND name LIKE 'Shop.%'").select("path", "line", F.col("name").alias("symbol"), "end_line")


@query(f"WITH {SETTLED_SQL} SELECT event_id, row_number() OVER (ORDER BY path, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END, event_id) AS emitted FROM s")
def emission_order(spark, sf_dir):
    """The place of each settled finding in the order of emission."""
    return L.numbered(L.settle(event_findings(spark, sf_dir))).select("event_id", F.col("emitted").cast("long").alias("emitted"))


@query(f"WITH {OPERATED_SQL} SELECT CAST(count(*) AS VARCHAR) AS findings, 'fail' AS gate, (SELECT string_agg('- `' || path || '`: ' || n, chr(10) ORDER BY n DESC, first) FROM (SELECT path, count(*) AS n, min(event_id) AS first FROM r GROUP BY 1 ORDER BY n DESC, first LIMIT 5)) AS files FROM r")
def markdown_page(spark, sf_dir):
    """The summary page's figures: findings, gate, top files."""
    rows = materialize(reported(spark, sf_dir))
    verdict = R.gate(rows, R.GatePolicy()).first().asDict(recursive=True)
    page = emit.markdown_summary({"gate": verdict, "review_brief": R.brief(rows, verdict["decision"], verdict["blocking_count"], {}), "summary": R.totals(rows).first().asDict()})
    lines = page.splitlines()
    at = lines.index("### Files") + 2
    stop = next(k for k in range(at, len(lines)) if not lines[k])
    found = next(x for x in lines if x.startswith("- findings: ")).removeprefix("- findings: ")
    return spark.createDataFrame([(found, lines[0].removeprefix("## Inspection: "), "\n".join(lines[at:stop]))], "findings string, gate string, files string")


@query(f"WITH {OPERATED_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY ci_id, scope_class ORDER BY path, line, fingerprint) AS k FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY ci_id ORDER BY k, scope_class) AS place FROM q) SELECT ci_id, count(*) AS n FROM o WHERE place <= 4 GROUP BY 1")
def review_pack(spark, sf_dir):
    """A review pack of up to four findings a rule: the rows of its label template."""
    rows = reported(spark, sf_dir).select("fingerprint", "ci_id", F.col("scope_class").alias("project"), F.col("path").alias("target_file"), "line", "emitted")
    with folder() as at:
        review.write_review_pack(rows, str(at), 4)
        labels = json.loads((at / "labels.json").read_text())
    return spark.createDataFrame([(x["ci_id"],) for x in labels], "ci_id string").groupBy("ci_id").agg(F.count("*").alias("n"))
