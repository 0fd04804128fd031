"""Command line: scan, emit, validate, show, scale-check. Exit codes: 0 fine, 1 findings, 2 usage, 4 broken document, 5 budget missed."""

from __future__ import annotations

import argparse
import json
import sys
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from quarrylens.operators import catalog
from quarrylens.operators import report as R
from quarrylens.operators.findings import COLUMNS
from quarrylens.operators.scan import Options, scan_files, scan_tree
from quarrylens.sinks import emit
from quarrylens.sources.domains import load_domain
from quarrylens.sources.settings import config_schema, load_config, read_json
from quarrylens.sources.tools import analyzer_catalog, availability
from quarrylens.sources.tree import synthetic_tree

BUDGETS = {250: 8.0, 1000: 35.0}


def report_findings(spark: SparkSession, path: str) -> DataFrame:
    """The finding rows of a report document, in its order."""
    rows = read_json(path).get("findings", [])
    kinds = {c: "int" if c == "line" else "string" for c in COLUMNS}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items())
    df = spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) + (k,) for k, r in enumerate(rows)], f"{schema}, emitted int")
    return df


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarrylens", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan", help="inspect a tree")
    scan.add_argument("root")
    scan.add_argument("--config")
    scan.add_argument("--profile", choices=list(catalog.SIGNALS))
    scan.add_argument("--scope-mode")
    scan.add_argument("--include", action="append", default=[])
    scan.add_argument("--exclude", action="append", default=[])
    scan.add_argument("--operations")
    scan.add_argument("--diff-from")
    scan.add_argument("--domain")
    scan.add_argument("--domain-file")
    scan.add_argument("--ratchet")
    scan.add_argument("--no-tools", action="store_true", help="leave outside tools alone")
    scan.add_argument("--output")
    for name in ("emit-sarif", "emit-annotations", "emit-github-summary", "emit-baseline", "validate-report"):
        c = sub.add_parser(name)
        c.add_argument("report")
        c.add_argument("--output", default="/dev/stdout")
        c.add_argument("--scope-class", action="append", default=[])
        c.add_argument("--owner-lane", action="append", default=[])
    sub.add_parser("validate-sarif").add_argument("document")
    for name in ("show-config-schema", "show-profile-catalog", "show-analyzer-catalog", "show-analyzer-availability", "show-profile-execution-plan", "scale-check"):
        sub.add_parser(name)
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    show = lambda x: print(json.dumps(x, indent=1, ensure_ascii=False))
    if a.command == "scan":
        return _scan(spark, a)
    if a.command == "validate-sarif":
        show(problems := emit.sarif_problems(read_json(a.document)))
        return 4 * bool(problems)
    if a.command == "show-config-schema":
        show(config_schema())
    elif a.command == "show-profile-catalog":
        show([{"profile_id": k, "signals": list(v), "lanes": list(catalog.LANES[k]), "analyzers": list(catalog.TOOLS.get(k, ()))} for k, v in catalog.SIGNALS.items()])
    elif a.command == "show-analyzer-catalog":
        show(analyzer_catalog())
    elif a.command == "show-analyzer-availability":
        show([r.asDict() for r in availability(spark).collect()])
    elif a.command == "show-profile-execution-plan":
        states = {r["tool"]: r["state"] for r in availability(spark).collect()}
        show([r.asDict() for r in catalog.execution_plan(spark, states).collect()])
    elif a.command == "scale-check":
        return _scale(spark, show)
    else:
        return _emit(spark, a, show)
    return 0


def _scan(spark: SparkSession, a: argparse.Namespace) -> int:
    from quarrylens.sources.settings import Config

    c = load_config(a.config) if a.config else Config()
    domain = load_domain(a.domain, a.domain_file)
    policy = R.GatePolicy(c.severity_threshold, c.fail_on_new_findings, c.fail_on_unreviewed_review_required, c.fail_on_analyzer_errors)
    exclude = (*a.exclude, *domain.excluded_files, *domain.excluded_prefixes)
    options = Options(a.profile or c.profile, a.scope_mode or c.scope_mode, tuple(a.include), exclude, policy, a.operations, a.diff_from, side_terms=domain.side_program_terms, authority_terms=domain.authority_terms, run_tools=not a.no_tools)
    done = scan_tree(spark, a.root, options)
    report = done.report(datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
    if a.ratchet:
        report["ratchet"] = emit.check_ratchet({r["ci_id"]: r["n"] for r in R.counts_by_rule(done.findings).collect()}, a.ratchet)
    text = json.dumps(report, indent=1, ensure_ascii=False)
    if a.output:
        emit.write_text(text + "\n", a.output)
        print(f"{report['summary']['total_findings']} findings, gate: {report['gate']['decision']}")
    else:
        print(text)
    return done.exit_code()


def _emit(spark: SparkSession, a: argparse.Namespace, show) -> int:
    rows = R.view(report_findings(spark, a.report), a.scope_class, a.owner_lane)
    if a.command == "validate-report":
        report = read_json(a.report)
        rows = report_findings(spark, a.report)
        found = R.document_problems(report) + [r["problem"] for r in R.problems(rows, *R.stored_counts(spark, report.get("summary") or {})).collect()]
        if len(report.get("residuals") or []) != (report.get("summary") or {}).get("residual_count"):
            found.append("residual_count does not match the residuals")
        show(found)
        return 4 * bool(found)
    if a.command == "emit-sarif":
        emit.write_sarif(rows, a.output)
    elif a.command == "emit-baseline":
        emit.write_baseline(rows, a.output)
    elif a.command == "emit-annotations":
        with open(a.output, "w", encoding="utf-8") as f:
            f.writelines(r["annotation"] + "\n" for r in emit.annotations(rows).orderBy("emitted").toLocalIterator())
    else:
        policy = R.GatePolicy()
        states = {str(x.get("tool")): str(x.get("state")) for x in read_json(a.report).get("external_runs") or []}
        verdict = R.view_gate(rows, policy, states).first().asDict(recursive=True)
        brief = R.brief(rows, verdict["decision"], verdict["blocking_count"], states, from_view=True)
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(emit.markdown_summary({"gate": verdict, "review_brief": brief, "summary": R.totals(rows).first().asDict()}))
    return 0


def _scale(spark: SparkSession, show) -> int:
    out = []
    for n, budget in BUDGETS.items():
        began = time.perf_counter()
        found = scan_files(synthetic_tree(spark, n), Options(profile="full")).findings.count()
        took = time.perf_counter() - began
        out.append({"files": n, "seconds": round(took, 2), "budget": budget, "findings": found, "ok": took <= budget})
    show(out)
    return 0 if all(x["ok"] for x in out) else 5


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quarrylens").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        return run(spark, a)
    except (ValueError, OSError) as e:
        print(f"quarrylens: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
