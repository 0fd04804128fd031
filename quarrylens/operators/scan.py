"""The whole inspection: files to facts to findings to a report, as one plan over DataFrames."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions.columns import squash, suffix
from quarrylens.functions.facts import extract
from quarrylens.operators import report as R
from quarrylens.operators.adapters import parse_payloads
from quarrylens.operators.catalog import EXTERNAL, LANES, SIDE, TOOLS, active_signals, check_request, lane_files, tool_facts, tools_that_apply
from quarrylens.operators.findings import apply_operations, changed_only, innermost, report_rows, resolved, settle
from quarrylens.operators.rules import all_findings, leaked_authority
from quarrylens.runtime import materialize
from quarrylens.sources.diff import git_changed, git_diff, parse_hunks
from quarrylens.sources.settings import Operations, load_operations
from quarrylens.sources.tools import run_tools
from quarrylens.sources.tree import ignore_patterns, preset_filters, read_tree, select_targets


@dataclass(frozen=True)
class Options:
    profile: str = "full"
    scope_mode: str = "full-repo"
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    policy: R.GatePolicy = field(default_factory=R.GatePolicy)
    operations_file: str | None = None
    diff_from: str | None = None
    most_files: int | None = None
    side_terms: tuple[str, ...] = ()
    authority_terms: tuple[str, ...] = ()
    tool_states: dict[str, str] = field(default_factory=dict)
    run_tools: bool = False


@dataclass
class Scan:
    """Results; findings are written once, all else is derived from them."""

    findings: DataFrame
    skipped: DataFrame
    resolved: DataFrame
    suppressed_count: int
    options: Options

    @cached_property
    def gate(self) -> dict:
        failed = sorted(t for t, s in self.options.tool_states.items() if s not in R.FINE)
        return R.gate(self.findings, self.options.policy, failed).first().asDict(recursive=True)

    @cached_property
    def summary(self) -> dict:
        out: dict = R.totals(self.findings).first().asDict()
        for r in R.count_by(self.findings).collect():
            out.setdefault(r["dimension"], {})[r["value"]] = r["n"]
        return out | {"suppressed_count": self.suppressed_count, "blocker_count": self.gate["blocking_count"], "resolved_baseline_count": self.resolved.count()}

    def report(self, made_at: str) -> dict:
        """The report document; findings of a very large scan belong in a dataset (write_findings) instead."""
        rows = lambda df: [json.loads(x) for x in df.toJSON().toLocalIterator()]
        ordered = R.by_severity(self.findings).drop("severity_rank", "emitted")
        blockers = rows(R.blockers(self.findings, self.options.policy))
        brief = R.brief(self.findings, self.gate["decision"], len(blockers), self.options.tool_states)
        return {
            "generated_at": made_at, "profile": self.options.profile, "scope_mode": self.options.scope_mode, "summary": self.summary, "gate": self.gate, "review_brief": brief, "blockers": blockers,
            "external_runs": [{"tool": t, "state": s} for t, s in sorted(self.options.tool_states.items())], "residuals": rows(R.residuals(self.findings)), "resolved_baseline": rows(self.resolved), "skipped": rows(self.skipped), "findings": rows(ordered),
        }

    def exit_code(self) -> int:
        """1 if there is any finding, whatever the gate says."""
        return int(not self.findings.isEmpty())


def anchored_payloads(payloads: DataFrame, files: DataFrame, spans: DataFrame) -> DataFrame:
    """Outside findings of the scanned files, with the symbol and the squashed line that identify them."""
    raw = parse_payloads(payloads).join(files.select("path"), "path", "left_semi")
    raw = innermost(raw.drop("symbol"), spans, ["path", "line"])
    lines = files.join(raw.select("path").distinct(), "path", "left_semi").select("path", F.split("text", "\n").alias("lines"))
    out = raw.drop("content").join(lines, "path", "left")
    return out.withColumn("content", F.coalesce(squash(F.try_element_at("lines", F.col("line"))), F.lit(""))).drop("lines")


def outside_runs(files: DataFrame, root: str, options: Options) -> DataFrame | None:
    """What the outside tools of the profile say of a tree; None where the profile has no such lane. Their file list is the driver's, as theirs is."""
    spark = files.sparkSession
    if EXTERNAL not in LANES.get(options.profile, ()) or options.profile not in TOOLS:
        return None
    asked = lane_files(files.select("path"), options.scope_mode)
    tools = [r["tool"] for r in tools_that_apply(tool_facts(asked), options.profile, os.path.isfile(os.path.join(root, "tsconfig.json"))).collect()]
    paths = sorted(r["path"] for r in asked.where(suffix(F.col("path")).isin(".py", ".sh", ".bash")).select("path").toLocalIterator()) if tools else []
    return run_tools(spark, root, tools, [os.path.join(root, p) for p in paths])


def scan_files(files: DataFrame, options: Options = Options(), operations: Operations | None = None, payloads: DataFrame | None = None, hunks: DataFrame | None = None, skipped: DataFrame | None = None, emitters: tuple = (), rules: tuple = ()) -> Scan:
    """Inspect files(path, text[, abs_path]), one row a path. emitters add facts in the Python pass; rules turn facts into raw findings (RAW)."""
    spark = files.sparkSession
    check_request(options.profile, list(options.include))
    active = active_signals(options.profile)
    facts = materialize(extract(files, emitters), by=["kind"])
    raw = all_findings(facts, active)
    for rule in rules:
        raw = raw.unionByName(rule(facts))
    if SIDE in active and options.side_terms:
        raw = raw.unionByName(leaked_authority(files, list(options.side_terms), list(options.authority_terms)))
    raw = raw.withColumn("evidence_ref", F.lit("inspection-rules"))
    spans = facts.where("kind = 'span'")
    if payloads is not None:
        raw = raw.unionByName(anchored_payloads(payloads, lane_files(files, options.scope_mode), spans))
    if hunks is not None:
        raw = changed_only(raw, spans, hunks)
    ops = operations or load_operations(spark, options.operations_file)
    rows = materialize(settle(raw))
    kept = materialize(report_rows(apply_operations(rows, ops)))
    gone = resolved(ops.baseline, rows, files.select("path"))
    none = spark.createDataFrame([], "path string, reason string")
    return Scan(kept, none if skipped is None else skipped, gone, rows.count() - kept.count(), options)


def scan_tree(spark: SparkSession, root: str, options: Options = Options(), payloads: DataFrame | None = None) -> Scan:
    """Inspect a directory tree; with options.run_tools the outside tools of the profile too, unless payloads are given."""
    include, exclude = preset_filters(root, options.scope_mode, list(options.include), [*options.exclude, *ignore_patterns(root)])
    entries = select_targets(read_tree(spark, root), include, exclude, most_files=options.most_files)
    targets = entries.where("skip_reason IS NULL")
    hunks = None
    if options.diff_from:
        try:
            changed = spark.createDataFrame([(p,) for p in git_changed(root, options.diff_from)], "path string")
            hunks = parse_hunks(spark, git_diff(root, options.diff_from))
            targets = targets.join(changed, "path", "left_semi")
        except ValueError:
            hunks = None
    files = materialize(targets.select("path", "abs_path", "text"))
    if payloads is None and options.run_tools and (runs := outside_runs(files, root, options)) is not None:
        runs = materialize(runs)
        options = replace(options, tool_states={r["tool"]: r["state"] for r in runs.select("tool", "state").collect()})
        payloads = runs.where("state IN ('executed', 'no-tests-collected')").select("tool", "root", "payload")
    return scan_files(files, options, payloads=payloads, hunks=hunks, skipped=entries.where("skip_reason <> ''").select("path", F.col("skip_reason").alias("reason")))
