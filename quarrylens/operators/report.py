"""Aggregates over settled findings: summary, gate, blockers, residuals, brief, view; every one is a query over the finding rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens.functions.columns import SEVERITIES, severity_rank
from quarrylens.runtime import materialize

LANES = tuple("external-analyzer human-judgment native-static".split())
GATED = ("runtime-source",)
DIMENSIONS = ("severity", "confidence", "actor_label", "triage_state", "priority", "baseline_status", "lifecycle_state", "owner_lane", "scope_class")
ABSENT = ("not-installed", "version-or-runtime-problem", "downstream-setup-required")
FINE = ("executed", "no-tests-collected", "no-applicable-source")


def gated(classes=GATED) -> Column:
    return F.col("scope_class").isin(*classes)


def count_by(rows: DataFrame, classes=GATED, dimensions=DIMENSIONS) -> DataFrame:
    """counts(dimension, value, n) over all dimensions in one aggregation: the cells are unpivoted, not the table read again."""
    pairs = [F.struct(F.lit(f"by_{d}").alias("dimension"), F.coalesce(F.col(d), F.lit("")).alias("value")) for d in dimensions]
    pairs.append(F.struct(F.lit("by_scope_policy").alias("dimension"), F.when(gated(classes), "gated").otherwise("advisory").alias("value")))
    aside = F.when(~gated(classes), F.struct(F.lit("advisory_by_scope_class").alias("dimension"), F.col("scope_class").alias("value")))
    cells = rows.select(F.explode(F.array_compact(F.array(*pairs, aside))).alias("c"))
    return cells.groupBy("c.dimension", "c.value").agg(F.count("*").alias("n"))


def totals(rows: DataFrame, classes=GATED) -> DataFrame:
    """One row of scalar counts."""
    unwaived = F.coalesce("waiver_status", F.lit("none")) == "none"
    n = lambda c, name: F.count_if(c).alias(name)
    return rows.agg(
        F.count("*").alias("total_findings"),
        n(~unwaived, "waived_count"),
        n(F.col("baseline_status") == "new", "new_count"),
        n(F.col("baseline_status") == "existing-baseline", "existing_baseline_count"),
        n(F.col("severity").isin("high", "critical") & unwaived & gated(classes), "blocker_count"),
        n(F.col("triage_state") == "accepted-residual", "residual_count"),
    )


@dataclass(frozen=True)
class GatePolicy:
    severity_threshold: str = "high"
    fail_on_new_findings: bool = False
    fail_on_unreviewed_review_required: bool = False
    fail_on_analyzer_errors: bool = False

    @property
    def blocking(self) -> list[str]:
        return list(SEVERITIES[SEVERITIES.index(self.severity_threshold) :])


MEMBERS = 1000  # findings of a reason that its row lists; gate_members() has all


def _gate_tests(policy: GatePolicy, classes) -> dict[str, tuple[Column, bool]]:
    free = (F.coalesce("waiver_status", F.lit("none")) == "none") & gated(classes)
    new = F.col("baseline_status") == "new"
    return {
        "severity-threshold": (free & F.col("severity").isin(*policy.blocking), True),
        "new-findings-present": (free & new, policy.fail_on_new_findings),
        "unreviewed-review-required": (free & new & (F.col("owner_lane") == "human-judgment"), policy.fail_on_unreviewed_review_required),
    }


def gate_members(rows: DataFrame, policy: GatePolicy, classes=GATED) -> DataFrame:
    """(reason, finding_id): every finding that gives a reason, whether the policy asks for it or not."""
    hits = [F.when(c, F.lit(k)) for k, (c, _) in _gate_tests(policy, classes).items()]
    return rows.select(F.explode(F.array_compact(F.array(*hits))).alias("reason"), "finding_id")


def gate(rows: DataFrame, policy: GatePolicy, failed_tools: list[str] = (), classes=GATED) -> DataFrame:
    """One row: the decision, the counts behind it, and each reason with the first MEMBERS findings, by id, that give it. Only rows of gated
    classes count. The findings that give a reason are written once, and counted and ranked from there."""
    tests = _gate_tests(policy, classes)
    given = materialize(gate_members(rows, policy, classes))
    counts = given.agg(*[F.count_if(F.col("reason") == k).cast("int").alias(k) for k in tests])
    place = F.row_number().over(Window.partitionBy("reason").orderBy("finding_id"))
    some = given.withColumn("place", place).where(F.col("place") <= MEMBERS)
    some = some.groupBy("reason").agg(F.array_sort(F.collect_list("finding_id")).alias("ids"))
    some = some.agg(F.map_from_entries(F.collect_list(F.struct("reason", "ids"))).alias("members"))  # a row for each reason
    one = counts.crossJoin(F.broadcast(some))  # one row each
    detail = [F.when(F.lit(on) & (F.col(f"`{k}`") > 0), F.struct(F.lit(k).alias("reason"), F.col(f"`{k}`").alias("count"), F.try_element_at("members", F.lit(k)).alias("members"))) for k, (_, on) in tests.items()]
    tools = F.array(*map(F.lit, failed_tools)).cast("array<string>")
    detail.append(F.when(F.lit(policy.fail_on_analyzer_errors and bool(failed_tools)), F.struct(F.lit("analyzer-runtime-error").alias("reason"), F.lit(len(failed_tools)).alias("count"), tools.alias("members"))))
    why = F.array_compact(F.array(*detail))
    return one.select(
        F.when(F.size(why) > 0, "fail").otherwise("pass").alias("decision"),
        F.col("`severity-threshold`").alias("blocking_count"),
        F.col("`unreviewed-review-required`").alias("unreviewed_review_required_count"),
        F.lit(len(failed_tools)).alias("analyzer_failure_count"),
        F.transform(why, lambda x: x["reason"]).alias("reasons"),
        why.alias("reason_details"),
        F.array(*map(F.lit, policy.blocking)).alias("blocking_severities"),
    )


def blockers(rows: DataFrame, policy: GatePolicy, classes=GATED) -> DataFrame:
    held = rows.where(gated(classes) & F.col("severity").isin(*policy.blocking) & (F.col("waiver_status") == "none"))
    return held.select(F.concat(F.lit("B-"), "finding_id").alias("blocker_id"), "finding_id", "signal", "severity", "target_file", "line", "reason", F.lit("resolve-or-waive").alias("required_decision"))


def residuals(rows: DataFrame) -> DataFrame:
    kept = rows.where("triage_state = 'accepted-residual'")
    return kept.select(F.concat(F.lit("R-"), "finding_id").alias("residual_id"), F.lit("accepted-risk").alias("classification"), "reason", "target_file", "line")


def top_counts(rows: DataFrame, column: str, order: str = "emitted", most: int = 5, drop_empty: bool = False) -> DataFrame:
    """The most frequent values, ties by first appearance."""
    if drop_empty:
        rows = rows.where(F.col(column) != "")
    return rows.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("count"), F.min(order).alias("first")).orderBy(F.desc("count"), "first").limit(most).select("name", "count")


def brief(rows: DataFrame, decision: str, n_blockers: int, tool_states: dict[str, str], classes=GATED, from_view: bool = False) -> dict:
    """The review brief; small by nature, so its top lists are collected."""
    top = lambda c, r=rows: [x.asDict() for x in top_counts(r, c, drop_empty=from_view).collect()]
    aside = rows.where(~gated(classes))
    n = aside.count()
    outside = top("scope_class", aside)
    names = [x["name"] for x in outside]
    failures = sorted(t for t, s in tool_states.items() if s not in (*FINE, *ABSENT))
    absent = sorted(t for t, s in tool_states.items() if s in ABSENT)
    focus = ["Begin with the files and signals on top."]
    if failures:
        focus.append("Repair the tools that failed before a clean result counts.")
    elif absent:
        focus.append("Settle whether the absent tools are needed here.")
    if n:
        focus.append("Review what lies outside the gate on its own.")
    return {
        "gate_decision": decision,
        "blocker_headline": f"{n_blockers} finding{'s' * (n_blockers != 1)} block{'s' * (n_blockers == 1)} the gate." if n_blockers else "Nothing blocks the gate.",
        "advisory_headline": f"{n} advisory finding{'s' * (n != 1)} in {', '.join(sorted(names) if from_view else names)}." if n else "Nothing lies outside the gate.",
        "top_files": top("target_file"),
        "top_signals": top("signal"),
        "top_scope_classes": top("scope_class"),
        "advisory_scope_classes": outside,
        "analyzer_failures": failures,
        "analyzer_availability_notes": absent,
        "recommended_focus": focus,
    }


def view(rows: DataFrame, scope_classes=(), lanes=()) -> DataFrame:
    """Findings of some scope classes and lanes; unknown names are an error, an empty list means all."""
    known = {"scope_class": "runtime-source tests fixtures docs-evidence roadmap-evidence maintainer-probes support generated".split(), "owner_lane": list(LANES)}
    for column, wanted in (("scope_class", scope_classes), ("owner_lane", lanes)):
        if bad := set(wanted) - set(known[column]):
            raise ValueError(f"unknown {column}: {', '.join(sorted(bad))}")
        if wanted:
            rows = rows.where(F.col(column).isin(*wanted))
    return rows


def by_severity(rows: DataFrame) -> DataFrame:
    """Most severe first, then in the order of emission."""
    return rows.orderBy(F.desc(severity_rank(F.col("severity"))), "emitted")


def counts_by_rule(rows: DataFrame) -> DataFrame:
    """Unwaived findings of each rule: what the ratchet compares."""
    return rows.where(F.coalesce("waiver_status", F.lit("none")) == "none").groupBy("ci_id").agg(F.count("*").alias("n"))


def ratchet_violations(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Rules with more findings than stored; counts(ci_id, n) on both sides, a missing one is 0."""
    s = stored.select(F.col("ci_id"), F.col("n").alias("previous"))
    out = current.select("ci_id", F.col("n").alias("current")).join(s, "ci_id", "left").withColumn("previous", F.coalesce("previous", F.lit(0).cast("long")))
    return out.where("current > previous").select("ci_id", "previous", "current", (F.col("current") - F.col("previous")).alias("delta"))


def view_summary(rows: DataFrame, classes=GATED, suppressed_count: int = 0, resolved_baseline_count: int = 0) -> DataFrame:
    """(dimension, value, n) of a view of a report: count_by() and totals() under the report's own gate classes, an absent value as ''."""
    one = totals(rows, classes).withColumns({"suppressed_count": F.lit(suppressed_count), "resolved_baseline_count": F.lit(resolved_baseline_count)})
    scalars = one.select(F.explode(F.array(*[F.struct(F.lit("total").alias("dimension"), F.lit(c).alias("value"), F.col(c).cast("long").alias("n")) for c in one.columns])).alias("s")).select("s.*")
    return count_by(rows, classes, (*DIMENSIONS,)).unionByName(scalars)


def view_gate(rows: DataFrame, policy: GatePolicy, tool_states: dict[str, str], classes=GATED) -> DataFrame:
    """The gate of a view: as gate(), under the report's classes; tools that are absent or not set up are no failures here."""
    return gate(rows, policy, sorted(t for t, s in tool_states.items() if s not in (*FINE, *ABSENT)), classes)


STORED_DIMENSIONS = ("by_severity", "by_baseline_status")
STORED_TOTALS = ("total_findings", "new_count", "existing_baseline_count", "waived_count", "residual_count")


def stored_counts(spark: SparkSession, summary: dict) -> tuple[DataFrame, DataFrame]:
    """counts(dimension, value, n) and totals(name, stored) of a report's summary; what is no count is null."""
    number = lambda x: x if isinstance(x, int) and not isinstance(x, bool) else None
    tables = {d: summary.get(d) if isinstance(summary.get(d), dict) else {} for d in STORED_DIMENSIONS}
    counts = spark.createDataFrame([(d, str(k), number(n)) for d, of in tables.items() for k, n in of.items()], "dimension string, value string, n long")
    return counts, spark.createDataFrame([(k, number(summary.get(k))) for k in STORED_TOTALS], "name string, stored long")


def problems(rows: DataFrame, counts: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """What is wrong with a report: enumerations out of their domain, and, held against a recount of its rows, the counts(dimension, value, n)
    of the dimensions and the totals(name, stored) of its summary. No rows: valid."""
    domains = {"severity": SEVERITIES, "confidence": SEVERITIES[:3], "baseline_status": ("new", "existing-baseline"), "waiver_status": ("none", "active-waiver"), "owner_lane": LANES}
    bad = [F.when(~F.coalesce(F.col(c).isin(*d), F.lit(False)), F.concat(F.lit(f"{c}: "), F.coalesce(c, F.lit("null")))) for c, d in domains.items()]
    bad += [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"{c} is empty")) for c in ("finding_id", "fingerprint", "ci_id", "signal", "target_file")]
    bad.append(F.when(F.col("line") < 1, F.lit("line is below 1")))
    out = rows.select(F.explode(F.array_compact(F.array(*bad))).alias("problem"))
    if counts is not None:
        names = [d.removeprefix("by_") for d in STORED_DIMENSIONS]
        own = count_by(rows, dimensions=names).where(F.col("dimension").isin(*STORED_DIMENSIONS)).withColumnRenamed("n", "recount")
        again = own.join(counts.where(F.col("dimension").isin(*STORED_DIMENSIONS)), ["dimension", "value"], "full").where("NOT (recount <=> n)")
        out = out.unionByName(again.select(F.concat_ws(" ", "dimension", "value", F.lit("does not add up")).alias("problem")))
    if stored is not None:
        one = totals(rows)
        own = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("recount")) for c in STORED_TOTALS])).alias("s")).select("s.*")
        out = out.unionByName(own.join(stored, "name", "left").where("NOT (recount <=> stored)").select(F.concat_ws(" ", "name", F.lit("does not add up")).alias("problem")))
    return out


def document_problems(report: dict) -> list[str]:
    """What is wrong with the parts of a report document around its findings."""
    out = [f"{k} is no list" for k in ("findings", "blockers", "residuals") if not isinstance(report.get(k, []), list)]
    out += [f"{k} is missing" for k in ("summary", "gate", "findings") if k not in report]
    verdict = report.get("gate") if isinstance(report.get("gate"), dict) else {}
    if verdict.get("decision") not in ("pass", "fail"):
        out.append("gate.decision is neither pass nor fail")
    if verdict.get("blocking_count") != len(report.get("blockers") or []):
        out.append("gate.blocking_count does not add up")
    told = {x.get("reason") for x in verdict.get("reason_details") or []}
    return out + [f"gate.reason_details lacks {r}" for r in verdict.get("reasons") or [] if r not in told]
