"""Findings as JSON, SARIF, workflow annotations, Markdown and baseline TOML; rows are rendered in Spark, only documents are put together here."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.columns import encode_message, encode_param
from quarrylens.operators.report import GATED, gated

LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}
MARKS = {"critical": "error", "high": "error", "medium": "warning", "low": "notice"}


def _mapped(table: dict[str, str], column: str, other: str):
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.col(column)), F.lit(other))


def sarif_results(rows: DataFrame, classes=GATED) -> DataFrame:
    """(emitted, rule_id, result JSON) of each finding."""
    aside = ~gated(classes)
    text = F.when(aside, F.concat(F.lit("Advisory-only ("), "scope_class", F.lit("): "), "reason")).otherwise(F.col("reason"))
    where = F.struct(F.struct(F.struct(F.col("target_file").alias("uri")).alias("artifactLocation"), F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("startLine"))).alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.col("signal").alias("ruleId"),
        F.when(aside, "note").otherwise(_mapped(LEVELS, "severity", "warning")).alias("level"),
        F.struct(text.alias("text")).alias("message"),
        F.array(where).alias("locations"),
        F.struct(F.col("scope_class"), F.when(aside, "advisory-only").otherwise("gated").alias("scope_policy")).alias("properties"),
        F.struct(F.col("fingerprint").alias("primaryLocationLineHash")).alias("fingerprints"),
    )
    return rows.select("emitted", F.col("signal").alias("rule_id"), F.to_json(result).alias("result"))


def sarif_rules(rows: DataFrame) -> DataFrame:
    """(rule_id, rule JSON), each worded as its first finding."""
    first = rows.groupBy("signal").agg(F.min("emitted").alias("emitted"), F.min_by(F.struct("ci_id", "reason", "confidence", "severity"), "emitted").alias("f"))
    rule = F.struct(F.col("signal").alias("id"), F.col("f.ci_id").alias("name"), F.struct(F.col("f.reason").alias("text")).alias("shortDescription"), F.struct(F.col("f.confidence").alias("precision"), F.col("f.severity").alias("problem.severity")).alias("properties"))
    return first.select("emitted", F.col("signal").alias("rule_id"), F.to_json(rule).alias("rule"))


def write_sarif(rows: DataFrame, path: str, tool: str = "quarrylens", classes=GATED) -> None:
    """One SARIF 2.1.0 document, streamed from the driver row by row."""
    with open(path, "w", encoding="utf-8") as f:
        rules = [json.loads(r["rule"]) for r in sarif_rules(rows).orderBy("emitted").collect()]
        f.write(json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json"})[:-1])
        f.write(', "runs": [{"tool": ' + json.dumps({"driver": {"name": tool, "rules": rules}}, ensure_ascii=False) + ', "results": [')
        for k, r in enumerate(sarif_results(rows, classes).orderBy("emitted").toLocalIterator()):
            f.write(", " * bool(k) + r["result"])
        f.write("]}]}\n")


def sarif_problems(document: dict) -> list[str]:
    """What keeps a document from being SARIF as written here."""
    out = [] if document.get("version") == "2.1.0" else ["version is not 2.1.0"]
    runs = document.get("runs")
    if not isinstance(runs, list) or not runs:
        return [*out, "there are no runs"]
    for run in runs:
        known = {r.get("id") for r in run.get("tool", {}).get("driver", {}).get("rules", [])}
        for k, r in enumerate(run.get("results", [])):
            if r.get("ruleId") not in known:
                out.append(f"result {k}: unknown rule {r.get('ruleId')}")
            if r.get("level") not in ("error", "warning", "note", "none"):
                out.append(f"result {k}: unknown level")
            if not r.get("locations") or not r.get("message", {}).get("text"):
                out.append(f"result {k}: no location or message")
    return out


def annotations(rows: DataFrame, classes=GATED) -> DataFrame:
    """(emitted, line) workflow commands; a finding without a line is put on line 1."""
    aside = ~gated(classes)
    reason = F.when(aside, F.concat(F.lit("advisory-only ("), "scope_class", F.lit("): "), "reason")).otherwise(F.col("reason"))
    level = F.when(aside, "notice").otherwise(_mapped(MARKS, "severity", "notice"))
    text = F.format_string("::%s file=%s,line=%d,title=%s::%s", level, encode_param(F.col("target_file")), F.coalesce("line", F.lit(1)), encode_param(F.concat_ws(" ", "ci_id", "signal")), encode_message(reason))
    return rows.select("emitted", text.alias("annotation"))


def toml_text(column):
    """A string's inside in TOML: escapes for quotes, backslashes and control signs."""
    simple = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
    out = column
    for a, b in simple.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    for code in [*range(32), 127]:
        if chr(code) not in simple:
            out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04X}"))
    return out


def baseline_entries(rows: DataFrame) -> DataFrame:
    """(target_file, ci_id, fingerprint, entry) inline tables that accept each finding, without line numbers."""
    part = lambda c: F.when(F.col(c) != "", F.concat(F.lit(f'{c} = "'), toml_text(F.col(c)), F.lit('"')))
    inside = F.concat_ws(", ", *map(part, ("fingerprint", "ci_id", "target_file")))
    return rows.select("target_file", "ci_id", "fingerprint", F.concat(F.lit("  { "), inside, F.lit(" },")).alias("entry")).where(inside != "")


def write_baseline(rows: DataFrame, path: str) -> None:
    """Operations TOML whose baseline accepts every finding, in order of file, rule and fingerprint."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("# Accepted findings; take an entry out once it is mended.\n[baseline]\nentries = [\n")
        for r in baseline_entries(rows).orderBy("target_file", "ci_id", "fingerprint").toLocalIterator():
            f.write(r["entry"] + "\n")
        f.write("]\n")


def markdown_summary(report: dict) -> str:
    """A summary page of a report document."""
    gate, brief, summary = report["gate"], report["review_brief"], report["summary"]
    out = [f"## Inspection: {gate['decision']}", "", f"- findings: {summary['total_findings']}", f"- blocking: {gate['blocking_count']}", f"- {brief['blocker_headline']}", f"- {brief['advisory_headline']}"]
    for title, key in (("Files", "top_files"), ("Signals", "top_signals"), ("Scope classes", "top_scope_classes")):
        if brief[key]:
            out += ["", f"### {title}", "", *(f"- `{x['name']}`: {x['count']}" for x in brief[key])]
    out += ["", "### Next", "", *(f"- {x}" for x in brief["recommended_focus"])]
    return "\n".join(out) + "\n"


def write_findings(rows: DataFrame, path: str, format: str = "parquet", redact: bool = False) -> None:
    """Findings as a dataset; redact blanks quoted secrets in excerpts."""
    if redact:
        rows = rows.withColumn("excerpt", F.when(F.col("signal") == "CI14_PLAINTEXT_SECRET", F.regexp_replace("excerpt", "[0-9A-Za-z_-]{8,}", "***")).otherwise(F.col("excerpt")))
    rows.write.mode("overwrite").format(format).save(path)


def write_text(text: str, path: str) -> None:
    """A file replaced in one step."""
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(f"{path}.new", path)


def check_ratchet(counts: dict[str, int], state_path: str) -> dict:
    """Compare with the stored counts: the first time they are stored, a rise fails and changes nothing, else they are stored anew."""
    from quarrylens.sources.settings import ratchet_state

    stored = ratchet_state(state_path)
    risen = [{"ci_id": k, "previous": p, "current": n, "delta": n - p} for k, n in sorted(counts.items()) if stored is not None and n > (p := stored.get(k, 0))]
    if not risen:
        write_text(json.dumps({"version": "1", "ci_id_counts": counts}, sort_keys=True) + "\n", state_path)
    return {"decision": "fail" if risen else "pass", "mode": "baseline-created" if stored is None else "check", "ci_id_counts": counts, "violations": risen}
