"""Corpus density, precision and review packs as Markdown and files."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.operators import evaluate as E
from quarrylens.runtime import discard, materialize
from quarrylens.sinks.emit import write_text

RANGE = 50_000


def _table(head: list[str], rows: list[list]) -> str:
    line = lambda xs: "| " + " | ".join("" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x).replace("|", "\\|") for x in xs) + " |"
    return "\n".join([line(head), line(["-"] * len(head)), *map(line, rows)]) + "\n"


def density_markdown(rows: DataFrame) -> str:
    """Findings of each rule over a corpus, with samples; one row a rule is collected."""
    out = E.density(rows).collect()
    return "# Findings by rule\n\n" + _table(["rule", "findings", "files", "samples"], [[r["ci_id"], r["n"], r["files"], "; ".join(f"{s['project']}/{s['target_file']}:{s['line']}" for s in r["samples"])] for r in out])


def write_corpus(rows: DataFrame, path: str, with_findings: bool = False, **settings) -> None:
    """A corpus document: each project's and each rule's findings, with samples, and all of them if asked, streamed row by row.

    rows are written once and read from there; the driver gets them in ranges of about RANGE rows.
    """
    rows = materialize(rows)
    density = [r.asDict(recursive=True) for r in E.density(rows).collect()]  # one row a rule
    projects = [r.asDict() for r in rows.groupBy("project").agg(F.count("*").alias("total_findings")).orderBy("project").collect()]
    head = {"projects": projects, "total_findings": sum(p["total_findings"] for p in projects), "per_ci_id": {r["ci_id"]: {"count": r["n"], "files_affected": r["files"], "samples": r["samples"]} for r in density}, **settings}
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        f.write(json.dumps(head, ensure_ascii=False)[:-1])
        if with_findings:
            f.write(', "findings": [')
            ranges = rows.repartitionByRange(max(1, -(-head["total_findings"] // RANGE)), "emitted").sortWithinPartitions("emitted")
            for k, x in enumerate(ranges.drop("emitted").toJSON().toLocalIterator()):
                f.write(", " * bool(k) + x)
            f.write("]")
        f.write("}\n")
    os.replace(f"{path}.new", path)
    discard(rows)


def precision_markdown(rows: DataFrame, labels: DataFrame) -> str:
    out = sorted(E.precision(rows, labels).collect(), key=lambda r: (r["is_total"], r["ci_id"] or ""))
    names = ["true_positive", "false_positive", "skipped", "unlabeled", "precision", "label_coverage"]
    return "# Precision\n\n" + _table(["rule", *names], [["all" if r["is_total"] else r["ci_id"], *(r[n] for n in names)] for r in out])


def write_review_pack(rows: DataFrame, folder: str, most: int, labels: DataFrame | None = None) -> None:
    """A folder with the findings to review (round robin over projects), a label template and a page about them."""
    os.makedirs(folder, exist_ok=True)
    chosen = E.round_robin(rows, most)
    write_text("".join(x + "\n" for x in chosen.toJSON().toLocalIterator()), os.path.join(folder, "findings.jsonl"))
    template = [json.loads(x) for x in E.label_template(chosen, labels).orderBy("ci_id", "project", "target_file", "line").toJSON().toLocalIterator()]
    write_text(json.dumps(template, indent=1, ensure_ascii=False) + "\n", os.path.join(folder, "labels.json"))
    write_text(f"# Review\n\nUp to {most} findings a rule. Set each label to true-positive, false-positive or skip.\n\n" + density_markdown(chosen), os.path.join(folder, "README.md"))
