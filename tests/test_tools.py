"""Domain packs, outside tools, review packs, own rules, the command line, and the engine without its corpus operators."""

import ast
import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from quarrylens import cli
from quarrylens.operators import catalog
from quarrylens.operators.adapters import outcome, readiness
from quarrylens.operators.scan import scan_files
from quarrylens.sinks.review import density_markdown, precision_markdown, write_review_pack
from quarrylens.sources.domains import load_domain
from quarrylens.sources.tools import availability, run_tools


def test_domains(tmp_path):
    assert load_domain(None).side_program_terms == ()
    pack = tmp_path / "shop/python/shop_domain_rules.py"
    pack.parent.mkdir(parents=True)
    pack.write_text("from types import SimpleNamespace as N\nSHOP_DOMAIN_RULES = N(domain_id='shop', side_program_terms=['till'], authority_terms=['owns'])\n")
    assert load_domain("shop", folder=str(tmp_path)).side_program_terms == ("till",)
    assert load_domain("shop", file=str(pack)).authority_terms == ("owns",)
    with pytest.raises(ValueError):
        load_domain("other", folder=str(tmp_path))


def test_tools(spark, tmp_path):
    (tmp_path / "test_x.py").write_text("def test_a():\n    assert 0\n")
    runs = {r["tool"]: r for r in run_tools(spark, str(tmp_path), ["pytest", "trivy"], []).collect()}
    assert runs["trivy"]["state"] == "not-installed"
    assert runs["pytest"]["state"] == "executed" and "FAILED" in runs["pytest"]["payload"]
    states = {r["tool"]: r["state"] for r in availability(spark, ("pytest", "trivy")).collect()}
    assert states == {"pytest": "ready", "trivy": "not-installed"}
    rows = [("mypy", 0, True, "executed"), ("pytest", 5, True, "no-tests-collected"), ("tsc", 2, True, "executed"), ("ruff", 2, True, "runtime-failure"), ("ruff", 0, False, "parse-failure")]
    df = spark.createDataFrame(rows, "t string, code int, parsed boolean, want string")
    assert df.where(outcome(F.col("t"), F.col("code"), F.col("parsed"))["runtime_state"] != F.col("want")).count() == 0
    texts = [(None, None, "not-installed"), ("tool 1.10.0", "1.9.2", "ready"), ("tool 1.8.9", "1.9.2", "version-or-runtime-problem"), ("no number", "1.0.0", "version-or-runtime-problem"), ("x", None, "ready")]
    df = spark.createDataFrame(texts, "said string, least string, want string")
    assert df.where(readiness(F.col("said"), F.col("least")) != F.col("want")).count() == 0


def test_catalog(spark):
    assert catalog.active_signals("unknown") == set(catalog.EVERY) and "CI05_COPY_PASTE_CODE" not in catalog.active_signals("quick-gate")
    assert catalog.applicable_tools("full", {".py", ".sql"}, True, False) == ["ruff", "pyflakes", "mypy", "pytest", "semgrep", "sqlfluff"]
    assert catalog.profile_signals(spark).where("profile_id = 'full' AND opt_in").count() == 5
    assert catalog.execution_plan(spark, {"ruff": "ready"}).where("runs").count() == 5


def test_review_pack(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{k}", "CI-1", f"p{k % 2}", "a.py", k, k) for k in range(6)], "fingerprint string, ci_id string, project string, target_file string, line int, emitted int")
    write_review_pack(rows, str(tmp_path), 3)
    assert [x["fingerprint"] for x in json.loads((tmp_path / "labels.json").read_text())] == ["f0", "f2", "f1"]
    assert "| CI-1 | 6 | 2 |" in density_markdown(rows)
    labels = spark.createDataFrame([("f0", "true-positive"), ("f1", "false-positive")], "fingerprint string, label string")
    assert "| all | 1 | 1 | 0 | 4 | 0.500 | 0.333 |" in precision_markdown(rows, labels)


def test_own_rules(spark):
    def lambdas(t):
        if hasattr(t, "nodes"):
            yield from (t.fact("lambda", n.lineno) for n in t.nodes if isinstance(n, ast.Lambda))

    def rule(facts):
        lit = {c: F.lit(v) for c, v in {"ci_id": "CI-90", "signal": "OWN_LAMBDA", "severity": "low", "confidence": "low", "priority": "P3", "owner_lane": "native-static", "reason": "a lambda", "recommended_action": "name it"}.items()}
        return facts.where("kind = 'lambda'").select("path", "line", *[v.alias(k) for k, v in lit.items()], "excerpt", "symbol", "content", F.lit(1).alias("phase"), F.lit(99).alias("rule_rank"), "ord")

    files = spark.createDataFrame([("a.py", "x = 1\nf = lambda: x\n")], "path string, text string")
    assert [(r["signal"], r["line"]) for r in scan_files(files, emitters=(lambdas,), rules=(rule,)).findings.collect()] == [("OWN_LAMBDA", 2)]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("eval(x)\n")
    out = str(tmp_path / "r.json")
    do = lambda *a: cli.run(spark, cli.parser().parse_args(list(a)))
    assert do("scan", str(tmp_path), "--output", out, "--ratchet", str(tmp_path / "s.json")) == 1
    assert do("validate-report", out) == 0
    assert do("emit-sarif", out, "--output", str(tmp_path / "s.sarif")) == 0 and do("validate-sarif", str(tmp_path / "s.sarif")) == 0
    assert do("emit-github-summary", out, "--output", str(tmp_path / "s.md")) == 0 and "fail" in (tmp_path / "s.md").read_text()
    assert do("emit-annotations", out, "--output", str(tmp_path / "a.txt")) == 0 and (tmp_path / "a.txt").read_text().startswith("::error file=src/a.py")
    assert do("emit-baseline", out, "--output", str(tmp_path / "b.toml")) == 0
    capsys.readouterr()
    assert do("show-profile-catalog") == 0 and len(json.loads(capsys.readouterr().out)) == 8


def test_without_corpus_operators(tmp_path):
    root = Path(__file__).resolve().parent.parent
    for name in ("quarrylens", "__spark_entry__.py"):
        copy = shutil.copytree if (root / name).is_dir() else shutil.copy
        copy(root / name, tmp_path / name)
    shutil.rmtree(tmp_path / "quarrylens/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'secret_gate' in q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q); e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
