"""Trees, scans, reports, sinks, the ratchet and the stream."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F
from quarrylens.operators import report as R
from quarrylens.operators.graph import strong_components
from quarrylens.operators.scan import Options, scan_files, scan_tree
from quarrylens.sinks import emit
from quarrylens.sources import settings
from quarrylens.sources.diff import parse_hunks
from quarrylens.sources.tree import preset_filters, read_tree, select_targets, synthetic_tree

FILES = {
    "src/a.py": "import os\ndef f():\n    try:\n        g()\n    except Exception:\n        pass\n    try:\n        g()\n    except Exception:\n        pass\n",
    "src/__init__.py": "", "src/_u.py": "eval(x)  # TODO\n", "tests/test_a.py": "eval(x)\n", "docs/n.md": "see http://api.internal.io\n", ".github/workflows/ci.yml": "uses: a/b@v1\n",
    "node_modules/x.py": "eval(x)\n", "big.py": "#" * 1_000_001, "bin.py": "\0", "pic.png": "x", "Dockerfile": "FROM a:latest\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    os.symlink(root / "src/a.py", root / "link.py")
    os.symlink(root / "src", root / "loop")
    return str(root)


def test_tree_and_skips(spark, tree):
    rows = {r["path"]: r["skip_reason"] for r in select_targets(read_tree(spark, tree)).collect()}
    assert set(rows) == {*FILES, "link.py", "loop"}
    assert {p for p, r in rows.items() if r is None} == {"src/a.py", "src/__init__.py", "src/_u.py", "tests/test_a.py", "docs/n.md", ".github/workflows/ci.yml", "Dockerfile"}
    assert rows["link.py"] == rows["loop"] == "symlink-skipped" and rows["node_modules/x.py"] == "generated-path-skipped"
    assert rows["big.py"] == "max-file-size-exceeded" and rows["bin.py"] == "binary-skipped" and rows["pic.png"] == "unsupported-suffix"
    assert preset_filters(tree, "source-only", [], [])[1] == [".github", "docs", "tests"]
    capped = {r["path"]: r["skip_reason"] for r in select_targets(read_tree(spark, tree), ["src"], most_files=2).collect()}
    assert [p for p, r in capped.items() if r is None and p] and sum(r is None for r in capped.values()) == 2 and capped["tests/test_a.py"] == ""
    with pytest.raises(ValueError):
        preset_filters(tree, "else", [], [])


@pytest.fixture(scope="module")
def done(spark, tree):
    return scan_tree(spark, tree, Options(policy=R.GatePolicy("high", fail_on_new_findings=True)))


def test_scan(done):
    got = sorted((r["target_file"], r["line"], r["signal"]) for r in done.findings.collect())
    assert got == [
        (".github/workflows/ci.yml", 1, "CI14_SUPPLY_CHAIN_DRIFT"), ("Dockerfile", 1, "CI14_SUPPLY_CHAIN_DRIFT"), ("src/_u.py", 1, "CI03_TODO_HACK"), ("src/_u.py", 1, "CI14_DYNAMIC_CODE_EXECUTION"),
        ("src/a.py", 5, "CI21_BROAD_EXCEPTION_SWALLOW"), ("tests/test_a.py", 1, "CI14_DYNAMIC_CODE_EXECUTION"),
    ]  # fmt: skip; two equal handlers of one function are one finding, addresses in docs are noise
    assert done.gate["decision"] == "fail" and done.gate["reasons"] == ["severity-threshold", "new-findings-present"] and done.gate["blocking_count"] == 1
    assert done.summary["total_findings"] == 6 and done.summary["by_severity"] == {"high": 2, "medium": 3, "low": 1} and done.exit_code() == 1


def test_report_documents(done, tmp_path):
    report = done.report("2024-01-01T00:00:00Z")
    assert [f["severity"] for f in report["findings"]] == ["high", "high", "medium", "medium", "medium", "low"]
    assert "Inspection: fail" in emit.markdown_summary(report)
    emit.write_sarif(done.findings, str(tmp_path / "s.sarif"))
    assert emit.sarif_problems(json.loads((tmp_path / "s.sarif").read_text())) == []
    emit.write_baseline(done.findings, str(tmp_path / "b.toml"))
    ops = settings.load_operations(done.findings.sparkSession, str(tmp_path / "b.toml"))
    assert ops.baseline.count() == 6
    assert R.problems(done.findings, R.count_by(done.findings)).count() == 0
    lines = [r["annotation"] for r in emit.annotations(done.findings).orderBy("emitted").collect()]
    assert any(x.startswith("::error file=src/_u.py,line=1,title=CI-14 CI14_DYNAMIC") for x in lines) and sum("advisory-only (tests)" in x for x in lines) == 1


def test_line_shifts_keep_identity_and_baselines(spark):
    text = "def f():\n    eval(x)\n"
    frame = lambda t: spark.createDataFrame([("a.py", t)], "path string, text string")
    first = scan_files(frame(text)).findings.collect()
    again = scan_files(frame("# new\n\n" + text)).findings.collect()
    assert [r["fingerprint"] for r in first] == [r["fingerprint"] for r in again] and again[0]["line"] == 4
    ops = settings.operations_from(spark, {"baseline": {"entries": [{"fingerprint": first[0]["fingerprint"]}, {"ci_id": "CI-02", "target_file": "a.py"}, {"ci_id": "CI-99"}]}, "waiver": {"entries": [{"waiver_id": "w", "ci_id": "CI-14", "line": 2}]}})
    done = scan_files(frame(text), operations=ops)
    one = done.findings.first()
    assert (one["baseline_status"], one["waiver_status"], one["triage_state"]) == ("existing-baseline", "active-waiver", "accepted-residual")
    assert [r["ci_id"] for r in done.resolved.collect()] == ["CI-02"]  # without a file an entry is never resolved
    hidden = scan_files(frame(text), operations=settings.operations_from(spark, {"suppression": {"entries": [{"match": "eval"}]}}))
    assert hidden.findings.count() == 0 and hidden.suppressed_count == 1
    for bad in ({"waiver": {"entries": [{"ci_id": "x"}]}}, {"baseline": {"entries": [{"line": "1"}]}}, {"suppression": {"entries": [{"match": ""}]}}):
        with pytest.raises(ValueError):
            settings.operations_from(spark, bad)


def test_external_rows(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    try:\n        g()\n    except Exception:\n        pass\n")], "path string, text string")
    payload = json.dumps([{"filename": "/r/a.py", "code": "BLE001", "message": "blind", "location": {"row": 5}}, {"filename": "/r/other.py", "code": "F401", "message": "x", "location": {"row": 1}}])
    out = scan_files(files, payloads=spark.createDataFrame([("ruff", "/r", payload)], "tool string, root string, payload string")).findings.collect()
    assert [(r["signal"], r["line"], r["ci_id"]) for r in out] == [("EXT_RUFF", 5, "CI-21")]  # the native row within a line gives way


def test_diff(spark, tmp_path):
    diff = "+++ b/x/a.py\n@@ -1 +2,2 @@ def\n+a\n@@ -9,2 +7,0 @@\n+++ b/b.py\n@@ -0,0 +1 @@\n+++ /dev/null\n@@ -1 +0,0 @@\n"
    assert sorted(map(tuple, parse_hunks(spark, diff).collect())) == [("b.py", 1, 1), ("x/a.py", 2, 3), ("x/a.py", 7, 7)]
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.py").write_text("eval(x)\n\n\neval(y)\n")
    (tmp_path / "b.py").write_text("eval(x)\n")
    git("add", "."), git("commit", "-qm", "x")
    (tmp_path / "a.py").write_text("eval(x)\n\n\neval(z)\n")
    out = scan_tree(spark, str(tmp_path), Options(diff_from="HEAD")).findings.collect()
    assert [(r["target_file"], r["line"]) for r in out] == [("a.py", 4)]


def test_ratchet(spark, tmp_path):
    at = str(tmp_path / "state.json")
    assert emit.check_ratchet({"CI-1": 2}, at)["mode"] == "baseline-created"
    broken = emit.check_ratchet({"CI-1": 3, "CI-2": 1}, at)
    assert broken["decision"] == "fail" and [v["delta"] for v in broken["violations"]] == [1, 1] and settings.ratchet_state(at) == {"CI-1": 2}
    assert emit.check_ratchet({"CI-1": 1}, at)["decision"] == "pass" and settings.ratchet_state(at) == {"CI-1": 1}


def test_ratchet_stream(spark, tmp_path):
    from quarrylens.streaming.ratchet import ratchet_stream

    for k, n in enumerate((2, 3, 1)):
        spark.range(n).select(F.lit("CI-1").alias("ci_id"), F.lit("none").alias("waiver_status")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        seen: dict[int, int] = {}
        stream = spark.readStream.schema("ci_id string, waiver_status string").parquet(str(tmp_path / "in"))
        ratchet_stream(stream, str(tmp_path / "state"), str(tmp_path / "ck"), lambda b, df: seen.update({b: df.count()})).awaitTermination(60)
        assert seen == {k: int(n == 3)}


def test_components_small_and_large_ways_agree(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (7, 7), (8, 9), (9, 10), (10, 8), (10, 1)]
    df = spark.createDataFrame(edges, "src long, dst long")
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 8, 9: 8, 10: 8}
    for most in (1000, 0):
        assert {r["node"]: r["component"] for r in strong_components(df, most).collect()} == want
    assert strong_components(df.limit(0)).count() == 0


def test_empty_and_null_files(spark):
    assert scan_files(spark.createDataFrame([("a.py", None), (None, "eval(x)")], "path string, text string")).findings.count() == 0
    empty = scan_files(spark.createDataFrame([], "path string, text string"))
    assert empty.findings.count() == 0 and empty.gate["decision"] == "pass" and empty.exit_code() == 0
    assert scan_files(synthetic_tree(spark, 50), Options(profile="quick-gate")).findings.count() == 0
    with pytest.raises(ValueError):
        scan_files(synthetic_tree(spark, 1), Options(profile="state-change"))


def test_corpus_documents_are_read_piece_by_piece(spark, tmp_path, monkeypatch):
    import tracemalloc

    at = tmp_path / "large.json"
    at.write_text(json.dumps({"findings": [{"fingerprint": f"f{k}", "project": "p", "ci_id": "CI-01", "line": k, "excerpt": "x" * 100} for k in range(100_000)]}))
    tracemalloc.start()
    rows = settings.load_harness(spark, str(at))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 and rows.count() == 100_000 and rows.agg(F.sum("line"), F.sum("emitted")).first()[:] == (4999950000, 4999950000)

    if hasattr(settings, "_Json"):
        monkeypatch.setattr(settings._Json, "PIECE", 1)
    one = {"fingerprint": "f [1]", "project": 'é "}', "line": 12345, "more": {"findings": [1, {"a": "]"}]}}
    document = {"per": {"findings": [{}], "n": 12.5}, "findings": [one, one | {"line": None, "ci_id": 7}], "z": [True, 10]}
    for text in (json.dumps(document), json.dumps(document, indent=2, ensure_ascii=False)):
        for code in ("utf-8", "utf-8-sig", "utf-16", "utf-16-le"):
            at.write_bytes(text.encode(code))
            got = [tuple(r) for r in settings.load_harness(spark, str(at)).orderBy("emitted").collect()]
            assert got == [("f [1]", 'é "}', None, None, None, 12345, 0), ("f [1]", 'é "}', "7", None, None, None, 1)]
    at.write_text('{"findings": []}')
    assert settings.load_harness(spark, str(at)).count() == 0
    for bad in ("[]", "{}", '{"findings": {}}', '{"findings": [1]}', '{"findings": [{"fingerprint": " "}]}', '{"findings": [{"fingerprint": "a"}', '{"findings": []} x', '{"findings": [{"fingerprint": "a", "line": "1"}]}'):
        at.write_text(bad)
        with pytest.raises((ValueError, TypeError)):
            settings.load_harness(spark, str(at))
