"""Payloads of thirteen outside tools as raw findings: payloads(tool, root, payload) is parsed in Spark, a broken one gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUFF = {
    **dict.fromkeys(("F", "UP", "ERA"), "CI-07"), "I": "CI-13", "D": "CI-15", "ANN": "CI-23", "S": "CI-14", "PT": "CI-09", "DTZ": "CI-25",
    **dict.fromkeys("E W C N SIM PL PLR PLW PLC".split(), "CI-02"), **dict.fromkeys(("B", "TRY", "BLE"), "CI-21"), "TD": "CI-03", "FIX": "CI-03",
}
RUFF_CODES = {"PLR0913": "CI-18", "PLW0603": "CI-26"}
ESLINT = {"CI-07": "no-unreachable no-unused", "CI-13": "import/", "CI-14": "no-eval no-implied-eval no-new-func security/", "CI-21": "no-empty", "CI-23": "@typescript-eslint/"}


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def ruff_rule(code: Column) -> Column:
    """The rule that a ruff code belongs to: by the code, else by its letters."""
    letters = F.regexp_extract(code, "^([A-Z]+)", 1)
    return F.coalesce(F.try_element_at(_map(RUFF_CODES), code), F.try_element_at(_map(RUFF), letters), F.lit("CI-21"))


def eslint_rule(rule: Column) -> Column:
    out = F.when(F.coalesce(rule, F.lit("")) == "", "CI-02")
    for ci, prefixes in ESLINT.items():
        for prefix in prefixes.split():
            out = out.when(rule.startswith(prefix), ci)
    return out.otherwise("CI-02")


def relative(path: Column, root: Column) -> Column:
    """path below root, POSIX; as it is when it lies elsewhere."""
    p = F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")
    base = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.when(p.startswith(base), F.substr(p, F.length(base) + 1)).otherwise(p)


class _Tool:
    """One tool's rows: how its payload becomes items, and the columns of a finding from an item."""

    def __init__(self, items, path, line, ci_id, severity, text, evidence, confidence="medium", priority=None, excerpt=None):
        self.items, self.path, self.line, self.ci_id, self.severity, self.text = items, path, line, ci_id, severity, text
        self.evidence, self.confidence, self.priority, self.excerpt = evidence, confidence, priority, excerpt

    def findings(self, name: str, payloads: DataFrame) -> DataFrame:
        rows = self.items(payloads.where(F.col("tool") == name))
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        severity = lit(self.severity)
        out = rows.select(
            relative(self.path, F.col("root")).alias("path"), lit(self.line).cast("int").alias("line"), lit(self.ci_id).alias("ci_id"), F.lit(f"EXT_{name.upper().replace('-', '_')}").alias("signal"),
            severity.alias("severity"), F.lit(self.confidence).alias("confidence"), (lit(self.priority) if self.priority is not None else F.when(severity == "high", "P1").otherwise("P2")).alias("priority"),
            F.lit("external-analyzer").alias("owner_lane"), (self.excerpt if self.excerpt is not None else self.text).alias("excerpt"), self.text.alias("reason"),
            F.lit(f"Look at what {name} reports and mend or narrow it.").alias("recommended_action"), self.evidence.alias("evidence_ref"), F.col("place").alias("place"),
        )
        return out.where(F.coalesce(F.col("path"), F.lit("")) != "")


def _json(schema: str, *levels: str):
    """Items of a JSON payload: the path of arrays to explode; each level's element is a column e1, e2, ..."""

    def items(rows: DataFrame) -> DataFrame:
        out = rows.withColumn("e0", F.from_json(F.when(F.col("payload") == "", None).otherwise(F.col("payload")), schema)).withColumn("place", F.array().cast("array<int>"))
        for k, level in enumerate(levels):
            inner = F.col(f"e{k}") if level == "" else F.col(f"e{k}.{level}")
            out = out.select("*", F.posexplode(inner).alias("_k", f"e{k + 1}")).withColumn("place", F.concat("place", F.array("_k"))).drop("_k")
        return out

    return items


def _lines(pattern: str, groups: int):
    """Items of a text payload: its lines that match, group g as column g1, g2, ..."""

    def items(rows: DataFrame) -> DataFrame:
        out = rows.select("tool", "root", F.posexplode(F.split("payload", "\r\n|\r|\n")).alias("_k", "raw")).withColumn("raw", F.trim("raw"))
        out = out.where(F.col("raw").rlike(pattern)).withColumn("place", F.array("_k"))
        return out.select("root", "place", "raw", *[F.regexp_extract("raw", pattern, g).alias(f"g{g}") for g in range(1, groups + 1)])

    return items


def _pytest(rows: DataFrame) -> DataFrame:
    """Failed tests; one row for the session if it tells of failures without naming one."""
    lines = rows.select("root", "payload", F.filter(F.transform(F.split("payload", "\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x.startswith("FAILED ")).alias("failed"))
    named = lines.select("root", F.posexplode("failed").alias("_k", "raw")).select("root", F.array("_k").alias("place"), F.trim(F.substring("raw", 8, 1 << 30)).alias("said")).withColumn("file", F.substring_index("said", "::", 1))
    session = lines.where((F.size("failed") == 0) & F.lower("payload").contains("failed")).select("root", F.array(F.lit(0)).alias("place"), F.lit("pytest reported failing tests").alias("said"), F.lit("pytest-session").alias("file"))
    return named.unionByName(session)


def tools() -> dict[str, _Tool]:
    c = F.col
    first = lambda *xs: F.coalesce(*[F.when(x != "", x) if isinstance(x, Column) else F.lit(x) for x in xs])
    to = lambda prefix, x: F.concat(F.lit(prefix), F.coalesce(x.cast("string"), F.lit("")))
    code = F.coalesce(c("e1.code"), F.lit(""))
    semgrep = F.upper(F.coalesce("e1.extra.severity", F.lit("WARNING")))
    family = F.regexp_extract(F.lower("e1.check_id"), r"\.ci(21|22|23|26)\.", 1)
    vulnerable = lambda name, version, id_, text: F.concat(name, F.lit(" "), version, F.lit(" is affected by "), id_, F.lit(": "), F.substring(text, 1, 160))
    osv_text = first(c("e3.summary"), c("e3.details"), c("e3.id"))
    trivy_text = first(c("e2.Title"), c("e2.Description"), c("e2.VulnerabilityID"))
    high = lambda test, other="medium": F.when(test, "high").otherwise(other)
    return {
        "ruff": _Tool(_json("array<struct<filename:string,code:string,message:string,location:struct<row:int>>>", ""), c("e1.filename"), c("e1.location.row"), ruff_rule(code), high(code.rlike("^S([^A-Z]|$)")), c("e1.message"), to("ruff:", code)),
        "pyflakes": _Tool(_lines(r"^(.+?):(\d+):(?:\d+:?)?\s*(.+)$", 3), c("g1"), c("g2"), F.when(F.lower("g3").contains("undefined name"), "CI-21").otherwise("CI-07"), "medium", c("g3"), F.lit("pyflakes")),
        "mypy": _Tool(_lines(r"^(.+?):(\d+):(?:\d+:)?\s*(error|note):\s*(.+)$", 4), c("g1"), c("g2"), "CI-23", F.when(c("g3") == "error", "high").otherwise("low"), c("g4"), F.lit("mypy")),
        "pytest": _Tool(_pytest, c("file"), F.lit(None), "CI-09", "high", c("said"), F.lit("pytest")),
        "semgrep": _Tool(_json("struct<results:array<struct<path:string,check_id:string,start:struct<line:int>,extra:struct<message:string,severity:string>>>>", "results"), c("e1.path"), c("e1.start.line"), F.when(family != "", F.concat(F.lit("CI-"), family)).otherwise("CI-14"), F.when(semgrep == "ERROR", "high").when(semgrep == "INFO", "low").otherwise("medium"), F.coalesce("e1.extra.message", F.lit("semgrep reported a finding")), to("semgrep:", c("e1.check_id"))),
        "eslint": _Tool(_json("array<struct<filePath:string,messages:array<struct<ruleId:string,severity:int,line:int,message:string>>>>", "", "messages"), c("e1.filePath"), c("e2.line"), eslint_rule(c("e2.ruleId")), high(c("e2.severity") == 2), c("e2.message"), to("eslint:", c("e2.ruleId"))),
        "tsc": _Tool(_lines(r"^(.+?)[(]([0-9]+),([0-9]+)[)]: *(?:warning|error) *(TS[0-9]+): *(.+)$", 5), c("g1"), c("g2"), "CI-23", "high", c("g5"), to("tsc:", c("g4")), confidence="high"),
        "shellcheck": _Tool(_json("array<struct<file:string,line:int,level:string,code:int,message:string>>", ""), c("e1.file"), c("e1.line"), F.when(c("e1.level").isin("error", "warning"), "CI-21").otherwise("CI-02"), high(c("e1.level") == "error"), c("e1.message"), to("shellcheck:SC", c("e1.code")), priority="P2"),
        "sqlfluff": _Tool(lambda rows: _json("array<struct<filepath:string,violations:array<struct<code:string,description:string,line_no:int,warning:boolean>>>>", "", "violations")(rows.withColumn("payload", F.coalesce(F.get_json_object("payload", "$.files"), "payload"))), c("e1.filepath"), c("e2.line_no"), "CI-02", F.when(c("e2.warning"), "low").otherwise("medium"), c("e2.description"), to("sqlfluff:", c("e2.code")), priority="P2"),
        "gitleaks": _Tool(_json("array<struct<RuleID:string,Description:string,File:string,StartLine:int>>", ""), c("e1.File"), F.when(c("e1.StartLine") != 0, c("e1.StartLine")).otherwise(1), "CI-14", "high", F.concat(F.lit("A secret was committed: "), first(c("e1.RuleID"), c("e1.Description"), "secret")), to("gitleaks:", first(c("e1.RuleID"), c("e1.Description"), "secret")), excerpt=first(c("e1.RuleID"), c("e1.Description"), "secret")),
        "osv-scanner": _Tool(_json("struct<results:array<struct<source:struct<path:string>,packages:array<struct<package:struct<name:string,version:string>,vulnerabilities:array<struct<id:string,summary:string,details:string>>>>>>>", "results", "packages", "vulnerabilities"), c("e1.source.path"), F.lit(1), "CI-14", "high", vulnerable(first(c("e2.package.name"), "?"), first(c("e2.package.version"), "?"), c("e3.id"), osv_text), to("osv-scanner:", c("e3.id"))),
        "trivy": _Tool(_json("struct<Results:array<struct<Target:string,Vulnerabilities:array<struct<VulnerabilityID:string,PkgName:string,InstalledVersion:string,Severity:string,Title:string,Description:string>>>>>", "Results", "Vulnerabilities"), c("e1.Target"), F.lit(1), "CI-14", high(F.lower("e2.Severity").isin("high", "critical")), vulnerable(first(c("e2.PkgName"), "?"), first(c("e2.InstalledVersion"), "?"), c("e2.VulnerabilityID"), trivy_text), to("trivy:", c("e2.VulnerabilityID"))),
        "codeql": _Tool(_json("struct<runs:array<struct<results:array<struct<ruleId:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>>>>", "runs", "results"), F.try_element_at("e2.locations", F.lit(1))["physicalLocation"]["artifactLocation"]["uri"], F.coalesce(F.try_element_at("e2.locations", F.lit(1))["physicalLocation"]["region"]["startLine"], F.lit(1)), "CI-14", "high", F.concat(F.lit("codeql ("), c("e2.ruleId"), F.lit("): "), F.substring(first(c("e2.message.text"), c("e2.ruleId")), 1, 160)), to("codeql:", c("e2.ruleId")), excerpt=c("e2.ruleId")),
    }


def parse_payloads(payloads: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Raw findings of payloads(tool, root, payload); equal to native raw findings but for phase 3 and evidence_ref."""
    out = None
    for rank, (name, tool) in enumerate(tools().items()):
        if only is None or name in only:
            rows = tool.findings(name, payloads).withColumn("rule_rank", F.lit(rank))
            out = rows if out is None else out.unionByName(rows)
    # place: the positions, level by level, in one payload; of several payloads of a tool, findings are told apart by what emission_key() holds
    digits = F.transform("place", lambda x: F.least(x, F.lit(9999)))
    order = F.aggregate(digits, F.lit(0).cast("long"), lambda s, x: s * 10000 + x)
    return out.withColumns({"phase": F.lit(3), "ord": order, "symbol": F.lit(""), "content": F.lit("")}).drop("place")


def outcome(analyzer: Column, exit_code: Column, parsed: Column) -> Column:
    """Struct of ok and runtime_state of a finished tool."""
    fine = exit_code.isin(0, 1) | ((analyzer == "pytest") & (exit_code == 5)) | ((analyzer == "tsc") & (exit_code == 2))
    state = F.when(fine & parsed, F.when((analyzer == "pytest") & (exit_code == 5), "no-tests-collected").otherwise("executed")).when(fine, "parse-failure").otherwise("runtime-failure")
    return F.struct((fine & parsed).alias("ok"), state.alias("runtime_state"))


def readiness(version_text: Column, least: Column) -> Column:
    """State of a tool from what its version probe printed (null: it isn't there) and the least version that is accepted (null: any)."""
    number = lambda t: F.transform(F.split(F.regexp_extract(t, r"(\d+\.\d+\.\d+)", 1), r"\."), lambda x: x.try_cast("int"))
    good = least.isNull() | (F.regexp_extract(version_text, r"(\d+\.\d+\.\d+)", 1) != "") & (number(version_text) >= number(least))
    return F.when(version_text.isNull(), "not-installed").when(good, "ready").otherwise("version-or-runtime-problem")
