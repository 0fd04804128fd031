"""The inspection rules as queries over facts: one scan decides all rules of a single fact, aggregates and anti joins decide the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.columns import SAMPLE_SEGMENTS, has_segment, host_of, inert_host, under, value_shaped
from quarrylens.operators.graph import strong_components

RAW = "path string, line int, ci_id string, signal string, severity string, confidence string, priority string, owner_lane string, excerpt string, reason string, recommended_action string, symbol string, content string, phase int, rule_rank int, ord int"


@dataclass(frozen=True)
class Rule:
    """A rule of one fact. rank is the place in the order of emission; phase 0 runs file by file, phase 1 after all files."""

    signal: str
    ci_id: str
    rank: int
    kind: str
    when: Column
    severity: str
    confidence: Column | str
    priority: str
    reason: Column
    action: str
    excerpt: Column
    lane: str = "native-static"
    phase: int = 0
    active_on: str | None = None  # another signal that switches the rule on


def _say(text: str, *args: Column) -> Column:
    return F.format_string(text, *args) if args else F.lit(text)


def per_fact_rules() -> list[Rule]:
    """All rules that one fact decides, in the order of emission."""
    c = F.col
    n = lambda k: F.element_at(c("nums"), k)
    tag = lambda t: F.array_contains(c("names"), t)
    last = F.element_at(F.split(c("value"), r"\."), -1)
    first = F.element_at(F.split(c("value"), r"\."), 1)
    dotted = c("value").contains(".")
    line = c("excerpt")
    r: list[Rule] = []

    def add(signal, kind, when, severity, confidence, priority, reason, action, excerpt=line, **more):
        ci_id = "-".join([signal[:2], signal[2:4]])
        r.append(Rule(signal, ci_id, len(r), kind, when, severity, confidence, priority, reason, action, excerpt, **more))

    define = F.format_string("def %s(...)", c("name"))
    add("CI02_SPAGHETTI_CODE", "fn", (n(1) >= 5) & (n(2) >= 8), "medium", "medium", "P2", _say("%s nests %d deep with complexity %d", c("name"), n(1), n(2)), "Move inner blocks into named functions.", F.format_string("%s [nesting %d, complexity %d]", define, n(1), n(2)))
    add("CI02_LONG_FUNCTION", "fn", (n(3) >= 80) & (n(2) >= 15), "low", "low", "P3", _say("%s has %d lines of code with complexity %d", c("name"), n(3), n(2)), "Split the function by task.", F.format_string("%s [%d lines, complexity %d]", define, n(3), n(2)))
    add("CI03_TODO_HACK", "todo", F.lit(True), "low", "high", "P3", _say("A comment marks unfinished work"), "Track the work or drop the marker.", lane="human-judgment")
    add("CI04_GOD_CLASS", "class", (c("n1") >= 15) & (F.size(F.filter(c("nums"), lambda x: x >= 2)) >= 2), "low", "low", "P3", _say("%s has %d methods in %d groups that share nothing", c("name"), c("n1"), F.size("nums")), "Divide the class along these groups.", F.concat(F.lit("class "), c("name")))
    add("CI12_POLTERGEIST", "class", c("flag"), "low", "medium", "P3", _say("%s only forwards %d method(s) to one object", c("name"), c("n2")), "Call the object itself.", F.concat(F.lit("class "), c("name")))
    add("CI14_DYNAMIC_CODE_EXECUTION", "call", c("name").isin("eval", "exec"), "high", "high", "P1", _say("Text is run as code"), "Parse the input or dispatch by table.")
    add("CI14_SUBPROCESS_SHELL_TRUE", "call", tag("shell") & (first == "subprocess") & dotted & c("flag") & last.isin(*"Popen call check_call check_output run".split()), "high", "high", "P1", _say("A command goes through the shell"), "Pass a list of arguments without a shell.")
    add("CI14_PLAINTEXT_SECRET", "secret", F.lit(True), "critical", "medium", "P1", _say("A secret seems to be written in the file"), "Rotate it and read it from a secret store.")
    add("CI14_INSECURE_HTTP", "http", ~c("flag") & ~inert_host(host_of(c("value"))), "medium", "medium", "P2", _say("A plain http address is used"), "Use https or keep the address local.")
    add("CI14_UNSAFE_DESERIALIZATION", "call", first.isin("pickle", "dill", "marshal", "shelve") & dotted & c("flag") & last.isin("load", "loads", "open"), "high", "high", "P1", _say("%s.%s may run code while it reads", first, last), "Read a format with a checked schema.")
    add("CI14_UNSAFE_YAML_LOAD", "call", (first == "yaml") & (last == "load") & c("flag") & ~tag("safe_loader"), "high", "high", "P1", _say("YAML is read without a safe loader"), "Use the safe loader.")
    add("CI14_SUPPLY_CHAIN_DRIFT", "dep", ~c("flag"), "medium", "medium", "P2", _say("%s (%s) may change without review", c("name"), c("value")), "Pin the exact version.")
    add("CI14_TAINTED_FLOW", "taint", F.lit(True), "high", "high", "P1", _say("Untrusted input reaches %s", c("value")), "Check or parametrise the input first.")
    add("CI21_BROAD_EXCEPTION_SWALLOW", "handler", (c("name") == "Exception") & c("value").isNull() & ~tag("retry") & ~tag("reraises") & ~tag("fallback"), "medium", "medium", "P1", _say("Any exception is swallowed"), "Catch what is expected and report the rest.")
    add("CI21_SILENT_EXCEPTION_RETURN", "handler", c("name").isin("", "Exception") & tag("silent"), "medium", "medium", "P1", _say("A failure becomes an empty result"), "Raise it or return an error that callers see.")
    add("CI22_FIRE_AND_FORGET_TASK", "task", F.lit(True), "medium", "medium", "P2", _say("A task is started and not kept"), "Keep the task and await or cancel it.", active_on="CI22_RESOURCE_CLEANUP_GAP")
    add("CI22_RESOURCE_CLEANUP_GAP", "open", ~c("flag"), "medium", "low", "P2", _say("What %s opens may stay open after an exception", c("name")), "Open it in a with statement.")
    add("CI23_CONTRACT_FIELD_DRIFT", "kwfields", c("n1") >= 2, "low", "low", "P3", _say("%s reads %d field(s) (%s) from **%s", c("name"), c("n1"), F.array_join(F.slice(F.transform("names", lambda x: F.concat(F.lit('"'), x, F.lit('"'))), 1, 5), ", "), c("value")), "Name the parameters.")
    wall = c("value").rlike(r"^datetime(\.datetime)?\.(now|today)$") & tag("plain")
    dice = c("value").rlike(r"^random\.(choice|randint|random|sample|shuffle|uniform)$")
    add("CI25_ENVIRONMENT_DRIFT", "call", tag("attr") & (wall | dice), "medium", F.when(wall, "medium").otherwise("low"), "P2", _say("%s gives another value on each run", c("value")), "Pass time and randomness in.")
    add("CI26_RACE_HAZARD", "global", ~c("flag"), "medium", "high", "P2", _say("%s changes the module's %s", c("value"), c("name")), "Pass the state or lock it.")
    size = F.size("names")
    add("CI18_PARAMETER_CLUSTER", "fn", (size >= 6) & ~c("flag"), "low", "low", "P3", _say("%s takes %d arguments by position", c("name"), size), "Group them in an object.", F.format_string("def %s(%s%s)", c("name"), F.array_join(F.slice("names", 1, 6), ", "), F.when(size > 6, "...").otherwise("")), phase=1)
    return r


def _raw(rule: Rule) -> Column:
    conf = rule.confidence if isinstance(rule.confidence, Column) else F.lit(rule.confidence)
    return F.struct(
        F.lit(rule.ci_id).alias("ci_id"),
        F.lit(rule.signal).alias("signal"),
        F.lit(rule.severity).alias("severity"),
        conf.alias("confidence"),
        F.lit(rule.priority).alias("priority"),
        F.lit(rule.lane).alias("owner_lane"),
        rule.excerpt.alias("excerpt"),
        rule.reason.alias("reason"),
        F.lit(rule.action).alias("recommended_action"),
        F.lit(rule.phase).alias("phase"),
        F.lit(rule.rank).alias("rule_rank"),
    )


def per_fact(facts: DataFrame, active: set[str] | None = None) -> DataFrame:
    """Findings of the rules that one fact decides; each fact is read once. active: the signals that are on (None: all)."""
    rules = [r for r in per_fact_rules() if active is None or (r.active_on or r.signal) in active]
    if not rules:
        return facts.sparkSession.createDataFrame([], RAW)
    rows = facts.where(F.col("kind").isin(*{r.kind for r in rules} - {"kwfields"}))
    if any(r.kind == "kwfields" for r in rules):
        rows = rows.unionByName(_fields_of(facts))
    hits = F.array(*[F.when((F.col("kind") == r.kind) & r.when, _raw(r)) for r in rules])
    out = rows.select("path", "line", "symbol", "content", "ord", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("f"))
    return out.select("path", "line", "f.*", "symbol", "content", "ord").select(*[x.split()[0] for x in RAW.split(", ")])


def _fields_of(facts: DataFrame) -> DataFrame:
    """One row for each function with the distinct fields that it reads from its keyword argument."""
    by = facts.where("kind = 'kwfield'").groupBy("path", "line", "name", F.col("n1").alias("place"))
    first = lambda k: F.first(k).alias(k)
    rows = by.agg(F.array_sort(F.collect_set("value")).alias("names"), F.first(F.element_at("names", 1)).alias("value"), first("symbol"), first("content"), first("excerpt"), F.min("ord").alias("ord"))
    return rows.select("path", F.lit("kwfields").alias("kind"), "line", F.lit(None).cast("int").alias("end_line"), "ord", "name", "value", "excerpt", "symbol", "content", F.size("names").alias("n1"), F.lit(None).cast("int").alias("n2"), F.lit(None).cast("boolean").alias("flag"), "names", F.lit(None).cast("array<int>").alias("nums"))


def _cross(rows: DataFrame, signal: str, rank: int, severity, confidence: str, priority, reason: Column, action: str, excerpt: Column) -> DataFrame:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(
        "path", "line", F.lit(f"CI-{signal[2:4]}").alias("ci_id"), F.lit(signal).alias("signal"), as_col(severity).alias("severity"), F.lit(confidence).alias("confidence"),
        as_col(priority).alias("priority"), F.lit("native-static").alias("owner_lane"), excerpt.alias("excerpt"), reason.alias("reason"), F.lit(action).alias("recommended_action"),
        "symbol", "content", F.lit(1).alias("phase"), F.lit(rank).alias("rule_rank"), "ord",
    )


def _anchored(groups: DataFrame) -> DataFrame:
    return groups.select("*", "first.*").drop("first")


def by_value(rows: DataFrame, least: int) -> DataFrame:
    """Of each value of `least` files or more: n_files, the first three files by path, refs, whether all are flagged, its first fact, and a
    128-bit mark of the set of its files.

    The set is never gathered or sorted in one place: it is counted and marked (by sums that don't depend on order), and a limit on the rank
    cuts each task's files of a value to three before they move.
    """
    fact = F.struct("path", "line", "ord", "excerpt", "symbol", "content", "name")
    each = rows.groupBy("value", "path").agg(F.count("*").alias("n"), F.bool_and(F.coalesce("flag", F.lit(False))).alias("flag"), F.min_by(fact, "ord").alias("fact"))
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "path")).alias(f"mark{k}") for k in (1, 2)]
    sets = each.groupBy("value").agg(F.count("*").alias("n_files"), F.sum("n").alias("refs"), F.bool_and("flag").alias("all_flagged"), F.min_by("fact", "path").alias("first"), *marks).where(F.col("n_files") >= least)
    place = F.row_number().over(Window.partitionBy("value").orderBy("path"))
    few = rows.select("value", "path").distinct().withColumn("place", place).where("place <= 3").groupBy("value").agg(F.array_sort(F.collect_list("path")).alias("files"))
    return sets.join(few, "value")


def copied_code(facts: DataFrame) -> DataFrame:
    """Function bodies of one shape in two files or more, one finding for each set of files."""
    fns = facts.where("kind = 'fn' AND value IS NOT NULL AND NOT (name LIKE '\\_\\_%' AND name LIKE '%\\_\\_')")
    p = F.col("path")
    support = has_segment(p, ["test", "tests", "docs", *SAMPLE_SEGMENTS]) | under(p, ["shared/tools", "shared/report/examples"])
    shapes = by_value(fns.withColumn("flag", support), 2)
    named = shapes.groupBy("n_files", "mark1", "mark2", "first.name").agg(F.min(F.struct("first.path", "first.line", "first.name")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("n_files", "mark1", "mark2").orderBy("at"))
    named = named.withColumn("k", rank).where("k <= 6").groupBy("n_files", "mark1", "mark2").agg(F.array_sort(F.collect_list("at")).alias("some"))
    sets = shapes.groupBy("n_files", "mark1", "mark2").agg(F.count("*").alias("shared"), F.first("files").alias("files"), F.bool_and("all_flagged").alias("support"), F.min_by("first", F.struct("first.path", "first.line")).alias("first")).join(named, ["n_files", "mark1", "mark2"])
    names = F.transform("some", lambda x: x["name"])
    reason = F.format_string("%d function(s) (%s) have one shape in %d files: %s", F.col("shared"), F.array_join(names, ", "), F.col("n_files"), F.array_join("files", ", "))
    return _cross(_anchored(sets), "CI05_COPY_PASTE_CODE", 0, F.when(F.col("support"), "low").otherwise("medium"), "low", F.when(F.col("support"), "P3").otherwise("P2"), reason, "Share one function.", F.format_string("def %s(...)", F.col("name")))


def _scattered(facts: DataFrame, kind: str, having: Column) -> DataFrame:
    return by_value(facts.where((F.col("kind") == kind) & having), 3)


def magic_numbers(facts: DataFrame) -> DataFrame:
    """Uncommon numbers in three files or more."""
    rows = _anchored(_scattered(facts, "num", F.lit(True)))
    reason = F.format_string("%s stands in %d files: %s", F.col("excerpt"), F.col("n_files"), F.array_join("files", ", "))
    return _cross(rows, "CI06_MAGIC_NUMBER", 1, "low", "low", "P3", reason, "Name the number once.", F.col("excerpt"))


def unused_private(facts: DataFrame) -> DataFrame:
    """Private top-level definitions whose name no file uses."""
    used = facts.where("kind = 'use'").select("name").distinct()
    rows = facts.where("kind = 'def'").join(used, "name", "left_anti")
    what = F.concat_ws(" ", "value", "name")
    return _cross(rows, "CI07_UNUSED_PRIVATE_SYMBOL", 2, "low", "medium", "P3", F.concat(F.lit("Nothing uses the private "), what), "Remove it or make it public.", what)


def import_cycles(facts: DataFrame) -> DataFrame:
    """Modules that import each other, one finding for each cycle. Of two files of one module name the later in path order counts."""
    modules = facts.where("kind = 'module'").groupBy(F.col("name").alias("module")).agg(F.max("path").alias("path"))
    edges = facts.where("kind = 'import'").join(modules, (F.col("name") == modules.module) & (facts.path == modules.path), "left_semi").select(F.col("name").alias("src"), F.col("value").alias("dst"))
    edges = edges.join(modules.select(F.col("module").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()
    nodes = strong_components(edges)
    nodes = nodes.groupBy("component").agg(F.count("*").alias("size")).join(nodes.withColumn("k", F.row_number().over(Window.partitionBy("component").orderBy("node"))).where("k <= 5"), "component")
    cycles = nodes.groupBy("component", "size").agg(F.array_sort(F.collect_list("node")).alias("cycle"))  # its first five
    rows = cycles.join(modules, modules.module == F.element_at("cycle", 1)).select("path", F.lit(1).alias("line"), F.lit("").alias("symbol"), F.lit("").alias("content"), F.lit(0).alias("ord"), "cycle", F.col("size").alias("modules"))
    dots = lambda k: F.when(F.col("modules") > k, "...").otherwise("")
    return _cross(rows, "CI13_CIRCULAR_IMPORT", 3, "medium", "high", "P2", F.format_string("%d modules import each other: %s%s", F.col("modules"), F.array_join(F.slice("cycle", 1, 5), ", "), dots(5)), "Move what they share into a third module.", F.concat(F.array_join(F.slice("cycle", 1, 4), " <-> "), dots(4)))


def scattered_constants(facts: DataFrame) -> DataFrame:
    """Value-shaped literals in three files or more, but for date formats, routes and in-memory databases of tests."""
    v = F.col("value")
    plain = v.endswith("-zh-overview.md") | v.rlike(r"^[A-Za-z]:\\Users\\[^\\]+\\project\\") | (v == r"(```[\s\S]*?```)") | (v.endswith(".md") & v.rlike("^(shared|docs)/"))
    dates = v.contains("%Y") & v.contains("%m") & v.contains("%d")
    rows = _scattered(facts, "str", value_shaped(v) & ~plain & ~dates & ~v.startswith("/api/"))
    rows = _anchored(rows.where(~((v == "sqlite:///:memory:") & F.col("all_flagged"))))
    reason = F.format_string("The constant stands in %d files: %s", F.col("n_files"), F.array_join("files", ", "))
    return _cross(rows, "CI20_SCATTERED_CONSTANT", 5, "medium", "medium", "P2", reason, "Define it once.", F.col("excerpt"))


CROSS = {
    "CI05_COPY_PASTE_CODE": copied_code,
    "CI06_MAGIC_NUMBER": magic_numbers,
    "CI07_UNUSED_PRIVATE_SYMBOL": unused_private,
    "CI13_CIRCULAR_IMPORT": import_cycles,
    "CI20_SCATTERED_CONSTANT": scattered_constants,
}


def keyword_pattern(*terms: str) -> str | None:
    """Any of terms as whole words in any case; terms with braces are templates and don't count; None: nothing matches."""
    kept = [t.strip() for t in terms if t.strip() and not {"{", "}"} & set(t)]
    return "(?i)\\b(" + "|".join(f"\\Q{t}\\E" for t in kept) + ")\\b" if kept else None


def leaked_authority(files: DataFrame, side_terms: list[str], authority_terms: list[str]) -> DataFrame:
    """Lines that speak of a side program as of an authority; without terms there are none."""
    side, authority = keyword_pattern(*side_terms), keyword_pattern(*authority_terms)
    if not side or not authority:
        return files.sparkSession.createDataFrame([], RAW)
    t = F.col("text")
    rows = files.select("path", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("k", "text"))
    rows = rows.where(t.rlike(side) & t.rlike(authority) & ~t.rlike("(?i)side program|reference-only|support-only|bounded trial"))
    rows = rows.select("path", (F.col("k") + 1).alias("line"), F.trim(t).alias("excerpt"), F.lit("").alias("symbol"), F.array_join(F.filter(F.split(t, r"\s+"), lambda x: x != ""), " ").alias("content"), F.col("k").alias("ord"))
    out = _cross(rows, "CI19_X", 0, "high", "medium", "P2", F.lit("A side program is treated as an authority"), "Name the owner of the decision.", F.col("excerpt"))
    return out.withColumns({"signal": F.lit("SIDE_PROGRAM_LEAK"), "owner_lane": F.lit("human-judgment"), "phase": F.lit(2)})


def all_findings(facts: DataFrame, active: set[str] | None = None) -> DataFrame:
    """Raw findings of every active rule."""
    out = per_fact(facts, active)
    for signal, rule in CROSS.items():
        if active is None or signal in active:
            out = out.unionByName(rule(facts))
    return out
