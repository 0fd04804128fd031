"""Profiles and the signals, lanes and tools that they switch on; severities; known limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions.columns import scope_class, suffix

HYGIENE = tuple(
    (
        "CI02_SPAGHETTI_CODE CI02_LONG_FUNCTION CI03_TODO_HACK CI07_UNUSED_PRIVATE_SYMBOL CI12_POLTERGEIST CI13_CIRCULAR_IMPORT CI14_PLAINTEXT_SECRET "
        "CI14_DYNAMIC_CODE_EXECUTION CI14_SUBPROCESS_SHELL_TRUE CI14_INSECURE_HTTP CI14_UNSAFE_DESERIALIZATION CI14_UNSAFE_YAML_LOAD "
        "CI14_SUPPLY_CHAIN_DRIFT CI14_TAINTED_FLOW CI20_SCATTERED_CONSTANT CI21_BROAD_EXCEPTION_SWALLOW CI21_SILENT_EXCEPTION_RETURN "
        "CI22_RESOURCE_CLEANUP_GAP CI25_ENVIRONMENT_DRIFT CI26_RACE_HAZARD"
    ).split()
)
OPT_IN = tuple("CI04_GOD_CLASS CI05_COPY_PASTE_CODE CI06_MAGIC_NUMBER CI18_PARAMETER_CLUSTER CI23_CONTRACT_FIELD_DRIFT".split())
SIDE = "SIDE_PROGRAM_LEAK"
EVERY = (SIDE, *HYGIENE, *OPT_IN)
SIGNALS = {
    "startup": (SIDE, "CI04_GOD_CLASS", "CI12_POLTERGEIST", "CI02_SPAGHETTI_CODE"),
    "quick-gate": (SIDE, *HYGIENE),
    "state-change": (SIDE, *"CI21_BROAD_EXCEPTION_SWALLOW CI22_RESOURCE_CLEANUP_GAP CI23_CONTRACT_FIELD_DRIFT CI25_ENVIRONMENT_DRIFT CI26_RACE_HAZARD".split()),
    "wrap-up": (SIDE, "CI03_TODO_HACK", "CI23_CONTRACT_FIELD_DRIFT"),
    "full": EVERY,
    "self-audit": EVERY,
    "build-preflight": (SIDE, *HYGIENE),
    "build-review": (SIDE, *HYGIENE),
}
NATIVE, EXTERNAL, HUMAN = "native-static", "external-analyzer", "human-judgment"
LANES = {
    "startup": (NATIVE, HUMAN), "quick-gate": (NATIVE, EXTERNAL), "state-change": (NATIVE,), "wrap-up": (NATIVE, HUMAN),
    **{p: (NATIVE, EXTERNAL, HUMAN) for p in ("full", "self-audit", "build-preflight", "build-review")},
}
NINE = tuple("ruff pyflakes mypy pytest semgrep eslint tsc shellcheck sqlfluff".split())
TOOLS = {"quick-gate": NINE[:2], "full": NINE, "self-audit": NINE, "build-review": NINE, "build-preflight": tuple(t for t in NINE if t != "pytest")}
NEEDS_INCLUDE = ("state-change", "build-preflight", "build-review")
READY_TOOLS = (*NINE, "gitleaks", "osv-scanner", "trivy", "codeql")
PYTHON_TOOLS = NINE[:4]


def active_signals(profile: str) -> set[str]:
    """Signals of a profile; an unknown one has all."""
    return set(SIGNALS.get(profile, EVERY))


def check_request(profile: str, include: list[str]) -> None:
    if profile in NEEDS_INCLUDE and not include:
        raise ValueError(f"profile {profile} looks at named paths only; give include")


def profile_signals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, s, s in OPT_IN) for p, ss in SIGNALS.items() for s in ss], "profile_id string, signal string, opt_in boolean")


def profile_lanes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, x) for p, xs in LANES.items() for x in xs], "profile_id string, lane string")


def execution_plan(spark: SparkSession, readiness: dict[str, str]) -> DataFrame:
    """For each profile and tool whether it would run; readiness has the state of each tool."""
    rows = [(p, t, readiness.get(t, "not-installed"), readiness.get(t) == "ready") for p in SIGNALS for t in TOOLS.get(p, ())]
    return spark.createDataFrame(rows, "profile_id string, analyzer_id string, state string, runs boolean")


def lane_files(files: DataFrame, scope_mode: str) -> DataFrame:
    """The files(path, ...) that outside tools are asked about: of a whole repository its sources and tests, else all."""
    return files.where(scope_class(F.col("path")).isin("runtime-source", "tests")) if scope_mode == "full-repo" else files


def tool_facts(files: DataFrame) -> DataFrame:
    """One row: which kinds of files there are."""
    p = F.col("path")
    has = lambda *ends: F.coalesce(F.bool_or(suffix(p).isin(*ends)), F.lit(False))
    return files.agg(
        has(".py").alias("python"), has(".js", ".jsx", ".ts", ".tsx").alias("web"), has(".ts", ".tsx").alias("typescript"), has(".sh", ".bash").alias("shell"), has(".sql").alias("sql"),
        F.coalesce(F.bool_or(scope_class(p) == "runtime-source"), F.lit(False)).alias("runtime_source"),
    )


def tools_that_apply(facts: DataFrame, profile: str, tsconfig: bool) -> DataFrame:
    """(tool): the tools of a profile that have something to read, in their order, from the row of tool_facts()."""
    need = {**{t: F.col("python") for t in PYTHON_TOOLS}, "semgrep": F.col("runtime_source"), "eslint": F.col("web"), "tsc": F.col("typescript") & F.lit(tsconfig), "shellcheck": F.col("shell"), "sqlfluff": F.col("sql")}
    named = F.array(*[F.when(need[t], F.lit(t)) for t in TOOLS.get(profile, ()) if t in need]).cast("array<string>")
    return facts.select(F.explode(F.array_compact(named)).alias("tool"))


def applicable_tools(profile: str, suffixes: set[str], runtime_source: bool, tsconfig: bool) -> list[str]:
    """The tools of a profile that have something to read."""
    web = {".js", ".jsx", ".ts", ".tsx"} & suffixes
    has = {"semgrep": runtime_source, "eslint": bool(web), "tsc": tsconfig and bool({".ts", ".tsx"} & suffixes), "shellcheck": bool({".sh", ".bash"} & suffixes), "sqlfluff": ".sql" in suffixes}
    return [t for t in TOOLS.get(profile, ()) if has.get(t, t in PYTHON_TOOLS and ".py" in suffixes)]
