"""Changed files and changed line ranges of a git diff."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECONDS = 60
HUNK = r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@"


def _git(root: str, *args: str) -> bytes:
    """What git prints; a ref is never taken for an option. Raises ValueError where git can't tell or takes longer than SECONDS."""
    try:
        run = subprocess.run(["git", "-C", root, "diff", "--relative", *args], capture_output=True, timeout=SECONDS, check=False)
    except (OSError, subprocess.TimeoutExpired) as e:
        raise ValueError(f"git diff failed: {e}") from e
    if run.returncode:
        raise ValueError(run.stderr.decode("utf-8", "replace").strip() or "git diff failed")
    return run.stdout


def git_diff(root: str, ref: str) -> str:
    """The diff of a tree against ref without context, paths relative to root; bytes that are no UTF-8 are replaced."""
    return _git(root, "--unified=0", "--no-color", "--end-of-options", ref, "--", ".").decode("utf-8", "replace")


def git_changed(root: str, ref: str) -> list[str]:
    """The files that differ from ref, those without a changed line (renamed, binary, of another mode) among them; paths relative to root."""
    return [x.decode("utf-8", "replace") for x in _git(root, "--name-only", "-z", "--end-of-options", ref, "--", ".").split(b"\x00") if x]


def parse_hunks(spark: SparkSession, diff: str) -> DataFrame:
    """hunks(path, start, end) of diff text: a hunk belongs to the last +++ line before it; no count is one line; a deletion marks one line."""
    lines = spark.createDataFrame([(k, x) for k, x in enumerate(diff.splitlines())], "k long, line string")
    return hunks_of(lines.withColumn("diff_id", F.lit(0))).drop("diff_id")


def hunks_of(lines: DataFrame) -> DataFrame:
    """As parse_hunks, over lines(diff_id, k, line) of any number of diffs."""
    from pyspark.sql import Window

    heads = lines.where(F.col("line").startswith("+++ ") | F.col("line").startswith("@@ "))
    path = F.when(F.col("line").startswith("+++ "), F.regexp_replace(F.substring("line", 5, 1 << 30), "^b/", ""))
    above = F.last(path, ignorenulls=True).over(Window.partitionBy("diff_id").orderBy("k"))
    rows = heads.withColumn("path", above).where(F.col("line").startswith("@@ ") & (F.col("path") != "/dev/null"))
    start = F.regexp_extract("line", HUNK, 1).cast("int")
    count = F.coalesce(F.expr(f"try_cast(regexp_extract(line, '{HUNK.replace(chr(92), chr(92) * 2)}', 2) AS int)"), F.lit(1))
    return rows.select("diff_id", "path", F.greatest(start, F.lit(1)).alias("start"), F.greatest(start + F.greatest(count, F.lit(1)) - 1, F.lit(1)).alias("end"))
