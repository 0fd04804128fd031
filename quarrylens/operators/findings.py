"""From raw findings to the ordered list: identity, dedup in and across lanes, scope noise, baseline, waivers, suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.columns import fingerprint, scope_class, severity_rank
from quarrylens.runtime import materialize, small_side
from quarrylens.sources.settings import Operations

COLUMNS = (
    "finding_id fingerprint ci_id signal severity confidence actor_label triage_state priority fixability baseline_status waiver_status lifecycle_state "
    "owner_lane target_file line excerpt reason evidence_ref recommended_action verification_status finding_class scope_class"
).split()
ORDER = ("phase", "path", "rule_rank", "ord", "line")
SUPPRESSION_BLOCK = 50_000
QUESTIONS = ("CI-06", "CI-08", "CI-11", "CI-12")


def emission_key(phase: str = "phase") -> Column:
    """The order of emission: file by file, then after all files rule by rule."""
    late = F.col(phase) > 0
    return F.struct(phase, F.when(late, "").otherwise(F.col("path")).alias("file"), "rule_rank", "path", "ord", "line", "signal", "reason")


def innermost(points: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """points with symbol: name of the shortest span(path, line, end_line, name, ord) of the same path that holds line, the first of equal ones; '' outside all."""
    s = spans.select(F.col("path").alias("p"), F.col("line").alias("a"), F.col("end_line").alias("b"), F.col("name").alias("n"), F.col("ord").alias("o"))
    best = points.join(s, (F.col("path") == F.col("p")) & F.col("line").between(F.col("a"), F.col("b"))).groupBy(*keys).agg(F.min_by("n", F.struct(F.col("b") - F.col("a"), "o")).alias("symbol"))
    return points.join(best, keys, "left").withColumn("symbol", F.coalesce("symbol", F.lit("")))


def identified(raw: DataFrame) -> DataFrame:
    """raw with its fingerprint."""
    return raw.withColumn("fingerprint", fingerprint(F.col("ci_id"), F.col("signal"), F.col("path"), F.col("symbol"), F.col("content")))


def first_of_each(rows: DataFrame, key: str = "fingerprint", order: Column | None = None) -> DataFrame:
    """The first row of each key in the order of emission."""
    best = rows.groupBy(key).agg(F.min_by(F.struct("*"), order if order is not None else emission_key()).alias("r"))
    return best.select("r.*")


def without_covered(rows: DataFrame) -> DataFrame:
    """rows without native findings that an external one of the same rule covers in the same file within one line: a band as an equi join."""
    near = rows.where((F.col("owner_lane") == "external-analyzer") & F.col("line").isNotNull())
    near = near.select("ci_id", "path", F.explode(F.array(F.col("line") - 1, F.col("line"), F.col("line") + 1)).alias("line")).distinct().withColumn("covered", F.lit(True))
    out = rows.join(near, ["ci_id", "path", "line"], "left")
    return out.where(~((F.col("owner_lane") == "native-static") & F.coalesce("covered", F.lit(False)))).drop("covered")


def without_noise(rows: DataFrame) -> DataFrame:
    aside = F.col("scope_class").isin("docs-evidence", "roadmap-evidence", "tests", "maintainer-probes", "support")
    return rows.where(~((F.col("signal") == "CI14_INSECURE_HTTP") & aside))


def _pattern(ci: Column, path: Column, line: Column) -> Column:
    part = lambda c: F.coalesce(c, F.lit("\x00"))
    return F.concat_ws("\x1f", F.lit("at"), part(ci), part(path), part(line.cast("string")))


def finding_keys(rows: DataFrame) -> Column:
    """All keys by which an entry can mean a finding: its fingerprint, its place, and the seven patterns of rule, file and line."""
    place = F.concat_ws("|", "ci_id", "path", F.coalesce(F.col("line").cast("string"), F.lit("")))
    by = lambda c: F.concat(F.lit("is\x1f"), c)
    none = F.lit(None).cast("string")
    ways = [_pattern(F.col("ci_id") if k & 4 else none, F.col("path") if k & 2 else none, F.col("line") if k & 1 else none) for k in range(1, 8)]
    return F.array_distinct(F.array(by(F.col("fingerprint")), by(place), *ways))


def entry_keys(entries: DataFrame) -> DataFrame:
    """entries with key: one row for its fingerprint and one for what else it names."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    at = F.when(some("ci_id").isNotNull() | some("target_file").isNotNull() | F.col("line").isNotNull(), _pattern(some("ci_id"), some("target_file"), F.col("line")))
    by = F.when(some("fingerprint").isNotNull(), F.concat(F.lit("is\x1f"), "fingerprint"))
    return entries.withColumn("key", F.explode(F.array_compact(F.array(by, at))))


def matches(rows: DataFrame, entries: DataFrame, *keep: str) -> DataFrame:
    """fingerprint, and keep of the entry that comes first, of every finding that an entry means: one equi join for what is an OR over wildcards."""
    keyed = rows.select("fingerprint", F.explode(finding_keys(rows)).alias("key"))
    hits = keyed.join(entry_keys(entries), "key")
    return hits.groupBy(hits["fingerprint"] if "fingerprint" not in entries.columns else keyed["fingerprint"]).agg(*[F.min_by(k, "ordinal").alias(k) for k in keep], F.lit(True).alias("hit"))


def meant_by(rows: DataFrame, **tables: DataFrame) -> DataFrame:
    """fingerprint, and for each named table of entries whether any of them means the finding: of findings that any entry means. The keys of
    all tables are joined at once."""
    keys = None
    for name, entries in tables.items():
        one = entry_keys(entries).select("key", *[F.lit(k == name).alias(k) for k in tables])
        keys = one if keys is None else keys.unionByName(one)
    either = [F.bool_or(k).alias(k) for k in tables]
    keyed = rows.select("fingerprint", F.explode(finding_keys(rows)).alias("key"))
    return keyed.join(keys.groupBy("key").agg(*either), "key").groupBy("fingerprint").agg(*either)


def unsuppressed(rows: DataFrame, suppression: DataFrame) -> DataFrame:
    """rows of which no signal, path, excerpt or reason holds a match(match). A table of entries of a checked size is broadcast; a larger one is
    gone through in blocks of it, each written, so that no task holds more than a block."""
    t = lambda c: F.coalesce(F.col(c), F.lit("")).contains(F.col("match"))
    holds = t("signal") | t("path") | t("excerpt") | t("reason")
    entries = suppression.select("match").where("match IS NOT NULL").distinct()
    if small_side(entries):
        return rows.join(F.broadcast(entries), holds, "left_anti")
    entries = materialize(entries)
    blocks = max(1, -(-entries.count() // SUPPRESSION_BLOCK))
    for k in range(blocks):
        some = entries.where(F.pmod(F.xxhash64("match"), F.lit(blocks)) == k)
        rows = materialize(rows.join(F.broadcast(some), holds, "left_anti"))  # about SUPPRESSION_BLOCK entries
    return rows


def apply_operations(rows: DataFrame, ops: Operations) -> DataFrame:
    """rows without suppressed ones, with baseline and waiver states. Rows have distinct fingerprints."""
    left = unsuppressed(rows, ops.suppression)
    out = left.join(meant_by(left, based=ops.baseline, waived=ops.waiver), "fingerprint", "left")
    based, waived = F.coalesce("based", F.lit(False)), F.coalesce("waived", F.lit(False))
    return out.withColumns(
        {
            "baseline_status": F.when(based, "existing-baseline").otherwise("new"),
            "lifecycle_state": F.when(waived, "accepted").otherwise("open"),
            "triage_state": F.when(waived, "accepted-residual").otherwise("review-first"),
            "waiver_status": F.when(waived, "active-waiver").otherwise("none"),
        }
    ).drop("based", "waived")


def resolved(entries: DataFrame, rows: DataFrame, scanned: DataFrame | None) -> DataFrame:
    """Baseline entries that no finding of rows matches, of scanned(path) files only; without scanned of all."""
    out = entries if scanned is None else entries.join(scanned.select(F.col("path").alias("target_file")).distinct(), "target_file", "left_semi")
    found = rows.select(F.explode(finding_keys(rows)).alias("key")).distinct()
    met = entry_keys(out).join(found, "key", "left_semi").select("ordinal").distinct()
    return out.join(met, "ordinal", "left_anti").select("ordinal", "fingerprint", "ci_id", "target_file", "line", F.lit("resolved").alias("lifecycle_state"))


def changed_only(rows: DataFrame, spans: DataFrame, hunks: DataFrame) -> DataFrame:
    """rows whose definition, or else line, overlaps a changed range(path, start, end); rows without a line go."""
    ends = spans.groupBy(F.col("path").alias("sp"), F.col("line").alias("sl")).agg(F.max("end_line").alias("last"))
    out = rows.where("line IS NOT NULL").join(ends, (F.col("path") == F.col("sp")) & (F.col("line") == F.col("sl")), "left").withColumn("last", F.coalesce("last", "line"))
    h = hunks.select(F.col("path").alias("hp"), F.col("start").alias("h1"), F.col("end").alias("h2"))
    return out.join(h, (F.col("path") == F.col("hp")) & (F.col("line") <= F.col("h2")) & (F.col("h1") <= F.col("last")), "left_semi").drop("sp", "sl", "last")


def numbered(rows: DataFrame) -> DataFrame:
    """rows with emitted: their place in the order of emission, from 1; ranges of the order are numbered apart and begin where the ones before end."""
    ranged = materialize(rows.withColumn("_key", emission_key()).repartitionByRange("_key").withColumn("_part", F.spark_partition_id()))
    begins = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row for each partition
    begins = begins.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_begin"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_key"))
    return ranged.join(F.broadcast(begins), "_part").withColumn("emitted", (F.col("_begin") + place)).drop("_key", "_part", "_begin")


def report_rows(rows: DataFrame) -> DataFrame:
    """The full finding schema, numbered in the order of emission."""
    external = F.col("owner_lane") == "external-analyzer"
    full = numbered(rows).withColumns(
        {
            "finding_id": F.concat(F.when(external, "F-EXT-").otherwise("F-SCAN-"), F.format_string("%04d", "emitted")),
            "actor_label": F.when(external, "external-analyzer").otherwise("native-detected"),
            "fixability": F.lit("owner-decision"),
            "evidence_ref": F.coalesce("evidence_ref", F.lit("inspection-rules")) if "evidence_ref" in rows.columns else F.lit("inspection-rules"),
            "verification_status": F.lit("executed"),
            "finding_class": F.when(F.col("ci_id").isin(*QUESTIONS), "design/review question").otherwise("confirmed defect"),
        }
    )
    return full.withColumnRenamed("path", "target_file").select(*COLUMNS, severity_rank(F.col("severity")).alias("severity_rank"), "emitted")


def settle(raw: DataFrame) -> DataFrame:
    """Identity, dedup and scope noise, before operations."""
    rows = without_covered(first_of_each(identified(raw))).withColumn("scope_class", scope_class(F.col("path")))
    return without_noise(rows)
