"""Measuring the rules: density over a corpus, review samples, labels, precision, overlap with other tools, scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.operators.adapters import ruff_rule

PLACE = ("project", "target_file", "line", "fingerprint")


def place_order() -> list[Column]:
    return [F.coalesce("project", F.lit("")), F.coalesce("target_file", F.lit("")), F.coalesce("line", F.lit(0)), F.coalesce("fingerprint", F.lit(""))]


def first_of_group(rows: DataFrame, group: list[str], order: list, most: int) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_k") <= most).drop("_k")


def density(rows: DataFrame, samples: int = 3) -> DataFrame:
    """Of each rule: findings, files, and its first samples in the order of emission; most frequent first."""
    order = F.col("emitted")
    kept = first_of_group(rows, ["ci_id"], [order], samples).groupBy("ci_id").agg(F.array_sort(F.collect_list(F.struct("emitted", "project", "target_file", "line"))).alias("samples"))
    counts = rows.groupBy("ci_id").agg(F.count("*").alias("n"), F.count_distinct("project", "target_file").alias("files"), F.min("emitted").alias("first"))
    return counts.join(kept, "ci_id").orderBy(F.desc("n"), "first").drop("first")


def round_robin(rows: DataFrame, most: int, group: str = "ci_id", stratum: str = "project", order: list | None = None) -> DataFrame:
    """Up to most rows of each group, one of each stratum in turn: the k-th of every stratum before the k+1-th of any."""
    if most <= 0:
        raise ValueError("most must be positive")
    turn = rows.withColumn("_turn", F.row_number().over(Window.partitionBy(group, stratum).orderBy(*(order or place_order()))))
    # no group needs a row of a later turn than most
    turn = turn.where(F.col("_turn") <= most)
    return turn.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy("_turn", stratum))).where(F.col("_k") <= most).drop("_turn", "_k")


def label_template(rows: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """A row to label for each finding, with the label and notes that it has already."""
    out = rows.select("fingerprint", "ci_id", "project", "target_file", "line")
    if labels is None:
        return out.withColumns({"label": F.lit(""), "notes": F.lit("")})
    return out.join(labels.select("fingerprint", "label", "notes"), "fingerprint", "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("label", "notes")})


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with label; '' where there is none."""
    return rows.join(labels.select("fingerprint", "label"), "fingerprint", "left").withColumn("label", F.coalesce("label", F.lit("")))


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null over nothing."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def precision(rows: DataFrame, labels: DataFrame, group: str = "ci_id") -> DataFrame:
    """Of each group, and of all (group null, is_total): true and false positives, skipped, unlabelled, precision and coverage."""
    n = lambda what, name: F.count_if(F.col("label") == what).alias(name)
    out = labelled(rows, labels).rollup(group).agg(n("true-positive", "true_positive"), n("false-positive", "false_positive"), n("skip", "skipped"), n("", "unlabeled"), F.count("*").alias("total"), F.grouping(group).alias("is_total"))
    known = F.col("true_positive") + F.col("false_positive")
    return out.withColumns({"precision": ratio(F.col("true_positive"), known), "label_coverage": ratio(F.col("total") - F.col("unlabeled"), F.col("total"))})


def unknown_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return labels.join(rows.select("fingerprint").distinct(), "fingerprint", "left_anti").select("fingerprint")


def unlabelled(rows: DataFrame, labels: DataFrame, most: int | None = 10) -> DataFrame:
    """Findings without a label in the order of their places; the first most (None: all)."""
    out = labelled(rows, labels).where("label = ''").orderBy(*place_order())
    return out if most is None else out.limit(most)


def differentiation(rows: DataFrame, others: DataFrame, top: int = 4) -> DataFrame:
    """Of each rule: findings with codes(target_file, line, code) of another tool within a line, how many of these are of the same rule, the share that is not, and the most frequent codes."""
    near = others.select("target_file", F.explode(F.array(F.col("line") - 1, F.col("line"), F.col("line") + 1)).alias("line"), "code")
    hits = rows.select("ci_id", "emitted", "target_file", "line").join(near, ["target_file", "line"])
    of = hits.groupBy("ci_id", "emitted").agg(F.bool_or(ruff_rule(F.col("code")) == F.col("ci_id")).alias("same"))
    counts = rows.groupBy("ci_id").agg(F.count("*").alias("total"))
    met = of.groupBy("ci_id").agg(F.count("*").alias("colocated"), F.count_if("same").alias("duplicates"))
    codes = hits.groupBy("ci_id", "code").agg(F.count("*").alias("n"), F.min("emitted").alias("first"))
    best = first_of_group(codes, ["ci_id"], [F.desc("n"), F.col("first"), F.col("code")], top).groupBy("ci_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("n"), "first", "code"))), lambda x: x["code"]).alias("top_codes"))
    out = counts.join(met, "ci_id", "left").join(best, "ci_id", "left").na.fill(0, ["colocated", "duplicates"])
    share = F.bround(F.lit(100.0) * (F.col("total") - F.col("duplicates")) / F.col("total")).cast("int")
    return out.select("ci_id", "total", "colocated", "duplicates", share.alias("unique_category_pct"), F.coalesce("top_codes", F.array().cast("array<string>")).alias("top_codes"))


def scorecard(expected: DataFrame, detected: DataFrame) -> DataFrame:
    """One row for expected(signal, wanted) against detected(signal): signals met, missed, and found though forbidden."""
    seen = detected.select("signal").distinct().withColumn("seen", F.lit(True))
    both = expected.join(seen, "signal", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    names = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("signal"))))
    return both.agg(F.count_if(F.col("wanted") & F.col("seen")).alias("met"), names(F.col("wanted") & ~F.col("seen")).alias("missed"), names(~F.col("wanted") & F.col("seen")).alias("unwanted"))


def confusion(cases: DataFrame) -> DataFrame:
    """One row for cases(case_id, positive, hit): counts, recall and false-positive rate."""
    n = lambda c, name: F.count_if(c).alias(name)
    p, h = F.col("positive"), F.col("hit")
    one = cases.agg(n(p & h, "tp"), n(p & ~h, "fn"), n(~p & h, "fp"), n(~p & ~h, "tn"))
    return one.withColumns({"recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "false_positive_rate": ratio(F.col("fp"), F.col("fp") + F.col("tn"))})


def noise(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Findings in 1000 lines."""
    lines = files.agg(F.sum(F.size(F.split("text", "\n"))).alias("lines"))
    return rows.agg(F.count("*").alias("findings")).crossJoin(F.broadcast(lines)).withColumn("per_1000_lines", ratio(F.col("findings") * 1000, F.col("lines")))
