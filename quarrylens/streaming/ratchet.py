"""Finding counts that may only fall, over a stream of scans: each micro-batch is compared with the stored counts of its project."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrylens.operators.report import ratchet_violations
from quarrylens.operators.scan import Options, Scan, scan_files


def _counts(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    return spark.read.schema("ci_id string, n long").parquet(f"{folder}/state-{batch}")


def ratchet_step(spark: SparkSession, counts: DataFrame, folder: str, previous: int | None, batch: int) -> DataFrame:
    """Violations of counts(ci_id, n) against version previous; the new version holds counts if there are none, else the old ones.

    A version is a folder of its own, so that a batch that runs again after a failure gives the same result.
    """
    if previous is None:
        counts.write.mode("overwrite").parquet(f"{folder}/state-{batch}")
        return ratchet_violations(counts, counts)
    stored = _counts(spark, folder, previous)
    broken = ratchet_violations(counts, stored)
    (counts if broken.isEmpty() else stored).write.mode("overwrite").parquet(f"{folder}/state-{batch}")
    return broken


def ratchet_stream(findings: DataFrame, folder: str, checkpoint: str, report: Callable[[int, DataFrame], None]) -> StreamingQuery:
    """Start the ratchet over a stream of findings(ci_id, waiver_status); report gets each batch's number and violations."""
    spark = findings.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        counts = batch.where(F.coalesce("waiver_status", F.lit("none")) == "none").groupBy("ci_id").agg(F.count("*").alias("n"))
        report(number, ratchet_step(spark, counts, folder, number - 1 if number else None, number))

    return findings.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scan_stream(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[int, Scan], None], options: Options | None = None) -> StreamingQuery:
    """Inspect the files(path, text) that arrive as Parquet below folder: a scan for each batch, which handle gets with the batch's number.

    A batch that runs again after a failure is inspected again and gives the same scan; handle must put it in place under its number.
    """
    files = spark.readStream.schema("path string, text string").parquet(folder)

    def step(batch: DataFrame, number: int) -> None:
        handle(number, scan_files(batch, options or Options()))

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
