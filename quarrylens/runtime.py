"""Session helpers: shipping the package to workers, shared-folder materialisation."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    out = os.path.join(tempfile.mkdtemp(prefix="ql-"), f"{PACKAGE.name}.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a fresh one where it is unset and one machine does all."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="ql-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_path(spark: SparkSession) -> str:
    """A new name in the shared folder."""
    return f"{shared_dir(spark)}/ql-{uuid.uuid4().hex}"


def materialize(df: DataFrame, parts: int | None = None, by: list[str] = ()) -> DataFrame:
    """Write df as Parquet into the shared folder, in folders by columns, and read it back: cuts lineage, survives executor loss. The shuffle
    files of the write are deleted when it ends."""
    spark = df.sparkSession
    path = shared_path(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        if by:  # a folder's rows come from few tasks, so that files are few, and a large folder's from many
            df = df.hint("rebalance", *[F.col(c) for c in by])
        out = (df if parts is None else df.coalesce(parts)).write
        (out.partitionBy(*by) if by else out).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._ql_path = path
    return out


SPREAD_ROWS = 10_000


def spread(df: DataFrame, each: int = 32 << 20) -> DataFrame:
    """df in parts of about SPREAD_ROWS rows, at least as many as there are cores, if it is estimated at less than `each` bytes a core: a few
    small files would else be the work of as few tasks, and many rows of few bytes of tasks that grow with the table. A table of more bytes has
    splits enough and is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or not small_side(df, each * cores):
        return df
    return df.repartition(max(cores, -(-df.count() // SPREAD_ROWS)))


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote for df; later reads of it fail. The driver's heap is collected, since Spark deletes the shuffle files of
    ended jobs only when their plans are, which a large heap puts off while the executors' disks fill."""
    path = getattr(df, "_ql_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        jvm.java.lang.System.gc()


def small_side(df: DataFrame, limit: int = 8 << 20) -> bool:
    """Whether the optimizer's size estimate of df is within limit bytes (a written table's estimate is its file size)."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= limit
