"""Session helpers shared by all operators: reading tables, cutting lineage, checking sizes."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest optimizer estimate at which a side is broadcast by hand.
BROADCAST_BYTES = 32 << 20


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once per context; they needn't have it installed."""
    context = spark.sparkContext
    if getattr(context, "_millrace_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="millrace-")) / "millrace.zip"  # the driver serves it to the executors
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._millrace_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder all executors share: `spark.checkpoint.dir` of the session.

    Only where neither the setting nor a folder of the context exists, as in local tests, a temporary folder is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return named or os.path.dirname(held.get())


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once into the shared checkpoint folder, with its lineage cut; it outlives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration()


def drop(df: DataFrame) -> None:
    """Delete the files of a table that `cut` wrote, once nothing reads it any more; other tables are left alone."""
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() != "LogicalRDD":
        return
    file = plan.rdd().getCheckpointFile()
    if file.isDefined():
        path, conf = _hadoop_path(df.sparkSession, file.get())
        path.getFileSystem(conf).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Delete all checkpoints of this session's context, when its results have been read or written."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        path, conf = _hadoop_path(spark, held.get())
        files = path.getFileSystem(conf)
        if files.exists(path):
            for status in files.listStatus(path):
                files.delete(status.getPath(), True)


def spread(df: DataFrame) -> DataFrame:
    """A scan with at least as many partitions as the session has cores, for work that computes much on few bytes.

    For plain scans of a table (with projections and filters), whose partitions are known without running anything. A scan
    of enough files is left as it is, so large tables aren't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint only if the optimizer's size estimate of `df` is within `limit`; otherwise `df` itself."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """The rows of a parameter table, at most `limit`; a larger table is an error, never a cut-off."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; it isn't a parameter table")
    return rows
