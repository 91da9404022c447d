"""Sinks: sharded Parquet by split, frequency and id tables, run records."""

from __future__ import annotations

import datetime
import json
import shlex
import subprocess
import sys
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.columns import col


def shard_count(n_rows: int, n_bytes: int, target_mb: float = 500) -> int:
    """Shards for a target size: at least one, at most one per row."""
    return max(1, min(max(n_rows, 1), int(n_bytes // (target_mb * 1024 * 1024))))


def stored_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: texts and bytes by their length, nested values as JSON, other values eight each."""
    sizes = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            sizes.append(F.octet_length(c))
        elif isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType):
            sizes.append(F.octet_length(F.to_json(F.struct(c.alias("v")))))
        else:
            sizes.append(F.lit(8))
    return sum((F.coalesce(x, F.lit(0)) for x in sizes), F.lit(0)).cast("long")


def shard_plan(df: DataFrame, split: str = "split", target_mb: float = 500) -> dict[str | None, int]:
    """Shards of each split for a target size, by one pass over the rows."""
    sums = df.groupBy(col(split).cast("string").alias("s")).agg(F.count("*").alias("n"), F.sum(stored_bytes(df)).alias("b")).collect()
    return {r["s"]: shard_count(r["n"], r["b"] or 0, target_mb) for r in sums}


def write_splits(df: DataFrame, path: str, split: str = "split", target_mb: float = 500, order_by: Sequence[str] = (), clean: bool = False, add: bool = False) -> None:
    """Parquet partitioned by split, each split in shards of about `target_mb` before compression, contiguous by `order_by` if it is given.

    A path that exists is an error unless `clean`. With `add` further splits are written beside those it has; one that is
    there already is an error, and nothing is written then. The commit's _SUCCESS marks the output complete.
    """
    plan = shard_plan(df, split, target_mb)
    if add:
        check_collisions(read_written_units(df.sparkSession, path, split), sorted(s for s in plan if s is not None))
    total = max(1, sum(plan.values()))
    if order_by:
        parts = df.repartitionByRange(total, split, *order_by).sortWithinPartitions(split, *order_by)
    else:
        shard = F.floor(F.rand(3) * F.coalesce(*[F.when(col(split).cast("string").eqNullSafe(F.lit(s)), F.lit(n)) for s, n in plan.items()], F.lit(1)))
        parts = df.withColumn("__shard", shard).repartition(total, split, "__shard").drop("__shard")
    parts.write.mode("overwrite" if clean else "append" if add else "errorifexists").partitionBy(split).parquet(path)


def check_collisions(written: set[str], names: Sequence[str]) -> None:
    """Each output split may be written once."""
    twice = sorted(written & set(names))
    if twice:
        raise ValueError(f"output splits written twice: {twice}")
    written.update(names)


def write_frequencies(df: DataFrame, path: str, text: str = "text", count: str = "n") -> None:
    """Text and count separated by a tab; texts with a tab or line break are an error."""
    checked = F.when(col(text).rlike(r"[\t\r\n]"), F.raise_error(F.concat(F.lit("text with a tab or line break: "), col(text)))).otherwise(col(text))
    df.select(checked.alias(text), count).write.mode("errorifexists").csv(path, sep="\t", quote="", escape="", emptyValue="")


def write_id_map(ids: DataFrame, path: str) -> None:
    """key,id with a header, sorted by id. The map of ids is read back as one table; its parts stay separate files."""
    ids.select("key", "id").repartitionByRange("id").sortWithinPartitions("id").write.mode("errorifexists").csv(path, header=True)


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """A written id map; ids must be 0..n-1."""
    from millrace.operators.aggregates import is_dense

    ids = spark.read.csv(path, header=True, schema="key string, id long")
    if not is_dense(ids):
        raise ValueError("the ids of the map aren't 0..n-1")
    return ids


def current_commit() -> str | None:
    """The commit of the working folder, None outside a repository or without the tool."""
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def provenance_record(config: Mapping[str, Any], datasets: Sequence[str] = (), models: Sequence[str] = (), command: str | None = None, commit: str | None = None, now: datetime.datetime | None = None) -> dict:
    """What made a dataset: its ancestors, the resolved configuration, command, commit and time; command and commit are those of this process unless given."""
    command = shlex.join(sys.argv) if command is None else command
    commit = current_commit() if commit is None else commit
    return {"produced_on": (now or datetime.datetime.now(datetime.UTC)).isoformat(), "git_commit": commit, "cli": command, "ancestry": {"datasets": sorted(set(datasets)), "models": sorted(set(models))}, "config": config}


def write_bytes(spark: SparkSession, content: bytes, path: str) -> None:
    """A small file through Hadoop's file system, so that it lands where the data does."""
    fs, target = _file_system(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(content))
    out.close()


def write_json(spark: SparkSession, record: Mapping[str, Any], path: str) -> None:
    """A JSON file beside the data."""
    write_bytes(spark, json.dumps(record, indent=2, default=str).encode(), path)


def read_written_units(spark: SparkSession, path: str, unit: str = "unit") -> set[str]:
    """Units that a partitioned output already has, so that a run can go on where it stopped; none if there is no output."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return set()
    return {s.getPath().getName().partition("=")[2] for s in fs.listStatus(target) if s.getPath().getName().startswith(unit + "=")}


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def write_unit(df: DataFrame, path: str, unit: str, name: str = "unit") -> None:
    """A unit's rows under path/unit=<unit>: written beside it first and moved when complete, so a unit is there whole or not at all. Units that don't name a folder are an error."""
    if not unit or "/" in unit or unit.startswith("."):
        raise ValueError(f"{unit!r} can't name a folder")
    spark = df.sparkSession
    fs, part = _file_system(spark, f"{path}/.part-{unit}")
    _, final = _file_system(spark, f"{path}/{name}={unit}")
    if fs.exists(final):
        raise ValueError(f"unit {unit!r} is already written")
    df.write.mode("overwrite").parquet(part.toString())
    if not fs.rename(part, final):
        raise OSError(f"unit {unit!r} couldn't be moved to its place")


def ingest_units(spark: SparkSession, units: Sequence[str], read: Callable[[str], DataFrame], path: str, name: str = "unit") -> list[str]:
    """Write the units that `path` doesn't have yet, one after another, and return them: a run that stopped goes on where it was."""
    done = read_written_units(spark, path, name)
    todo = [u for u in dict.fromkeys(units) if u not in done]
    for u in todo:
        write_unit(read(u), path, u, name)
    return todo


def cached(spark: SparkSession, path: str, build: Mapping[str, Callable[[], DataFrame]], target_mb: float = 500) -> DataFrame:
    """The table under `path` with its splits, each built once: a split without its marker is built again (download, extraction and joins are the builder's matter), the others are read as they are."""
    done = read_written_units(spark, path, "split")
    for split, make in build.items():
        fs, marker = _file_system(spark, f"{path}/split={split}/_SUCCESS")
        if split in done and fs.exists(marker):
            continue
        df = make()
        n = shard_plan(df.withColumn("__split", F.lit(split)), "__split", target_mb).get(split, 1)
        df.repartition(n).write.mode("overwrite").parquet(f"{path}/split={split}")
    return spark.read.option("basePath", path).parquet(*(f"{path}/split={s}" for s in build))
