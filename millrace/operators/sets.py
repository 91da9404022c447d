"""Unions of splits, shards and sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.windows import first_occurrence


def concatenate(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of several frames with the same columns."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def merge_shards(frames: Sequence[DataFrame], key: str | None, order_by: Sequence[str]) -> DataFrame:
    """Shards in their order as one frame, missing columns null; with a key only its first row (earlier shard, then order)."""
    numbered = [f.withColumn("__shard", F.lit(i)) for i, f in enumerate(frames)]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    return (first_occurrence(merged, key, ["__shard", *order_by]) if key else merged).drop("__shard")


def zip_columns(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """The columns of two tables of equal length side by side, row by row in their orders. Names that both have and tables of different length are errors, the latter when the query runs."""
    from millrace.operators.columns import assign_row_index

    both = sorted(set(left.columns) & set(right.columns))
    if both:
        raise ValueError(f"columns in both tables: {both}")
    a, b = assign_row_index(left, left_order, out="__row"), assign_row_index(right, right_order, out="__other")
    joined = a.join(b, F.col("__row") == F.col("__other"), "full")
    paired = F.when(F.col("__row").isNull() | F.col("__other").isNull(), F.raise_error(F.lit("the tables differ in length"))).otherwise(F.lit(True))
    return joined.where(paired).drop("__row", "__other")


def mixture_rows(sources: Mapping[str, DataFrame], order_by: Mapping[str, Sequence[str]], source: str = "source_name", number: str = "source_id", row: str = "row") -> DataFrame:
    """`mixture` with a row number over all: each source's rows in its order, after those of the sources before it."""
    from millrace.operators.columns import assign_row_index

    offset, frames = 0, {}
    for name, frame in sources.items():
        numbered = assign_row_index(frame, order_by[name], out="__row")
        frames[name] = numbered.withColumn(row, F.col("__row") + offset).drop("__row")
        offset += numbered.count()
    return mixture(frames, source, number)


def mixture(sources: Mapping[str, DataFrame], source: str = "source_name", number: str = "source_id") -> DataFrame:
    """Sources end to end with their name and number; missing columns are null."""
    named = [f.withColumns({source: F.lit(n), number: F.lit(i)}) for i, (n, f) in enumerate(sources.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
