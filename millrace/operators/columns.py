"""Projections and column operators. Each is a function from a DataFrame to a DataFrame; Catalyst prunes what isn't read."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import blank_to_null, strip
from millrace.session import cut


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def remove_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop columns; unknown names are an error."""
    _require(df, columns)
    return df.drop(*columns)


def select_columns(df: DataFrame, columns: Sequence[str] = ("row", "id")) -> DataFrame:
    """Keep only these columns, in this order."""
    return df.select(*[col(c) for c in columns])


def _require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")


def extract_nested(df: DataFrame, column: str, paths: Sequence[tuple[str, str]]) -> DataFrame:
    """Columns from JSON paths of a JSON text or a struct column, which is dropped.

    A path without a value, a JSON null and blank text give null; results are text (numbers as JSON writes them). A path
    with a wildcard that finds several values is an error when it is computed, as one value can't stand for them.
    """
    _require(df, [column])
    source = col(column)
    if isinstance(df.schema[column].dataType, (T.StructType, T.ArrayType, T.MapType)):
        source = F.to_json(source)
    out = {}
    for path, name in paths:
        value = F.get_json_object(source, path)
        if "*" in path:
            # a wildcard over one value gives its JSON, over several a JSON array of them
            found = F.from_json(value, "array<string>")
            one = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
            value = F.when(value.startswith("[") & (F.size(found) > 1), F.raise_error(F.lit(f"{path} finds several values"))).when(value.startswith("["), F.get(found, 0)).otherwise(one)
        out[name] = blank_to_null(value)
    if column in out:
        return df.withColumns(out)
    return df.withColumns(out).drop(column)


def cast_columns(df: DataFrame, types: Mapping[str, str | None]) -> DataFrame:
    """Cast columns; a null type drops the column, `audio_decode` and the like are tags that leave media as they are. Invalid values are an error."""
    _require(df, list(types))
    casts = {c: col(c).cast(t) for c, t in types.items() if t is not None and not t.startswith(("audio_", "image_"))}
    return df.withColumns(casts).drop(*[c for c, t in types.items() if t is None])


def rename_columns(df: DataFrame, names: Mapping[str, str | None]) -> DataFrame:
    """Rename in order; a null target drops the column."""
    for old, new in names.items():
        _require(df, [old])
        df = df.drop(old) if new is None else df.withColumnRenamed(old, new)
    return df


def assign_row_index(df: DataFrame, order_by: Sequence[str | Column], split: str | None = None, out: str = "row") -> DataFrame:
    """Number the rows of each split from 0 in a given order.

    The rows are range-partitioned by the order and counted per partition, so no task sees a whole split. The partitioned
    rows are written to the checkpoint folder once: ranges are sampled, and a second evaluation could draw others. The order
    should tell all rows apart, else equal rows are numbered in any order.
    """
    keys = [o if isinstance(o, Column) else col(o) for o in order_by]
    by = [col(split)] if split else []
    part = cut(df.repartitionByRange(*by, *keys).withColumn("__p", F.spark_partition_id()))
    counts = part.groupBy(*by, "__p").agg(F.count("*").alias("__n"))
    ahead = counts.withColumn("__ahead", F.sum("__n").over(W.partitionBy(*by).orderBy("__p")) - F.col("__n")).drop("__n")
    local = part.withColumn("__r", F.row_number().over(W.partitionBy(*by, "__p").orderBy(*keys)))
    if split:
        on = (F.col("l.__p") == F.col("a.__p")) & F.col(f"l.`{split}`").eqNullSafe(F.col(f"a.`{split}`"))
        joined = local.alias("l").join(ahead.alias("a"), on).select("l.*", "a.__ahead")
    else:
        joined = local.join(ahead, "__p")
    return joined.withColumn(out, (F.col("__r") - 1 + F.col("__ahead")).cast("long")).drop("__p", "__r", "__ahead")


def map_columns(df: DataFrame, outputs: Mapping[str, Column], remove: Sequence[str] = (), filter_null_outputs: bool = False) -> DataFrame:
    """Add or replace columns, drop others, and on request drop rows with a null among the outputs (other nulls don't count)."""
    out = df.withColumns(dict(outputs)).drop(*[c for c in remove if c not in outputs])
    return out.dropna(how="any", subset=list(outputs)) if filter_null_outputs else out


def map_values(df: DataFrame, column: str, out: str, f: Callable[[Column], Column], filter_null_outputs: bool = False) -> DataFrame:
    """One column from one column."""
    return map_columns(df, {out: f(col(column))}, filter_null_outputs=filter_null_outputs)


def override_values(df: DataFrame, rules: Sequence[tuple[str, Any, str, Any]]) -> DataFrame:
    """Rules (if column, equals value, then column, becomes value) in order; later rules see what earlier ones wrote, and null equals null."""
    for if_col, value, then_col, new in rules:
        kind = df.schema[then_col].dataType if then_col in df.columns else None
        lit = F.lit(new).cast(kind) if kind is not None else F.lit(new)
        old = col(then_col) if then_col in df.columns else F.lit(None)
        df = df.withColumn(then_col, F.when(col(if_col).eqNullSafe(F.lit(value)), lit).otherwise(old))
    return df


def add_constants(df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
    """Columns of one value each; an existing column of the name is an error."""
    if both := [c for c in values if c in df.columns]:
        raise ValueError(f"columns exist: {both}")
    return df.withColumns({c: F.lit(v) for c, v in values.items()})


def composite_id(df: DataFrame, columns: Sequence[str], out: str = "id", delimiter: str = ":") -> DataFrame:
    """The texts of several columns joined; a null is the text `None`."""
    return df.withColumn(out, F.concat_ws(delimiter, *[F.coalesce(col(c).cast("string"), F.lit("None")) for c in columns]))


def select_caption(df: DataFrame, columns: Sequence[str], out: str = "caption", source_out: str = "caption_source", min_characters: int = 1, item_key: str = "caption") -> DataFrame:
    """The first usable caption of several columns, and the column it is from.

    A list column offers its first item that isn't blank (of structs, the field `item_key`); a caption is stripped and
    usable from `min_characters` characters; a list's later items aren't tried if its first is too short.
    """
    candidates = []
    for c in columns:
        kind, value = df.schema[c].dataType, col(c)
        if isinstance(kind, T.ArrayType):
            items = F.transform(value, lambda x: x[item_key]) if isinstance(kind.elementType, T.StructType) else value
            value = F.get(F.filter(items, lambda x: strip(x) != ""), 0)
        text = strip(value.cast("string"))
        candidates.append((c, F.when((F.char_length(text) >= min_characters) & (text != ""), text) if min_characters else text))
    chosen = F.coalesce(*[x for _, x in candidates])
    source = F.coalesce(*[F.when(x.isNotNull(), F.lit(c)) for c, x in candidates])
    return df.withColumns({out: chosen, source_out: source})


def select_task_columns(df: DataFrame, needed: dict[str, Sequence[str]], task: Sequence[str], always: Sequence[str] = ("row", "id")) -> DataFrame:
    """The columns that the fields of a task need (by `needed`), and those always kept, as far as the table has them; an unknown field is an error. Catalyst then reads no others."""
    if unknown := [f for f in task if f not in needed]:
        raise ValueError(f"no rule for fields {unknown}")
    wanted = dict.fromkeys([*always, *(c for f in task for c in needed[f])])
    return df.select(*[col(c) for c in wanted if c in df.columns])


def check_same_features(frames: Mapping[str, DataFrame]) -> None:
    """All splits must have the same columns and types, in order."""
    kinds = {name: [(f.name, f.dataType) for f in df.schema.fields] for name, df in frames.items()}
    first = next(iter(kinds.values()), None)
    different = [name for name, kind in kinds.items() if kind != first]
    if different:
        raise ValueError(f"splits with other columns or types: {different}")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of a schema in its order and types; missing ones are null, others are dropped."""
    return df.select(*[(col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])
