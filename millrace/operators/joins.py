"""Joins: index to source, lookups, anti and range joins, and the nearest name of a small list."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.columns import col
from millrace.session import bounded_rows, broadcast_if_small


def join_index(index: DataFrame, source: DataFrame | None, row: str = "row", key: str = "id", index_wins: bool = False) -> DataFrame:
    """The source rows that an index names by row number, with the index's own columns; ids must agree, else the query fails.

    Shared columns come from the source, or with `index_wins` from the index. Rows named twice come twice; the index order is
    kept as the column `row` only. Without a source the index itself is returned; if the index has all columns, the source
    isn't read.
    """
    if source is None or set(source.columns) <= set(index.columns) and index_wins:
        return index
    s = source.withColumnsRenamed({c: f"__s_{c}" for c in source.columns})
    joined = index.join(s, col(row) == F.col(f"__s_{row}")) if row in source.columns else index.join(s, col(row) == F.col("__s_row"))
    agree = F.when(~col(key).eqNullSafe(F.col(f"__s_{key}")), F.raise_error(F.concat(F.lit("index and source disagree on id: "), F.coalesce(col(key).cast("string"), F.lit("null"))))).otherwise(col(key))
    shared = [c for c in source.columns if c in index.columns and c not in (row, key)]
    out: list[Column] = [col(row), agree.alias(key)]
    for c in source.columns:
        if c not in (row, key) and c not in shared:
            out.append(F.col(f"__s_{c}").alias(c))
    for c in index.columns:
        if c not in (row, key):
            out.append((col(c) if c not in shared or index_wins else F.col(f"__s_{c}")).alias(c))
    return joined.select(*out)


def number_source(source: DataFrame, order_by: Sequence[str], out: str = "row") -> DataFrame:
    """A source with its row numbers, for `join_index`."""
    from millrace.operators.columns import assign_row_index

    return assign_row_index(source, order_by, out=out)


def join_lookup(df: DataFrame, lookup: DataFrame, key: str, columns: Sequence[str], lookup_key: str | None = None) -> DataFrame:
    """Left join to a table of unique keys: adds `columns`, null where nothing matches; a null key matches a null lookup key.

    Repeated keys in the lookup fail the query when it runs: the lookup is aggregated by its key and checked on the way into the
    join. Columns that `df` already has keep its values.
    """
    lookup_key = lookup_key or key
    added = [c for c in columns if c not in df.columns]
    if not added:
        return df
    one = lookup.groupBy(col(lookup_key).alias("__key")).agg(F.count("*").alias("__n"), F.first(F.struct(*[col(c).alias(c) for c in added])).alias("__v"))
    unique = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit(f"{lookup_key} isn't unique in the lookup table: "), F.coalesce(F.col("__key").cast("string"), F.lit("null"))))).otherwise(F.col("__v"))
    side = one.select("__key", unique.alias("__v"))
    joined = df.join(broadcast_if_small(side), col(key).eqNullSafe(F.col("__key")), "left")
    return joined.select(*[col(c) for c in df.columns], *[F.col("__v")[c].alias(c) for c in added])


def join_last_word(df: DataFrame, names: DataFrame, text: str, name: str) -> DataFrame:
    """Pairs of rows and names (theta join) whose last word the text ends with after a space; as an equal last word follows from that, it is an equi join on it, with the condition on top."""
    last = lambda c: F.regexp_extract(c, r"(\S+)$", 1)
    n = names.where(col(name).isNotNull()).select(*[col(c).alias(f"__n_{c}") for c in names.columns]).withColumn("__w", last(F.col(f"__n_{name}"))).where("__w <> ''")
    joined = df.withColumn("__t", last(col(text))).join(broadcast_if_small(n), (F.col("__t") == F.col("__w")) & F.endswith(col(text), F.concat(F.lit(" "), F.col("__w"))))
    kept = [c for c in names.columns if c not in df.columns]
    return joined.select(*[col(c) for c in df.columns], *[F.col(f"__n_{c}").alias(c) for c in kept])


def join_with_fallback(df: DataFrame, side: DataFrame, key: str, value: str, fallback: Column) -> DataFrame:
    """Left join to a side table for `value`, computed where the table lacks it. Repeated keys of the side count by their least value."""
    one = side.where(col(key).isNotNull()).groupBy(col(key).alias("__key")).agg(F.min(col(value)).alias("__value"))
    return df.join(broadcast_if_small(one), col(key) == F.col("__key"), "left").withColumn(value, F.coalesce("__value", fallback)).drop("__key", "__value")


def outside(df: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in the allowed table (anti join; null keys stay, as they equal nothing)."""
    return df.join(allowed.select(key).distinct(), key, "left_anti")


def without_prefix(df: DataFrame, exceptions: DataFrame, key: str, text: str, exception_key: str, prefix: str) -> DataFrame:
    """Rows for which no exception has their key and a prefix of their text."""
    e = exceptions.select(F.col(exception_key).alias("__k"), F.col(prefix).alias("__p"))
    return df.join(e, (col(key) == F.col("__k")) & F.startswith(col(text), F.col("__p")), "left_anti")


def shared_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that both tables hold: leakage between splits. Each side is reduced to its keys first."""
    return left.select(key).distinct().join(right.select(key).distinct(), key)


def join_interval(df: DataFrame, spans: DataFrame, on: Column, at: Column, start: Column, end: Column, outside_only: bool = False) -> DataFrame:
    """Equi join with the condition that `at` lies in start..end (an open end is null); with `outside_only` that it doesn't."""
    within = (at >= start) & (at <= F.coalesce(end, F.lit("9999-12-31").cast("date")))
    return df.join(broadcast_if_small(spans), on & (~within if outside_only else within))


def in_office(df: DataFrame, spans: DataFrame, at: str, name: str = "name", start: str = "start_date", end: str = "end_date") -> DataFrame:
    """(distinct at, names whose span covers it): a range join without an equal key against a small table, whose size is checked."""
    bounded_rows(spans.select(name), 10_000, "the table of spans")
    days = df.where(col(at).isNotNull()).select(col(at).alias("__at")).distinct()
    held = F.broadcast(spans)
    covered = days.join(held, (F.col("__at") >= col(start)) & (F.col("__at") <= F.coalesce(col(end), F.lit("9999-12-31").cast("date"))))
    return covered.select(F.col("__at").alias(at), name)


def nearest_name(df: DataFrame, column: str, names: DataFrame, name: str, cutoff: float = 0.75, out: str = "nearest") -> DataFrame:
    """The most similar name of a small list by the ratio of matching blocks, null below the cutoff (ties: first in order). Distinct values are compared once (Arrow batches)."""
    listed = sorted({r[0] for r in bounded_rows(names.select(name), 10_000, "the list of names") if r[0]})

    @F.pandas_udf("string")
    def nearest(values: pd.Series) -> pd.Series:
        def one(v):
            scored = [(difflib.SequenceMatcher(None, v, n).ratio(), n) for n in listed]
            best = max(scored, key=lambda x: x[0], default=(0.0, None))
            return best[1] if best[0] >= cutoff else None

        known = {v: one(v) for v in values.dropna().unique()}
        return values.map(known, na_action="ignore")

    return df.withColumn(out, nearest(col(column)))


def resolve_references(df: DataFrame, key: str, refs: str, labels: DataFrame, uri: str, language: str, label: str, preference: Sequence[str], out: str = "labels") -> DataFrame:
    """The labels of an array of references, in its order and each once, in the preferred language that exists."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in preference]), col(language)), F.lit(0))
    best = labels.where(rank > 0).groupBy(col(uri).alias("__uri")).agg(F.min_by(col(label), rank).alias("__label"))
    spread = df.select(key, F.posexplode(refs).alias("__pos", "__uri")).join(broadcast_if_small(best), "__uri")
    found = spread.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__pos", "__label"))).alias("__all"))
    listed = found.select(key, F.array_distinct(F.transform("__all", lambda x: x["__label"])).alias(out))
    return df.join(listed, key, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))
