"""Ordered analytics within a group. Every operator takes its order; ties are broken by the columns given last."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.columns import col


def filter_by_group_count(df: DataFrame, key: str, condition: str, count: str = "n_in_group") -> DataFrame:
    """Rows for which a condition holds that may use the number of rows of their key; the helper column isn't kept."""
    return df.withColumn(count, F.count("*").over(W.partitionBy(key))).where(condition).drop(count)


def first_occurrence(df: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """The first row of each key in an order; null keys count as one key.

    Aggregated as the least row, so a key with very many rows is reduced before the shuffle and never sorted in one task.
    """
    rest = [c for c in df.columns if c not in order_by and c != key]
    # order columns first; the rest rides along
    row = F.struct(*[col(c) for c in order_by], F.struct(*[col(c) for c in rest]).alias("__rest")) if rest else F.struct(*[col(c) for c in order_by])
    first = df.groupBy(col(key)).agg(F.min_by(row, F.struct(*[col(c) for c in order_by])).alias("__row"))
    return first.select(*[F.col("__row.__rest")[c].alias(c) if c in rest else (col(c) if c == key else F.col("__row")[c].alias(c)) for c in df.columns])


def neighbours(df: DataFrame, partition: Sequence[str], order_by: Sequence[str], column: str, previous: str = "prev", following: str = "next") -> DataFrame:
    """The value of the row before and of the row after in a group."""
    w = W.partitionBy(*partition).orderBy(*order_by)
    return df.withColumns({previous: F.lag(column).over(w), following: F.lead(column).over(w)})


def sandwiched(df: DataFrame, partition: Sequence[str], order_by: Sequence[str], column: str) -> DataFrame:
    """Rows that differ from neighbours which are equal: likely wrong attributions."""
    n = neighbours(df, partition, order_by, column, "__prev", "__next")
    return n.where((F.col("__prev") == F.col("__next")) & (col(column) != F.col("__prev"))).withColumn("surrounding", F.col("__prev")).drop("__prev", "__next")


def overlaps(df: DataFrame, partition: Sequence[str], start: str, end: str, tolerance: float, tie: Sequence[str] = ()) -> DataFrame:
    """Rows that start more than `tolerance` before the row before them ends, with that end as `prev_end`."""
    w = W.partitionBy(*partition).orderBy(start, *tie)
    return df.withColumn("prev_end", F.lag(end).over(w)).where(F.col("prev_end") - col(start) > tolerance)


def crosstalk(df: DataFrame, partition: Sequence[str], order_by: Sequence[str], start: str, end: str, run: int = 4, max_turn: float = 2.0, max_span: float = 10.0, out: str = "crosstalk") -> DataFrame:
    """Mark turns of any run of `run` consecutive turns, each shorter than `max_turn`, that spans at most `max_span` in all."""
    w = W.partitionBy(*partition).orderBy(*order_by)
    ahead, behind = w.rowsBetween(0, run - 1), w.rowsBetween(-(run - 1), 0)
    short = F.coalesce(col(end) - col(start) < max_turn, F.lit(False))
    heads = (F.count("*").over(ahead) == run) & F.min(short).over(ahead) & (F.last(col(end)).over(ahead) - col(start) <= max_span)
    return df.withColumn("__head", heads).withColumn(out, F.max("__head").over(behind)).drop("__head")


def pause_sessions(df: DataFrame, partition: Sequence[str], order_by: Sequence[str], gap: Column, out: str = "session") -> DataFrame:
    """Number the sessions of a group from 0: one begins where `gap`, a condition over the row and its `__prev_end`-like columns, holds."""
    w = W.partitionBy(*partition).orderBy(*order_by)
    return df.withColumn("__new", F.when(F.row_number().over(w) == 1, 0).otherwise(F.coalesce(gap.cast("int"), F.lit(0)))).withColumn(out, F.sum("__new").over(w)).drop("__new")


def gap_sessions(df: DataFrame, partition: Sequence[str], order_by: Sequence[str], start: str, end: str, max_pause: float, out: str = "session") -> DataFrame:
    """Sessions split where a row starts more than `max_pause` after the row before it ends."""
    w = W.partitionBy(*partition).orderBy(*order_by)
    marked = df.withColumn("__gap", col(start) - F.lag(col(end)).over(w))
    return pause_sessions(marked, partition, order_by, F.col("__gap") > max_pause, out).drop("__gap")


def fill_gaps(df: DataFrame, group: Sequence[str], order_by: str, start: str, end: str) -> DataFrame:
    """Spans for rows without one: between the known neighbours of their group by linear interpolation over the row numbers, flat at the group's ends; then no span begins before the one before it ends. A group without any span stays null."""
    w = W.partitionBy(*group).orderBy(order_by)
    up, down = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    known = col(start).isNotNull() & col(end).isNotNull()
    k = df.withColumn("__k", F.row_number().over(w))
    k = k.withColumns({
        "__a": F.last(F.when(known, F.struct(F.col("__k").alias("k"), col(end).alias("t"))), ignorenulls=True).over(up),
        "__b": F.first(F.when(known, F.struct(F.col("__k").alias("k"), col(start).alias("t"))), ignorenulls=True).over(down),
    })
    span = F.col("__b.k") - F.col("__a.k")
    frac = (F.col("__k") - F.col("__a.k")) / span
    step = F.col("__b.t") - F.col("__a.t")
    s = F.when(known, col(start)).when(F.col("__a").isNull(), F.col("__b.t")).when(F.col("__b").isNull(), F.col("__a.t")).otherwise(F.col("__a.t") + step * frac)
    e = F.when(known, col(end)).when(F.col("__a").isNull(), F.col("__b.t")).when(F.col("__b").isNull(), F.col("__a.t")).otherwise(F.col("__a.t") + step * F.least(F.lit(1.0), frac + 1.0 / span))
    filled = k.withColumns({"__s": s, "__e": F.greatest(s, e)}).drop("__a", "__b")
    # running maximum of all ends so far: what a span may not begin before
    before = F.max("__e").over(w.rowsBetween(W.unboundedPreceding, -1))
    fixed = filled.withColumn("__f", F.greatest(F.col("__s"), F.coalesce(before, F.col("__s"))))
    return fixed.withColumns({start: F.col("__f"), end: F.greatest("__e", "__f")}).drop("__k", "__s", "__e", "__f")


def split_fractions(df: DataFrame, fractions: Mapping[str, float], order_by: Sequence[str], out: str = "split") -> DataFrame:
    """Contiguous splits by row number: bounds are the summed fractions times n, rounded half to even; the last ends at n."""
    from millrace.operators.columns import assign_row_index

    numbered = assign_row_index(df, order_by, out="__row")
    n = numbered.count()
    bounds = np.round(np.cumsum([0.0, *fractions.values()]) * n).astype(int)
    bounds[-1] = n
    names = list(fractions)
    split = F.lit(None).cast("string")
    for name, a, b in reversed(list(zip(names, bounds[:-1], bounds[1:], strict=True))):
        split = F.when((F.col("__row") >= int(a)) & (F.col("__row") < int(b)), F.lit(name)).otherwise(split)
    return numbered.withColumn(out, split).where(F.col(out).isNotNull()).drop("__row")


def prefix_sum(df: DataFrame, partition: Sequence[str], order_by: Sequence[str], value: Column, out: str) -> DataFrame:
    """The sum of a value over the rows before, in a group."""
    w = W.partitionBy(*partition).orderBy(*order_by).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))


def carry_back(df: DataFrame, partition: Sequence[str], order_by: Sequence[str], value: str, continues: Column, out: str = "context") -> DataFrame:
    """The last value before the row that isn't a continuation (such as a list's connector)."""
    w = W.partitionBy(*partition).orderBy(*order_by).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(out, F.last(F.when(~continues, col(value)), ignorenulls=True).over(w))


def repair_sandwiched(df: DataFrame, group: Sequence[str], order_by: str, label: str, section: str, out: str = "repaired", allowed: Column | None = None) -> DataFrame:
    """Sequential repair: a row whose neighbours in the same section agree takes their label, and is their neighbour from then on.

    A repaired row counts as the row before for later ones, which no window can say; each group is one pandas frame, so a
    group must fit in memory. Rows for which `allowed` holds are left out of the chain and stay as they are; null labels too.
    """
    skip = F.coalesce(allowed, F.lit(False)) if allowed is not None else F.lit(False)
    marked = df.withColumns({"__skip": skip | col(label).isNull(), out: col(label)})

    def repair(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order_by, kind="stable")
        chain = [i for i, s in enumerate(pdf["__skip"]) if not s]
        labels, sections = list(pdf[out]), list(pdf[section])
        for a, b, c in zip(chain, chain[1:], chain[2:], strict=False):
            if sections[a] == sections[b] == sections[c] and labels[a] == labels[c] != labels[b]:
                labels[b] = labels[a]
        pdf[out] = labels
        return pdf

    return marked.groupBy(*group).applyInPandas(repair, marked.schema).drop("__skip")


def frame_powers(df: DataFrame, key: str, wave: str, frame: int, hop: int) -> DataFrame:
    """(key, frame, power): mean square of each frame of a waveform; JVM-side over array slices."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(wave) - frame, F.lit(0)), F.lit(hop))
    power = F.aggregate(F.slice(F.col(wave), F.col("__s") + 1, F.lit(frame)), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / frame
    spread = df.where(F.size(wave) >= frame).select(key, wave, F.posexplode(starts).alias("frame", "__s"))
    return spread.select(key, "frame", power.alias("power"))
