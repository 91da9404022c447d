"""Ordered samples, shuffled passes, weighted mixtures and length-bucketed batches.

Shuffles are orders by a seeded hash, so they are the same in every run, can be resumed anywhere, and need no state.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.columns import assign_row_index, col
from millrace.operators.filters import blake_bucket
from millrace.session import cut


def seeded(seed: int, *keys: Column | int | str) -> Column:
    """A hash of seed and keys as hexadecimal text; adjacent seeds have unrelated orders."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(k if isinstance(k, Column) else F.lit(str(k))).cast("string") for k in keys]))


def random_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of least seeded hash of the key: a uniform sample of fixed size, kept as a heap of n rows per task."""
    return df.orderBy(seeded(seed, col(key)), col(key)).limit(n)


def first_items(df: DataFrame, array: str, k: int) -> DataFrame:
    """An array's first k entries."""
    return df.withColumn(array, F.slice(array, 1, k))


def shuffled_batches(df: DataFrame, key: str, size: int, passes: Sequence[int] = (0,), seed: int = 0) -> DataFrame:
    """(pass, batch, pos, key): in each pass every row once in a seeded order, in batches of `size`; what is left at the end is dropped, as in training."""
    rows = df.select(col(key).alias("key"), F.explode(F.array(*[F.lit(p) for p in passes])).alias("pass"))
    numbered = assign_row_index(rows.withColumn("__h", seeded(seed, F.col("pass"), F.col("key"))), ["__h", "key"], split="pass")
    total = df.count()
    kept = numbered.where(F.col("row") < (total // size) * size)
    return kept.select("pass", F.floor(F.col("row") / size).cast("long").alias("batch"), (F.col("row") % size).cast("int").alias("pos"), F.col("key").alias(key))


def chunk_counts(weights: Mapping[str, float], pool: int, chunk: int, seed: int) -> dict[str, int]:
    """How many rows each source gives to a chunk: a multinomial draw seeded by (seed, chunk)."""
    names = sorted(weights)
    p = np.array([weights[n] for n in names], dtype=float)
    drawn = np.random.default_rng([seed, chunk]).multinomial(pool, p / p.sum())
    return dict(zip(names, map(int, drawn), strict=True))


def draw_weights(df: DataFrame, source: str, weights: Mapping[str, float], length: Column | None = None) -> dict[str, float]:
    """Draw probabilities: shares of rows as they are, or shares of length divided by the source's mean length, as sources of short rows need more draws."""
    if length is None:
        return dict(weights)
    means = {str(r["s"]): r["m"] for r in df.groupBy(col(source).cast("string").alias("s")).agg(F.avg(length).alias("m")).collect() if r["s"] in weights}
    return {s: w / means[s] for s, w in weights.items()}


def cropped_seconds(duration: Column, crop: float, most: int) -> Column:
    """The seconds that crops of a clip cover: at most `most` whole crops, a shorter clip all of itself; null for a duration that isn't finite."""
    crops = F.least(F.greatest(F.floor(duration / crop), F.lit(1)), F.lit(most))
    finite = ~F.isnan(duration) & (F.abs(duration) < float("inf"))
    return F.when(finite & (duration >= crop), crops * crop).when(finite, duration)


def crop_probabilities(df: DataFrame, duration: str, crop: float, most: int, out: str = "probability") -> DataFrame:
    """How likely a draw takes each clip: its cropped seconds by those of all; clips without a finite length above 0 have 0."""
    seconds = F.when(col(duration) > 0, F.coalesce(cropped_seconds(col(duration), crop, most), F.lit(0.0))).otherwise(0.0)
    total = df.agg(F.sum(seconds).alias("__total"))
    return df.crossJoin(F.broadcast(total)).withColumn(out, F.coalesce(F.try_divide(seconds, F.col("__total")), F.lit(0.0))).drop("__total")


def crop_draws(df: DataFrame, key: str, duration: str, crop: float, most: int, n: int, seed: int = 0) -> DataFrame:
    """(draw, key): n seeded draws with replacement by `crop_probabilities`. Each draw is a number in 0..1, which is looked up in the clips' cumulated shares; these are summed by ranges of keys, so no task sees all clips."""
    rated = crop_probabilities(df.where(col(key).isNotNull()), duration, crop, most).where("probability > 0").select(col(key).alias("k"), "probability")
    part = cut(rated.repartitionByRange("k").withColumn("p", F.spark_partition_id()))
    ahead = part.groupBy("p").agg(F.sum("probability").alias("s")).withColumn("lo", F.sum("s").over(W.orderBy("p")) - F.col("s"))
    upto = part.join(F.broadcast(ahead), "p").withColumn("hi", F.col("lo") + F.sum("probability").over(W.partitionBy("p").orderBy("k")))
    bucket = 1 << 12
    spans = upto.withColumn("b", F.explode(F.sequence(F.floor((F.col("hi") - F.col("probability")) * bucket), F.floor(F.col("hi") * bucket))))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), (F.conv(F.substring(seeded(seed, F.col("id")), 1, 12), 16, 10).cast("double") / 2.0**48).alias("x")).withColumn("b", F.floor(F.col("x") * bucket))
    hit = draws.join(spans, "b").where("x >= hi - probability and x < hi")
    # at a bound that rounding moved two clips may claim a draw, or none: the lesser key, or the last clip
    first = hit.groupBy("draw").agg(F.min("k").alias("k"))
    last = upto.agg(F.max("k").alias("z"))
    return draws.select("draw").join(first, "draw", "left").crossJoin(F.broadcast(last)).select("draw", F.coalesce("k", "z").alias(key))


def mixture_chunks(df: DataFrame, source: str, key: str, weights: Mapping[str, float], pool: int, chunks: Sequence[int], seed: int = 0) -> DataFrame:
    """(chunk, source, position, key) for the chunks asked for: each source is an endless stream of reshuffled passes over its rows, read on from where the chunks before stopped.

    Positions are planned on the driver from the draws (one number per chunk and source); rows join by cycle and position.
    """
    names = sorted(weights)
    rows = df.where(col(source).cast("string").isin(names)).select(col(source).cast("string").alias("source"), col(key).alias("key"))
    sizes = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()}
    empty = [n for n in names if not sizes.get(n)]
    if empty:
        raise ValueError(f"sources without rows: {empty}")
    starts = dict.fromkeys(names, 0)
    plan = []
    for chunk in range(max(chunks) + 1):
        for name, n in chunk_counts(weights, pool, chunk, seed).items():
            if chunk in chunks and n:
                plan.append((chunk, name, starts[name], starts[name] + n))
            starts[name] += n
    spark = df.sparkSession
    cycles = sorted({(s, c) for _, s, a, b in plan for c in range(a // sizes[s], (b - 1) // sizes[s] + 1)})
    passes = rows.join(F.broadcast(spark.createDataFrame([(s, c, sizes[s]) for s, c in cycles], "source string, cycle int, n long")), "source")
    split = passes.withColumn("__split", F.concat_ws("/", "source", F.col("cycle").cast("string"))).withColumn("__h", seeded(seed, F.col("source"), F.col("cycle"), F.col("key")))
    placed = assign_row_index(split, ["__h", "key"], split="__split").withColumn("position", F.col("cycle") * F.col("n") + F.col("row")).drop("n")
    wanted = spark.createDataFrame(plan, "chunk int, source string, a long, b long")
    return placed.join(F.broadcast(wanted), "source").where("position >= a and position < b").select("chunk", F.col("source").alias(source), "position", F.col("key").alias(key))


def batch_ends(lengths: np.ndarray, budget: float) -> list[int]:
    """Where the batches of rows sorted by length end: the most rows whose number times the longest keeps to the budget, one at least.

    In sorted lengths the padded size of rows a to b is (b - a) * lengths[b - 1] and grows with b, so each end is found by bisection.
    """
    ends, a, n = [], 0, len(lengths)
    while a < n:
        fits = bisect.bisect_right(range(a + 1, n + 1), budget, key=lambda b: (b - a) * lengths[b - 1])
        a += max(fits, 1)
        ends.append(a)
    return ends


def bucketed_batches(pool: DataFrame, chunk: str, key: str, length: str, budget: float, seed: int = 0) -> DataFrame:
    """(chunk, batch, pos, key): each chunk's pool sorted by length and packed greedily under a padded budget, batches in seeded order. A chunk is one pandas frame; its size is the pool's, chosen by the caller."""
    kind = pool.schema[key].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([length, key], kind="stable")
        ends = np.array(batch_ends(pdf[length].to_numpy(), budget), dtype=int)
        sizes = np.diff(ends, prepend=0)
        place = np.random.default_rng([seed, int(pdf[chunk].iloc[0])]).permutation(len(ends))
        pos = np.arange(len(pdf)) - np.repeat(ends - sizes, sizes)
        return pd.DataFrame({chunk: pdf[chunk].to_numpy(), "batch": np.repeat(place, sizes), "pos": pos, key: pdf[key].to_numpy()})

    return pool.select(chunk, key, length).groupBy(chunk).applyInPandas(pack, f"{chunk} int, batch int, pos int, {key} {kind}")


def fixed_batches(pool: DataFrame, chunk: str, key: str, size: int, seed: int = 0) -> DataFrame:
    """(chunk, batch, pos, key): each chunk's pool in seeded order, cut into batches of `size`; the last may be shorter."""
    numbered = assign_row_index(pool.withColumn("__h", seeded(seed, col(chunk), col(key))), ["__h", key], split=chunk)
    return numbered.select(chunk, F.floor(F.col("row") / size).cast("int").alias("batch"), (F.col("row") % size).cast("int").alias("pos"), key)


def crop_starts(df: DataFrame, samples: str, crop: int, most: int, key: str, seed: int = 0) -> DataFrame:
    """(key, crop, start) of non-overlapping crops: the clip in equal parts, a seeded offset in each; a clip no longer than a crop has one at 0."""
    n = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(col(samples) / crop)))
    part = F.floor(col(samples) / n)
    spread = df.where(col(samples).isNotNull()).select(col(key), col(samples).alias("__n"), part.alias("__part"), F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("crop"))
    room = F.greatest(F.col("__part") - crop, F.lit(0)) + 1
    offset = F.conv(F.substring(seeded(seed, col(key), F.col("crop")), 1, 12), 16, 10).cast("long") % room
    return spread.select(key, "crop", F.when(F.col("__n") <= crop, F.lit(0)).otherwise(F.col("crop") * F.col("__part") + offset).cast("long").alias("start"))


def estimated_length(kind: str, text: Column | None = None, n_tokens: Column | None = None, units: Column | None = None, stretch: int = 1, height: Column | None = None, width: Column | None = None, patch: int = 1) -> Column:
    """Length of a training row with its end mark: text tokens (or a quarter of the characters, rounded up), voice units by the stretch, image patches, the latter two with a pair of marks."""
    if kind == "text":
        body = F.coalesce(n_tokens, F.ceil(F.char_length(text) / 4)) if n_tokens is not None else F.ceil(F.char_length(text) / 4)
    elif kind == "voice":
        body = F.ceil(F.size(units) / stretch) + 2
    elif kind == "image":
        body = F.floor(height / patch) * F.floor(width / patch) + 2
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return (body + 1).cast("long")


def held_out_split(df: DataFrame, speaker: str, percent: int | None = None, matching: Sequence | None = None, operate_on: str | None = None, split: str = "split") -> DataFrame:
    """Speakers held out for validation: a percent of them by hash, or those of a list; nulls share one bucket, or go to train.

    With `operate_on` only that split is divided and the other rows stay, except those of an existing validation split,
    which the new one replaces.
    """
    if (percent is None) == (matching is None):
        raise ValueError("either a percent or a list is needed")
    held = blake_bucket(col(speaker).cast("string")) < percent if percent is not None else F.coalesce(col(speaker).isin(list(matching)), F.lit(False))
    new = F.when(held, F.lit("validation")).otherwise(F.lit("train"))
    if operate_on is None:
        return df.withColumn(split, new)
    kept = df.where(col(split).isNull() | ~col(split).isin([x for x in ("validation", "train") if x != operate_on]))
    return kept.withColumn(split, F.when(col(split) == operate_on, new).otherwise(col(split)))


def padded_batches(df: DataFrame, batch: Sequence[str], order_by: Sequence[str], values: str, pad: float = 0.0) -> DataFrame:
    """(batch, n, length, lengths, values): arrays of a batch padded to its longest, with their own lengths; a batch is one row and so must be small."""
    g = df.groupBy(*batch).agg(F.array_sort(F.collect_list(F.struct(*order_by, F.col(values).alias("__v")))).alias("__rows"))
    rows = F.transform("__rows", lambda r: r["__v"])
    longest = F.array_max(F.transform(rows, lambda v: F.size(v)))
    wide = F.transform(rows, lambda v: F.concat(v, F.array_repeat(F.lit(pad).cast("double"), longest - F.size(v))))
    return g.select(*batch, F.size("__rows").alias("n"), longest.alias("length"), F.transform(rows, lambda v: F.size(v)).alias("lengths"), wide.alias("values"))


def resume_at(batches_per_chunk: Iterator[int], consumed: int) -> tuple[int, int]:
    """(chunk, batch in it) at which reading goes on after so many batches."""
    chunk = 0
    for n in batches_per_chunk:
        if consumed < n:
            return chunk, consumed
        consumed -= n
        chunk += 1
    return chunk, consumed


def unit_bounds(lo: int, hi: int, size: Mapping[int, int], limit: int) -> list[tuple[int, int]]:
    """Ranges of units whose summed size is within a limit, by halving; empty ones are left out, and one unit that is too large stays whole."""
    total = sum(size.get(i, 0) for i in range(lo, hi + 1))
    if total == 0:
        return []
    if total <= limit or lo == hi:
        return [(lo, hi)]
    middle = lo + math.floor((hi - lo) / 2)
    return unit_bounds(lo, middle, size, limit) + unit_bounds(middle + 1, hi, size, limit)
