"""Corpus statistics. Aggregates are partial before they shuffle; ratios are ratios of sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import char_edits, word_count, word_edits
from millrace.operators.columns import col
from millrace.session import broadcast_if_small


def text_frequency(df: DataFrame, source: str, text: str) -> DataFrame:
    """(source, text, n) of the texts that aren't empty."""
    return df.where(col(text) != "").groupBy(col(source).alias("source"), col(text).alias("text")).agg(F.count("*").alias("n"))


def source_size(df: DataFrame, source: str, text: str, duration: str | None = None) -> DataFrame:
    """(source, size): seconds of all rows if there is a duration column, else characters of the texts; 0 for none."""
    amount = F.sum(col(duration)) if duration else F.sum(F.char_length(col(text)))
    return df.groupBy(col(source).alias("source")).agg(F.coalesce(amount, F.lit(0)).cast("double").alias("size"))


def mixture_factors(sizes: DataFrame, source: str = "source", weight: str = "weight", size: str = "size") -> DataFrame:
    """(source, factor): share by weight over share by size, of sources with positive weight and size. One row per source."""
    kept = sizes.where((col(weight) > 0) & (col(size) > 0))
    whole = W.partitionBy(F.lit(1))
    return kept.select(col(source), ((col(weight) / F.sum(col(weight)).over(whole)) / (col(size) / F.sum(col(size)).over(whole))).alias("factor"))


def weighted_frequency(frequency: DataFrame, factors: DataFrame) -> DataFrame:
    """(text, n): counts times their source's factor, scaled so that the least factor is 1, rounded half to even, summed, at least 1."""
    least = F.min("factor").over(W.partitionBy(F.lit(1)))  # one row per source
    scaled = factors.select("source", (F.col("factor") / least).alias("times"))
    joined = frequency.join(broadcast_if_small(scaled), "source")
    return joined.groupBy("text").agg(F.greatest(F.lit(1), F.sum(F.bround(F.col("n") * F.col("times")).cast("long"))).alias("n"))


def dense_ids(df: DataFrame, source_order: str, value: str, namespace: Column | None = None, out: str = "id") -> DataFrame:
    """(key, id): ids 0..n-1 of the distinct values, by the first source they occur in and then by their text.

    Null and empty values have none; 0 is a value. The key is `namespace:value`. Ids are counted over a range partitioning, so
    the values may be many.
    """
    from millrace.operators.columns import assign_row_index

    text = col(value).cast("string")
    key = text if namespace is None else F.concat_ws(":", namespace, text)
    first = df.where(text.isNotNull() & (text != "")).groupBy(key.alias("key")).agg(F.min(col(source_order)).alias("__order"), F.min(text).alias("__text"))
    return assign_row_index(first, ["__order", "__text", "key"], out=out).select("key", out)


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The distinct combinations of columns; null is a value."""
    return df.select(*[col(c) for c in columns]).distinct()


def is_dense(ids: DataFrame, column: str = "id") -> Column | bool:
    """Whether the ids are 0..n-1, each once."""
    r = ids.agg(F.count("*").alias("n"), F.countDistinct(col(column)).alias("d"), F.min(col(column)).alias("lo"), F.max(col(column)).alias("hi")).first()
    return r["n"] == 0 or (r["n"] == r["d"] and r["lo"] == 0 and r["hi"] == r["n"] - 1)


def split_summary(df: DataFrame, split: str, speaker: str, duration: str) -> DataFrame:
    """(split, n_rows, n_speakers, hours); null durations count as none."""
    return df.groupBy(col(split).alias("split")).agg(F.count("*").alias("n_rows"), F.countDistinct(col(speaker)).alias("n_speakers"), (F.coalesce(F.sum(col(duration)), F.lit(0.0)) / 3600).alias("hours"))


def error_counts(df: DataFrame, hypothesis: str, reference: str) -> DataFrame:
    """`df` with word_edits, words, char_edits and chars; they add up over rows. Nulls count as empty texts."""
    h, r = col(hypothesis), col(reference)
    return df.withColumns({"word_edits": word_edits(h, r), "words": F.coalesce(word_count(r), F.lit(0)), "char_edits": char_edits(h, r), "chars": F.coalesce(F.char_length(r), F.lit(0))})


def error_rates(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """WER and CER as ratios of sums: over all (group null, `overall` true) and by each group; null where the denominator is 0."""
    sums = [F.sum(c).alias(c) for c in ("word_edits", "words", "char_edits", "chars")]
    if groups:
        rolled = counts.groupingSets([[], list(groups)], *groups).agg(F.grouping(groups[0]).cast("boolean").alias("overall"), *sums)
    else:
        rolled = counts.agg(F.lit(True).alias("overall"), *sums)
    return rolled.withColumns({"wer": F.try_divide(F.col("word_edits"), F.col("words")), "cer": F.try_divide(F.col("char_edits"), F.col("chars"))})


def baseline_gap(metrics: DataFrame, system: str, baseline: str, keys: Sequence[str], value: str) -> DataFrame:
    """`metrics` with `gap`: the value less that of the baseline system for the same keys, null where it has none."""
    base = F.max(F.when(col(system) == baseline, col(value))).over(W.partitionBy(*keys))
    return metrics.withColumn("gap", col(value) - base)


def grouped_means(df: DataFrame, value: str, groupings: Sequence[Sequence[str]], weight: str | None = None) -> DataFrame:
    """Sum, count and mean of a value over all and for each grouping, in one pass over grouping sets; weighted if a weight is given. Null values don't count; groups without any are left out."""
    columns = list(dict.fromkeys(c for g in groupings for c in g))
    w = col(weight) if weight else F.lit(1.0)
    total, count = F.sum(col(value) * w), F.sum(F.when(col(value).isNotNull(), w))
    sets = [[], *[list(g) for g in groupings]]
    grouped = df.groupingSets(sets, *columns).agg(F.grouping_id(*columns).alias("grouping"), total.alias("total"), count.alias("count"))
    return grouped.where("count > 0").withColumn("mean", F.col("total") / F.col("count"))


def code_histogram(df: DataFrame, codes: str, length: str | None, groups: Sequence[str]) -> DataFrame:
    """(groups, code, n) over the array's first `length` entries, the rest being padding."""
    spread = df.select(*groups, *([length] if length else []), F.posexplode(codes).alias("__pos", "code"))
    kept = spread.where(F.col("__pos") < col(length)) if length else spread
    return kept.groupBy(*groups, "code").agg(F.count("*").alias("n"))


def codebook_stats(histogram: DataFrame, groups: Sequence[str], size: int) -> DataFrame:
    """Used share of a codebook of `size` and perplexity exp(-sum p ln p), by group."""
    totals = histogram.groupBy(*groups).agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("used"), F.sum(F.when(F.col("n") > 0, F.col("n") * F.ln("n"))).alias("s"))
    return totals.select(*groups, "total", (F.col("used") / size).alias("usage"), F.exp(F.ln("total") - F.col("s") / F.col("total")).alias("perplexity"))


def digit_shares(histogram: DataFrame, levels: Sequence[int]) -> DataFrame:
    """(digit, level, share): how often each level of each mixed-radix digit of the code occurs, first digit fastest."""
    radix, digits = 1, []
    for i, n in enumerate(levels):
        digits.append(F.struct(F.lit(i).alias("digit"), (F.floor(F.col("code") / radix) % n).cast("int").alias("level")))
        radix *= n
    spread = histogram.select("n", F.explode(F.array(*digits)).alias("d")).groupBy("d.digit", "d.level").agg(F.sum("n").alias("n"))
    return spread.select("digit", "level", (F.col("n") / F.sum("n").over(W.partitionBy("digit"))).alias("share"))


def safe_average(total: Column, count: Column) -> Column:
    """total / count, 0 if there is nothing."""
    return F.coalesce(F.try_divide(total, count), F.lit(0.0))


def union_reasons(*arrays: Column) -> Column:
    """The arrays' entries in order, each once, without nulls; null arrays are empty."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.flatten(F.array(*[F.coalesce(a, empty) for a in arrays]))))


def voicing_stats(df: DataFrame, key: str, f0: str) -> DataFrame:
    """(key, n_frames, n_voiced, mean_log_f0, std_log_f0) over the frames with f0 > 0; population deviation, null without voiced frames."""
    spread = df.select(key, F.explode(f0).alias("__f"))
    voiced = F.when(F.col("__f") > 0, F.ln("__f"))
    return spread.groupBy(key).agg(F.count("*").alias("n_frames"), F.count(voiced).alias("n_voiced"), F.avg(voiced).alias("mean_log_f0"), F.stddev_pop(voiced).alias("std_log_f0"))


def z_scored_f0(df: DataFrame, f0: str, mean: str, std: str, out: str = "f0_z") -> DataFrame:
    """Voiced frames' log f0 in deviations from the mean, 0 for the others; JVM-side over the array."""
    return df.withColumn(out, F.transform(f0, lambda x: F.when(x > 0, F.try_divide(F.ln(x) - col(mean), F.nullif(col(std), F.lit(0.0)))).otherwise(0.0)))


def compare_tracks(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Of two f0 tracks by key: voicing_error, rmse_cents and correlation where both are voiced, and l1 over all frames both have."""
    z = df.select(key, F.explode(F.slice(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")), F.lit(1), F.least(F.size(a), F.size(b)))).alias("z"))
    x, y = F.col("z.a").cast("double"), F.col("z.b").cast("double")
    both = (x > 0) & (y > 0)
    cents = F.when(both, 1200 * F.log2(x / y))
    return z.groupBy(key).agg(
        F.avg(F.when((x > 0) != (y > 0), 1.0).otherwise(0.0)).alias("voicing_error"),
        F.sqrt(F.avg(cents * cents)).alias("rmse_cents"),
        F.corr(F.when(both, x), F.when(both, y)).alias("correlation"),
        F.avg(F.abs(x - y)).alias("l1"),
    )


def span_scores(spans: DataFrame, token: Sequence[str], start: str, end: str, score: str, count: str = "count") -> DataFrame:
    """Word spans of a token as one: least start, last end, summed score and count, and their average."""
    merged = spans.groupBy(*token).agg(F.min(start).alias("start"), F.max(end).alias("end"), F.sum(score).alias("score"), F.sum(count).alias("count"))
    return merged.withColumn("average", F.try_divide("score", "count"))


def rare_values(df: DataFrame, value: Column, at_most: int = 2, out: str = "label") -> DataFrame:
    """(value, n) of the values that occur at most so often."""
    return df.groupBy(value.alias(out)).agg(F.count("*").alias("n")).where(F.col("n") <= at_most)
