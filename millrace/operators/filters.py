"""Row filters. A null input decides before the rule: the row is dropped, or kept with `prune_nulls=False`."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import strip
from millrace.operators.columns import col


def prune(df: DataFrame, columns: Sequence[str], keep: Column, prune_nulls: bool = True) -> DataFrame:
    """Keep rows by a condition over `columns`; any null among them keeps the row only if `prune_nulls` is off."""
    if not columns:
        raise ValueError("a filter needs input columns")
    any_null = reduce(lambda a, b: a | b, [col(c).isNull() for c in columns])
    if prune_nulls:
        # written as a plain conjunction, so that it reaches the scan
        return df.where(reduce(lambda a, b: a & b, [col(c).isNotNull() for c in columns]) & keep)
    return df.where(any_null | keep)


def _spelled(v: Any) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v)


def matches(c: Column, values: Sequence[Any], containing: bool = False, case_sensitive: bool = False, strip_text: bool = True) -> Column:
    """Whether the text of a value equals one of `values`, or with `containing` holds one; both sides stripped and in small letters unless said otherwise."""
    text = c.cast("string")
    wanted = [_spelled(v) for v in values]
    if strip_text:
        text, wanted = strip(text), [v.strip() for v in wanted]
    if not case_sensitive:
        text, wanted = F.lower(text), [v.lower() for v in wanted]
    if not wanted:
        return F.lit(False)
    if containing:
        return reduce(lambda a, b: a | b, [F.contains(text, F.lit(v)) for v in wanted])
    return text.isin(wanted)


def in_range(c: Column, low: float | None = None, high: float | None = None, floating: bool = True) -> Column:
    """Whether low < value < high, both ends left out, either open. NaN lies in a range: no comparison puts it outside.

    Spark orders NaN above all numbers, so only the upper end needs a test for it, and only `floating` values; the rest is
    plain comparisons that reach the scan.
    """
    inside = F.lit(True)
    if low is not None:
        inside = inside & (c > low)
    if high is not None:
        inside = inside & ((c < high) | F.isnan(c) if floating else c < high)
    return inside


def _several(results: Sequence[Column], behavior: str) -> Column:
    if behavior not in ("any", "all"):
        raise ValueError("several inputs are combined by any or all")
    return reduce((lambda a, b: a & b) if behavior == "all" else (lambda a, b: a | b), results)


def prune_matching(df: DataFrame, columns: Sequence[str], values: Sequence[Any], negate: bool = False, behavior: str = "any", prune_nulls: bool = True, **options: Any) -> DataFrame:
    """Keep rows whose columns match (or with `negate` don't match) the values, in any or in all of the columns."""
    results = [matches(col(c), values, **options) for c in columns]
    return prune(df, columns, _several([~r for r in results] if negate else results, behavior), prune_nulls)


def prune_range(df: DataFrame, columns: Sequence[str], low: float | None = None, high: float | None = None, negate: bool = False, behavior: str = "any", prune_nulls: bool = True) -> DataFrame:
    """Keep rows with values strictly inside a range, or with `negate` outside it or at its ends."""
    floating = [isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) for c in columns]
    results = [in_range(col(c), low, high, f) for c, f in zip(columns, floating, strict=True)]
    return prune(df, columns, _several([~r for r in results] if negate else results, behavior), prune_nulls)


def prune_duration(df: DataFrame, column: str = "duration_s", low: float = 0.1, high: float = 25.0, prune_nulls: bool = True) -> DataFrame:
    """Keep rows with low <= duration <= high, ends included."""
    return prune(df, [column], col(column).between(low, high), prune_nulls)


def prune_licenses(df: DataFrame, column: str = "license", allowed: Sequence[str] = ("CC0", "PD")) -> DataFrame:
    """Keep rows of the allowed licenses, as written."""
    return prune_matching(df, [column], allowed, case_sensitive=True)


def prune_mismatch(df: DataFrame, column: str = "ctc_mismatch", below: float = 0.5) -> DataFrame:
    """Keep rows whose mismatch is below a threshold (0.5 for recognition, 0.2 for synthesis)."""
    return prune_range(df, [column], high=below)


def prune_generation_excluded(df: DataFrame, column: str = "generation_excluded") -> DataFrame:
    """Keep rows that aren't excluded from generation; unknown ones are dropped."""
    return prune_matching(df, [column], [False])


def prune_aspect_ratio(df: DataFrame, sizes: Sequence[tuple[str, str]] = (("width", "height"),), ratio: float = 4.0, prune_nulls: bool = True) -> DataFrame:
    """Keep rows all of whose images have max(w, h) <= ratio * max(1, min(w, h))."""
    keep = reduce(lambda a, b: a & b, [F.greatest(col(w), col(h)) <= ratio * F.greatest(F.lit(1), F.least(col(w), col(h))) for w, h in sizes])
    return prune(df, [c for s in sizes for c in s], keep, prune_nulls)


def prune_listed(df: DataFrame, columns: Sequence[str], allowed: DataFrame, prune_nulls: bool = True) -> DataFrame:
    """Keep rows all of whose URLs are in the allow table (its first column). Rows with nulls stay only with `prune_nulls=False`, and if their other URLs are allowed."""
    name = allowed.columns[0]
    listed = allowed.select(F.col(name).alias("__url")).where("__url is not null").distinct()
    for i, c in enumerate(columns):
        mark = listed.withColumn(f"__ok{i}", F.lit(True))
        df = df.join(mark, col(c) == mark["__url"], "left").drop("__url")
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"__ok{i}"), col(c).isNull()) for i, c in enumerate(columns)])
    return prune(df, columns, ok, prune_nulls=True).drop(*[f"__ok{i}" for i in range(len(columns))]) if prune_nulls else df.where(ok).drop(*[f"__ok{i}" for i in range(len(columns))])


def prune_opted_out(df: DataFrame, headers: str, directives: Sequence[str] = ("noai", "noimageai", "noindex")) -> DataFrame:
    """Drop downloads whose response headers (a map) opt out: an `x-robots-tag` with one of the directives, or `tdm-reservation: 1`. Rows without headers stay."""
    lower = F.transform_keys(col(headers), lambda k, v: F.lower(k))
    tags = F.transform(F.split(F.lower(F.coalesce(F.element_at(lower, "x-robots-tag"), F.lit(""))), "[,;]"), lambda t: F.trim(t))
    out = F.arrays_overlap(tags, F.array(*[F.lit(d) for d in directives])) | (F.trim(F.coalesce(F.element_at(lower, "tdm-reservation"), F.lit(""))) == "1")
    return df.where(col(headers).isNull() | ~out)


def sample_fraction(df: DataFrame, column: str, fraction: float) -> DataFrame:
    """A deterministic sample by the md5 of an id; a larger fraction keeps all rows of a smaller one. Null ids are left out."""
    head = F.conv(F.substring(F.md5(col(column).cast("string")), 1, 16), 16, 10).cast("decimal(20,0)").cast("double")
    return df.where(head / F.lit(2.0**64) < fraction)


def starts_with_bytes(c: Column, prefix: bytes) -> Column:
    """Whether binary content starts with a prefix, such as %PDF."""
    return F.substring(c, 1, len(prefix)) == F.lit(prefix)


def is_jpeg(c: Column) -> Column:
    """Whether binary content starts and ends as a JPEG file does."""
    return F.coalesce(starts_with_bytes(c, b"\xff\xd8\xff") & (F.substring(c, -2, 2) == F.lit(b"\xff\xd9")), F.lit(False))


def contains_bytes(c: Column, part: bytes) -> Column:
    """Whether binary content holds a part."""
    return F.contains(c, F.lit(part))


def audio_measures(rate: int):
    """A UDF (Arrow batches) from a waveform (array of float in -1..1) to (rms_dbfs, active_ratio, snr_db, clip_fraction).

    Frames of 25 ms every 10 ms; active are those within 35 dB of the loudest; the ratio of signal to noise is the median of
    the active frames above the tenth percentile of all. Shorter waveforms and null ones have null measures.
    """
    frame, hop = int(0.025 * rate), int(0.010 * rate)

    def level(power: np.ndarray) -> np.ndarray:
        return 10 * np.log10(np.maximum(power, 1e-10))

    @F.pandas_udf("rms_dbfs double, active_ratio double, snr_db double, clip_fraction double")
    def measure(waves: pd.Series) -> pd.DataFrame:
        rows = []
        for w in waves:
            if w is None or len(w) < frame:
                rows.append((None,) * 4)
                continue
            x = np.asarray(w, dtype=np.float64)
            db = level((np.lib.stride_tricks.sliding_window_view(x, frame)[::hop] ** 2).mean(axis=1))
            active = db > db.max() - 35
            rows.append((float(level(np.array((x**2).mean()))), float(active.mean()), float(np.quantile(db[active], 0.5) - np.quantile(db, 0.1)), float((np.abs(x) >= 0.999).mean())))
        return pd.DataFrame(rows, columns=["rms_dbfs", "active_ratio", "snr_db", "clip_fraction"]).astype("float64")

    return measure


def prune_audio_quality(df: DataFrame, wave: str, rate: int, min_rms_dbfs: float = -40.0, min_active: float = 0.3, min_snr: float = 15.0, max_clipping: float = 0.01) -> DataFrame:
    """Keep rows whose waveform meets all four thresholds; waveforms shorter than a frame stay, null ones go."""
    frame = int(0.025 * rate)
    rated = df.where(col(wave).isNotNull()).withColumn("__m", audio_measures(rate)(col(wave)))
    good = (F.col("__m.rms_dbfs") >= min_rms_dbfs) & (F.col("__m.active_ratio") >= min_active) & (F.col("__m.snr_db") >= min_snr) & (F.col("__m.clip_fraction") <= max_clipping)
    return rated.where((F.size(col(wave)) < frame) | good).drop("__m")


@F.pandas_udf(T.IntegerType())
def blake_bucket(ids: pd.Series) -> pd.Series:
    """Bucket 0..99 of an id by blake2b of its text (Arrow batches; Spark has no blake2b). All null ids share the bucket of the text `None`."""
    return pd.Series([int.from_bytes(hashlib.blake2b(str(None if pd.isna(i) else i).encode(), digest_size=8).digest(), "big") % 100 for i in ids], dtype="int32")
