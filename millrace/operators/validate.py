"""Data checks: named queries whose rows are violations, and rates with bounds."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import word_count

#: Share of segments that may be too short, too slow or too fast.
BOUNDS = {"tiny": 0.01, "slow": 0.005, "fast": 0.002}


def violations(df: DataFrame, rules: Mapping[str, Column], keys: list[str]) -> DataFrame:
    """(check, keys): one row for each row and rule that holds, in one pass over the table; null rules don't hold."""
    hits = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(hits).alias("check"))


# Patterns of text that must not stay in a segment, and the tolerances of its times in seconds.
ALPHANUMERIC = "[A-Za-z0-9]"
STAGE_LEAK = r"(?i)\((?:laughter|pause|nods|indicating|inaudible|crosstalk)"
LABEL_LEAK = r"\b(?:CHIEF JUSTICE|JUSTICE|GENERAL|MRS?\.|MS\.) [A-Z]{3,}[A-Z'\-]*:"
TIME_TOLERANCE, CAP_TOLERANCE = 0.002, 0.001


def segment_rules(cap: float = 25.0) -> dict[str, Column]:
    """Row checks of segments: nulls, times, cap, text without letters, stage directions and labels left in the text."""
    c = F.col
    return {
        "nulls": c("audio.bytes").isNull() | c("text_original").isNull() | c("speaker_id").isNull() | c("avg_word_score").isNull(),
        "bad_times": (c("end_s") <= c("start_s")) | (c("duration_s") <= 0) | (F.abs(c("duration_s") - (c("end_s") - c("start_s"))) > TIME_TOLERANCE),
        "over_cap": c("duration_s") > cap + CAP_TOLERANCE,
        "no_alphanumeric": ~c("text_original").rlike(ALPHANUMERIC),
        "stage_leak": c("text_original").rlike(STAGE_LEAK),
        "label_leak": c("text_original").rlike(LABEL_LEAK),
    }


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of the keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def rates(df: DataFrame, text: str = "text_original", duration: str = "duration_s") -> DataFrame:
    """Shares of segments that are tiny (< 0.3 s), slow (over 3 s, under 1 word a second) or fast (over 1 s, above 8 words a second); one row, zeros for an empty table."""
    d = F.col(duration)
    spoken = F.size(F.regexp_extract_all(F.col(text), F.lit("([A-Za-z0-9']+)"), 1))
    n = F.count("*")
    share = lambda c: F.coalesce(F.try_divide(F.count_if(c), n), F.lit(0.0))
    return df.agg(n.alias("n"), share(d < 0.3).alias("tiny"), share((d > 3) & (word_count(F.col(text)) / d < 1.0)).alias("slow"), share((d > 1) & (spoken / d > 8.0)).alias("fast"))


def broken_bounds(rates_row: DataFrame, bounds: Mapping[str, float] = BOUNDS) -> DataFrame:
    """(rate, value, bound) of the rates that aren't below their bound."""
    parts = [rates_row.select(F.lit(k).alias("rate"), F.col(k).alias("value"), F.lit(b).alias("bound")) for k, b in bounds.items()]
    return reduce(lambda a, b: a.union(b), parts).where("value >= bound")


def report(frames: Mapping[str, DataFrame]) -> DataFrame:
    """(check, n_rows) of named violation queries; all should be 0."""
    return reduce(lambda a, b: a.union(b), [f.agg(F.lit(name).alias("check"), F.count("*").alias("n_rows")) for name, f in frames.items()])


def require_none(frames: Mapping[str, DataFrame]) -> None:
    """Fail if any named query has a row."""
    bad = [name for name, f in frames.items() if f.limit(1).count()]
    if bad:
        raise ValueError(f"checks with violations: {bad}")
