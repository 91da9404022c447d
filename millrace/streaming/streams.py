"""Incremental forms of first-occurrence deduplication and pause sessions, and windowed counts over late data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The first row of each key among those that come within `delay` of it; state is dropped behind the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, delay: str, length: str, *groups: str | Column, slide: str | None = None) -> DataFrame:
    """Counts by time window and groups; a window closes when the watermark passes it, later rows are left out."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return stream.withWatermark(time, delay).groupBy(window, *groups).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *groups, "n")


def sessions(stream: DataFrame, time: str, delay: str, gap: str, *groups: str) -> DataFrame:
    """Sessions by group that end after a gap without rows."""
    window = F.session_window(time, gap)
    return stream.withWatermark(time, delay).groupBy(window, *groups).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *groups, "n")
