"""Dates: months, stamps of harvests, and pauses that a server asks for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_window(day: Column) -> tuple[Column, Column]:
    """First and last day of a date's month."""
    d = day.cast("date")
    return F.trunc(d, "month"), F.last_day(d)


def windows_of_months(first: Column, last: Column) -> Column:
    """(start, end) of each month from a date's to another's, ends included, cut to the two dates; empty if they are exchanged, null if one is null."""
    a, b = first.cast("date"), last.cast("date")
    months = F.sequence(F.trunc(a, "month"), F.trunc(b, "month"), F.expr("interval 1 month"))
    cut = F.transform(months, lambda m: F.struct(F.greatest(m, a).alias("start"), F.least(F.last_day(m), b).alias("end")))
    return F.when(a <= b, cut).when(a.isNotNull() & b.isNotNull(), F.array().cast("array<struct<start:date,end:date>>"))


def stamp(at: Column) -> Column:
    """A time as harvests write it (UTC)."""
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")


def retry_after(header: Column, now: Column) -> Column:
    """Seconds to wait by a Retry-After header, which holds seconds or a date; at least 0, null for anything else."""
    text = F.trim(header)
    date = F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.when(text.rlike("^[0-9]{1,9}$"), text.try_cast("long")).when(text.rlike("^[A-Za-z]{3}, .* GMT$"), F.unix_timestamp(date) - F.unix_timestamp(now))
    return F.greatest(wait, F.when(wait.isNotNull(), F.lit(0)))
