"""Paged sources as a Python data source: one partition per unit, pages by cursor, retries with growing pauses."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Request = Callable[[str, "str | None"], "tuple[Sequence[Any], str | None]"]


def pages(request: Request, unit: str, max_pages: int | None = None, retries: int = 3, pause: float = 0.0, backoff: float = 0.5) -> Iterator[Any]:
    """The records of a unit: pages until the cursor is null or `max_pages` were read. A failing page is tried again after growing pauses; the last error is raised without its message, which may hold secrets."""
    cursor: str | None = None
    read = 0
    while True:
        for attempt in range(retries + 1):
            try:
                records, following = request(unit, cursor)
                break
            except Exception as e:
                if attempt == retries:
                    raise RuntimeError(f"unit {unit!r}: page {read} failed {retries + 1} times ({type(e).__name__})") from None
                time.sleep(backoff * (attempt + 1))
        yield from records
        read += 1
        if following is None or (max_pages is not None and read >= max_pages):
            return
        cursor = following
        if pause:
            time.sleep(pause)


class Unit(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Reader(DataSourceReader):
    def __init__(self, units: Sequence[str], request: Request, max_pages: int | None, retries: int, backoff: float):
        self.units, self.request, self.max_pages, self.retries, self.backoff = units, request, max_pages, retries, backoff

    def partitions(self) -> list[Unit]:
        return [Unit(u) for u in self.units] or [Unit("")]

    def read(self, partition: Unit) -> Iterator[tuple[str, str]]:
        if partition.name == "":
            return
        for record in pages(self.request, partition.name, self.max_pages, self.retries, backoff=self.backoff):
            yield partition.name, json.dumps(record, ensure_ascii=False)


def read_paged(spark: SparkSession, name: str, units: Sequence[str], request: Request, max_pages: int | None = None, retries: int = 3, backoff: float = 0.5):
    """(unit, value): every record of the units as JSON text, units read in parallel. `request` must be picklable; rate limits are its own matter."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "unit string, value string"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(list(units), request, max_pages, retries, backoff)

    spark.dataSource.register(Paged)
    return spark.read.format(name).load()


def bounded_units(unit: Any, size: Callable[[Any], int], split: Callable[[Any], Sequence[Any]], limit: int) -> list[Any]:
    """A unit split until every part is within the limit; empty parts are left out, parts that can't be split stay."""
    n = size(unit)
    if n == 0:
        return []
    parts = list(split(unit)) if n > limit else []
    return [u for p in parts for u in bounded_units(p, size, split, limit)] if parts else [unit]


def halves(start: int, end: int) -> list[tuple[int, int]]:
    """A window of seconds in two, ends included; a window of one second can't be split."""
    return [] if end - start < 1 else [(start, start + (end - start) // 2), (start + (end - start) // 2 + 1, end)]
