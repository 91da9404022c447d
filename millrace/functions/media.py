"""Hooks for media kernels, with deterministic stand-ins that need no codec: sizes from headers, duration from WAV files.

A model kernel (scores, unit ids, latents, recognition) is any function of a batch; `kernel` wraps it as an Arrow UDF that
loads its state once per worker process.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STATES: dict[str, Any] = {}


def kernel(name: str, load: Callable[[], Any], run: Callable[[Any, pd.Series], pd.Series], returns: str) -> Callable[[Column], Column]:
    """A UDF around a model: `load` makes its state once per worker process, `run` maps a batch."""

    @F.pandas_udf(returns)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if name not in _STATES:
            _STATES[name] = load()
        for batch in batches:
            yield run(_STATES[name], batch)

    return apply


def device_batches(df: DataFrame, run: Callable[[str | None, pd.DataFrame], pd.DataFrame], schema: str, devices: float = 0.0, resource: str = "gpu") -> DataFrame:
    """Batches through a function of (device, batch). With `devices` each task asks for that share of a device by a resource profile, and gets the address that Spark gave it; without, tasks run anywhere with no device."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = TaskContext.get().resources().get(resource) if devices else None
        for frame in frames:
            yield run(held.addresses[0] if held else None, frame)

    if not devices:
        return df.mapInPandas(batches, schema)
    profile = ResourceProfileBuilder().require(TaskResourceRequests().cpus(1).resource(resource, devices)).build
    return df.mapInPandas(batches, schema, profile=profile)


def _wav_seconds(data: bytes | None) -> float | None:
    if not data:
        return None
    try:
        with wave.open(io.BytesIO(data)) as w:
            return round(w.getnframes() / w.getframerate(), 3)
    except (wave.Error, EOFError, ZeroDivisionError):
        return None


@F.pandas_udf(T.DoubleType())
def wav_seconds(data: pd.Series) -> pd.Series:
    """Seconds of WAV content, to the millisecond; null if it can't be read (Arrow batches)."""
    return pd.Series([_wav_seconds(d) for d in data], dtype="float64")


def pdf_texts(convert: Callable[[bytes], str]) -> Callable[[Column], Column]:
    """A UDF from PDF bytes to their text by a converter (such as a call of an installed tool); null for null bytes and where the converter fails."""

    @F.pandas_udf(T.StringType())
    def apply(data: pd.Series) -> pd.Series:
        def one(d: bytes | None) -> str | None:
            try:
                return None if d is None else convert(d)
            except Exception:  # a broken file is a row without text, not the end of the job
                return None

        return data.map(one, na_action="ignore")

    return apply


def pulse_sharpness(residual: Column) -> Column:
    """Kurtosis of a prediction residual (array): sharp pulses give high values. Null for fewer than two values or none that differ."""
    n = F.size(residual)
    mean = F.aggregate(residual, F.lit(0.0), lambda a, x: a + x) / n
    moment = lambda k: F.aggregate(residual, F.lit(0.0), lambda a, x: a + F.pow(x - mean, F.lit(float(k)))) / n
    return F.when(n > 1, moment(4) / F.nullif(F.pow(moment(2), F.lit(2.0)), F.lit(0.0)))


def cepstral_peak(frames: pd.Series, rate: int, low_hz: float, high_hz: float) -> pd.Series:
    """Height of the highest cepstral value between two pitches over the cepstrum's trend, for each frame; null for frames shorter than a period of the lower pitch. A batch function for `kernel`."""

    def one(frame) -> float | None:
        x = np.asarray(frame, dtype=float)
        lo, hi = int(rate / high_hz), int(rate / low_hz)
        if len(x) <= hi or lo < 1:
            return None
        spectrum = np.log(np.abs(np.fft.rfft(x * np.hanning(len(x)))) ** 2 + 1e-12)
        cepstrum = np.abs(np.fft.irfft(spectrum))[: hi + 1]
        at = np.arange(lo, hi + 1)
        slope, base = np.polyfit(at, cepstrum[lo : hi + 1], 1)
        peak = lo + int(cepstrum[lo : hi + 1].argmax())
        return float(cepstrum[peak] - (slope * peak + base))

    return frames.map(one, na_action="ignore")


def padded(pixels: pd.Series, height: int, width: int, fill: int = 0) -> pd.Series:
    """Images (nested lists of rows) cut or padded at the right and the bottom to one size. A batch function for `kernel`."""

    def one(image) -> list:
        rows = [[*row[:width], *[fill] * (width - len(row))] for row in (list(r) for r in image)][:height]
        return rows + [[fill] * width for _ in range(height - len(rows))]

    return pixels.map(one, na_action="ignore")


def image_size(data: bytes | None) -> tuple[int | None, int | None]:
    """(width, height) from the header of a PNG, GIF or JPEG file."""
    if not data:
        return None, None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:4] == b"GIF8" and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return width, height
            at += 2 + size
    return None, None


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def image_sizes(data: pd.Series) -> pd.DataFrame:
    """`image_size` (Arrow batches)."""
    return pd.DataFrame([image_size(d) for d in data], columns=["width", "height"]).astype("Int32")


def fitted(width: Column, height: Column, largest: int) -> tuple[Column, Column]:
    """Sizes scaled down so that neither exceeds a limit, at least 1; within it they stay."""
    scale = F.least(F.lit(1.0), F.lit(float(largest)) / F.greatest(width, height))
    return F.greatest(F.lit(1), F.round(width * scale)).cast("int"), F.greatest(F.lit(1), F.round(height * scale)).cast("int")


def mel_to_db(c: Column) -> Column:
    """Log mel values (base 10) in decibels."""
    return F.transform(c, lambda x: x * 10)
