"""Token rows of text and media: subword ids, and media slots stretched to their positions."""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MODELS: dict[int, object] = {}


def subword_ids(spark: SparkSession, text: Column, model: str) -> Column:
    """Ids of a sentencepiece model without special tokens (Arrow batches); null for null, empty for empty text. The model file is read on the driver and broadcast."""
    if os.path.getsize(model) > 32 << 20:
        raise ValueError(f"{model} is too large to be shipped to every worker")
    with open(model, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        key = hash(shared.value)
        if key not in _MODELS:
            _MODELS[key] = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for texts in batches:
            yield pd.Series([None if t is None else np.asarray(_MODELS[key].encode(t), dtype=np.int32) for t in texts], dtype=object)

    return encode(text)


@dataclass(frozen=True)
class Marks:
    """Ids of the marks around a medium and of the row's end, and the numbers of the modalities."""

    begin: int
    slot: int
    end: int
    row_end: int
    text_modality: int = 0
    media_modality: int = 1
    end_modality: int = 1


def training_rows(df: DataFrame, text_ids: str, positions: str, synthesis: str, marks: Marks) -> DataFrame:
    """Adds input_ids, modality_ids and loss_mask.

    A medium of `positions` slots (null: none) follows the text when it is to be made (`synthesis`), else goes before it.
    Loss counts for what is to be made: the media with its marks after the text, or the text; and for the row's end. A null
    text counts as empty; everything is built from arrays on the JVM.
    """
    text = F.coalesce(F.col(text_ids).cast("array<int>"), F.array().cast("array<int>"))
    media = F.col(positions).isNotNull()
    made = F.coalesce(F.col(synthesis), F.lit(True))
    n, size = F.coalesce(F.col(positions), F.lit(0)).cast("int"), F.size(text)
    whole = lambda value, count: F.array_repeat(F.lit(value), count)

    def row(of_text: Column, of_media: Column, last: Column, kind: str) -> Column:
        none = F.array().cast(f"array<{kind}>")
        before = F.when(media & ~made, of_media).otherwise(none)
        after = F.when(media & made, of_media).otherwise(none)
        return F.concat(before, of_text, after, F.array(last))

    ids = row(text, F.concat(F.array(F.lit(marks.begin)), whole(marks.slot, n), F.array(F.lit(marks.end))), F.lit(marks.row_end), "int")
    kinds = row(whole(marks.text_modality, size), F.concat(F.array(F.lit(marks.text_modality)), whole(marks.media_modality, n), F.array(F.lit(marks.end_modality))), F.lit(marks.text_modality), "int")
    closing = made & F.lit(marks.end_modality == marks.media_modality)
    of_text = F.array_repeat(~(media & made), size)
    of_media = F.concat(F.array(made), F.array_repeat(made, n), F.array(closing))
    return df.withColumns({"input_ids": ids, "modality_ids": kinds, "loss_mask": row(of_text, of_media, F.lit(True), "boolean")})


@dataclass(frozen=True)
class Medium:
    """A placeholder id in a text, what stands for it (begin, slot, end) and its modality's number."""

    placeholder: int
    begin: int
    slot: int
    end: int
    modality: int


def expand_placeholders(df: DataFrame, ids: str, media: Mapping[str, Medium], row_end: int, made: Sequence[str] = (), text_modality: int = 0) -> DataFrame:
    """Adds input_ids, modality_ids, loss_mask and n_positions: every placeholder in the ids becomes begin, its slots and end.

    `media` maps a column with the slots of each of a kind's placeholders (array of int, in their order) to the kind; any number of
    kinds and placeholders may stand anywhere in the text. Loss counts for the media of the kinds in `made`, or if there are none
    for the text, and for the row's end. A placeholder without an entry in its column fails the query; entries that no
    placeholder uses are an error too. Null ids count as empty. All arrays are built on the JVM.
    """
    text = F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>"))
    of_text = not made
    parts = lambda id_, kind, loss: F.struct(id_.alias("id"), F.lit(kind).alias("kind"), F.lit(loss).alias("loss"))

    def nth(i: Column, placeholder: int) -> Column:
        """How many placeholders of the kind stand before place i."""
        return F.size(F.filter(F.slice(text, F.lit(1), i), lambda x: x == placeholder))

    def expand(x: Column, i: Column) -> Column:
        out = F.array(parts(x, text_modality, of_text))
        for column, m in media.items():
            slots = F.get(F.col(column), nth(i, m.placeholder))
            slots = F.when(slots.isNull(), F.raise_error(F.lit(f"a placeholder without an entry in {column}")).cast("int")).otherwise(slots)
            loss = column in made
            whole = F.concat(F.array(parts(F.lit(m.begin), text_modality, loss)), F.array_repeat(parts(F.lit(m.slot), m.modality, loss), slots), F.array(parts(F.lit(m.end), m.modality, loss)))
            out = F.when(x == m.placeholder, whole).otherwise(out)
        return out

    spread = F.concat(F.flatten(F.transform(text, expand)), F.array(parts(F.lit(row_end), text_modality, True)))
    checked = spread
    for column, m in media.items():
        left_over = F.coalesce(F.size(F.col(column)), F.lit(0)) > nth(F.size(text), m.placeholder)
        checked = F.when(left_over, F.raise_error(F.lit(f"entries of {column} without a placeholder")).cast(_PARTS)).otherwise(checked)
    out = df.withColumn("__x", checked)
    return out.withColumns({"input_ids": F.col("__x.id"), "modality_ids": F.col("__x.kind"), "loss_mask": F.col("__x.loss"), "n_positions": F.size("__x")}).drop("__x")


_PARTS = "array<struct<id:int,kind:int,loss:boolean>>"
