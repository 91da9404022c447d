"""Encoding of the whole corpus with a public byte-level BPE tokenizer, by dynamic programming over prefixes.

Of all tokens that end at a byte, exactly one is the last token of the encoding of the text up to there: the one that
stays separate from the last token before it. So the encoding of a piece is a table with one token per byte prefix, read
backwards. The table of a prefix never changes when bytes follow, which makes appends exact and cheap, and an edit costs
only the pieces near it. Pieces are the pre-tokens of the tokenizer's pattern; those seen before come from a cache.

The vocabulary file is read once on the driver and broadcast (under 1 MB; its size is checked), so executors need no file.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the pattern that splits text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Caches are emptied beyond these entries; that changes no result.
PIECES, PAIRS, LARGEST_FILE = 200_000, 1_000_000, 16 << 20
#: Longer pieces aren't kept in the cache.
KEPT_BYTES = 64


def merged(ranks: dict[bytes, int], raw: bytes) -> list[int]:
    """The encoding by its definition: merge the neighbours of least rank, leftmost first, until none merges. Quadratic; it decides pairs of tokens and serves tests."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while len(parts) > 1:
        least, at = min(((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
        if least == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Encoder:
    """Encodes texts with the vocabulary of a rank file: lines of base64 token and rank."""

    def __init__(self, file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file.splitlines() if line.strip())}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.pattern = regex.compile(PATTERN)
        self._apart: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}

    def whole(self, token: int) -> bool:
        """Whether the token's bytes are encoded as that token."""
        got = self._whole.get(token)
        if got is None:
            got = self._whole[token] = merged(self.ranks, self.tokens[token]) == [token]
        return got

    def apart(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are when one follows the other."""
        got = self._apart.get((left, right))
        if got is None:
            if len(self._apart) > PAIRS:
                self._apart.clear()
            got = self._apart[left, right] = merged(self.ranks, self.tokens[left] + self.tokens[right]) == [left, right]
        return got

    def extend(self, raw: bytes, last: list[int]) -> list[int]:
        """Continue the table `last`: `last[i]` is the last token of the encoding of the first i + 1 bytes of `raw`."""
        ranks = self.ranks
        for end in range(len(last) + 1, len(raw) + 1):
            for start in range(max(0, end - self.longest), end):
                token = ranks.get(raw[start:end])
                if token is not None and self.whole(token) and (start == 0 or self.apart(last[start - 1], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return last

    def read(self, last: list[int]) -> list[int]:
        """The encoding that a table holds."""
        out, at = [], len(last)
        while at:
            token = last[at - 1]
            out.append(token)
            at -= len(self.tokens[token])
        return out[::-1]

    def piece(self, text: str) -> tuple[int, ...]:
        """The ids of one pre-token."""
        got = self._pieces.get(text)
        if got is None:
            raw = text.encode()
            token = self.ranks.get(raw)
            got = (token,) if token is not None and self.whole(token) else tuple(self.read(self.extend(raw, [])))
            if len(raw) <= KEPT_BYTES:
                if len(self._pieces) > PIECES:
                    self._pieces.clear()
                self._pieces[text] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; null and empty texts have none. Spellings of special tokens are ordinary text."""
        out: list[int] = []
        if text:
            for p in self.pattern.findall(text):
                out += self.piece(p)
        return out

    def count(self, text: str | None) -> int:
        """The number of ids of a text."""
        return sum(len(self.piece(p)) for p in self.pattern.findall(text)) if text else 0


class Prefixes:
    """A text with the table of each of its pieces: appends are exact and continue the table, edits encode anew only near them."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, text
        self.pieces: list[str] = encoder.pattern.findall(text)
        self.tables: list[list[int]] = [encoder.extend(p.encode(), []) for p in self.pieces]

    @property
    def ids(self) -> list[int]:
        return [i for t in self.tables for i in self.encoder.read(t)]

    def append(self, more: str) -> Prefixes:
        """The text goes on. The pattern looks one character ahead, so only the last two pieces can change."""
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, instead: str) -> Prefixes:
        """Replace the characters start..end. Pieces are kept before the edit, and from where the new pieces meet old ones after it."""
        text = self.text[:start] + instead + self.text[end:]
        kept, at = 0, 0
        while kept < len(self.pieces) and at + len(self.pieces[kept]) < start:
            at += len(self.pieces[kept])
            kept += 1
        if kept:  # the piece before may have looked ahead
            kept -= 1
            at -= len(self.pieces[kept])
        shift = len(text) - len(self.text)
        ends, place = {}, 0
        for i, p in enumerate(self.pieces):
            ends[place] = i
            place += len(p)
        pieces, tables = self.pieces[:kept], self.tables[:kept]
        old = iter(zip(self.pieces[kept:], self.tables[kept:], strict=True))
        for m in self.encoder.pattern.finditer(text, at):
            again = ends.get(m.start() - shift) if m.start() >= start + len(instead) and m.start() - shift >= end else None
            if again is not None:
                pieces += self.pieces[again:]
                tables += self.tables[again:]
                break
            before, table = next(old, ("", []))
            new = m.group()
            pieces.append(new)
            # an old piece that the new one only continues keeps its table
            tables.append(self.encoder.extend(new.encode(), list(table)) if before and new.startswith(before) else self.encoder.extend(new.encode(), []))
        self.text, self.pieces, self.tables = text, pieces, tables
        return self


_ENCODERS: dict[int, Encoder] = {}


def _worker_encoder(shared) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    file = shared.value
    key = hash(file)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(file)
    return _ENCODERS[key]


def vocabulary(folder: str | None = None, name: str = VOCABULARY) -> bytes:
    """The rank file of a byte-level vocabulary."""
    path = os.path.join(folder or FOLDER, f"{name}.tiktoken")
    if os.path.getsize(path) > LARGEST_FILE:
        raise ValueError(f"{path} is too large to be shipped to every worker")
    with open(path, "rb") as f:
        return f.read()


def ids_column(spark: SparkSession, text: Column, folder: str | None = None, name: str = VOCABULARY) -> Column:
    """The ids of a text as array<int>; null and empty texts give an empty array."""
    shared = spark.sparkContext.broadcast(vocabulary(folder, name))

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _worker_encoder(shared)
        for texts in batches:
            yield pd.Series([np.asarray(encoder.encode(t), dtype=np.int32) for t in texts], dtype=object)

    return encode(text)


def count_column(spark: SparkSession, text: Column, folder: str | None = None, name: str = VOCABULARY) -> Column:
    """The number of ids of a text; 0 for null and empty texts."""
    shared = spark.sparkContext.broadcast(vocabulary(folder, name))

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _worker_encoder(shared)
        for texts in batches:
            yield pd.Series([encoder.count(t) for t in texts], dtype="int32")

    return count(text)


def encode_corpus(df: DataFrame, text: str = "text", out: str = "ids", folder: str | None = None, name: str = VOCABULARY) -> DataFrame:
    """`df` with the ids of `text`; an existing column `out` is replaced. Every row stays."""
    return df.withColumn(out, ids_column(df.sparkSession, F.col(text), folder, name))
