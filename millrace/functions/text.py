"""Text expressions. All are JVM-side columns unless their docstring says otherwise."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space at an end, as Unicode has it, with the four separators of ASCII.
WHITE = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Text without white space around it (any Unicode white space, not only blanks)."""
    return F.regexp_replace(c, rf"(?U)^{WHITE}+|{WHITE}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none around."""
    return strip(F.regexp_replace(c, rf"(?U){WHITE}+", " "))


def blank_to_null(c: Column) -> Column:
    """Null for text that is empty or white space."""
    return F.when(strip(c) != "", c)


def words(c: Column) -> Column:
    """The words between white space; blank text has none."""
    return F.filter(F.split(collapse(c), " "), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


@F.pandas_udf(T.StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """HTML entities as characters (Arrow batches; Spark has no function for it)."""
    return texts.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def fold(texts: pd.Series) -> pd.Series:
    """NFC and case folding (Arrow batches)."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t).casefold(), na_action="ignore")


@F.pandas_udf(T.StringType())
def plain_letters(texts: pd.Series) -> pd.Series:
    """Compatibility forms without combining marks (Arrow batches)."""
    return texts.map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)), na_action="ignore")


def without_tags(c: Column) -> Column:
    """Markup between < and > taken out."""
    return F.regexp_replace(c, "<[^>]+>", "")


def clean_text(c: Column) -> Column:
    """Entities as characters, tags out, white space collapsed; null if nothing is left."""
    return F.nullif(collapse(without_tags(unescape(c))), F.lit(""))


@F.pandas_udf(T.ArrayType(T.StringType()))
def clean_texts(arrays: pd.Series) -> pd.Series:
    """`clean_text` over arrays (Arrow batches): entries in order, those that come out empty left out; a null array is empty."""

    def clean(t):
        return " ".join(re.sub("<[^>]+>", "", html.unescape(t)).split())

    return pd.Series([[c for c in (clean(t) for t in (a if a is not None else []) if t is not None) if c] for a in arrays], dtype=object)


def matches_terms(texts: Sequence[Column], terms: Sequence[str]) -> Column:
    """Whether any of the texts holds any term as whole words, case folded; null texts are skipped, no terms match nothing.

    A term may begin or end with a symbol; words end where no letter, digit or underscore follows.
    """
    folded = sorted({unicodedata.normalize("NFC", t).casefold() for t in terms if t}, key=lambda t: (-len(t), t))
    if not folded:
        return F.lit(False)
    quoted = "|".join(r"\Q" + t.replace(r"\E", r"\E\\E\Q") + r"\E" for t in folded)
    pattern = rf"(?U)(?<!\w)(?:{quoted})(?!\w)"
    return reduce(lambda a, b: a | b, [F.coalesce(fold(t).rlike(pattern), F.lit(False)) for t in texts])


def slug(c: Column, length: int = 60) -> Column:
    """Small letters and digits joined by `_`, cut to `length`, with a piece of the text's md5 so that cut slugs differ."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat_ws("_", F.substring(flat, 1, length), F.substring(F.md5(c), 1, 8))


# Words whose full stop ends no sentence.
NO_END = "MR MRS MS DR ST LT JR GEN V VS".split()


def ends_sentence(token: Column) -> Column:
    """Whether a token ends a sentence: . ? or ! before closing quotes and brackets, but not an abbreviation's or an initial's full stop."""
    core = F.regexp_replace(token, "[\"')]+$", "")
    base = F.upper(F.regexp_replace(F.regexp_replace(core, "^[(\"']+", ""), r"\.+$", ""))
    stop = core.endswith(".")
    kept = base.isin(NO_END) | base.rlike(r"(?U)^\p{Alpha}$")
    return F.coalesce(core.rlike("[.?!]$") & ~(stop & kept), F.lit(False))


def roman_value(c: Column) -> Column:
    """Value of a roman numeral over I, V and X; null for other text. A smaller sign before a larger one is taken off."""
    signs = F.filter(F.split(F.upper(c), ""), lambda s: s != "")
    one = lambda s: F.when(s == "I", 1).when(s == "V", 5).when(s == "X", 10)
    value = F.aggregate(
        F.reverse(signs),
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("last")),
        lambda acc, s: F.struct((acc["total"] + F.when(one(s) < acc["last"], -one(s)).otherwise(one(s))).alias("total"), one(s).alias("last")),
        lambda acc: acc["total"],
    )
    return F.when(F.upper(c).rlike("^[IVX]+$"), value)


def runs_collapsed(values: Column, blank: Column) -> Column:
    """An array with equal neighbours as one, then without `blank`."""
    ends = F.filter(values, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(values, i - 1)))
    return F.array_remove(ends, blank)


def edits(a: list, b: list) -> int:
    """Levenshtein distance of two sequences, bit-parallel: a column of the table is one pair of integers with a bit per entry of `a`."""
    if not a or not b:
        return len(a) or len(b)
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for y in b:
        same = at.get(y, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        grows, shrinks = down | ~(diagonal | up), up & diagonal
        score += bool(grows & top) - bool(shrinks & top)
        grows, shrinks = grows << 1 | 1, shrinks << 1
        up = (shrinks | ~(diagonal | grows)) & full
        down = grows & diagonal & full
    return score


@F.pandas_udf(T.IntegerType())
def word_edits(hypothesis: pd.Series, reference: pd.Series) -> pd.Series:
    """Levenshtein distance of words (Arrow batches); a null text counts as none."""
    return pd.Series([edits((h or "").split(), (r or "").split()) for h, r in zip(hypothesis, reference, strict=True)], dtype="int32")


def char_edits(hypothesis: Column, reference: Column) -> Column:
    """Levenshtein distance of characters; a null text counts as empty."""
    return F.levenshtein(F.coalesce(hypothesis, F.lit("")), F.coalesce(reference, F.lit("")))


SENTENCE = re.compile(r"[.!?][\"”’)]?\s+(?=[\"“(]?[A-Z0-9])")
