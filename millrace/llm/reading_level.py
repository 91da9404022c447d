"""Reading level of each document.

A linear ranker is learnt from pairs of graded documents, the harder against the easier, on features of syntax (length of
sentences, clauses, subordination) and vocabulary (length of words, grades of words learnt from the graded documents).
Isotonic regression turns its scores into levels; it is fitted on held-out scores, each from a ranker and word grades that
didn't see the document. Layout, capitals, speaker names, markup and stray symbols are taken off first, so they can't
change a level.

Whether a text is English is told by models of its letters (trigrams), one for each language that the documents name,
and one of letters without order for texts in none; the language of most graded documents is English. Documents
whose letters speak against the language they name don't teach it. A text must also be as likely as graded ones are.

Fitting takes at most `GRADED` graded documents (those of least hash), about `SPOKEN` documents with a language, and
`PAIR_SAMPLE` pairs. One scan of the documents gathers these, one rates all documents.
"""

from __future__ import annotations

import bisect
import html
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import bounded_rows, cut, drop

GRADED, SPOKEN, PAIR_SAMPLE = 20_000, 10_000, 200_000
#: Cells of the trigram tables; least share of the sample for a language to get one; nats a trigram below the least likely graded text.
TRIGRAM_BITS, LEAST_SHARE, SLACK = 15, 0.001, 0.5
TRIGRAMS = 1 << TRIGRAM_BITS
#: Trigrams of a text must be this many to be told by; fewer say nothing.
LEAST_TRIGRAMS = 8

SUBORDINATORS = set("although though because since unless whereas while when whenever after before if until that which who whom whose where consequently therefore however notwithstanding moreover nevertheless furthermore thereby whereby hence thus meant".split())

_DROPPED = re.compile(r"<\|[^<>|]*\|>|<[/!?]?[A-Za-z!-][^<>]*>|https?://\S+|www\.\S+|\[[^\[\]]*\]|[­​-‏ -‮⁠﻿]|[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_SPEAKER = re.compile(r"(?m)^[^\S\n]*(?:[A-Z][A-Z'’.\-]*\s+){0,4}[A-Z][A-Z'’.\-]+\s*:(?=\s)")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_ASCII_WORD = re.compile(r"[a-z]+(?:['\-][a-z]+)*")  # the same words of a small ASCII text, found faster
_MARKUP = re.compile(r"[<\[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|https?:|www\.")
_END = re.compile(r"[.!?。！？]+(?=[\s\"'”’»)\]]|$)")


def plain(text: str | None) -> str:
    """The text without markup, addresses, notes in square brackets, invisible characters and speaker names."""
    if not text:
        return ""
    out = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
    if "&" in out:
        out = html.unescape(out)
    if not out.isascii() or _MARKUP.search(out):
        out = re.sub(r"(?i)</(?:p|div|li|h\d|tr)\s*>|<br\s*/?>", "\n", out)
        out = _DROPPED.sub(" ", out)
    return _SPEAKER.sub(" ", out) if ":" in out else out


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence, in small letters. A line's end ends a sentence where the text has no other ends, or where no mark stands before it and a capital follows small letters."""
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) > 1:
        marks = len(_END.findall(text))
        cased = text != text.upper()
        joined = [lines[0].strip()]
        for line in lines[1:]:
            line, before = line.strip(), joined[-1][-1:]
            if marks * 10 <= len(lines) or (cased and before.isalnum() and line[:1].isupper()):
                joined[-1] += "."
            joined.append(line)
        text = " ".join(joined)
    low = text.lower()
    return [s for s in map((_ASCII_WORD if low.isascii() else _WORD).findall, _END.split(low)) if s]


def trigrams(words: list[str]) -> np.ndarray:
    """The table cell of each three successive letters of the words, with a space between words."""
    s = f" {' '.join(words)} "
    c = np.frombuffer(s.encode("ascii"), dtype=np.uint8).astype(np.uint32) if s.isascii() else np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32)
    return _cells(c[:-2], c[1:-1], c[2:]) if len(c) > 2 else np.zeros(0, dtype=np.int64)


def _cells(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    mixed = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) + c * np.uint32(0xC2B2AE3D)
    return (mixed >> np.uint32(32 - TRIGRAM_BITS)).astype(np.int64)


class Languages:
    """Log probabilities of trigrams by language (rows; the last is letters without order), the row of English, and the least mean it may have."""

    def __init__(self, tables: np.ndarray, english: int, floor: float):
        # a row per cell, so a trigram's probabilities lie together
        self.tables, self.english, self.floor = np.ascontiguousarray(tables.T, dtype=np.float32), english, floor

    def means(self, cells: np.ndarray) -> np.ndarray:
        """Mean log probability of the cells in each language."""
        return np.ones(len(cells), dtype=np.float32) @ self.tables.take(cells, axis=0) / len(cells)

    def is_english(self, words: list[str]) -> bool:
        """Whether English is the likeliest language of the words, and likely enough."""
        cells = trigrams(words)
        if len(cells) < LEAST_TRIGRAMS:
            return False
        means = self.means(cells)
        return int(means.argmax()) == self.english and float(means[self.english]) >= self.floor


FEATURES = 9


def syntax(text: str) -> tuple[list[float], list[str]]:
    """(features that need no grades, words). Texts without words have features 0."""
    clean = plain(text)
    own = sentences(clean)
    words = [w for s in own for w in s]
    n = len(words)
    if not n:
        return [0.0] * (FEATURES - 2), words
    lengths = list(map(len, own))
    sizes = sorted(map(len, words))
    return [
        # a long sentence weighs by its words, so that a few short ones can't hide it
        math.log(sum([x * x for x in lengths]) / n),
        math.log(n / len(own)),
        sum(sizes) / n,
        1 - bisect.bisect_left(sizes, 8) / n,
        1 - bisect.bisect_left(sizes, 12) / n,
        (clean.count(",") + clean.count(";")) / len(own),
        sum(map(SUBORDINATORS.__contains__, words)) / len(own),
    ], words


def vocabulary(words: list[str], grades: dict[str, float]) -> list[float]:
    """Mean and ninth decile of the words' grades; words without one are passed over, no words have 0."""
    if not words:
        return [0.0, 0.0]
    graded = sorted([g for g in map(grades.get, words) if g is not None] or [2.5])
    at = 0.9 * (len(graded) - 1)
    below = graded[int(at)]
    return [sum(graded) / len(graded), below + (graded[min(int(at) + 1, len(graded) - 1)] - below) * (at - int(at))]


def features(text: str, grades: dict[str, float]) -> tuple[list[float], list[str]]:
    """(features, words)."""
    base, words = syntax(text)
    return base + vocabulary(words, grades), words


def rank_pairs(x: np.ndarray, y: np.ndarray, seed: int = 5, pairs: int = PAIR_SAMPLE) -> np.ndarray:
    """Weights of the linear ranker: logistic regression on differences of pairs with different grades, by Newton's method, with a small ridge."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, len(y), pairs), rng.integers(0, len(y), pairs)
    differ = y[a] != y[b]
    a, b = a[differ], b[differ]
    d = (x[a] - x[b]) * np.sign(y[a] - y[b])[:, None]
    gap = np.abs(y[a] - y[b])
    w = np.zeros(x.shape[1])
    ridge = 1e-3 * len(d)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ ((1 - p) * gap) - ridge * w
        hess = (d * (p * (1 - p) * gap)[:, None]).T @ d + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score, level) of the non-decreasing steps that fit y best (pool adjacent violators); between steps levels are interpolated. Equal scores are one point."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, first score, last score
    for s, v in zip(score[order], y[order], strict=True):
        if blocks and blocks[-1][3] == s:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([float(v), 1.0, float(s), float(s)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            top = blocks.pop()
            blocks[-1][0] += top[0]
            blocks[-1][1] += top[1]
            blocks[-1][3] = top[3]
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    ys = np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])
    return xs, ys


class LevelModel:
    """Word grades, scaling, weights of the ranker, the isotonic steps, and the language models."""

    def __init__(self, grades: dict[str, float], mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, xs: np.ndarray, ys: np.ndarray, languages: Languages):
        self.grades, self.mean, self.scale, self.weights, self.xs, self.ys, self.languages = grades, mean, scale, weights, xs, ys, languages

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def level(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.xs, self.ys)


def _fold(key) -> int:
    return zlib.crc32(str(key).encode()) % 2


def gather(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, lang: str | None) -> DataFrame:
    """(k, g, s, base, words): key, grade, language, features and words of the graded documents and the sample with a language, from one scan, computed once. Null grades, keys and texts are left out; several grades of one document count by their mean."""
    graded = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.avg(label).alias("__grade"))
    graded = cut(graded.orderBy(F.xxhash64(key), key).limit(GRADED))
    named = F.lower(F.trim(F.col(lang).cast("string"))) if lang and lang in docs.columns else F.lit(None).cast("string")
    named = F.when(named != "", named)
    share = min(1.0, SPOKEN / max(1, docs.count()))
    drawn = F.pmod(F.xxhash64(F.lit(17), key), F.lit(1 << 20)) < int(share * (1 << 20))
    rows = docs.select(key, text, named.alias("__spoken")).where(F.col(text).isNotNull()).join(F.broadcast(graded), key, "left")
    rows = rows.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col("__grade").alias("g"), F.when(drawn, F.col("__spoken")).alias("s")).where("g is not null or s is not null")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [syntax(t) for t in batch["t"]]
            yield pd.DataFrame({"k": batch["k"], "g": batch["g"], "s": batch["s"], "base": [x for x, _ in own], "words": [w for _, w in own]})

    out = cut(rows.mapInPandas(read, "k string, g double, s string, base array<double>, words array<string>"))
    drop(graded)
    return out


def learn_languages(sample: DataFrame) -> Languages | None:
    """The models of the letters of each language, from the documents of `gather`: all first, then without those whose letters speak against their language. None without graded texts."""
    languages: Languages | None = None
    of = F.when(F.col("g").isNotNull(), F.lit("\u0000graded")).otherwise(F.col("s"))
    rows = sample.select(of.alias("lang"), "s", "g", "words")
    # the name most graded documents bear is English's; where they bear none, graded texts stand for themselves
    names = {r["s"]: r["n"] for r in sample.where("g is not null and s is not null").groupBy("s").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "s").limit(1).collect()}
    english = next(iter(names), None)
    total = sample.where("s is not null").count()
    listed = sorted(r["s"] for r in sample.where("s is not null").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= max(1.0, LEAST_SHARE * total)).collect())
    order = ["\u0000graded", *(x for x in listed if x != english)]
    row_of = {x: i for i, x in enumerate(order)}
    if english is not None:
        row_of[english] = 0

    def count(model: Languages | None):
        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.zeros((len(order), TRIGRAMS))
            letters: dict[int, float] = {}
            low = math.inf
            for batch in batches:
                for lang, words in zip(batch["lang"], batch["words"], strict=True):
                    at = row_of.get(lang)
                    cells = trigrams(list(words))
                    if at is None or len(cells) < LEAST_TRIGRAMS:
                        continue
                    if model is not None:
                        means = model.means(cells)
                        if int(means.argmax()) != at:
                            continue
                        if lang == order[0]:
                            low = min(low, float(means[0]))
                    sums[at] += np.bincount(cells, minlength=TRIGRAMS)
                    for c in np.frombuffer(" ".join(["", *words]).encode("utf-32-le"), dtype=np.uint32).tolist():
                        letters[c] = letters.get(c, 0.0) + 1.0
            at, cell = np.nonzero(sums)
            yield pd.DataFrame({"kind": np.concatenate([at, np.full(len(letters), -1), [-2]]).astype("int32"), "cell": np.concatenate([cell, list(letters), [0]]).astype("int64"), "n": np.concatenate([sums[at, cell], list(letters.values()), [low]]).astype("float64")})

        return step

    for _ in range(2):
        rows_n = rows.select("lang", "words").mapInPandas(count(languages), "kind int, cell long, n double")
        got = rows_n.groupBy("kind", "cell").agg(F.when(F.first("kind") == -2, F.min("n")).otherwise(F.sum("n")).alias("n")).toPandas()
        sums = np.zeros((len(order), TRIGRAMS))
        own = got[got["kind"] >= 0]
        sums[own["kind"].to_numpy(dtype=int), own["cell"].to_numpy(dtype=int)] = own["n"]
        if not sums[0].any():
            return None
        letters = got[got["kind"] == -1].sort_values("n", ascending=False)
        smooth = 0.5
        tables = np.log(sums + smooth) - np.log(sums.sum(axis=1, keepdims=True) + smooth * TRIGRAMS)
        unordered = _without_order(letters["cell"].to_numpy(dtype=np.uint64), letters["n"].to_numpy())
        low = got[got["kind"] == -2]["n"]
        floor = float(low.min()) - SLACK if languages is not None and len(low) else -math.inf
        languages = Languages(np.vstack([tables, unordered]), 0, floor if math.isfinite(floor) else -math.inf)
    return languages


def _without_order(letters: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log probabilities of the cells for letters drawn one by one. Cells are filled by drawing seeded triples, so the cost is fixed however many letters there are."""
    rng = np.random.default_rng(3)
    drawn = rng.choice(letters.astype(np.uint32), size=(3, 40 * TRIGRAMS), p=counts / counts.sum())
    sums = np.bincount(_cells(*drawn), minlength=TRIGRAMS) + 0.5
    return np.log(sums) - math.log(sums.sum())


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "reading_level", lang: str | None = "lang") -> LevelModel | None:
    """The model of the graded documents; those that aren't English are left out. None if fewer than two grades are left."""
    sample = gather(docs, labels, key, text, label, lang)
    languages = learn_languages(sample)
    if languages is None:
        drop(sample)
        return None
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(languages)

    @F.pandas_udf("boolean")
    def english(words: pd.Series) -> pd.Series:
        return words.map(lambda w: known.value.is_english(list(w)))

    @F.pandas_udf("int")
    def fold(keys: pd.Series) -> pd.Series:
        return keys.map(_fold)

    own = cut(sample.where("g is not null").where(english("words")).select("k", fold("k").alias("fold"), F.col("g").alias("grade"), "base", "words"))
    drop(sample)
    seen = own.select("grade", "fold", F.explode(F.array_distinct("words")).alias("word"))
    table = seen.groupBy("word").agg(F.count("*").alias("n"), F.sum("grade").alias("g"), F.count_if(F.col("fold") == 0).alias("n0"), F.sum(F.when(F.col("fold") == 0, F.col("grade")).otherwise(0.0)).alias("g0"))
    # words of three graded documents or more; their number is bounded by the graded documents, not by the corpus
    counts = table.where("n >= 3").toPandas().sort_values("word")
    smooth = lambda g, n: dict(zip(counts["word"][n > 0], ((g + 2 * 2.5) / (n + 2))[n > 0], strict=True))
    grades = smooth(counts["g"], counts["n"])
    # a document's own fold doesn't grade its words while the ranker learns
    other = spark.sparkContext.broadcast([smooth(counts["g"] - counts["g0"], counts["n"] - counts["n0"]), smooth(counts["g0"], counts["n0"])])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, g, f, [*b, *vocabulary(list(w), other.value[f])]) for k, f, g, b, w in zip(batch["k"], batch["fold"], batch["grade"], batch["base"], batch["words"], strict=True) if len(w) >= 5]
            yield pd.DataFrame(rows, columns=["k", "grade", "fold", "x"]).astype({"grade": "float64", "fold": "int32"})

    rows = sorted(bounded_rows(own.select("k", "fold", "grade", "base", "words").mapInPandas(measure, "k string, grade double, fold int, x array<double>"), 2 * GRADED, "the graded documents"), key=lambda r: r["k"])
    drop(own)
    y = np.array([r["grade"] for r in rows])
    if len(set(y)) < 2:
        return None
    x, folds = np.array([r["x"] for r in rows]), np.array([r["fold"] for r in rows])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = (x - mean) / scale
    weights = rank_pairs(z, y)
    # levels are calibrated on scores of rankers that didn't see the document
    held = z @ weights
    for f in (0, 1):
        if len(set(y[folds != f])) > 1:
            held[folds == f] = z[folds == f] @ rank_pairs(z[folds != f], y[folds != f])
    xs, ys = isotonic(held, y)
    return LevelModel(grades, mean, scale, weights, xs, ys, languages)


def reading_levels(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "reading_level", lang: str | None = "lang") -> DataFrame:
    """(key, english, n_words, score, level_estimate, level) of every document.

    `level` is the estimate rounded to a level of the labels; it and the scores are null for texts without words and where
    no model can be learnt; then no text counts as English. Null and empty texts have 0 words. Languages may be null, wrong
    or missing altogether.
    """
    model = fit(docs, labels, key, text, label, lang)
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            got = [features(t, m.grades if m else {}) if t else ([0.0] * FEATURES, []) for t in batch[text]]
            n = np.array([len(g[1]) for g in got], dtype="int32")
            out = pd.DataFrame({key: batch[key], "english": [bool(m) and m.languages.is_english(g[1]) for g in got], "n_words": n})
            if m and len(got):
                score = m.score(np.array([g[0] for g in got]))
                level = m.level(score)
                score[n == 0] = np.nan
                level[n == 0] = np.nan
            else:
                score = level = np.full(len(got), np.nan)
            out["score"], out["level_estimate"] = score, level
            yield out

    rated = docs.select(key, text).mapInPandas(estimate, f"{key} {kind}, english boolean, n_words int, score double, level_estimate double")
    nan_to_null = lambda c: F.when(~F.isnan(c), F.col(c))
    return rated.select(key, "english", "n_words", nan_to_null("score").alias("score"), nan_to_null("level_estimate").alias("level_estimate"), F.floor(nan_to_null("level_estimate") + 0.5).cast("int").alias("level"))
