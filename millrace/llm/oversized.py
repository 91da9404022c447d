"""Splitting oversized items at natural boundaries.

The least number of pieces that can hold an item under the limit gives equal-length targets. Each target moves to the
strongest boundary (end of a sentence, then of a clause, then of a word, else any character) within `NEAR` of a piece's
length around it, the nearest among equals, and a piece is added where a limit fails. Consecutive pieces overlap.

Pieces are to end where sentences end if that is possible. So only where a target had no end of a sentence near it, all ways
to cut the item are weighed by dynamic programming: first the fewest cuts that aren't ends of sentences, then the fewest
pieces, then the most equal ones. No piece in them is shorter than `SHORTEST` of the limit, so an end of a sentence
beside the item's own end draws no cut there.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import bounded_rows, cut, drop

# English abbreviations by what their full stop can mean; the corpus adds its own (`learn_habits`).
#: before a name or a word of the same sentence: never an end
TITLES = "mr mrs ms dr prof st rev hon gen col capt lt sgt gov sen rep messrs mme mlle fr sr. adm cmdr maj pres supt v vs cf viz approx ca e.g i.e al".split()
#: before a number: no end there
NUMBERED = "no nos sec secs p pp fig figs art arts vol vols ch chap para pt ex op ed".split()
#: may end a sentence: only if a usual first word follows
EITHER = "inc ltd co corp llc bros jr sr esq etc dept univ assn mt ave blvd rd jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun a.m p.m u.s u.k u.n d.c ph.d m.d b.a m.a".split()
#: usual first words of sentences
STARTERS = set("the a an this that these those in on at by for from with after before when while where who what which why how if as but and or so yet no yes not he she it we you they i his her its our your their my there here then now also one some all both each every many most is are was were do does did has have had can could may might will would shall should to of see perhaps although because however".split())
SAID = re.compile(r"(?:[A-Z][\w'’.\-]*\s+){0,4}?(?:said|asked|wrote|replied|answered|added|cried|called|exclaimed|whispered|noted|observed|remarked|inquired|shouted)\b")
MARKS = re.compile(r"[.!?…。！？]+")
CLOSERS = "\"'”’»)]}』」›"
OPENERS = "\"'“‘«([{„‚「『‹¿¡-–—*"
CLAUSE = re.compile(r"[,;:—–](?=\s)")
SPACE = re.compile(r"\s+")
#: How far a cut may lie from its target, as a share of the way between two targets; the least piece of the second search as a share of the limit.
NEAR, SHORTEST = 0.25, 0.05
#: What a word is searched back to; applied to reversed text, so the cost is the word's length.
_WORD_BACK = re.compile(r"[^\s(\[{\"“‘«'—–/]*")
_LETTERS_BACK = re.compile(r"[^\W\d_]*")
_LETTERS = re.compile(r"[^\W\d_]+")


class Habits:
    """What a corpus shows of its words: those that it mostly writes small inside sentences (with a capital they begin one), those that it doesn't, and those whose full stop often stands inside a sentence."""

    def __init__(self, small: Iterable[str] = (), names: Iterable[str] = (), stopped: Iterable[str] = ()):
        self.small, self.names, self.stopped = frozenset(small), frozenset(names), frozenset(stopped)


#: A word counts from this share of all words and `SEEN` times on, so at most 1 / RARE are kept; share of its full stops inside sentences that makes a word an abbreviation.
RARE, SEEN, INSIDE = 1e-6, 5, 0.3


def learn_habits(texts: DataFrame, text: str = "text") -> Habits:
    """The habits of all texts, by one pass on the JVM: words between white space, without quote marks and brackets around them."""
    bare = F.regexp_replace(F.col(text), r"(?<![^\s])[\"'“‘«(\[{]+|[\"'’”»)\]},;:]+(?![^\s])", "")
    split = texts.where(F.col(text).isNotNull()).select(F.split(bare, r"\s+").alias("ws"))
    at = split.select(F.explode(F.arrays_zip(F.slice("ws", 1, F.greatest(F.size("ws") - 1, F.lit(0))).alias("w"), F.slice("ws", 2, F.size("ws")).alias("next"))).alias("p")).select("p.w", "p.next")
    last = F.right("w", F.lit(1))
    ended = last.isin(".", "!", "?", "…")
    # the word after one that ends nothing stands inside a sentence
    first = F.left("next", F.lit(1))
    small = ((first == F.lower(first)) & (first != F.upper(first))).cast("int")
    none = F.lit(0)
    # one row for each word that stands inside a sentence or has a full stop, so the texts are read once
    row = F.when(last == ".", F.struct(F.expr("left(w, length(w) - 1)").alias("word"), none.alias("small"), none.alias("seen"), F.lit(1).alias("stops"), small.alias("stops_inside")))
    row = row.when(~ended, F.struct(F.col("next").alias("word"), small.alias("small"), F.lit(1).alias("seen"), none.alias("stops"), none.alias("stops_inside")))
    # words as written are counted first: few of them are left to be looked at by patterns
    written = at.where("next <> ''").select(row.alias("r")).where("r is not null").groupBy("r.word").agg(*[F.sum(F.col(f"r.{c}")).alias(c) for c in ("small", "seen", "stops", "stops_inside")])
    listed = written.where(F.col("word").rlike(r"^\p{L}+$") | ((F.col("stops") > 0) & F.col("word").rlike(r"^\p{L}[\p{L}.]*$")))
    counts = listed.groupBy(F.lower("word").alias("word")).agg(*[F.sum(c).alias(c) for c in ("small", "seen", "stops", "stops_inside")])
    kept = cut(counts.where((F.col("seen") >= SEEN) | ((F.col("stops") >= SEEN) & (F.col("stops_inside") >= INSIDE * F.col("stops")))))
    n = kept.agg(F.sum("seen")).first()[0] or 0
    rows = kept.where((F.col("seen") >= RARE * n) | (F.col("stops") >= RARE * n)).collect()
    drop(kept)
    common = [r for r in rows if r["seen"] >= SEEN]
    return Habits(
        (r["word"] for r in common if r["small"] > r["seen"] / 2), (r["word"] for r in common if r["small"] <= r["seen"] / 2),
        (r["word"] for r in rows if r["stops"] >= SEEN and r["stops_inside"] >= INSIDE * r["stops"]),
    )


def sentence_ends(text: str | None, habits: Habits | None = None) -> list[int]:
    """Places where one sentence ends and another begins: characters up to and including the last mark, with what closes there. The last sentence's end isn't one.

    Whether a word after an abbreviation begins a sentence is told by the habits of the corpus, and by the fixed list of usual first
    words where the corpus is silent; abbreviations are the fixed ones and those of the corpus.
    """
    if not text:
        return []
    out: list[int] = []
    size = len(text)
    quotes, done = 0, 0
    token, initials = 0, True  # where the word before a mark begins; whether its earlier parts are single letters with full stops
    for m in MARKS.finditer(text):
        start, end = m.span()
        quotes += text.count('"', done, end)
        back = text[done:start][::-1]
        own = _WORD_BACK.match(back).end()
        if own < len(back):
            token, initials = start - own, True
        part_from, letters = max(token, done), _LETTERS_BACK.match(back).end()
        was_initials = initials
        initials = initials and start - part_from == 1 and text[part_from].isalpha() and m.group() == "."
        done = end
        closed, inside = end, quotes
        while closed < size and text[closed] in CLOSERS:
            if text[closed] == '"':
                if inside % 2 == 0:  # it opens
                    break
                inside += 1
            elif text[closed] == "'" and closed + 1 < size and text[closed + 1].isalnum():
                break
            closed += 1
        if closed < size and MARKS.match(text, closed):
            continue  # more marks follow, such as ?".
        at = closed
        while at < size and text[at].isspace():
            at += 1
        if at >= size:
            break
        after, joined = text[at], at == closed
        mark = m.group()
        if mark[-1] in "。！？":
            out.append(closed)
            continue
        if after.islower() or after in ",;:)]}/%&=+…":
            continue
        if joined and closed == end:
            # no white space: only a word before and a capitalised word or an opening mark after make it an end
            before = back[:letters][::-1] if letters >= 2 else ""
            follows = text[at + 1 : at + 2]
            capital = after.isupper() and bool(follows) and (follows.islower() or follows in " '’" or (follows == "." and before.islower() and len(before) > 2))
            if not before or not (capital or after in "\"“‘«([") or before.lower().endswith(("www", "http")):
                continue
        elif joined and not (after.isupper() or after in OPENERS):
            continue
        if mark == ".":
            part = text[part_from:start]
            # sentences run together (shore.Mr. Bo): the abbreviation is what follows the joint
            run_on = not joined and part_from > token and part_from - token > 2 and text[part_from - 1] == "." and text[part_from - 3 : part_from - 1].isalpha() and re.fullmatch(r"[A-Z][a-z]*", part)
            dotted = part_from > token and not run_on
            low = text[token:start].lower() if dotted and start - token <= 12 else "" if dotted else part.lower()
            if closed == end:
                if low in TITLES or (after.isdigit() and low in NUMBERED):
                    continue
                if not dotted and len(part) == 1 and part.isalpha() and part.isupper() and after.isupper() and not _starter(text, at, habits, pronoun=part == "I"):
                    continue
                lettered = dotted and was_initials and len(part) == 1 and part.isalpha()
                if (low in EITHER or lettered or (habits is not None and low in habits.stopped)) and not (after in OPENERS or _starter(text, at, habits)):
                    continue
            if start == token:
                near = start
                while near and text[near - 1].isspace():
                    near -= 1
                if not near or text[near - 1] == ".":
                    continue  # a full stop by itself
        elif mark[-1] in "!?" and closed > end and text[closed - 1] in "\"”’»" and SAID.match(text, at):
            continue
        out.append(closed)
    return out


def _starter(text: str, at: int, habits: Habits | None, pronoun: bool = True) -> bool:
    """Whether a word stands here that begins a sentence if it has a capital. After an initial it takes more than one: initials stand before names."""
    m = _LETTERS.match(text, at)
    if m is None or len(m.group()) == 1 or not pronoun:
        return False
    word = m.group().lower()
    if habits is not None and (word in habits.small or word in habits.names):
        return word in habits.small
    return word in STARTERS


def boundaries(text: str | None, habits: Habits | None = None) -> list[tuple[int, int]]:
    """(place, strength) in order: 3 end of a sentence, 2 of a clause, 1 of a word."""
    if not text:
        return []
    found = {m.start(): 1 for m in SPACE.finditer(text)}
    found |= {m.end(): 2 for m in CLAUSE.finditer(text)}
    found |= dict.fromkeys(sentence_ends(text, habits), 3)
    found.pop(0, None)
    found.pop(len(text), None)
    return sorted(found.items())


Cut = tuple[int, float, int]


def _snapped(bounds: list[tuple[int, int]], size: int, length: float, limit: float, overlap: float) -> list[Cut]:
    """(character, second, strength) of the inner cuts: equal targets for the least number of pieces, each moved to the strongest boundary near it; a piece more where a limit fails."""
    per = length / size if size else 0.0
    seconds = [p * per for p, _ in bounds]
    n = max(2, math.ceil((length - overlap) / (limit - overlap) - 1e-9))
    while True:
        whole = (length + (n - 1) * overlap) / n  # of a piece
        step = whole - overlap
        near = NEAR * step
        cuts: list[Cut] = []
        start = 0.0
        for k in range(1, n):
            target = whole + (k - 1) * step
            last = min(target + near, start + limit)
            a, b = bisect.bisect_left(seconds, target - near), bisect.bisect_right(seconds, last)
            if a < b:
                at = min(range(a, b), key=lambda i: (-bounds[i][1], abs(seconds[i] - target)))
                cuts.append((bounds[at][0], seconds[at], bounds[at][1]))
            else:
                second = min(target, last)
                cuts.append((min(size, max(0, int(second / per))) if per else 0, second, 0))
            start = cuts[-1][1] - overlap
        if length - start <= limit + 1e-9 and all(b[1] - a[1] > 1e-9 for a, b in zip([(0, overlap, 0), *cuts], cuts, strict=False)):
            return cuts
        n += 1


def _weighed(bounds: list[tuple[int, int]], size: int, length: float, limit: float, overlap: float) -> list[Cut] | None:
    """The cuts at boundaries with the fewest that aren't ends of sentences, then the fewest in all, then the least sum of squared lengths; None if no row of boundaries holds the limit."""
    per = length / size
    at = np.array([p * per for p, _ in bounds])
    weak = np.array([s < 3 for _, s in bounds], dtype=np.int64)
    m = len(at)
    least = SHORTEST * limit
    ends = np.append(at, length)
    weak = np.append(weak, 0)
    cost = np.full(m + 1, -1, dtype=np.int64)  # weak cuts x (m + 2) + pieces; -1 is out of reach
    spread, back = np.zeros(m + 1), np.full(m + 1, -1)
    for j in range(m + 1):
        x = ends[j]
        best: tuple[int, float, int] | None = (int(weak[j]) * (m + 2) + 1, x * x, -1) if least <= x <= limit + 1e-9 else None
        lo, hi = np.searchsorted(at, x - (limit - overlap) - 1e-9), np.searchsorted(at, x - least, side="right")
        hi = min(hi, j)
        if lo < hi and (ok := cost[lo:hi] >= 0).any():
            own = np.where(ok, cost[lo:hi], np.iinfo(np.int64).max)
            low = own.min()
            dev = np.where(own == low, spread[lo:hi] + (x - at[lo:hi]) ** 2, np.inf)
            i = int(dev.argmin())
            found = (int(low) + int(weak[j]) * (m + 2) + 1, float(dev[i]), lo + i)
            best = found if best is None or found[:2] < best[:2] else best
        if best is not None:
            cost[j], spread[j], back[j] = best
    if cost[m] < 0:
        return None
    out: list[Cut] = []
    j = int(back[m])
    while j >= 0:
        out.append((bounds[j][0], float(at[j]), bounds[j][1]))
        j = int(back[j])
    return out[::-1]


def cuts_of(bounds: list[tuple[int, int]], size: int, length: float, limit: float, overlap: float) -> list[Cut]:
    """The inner cuts of an item of `size` characters and `length` seconds."""
    cuts = _snapped(bounds, size, length, limit, overlap)
    if all(s == 3 for *_, s in cuts) or not any(s == 3 for _, s in bounds):
        return cuts
    weighed = _weighed(bounds, size, length, limit, overlap)
    weak = lambda c: sum(s < 3 for *_, s in c)
    return weighed if weighed is not None and weak(weighed) < weak(cuts) else cuts


def pieces_of(text: str | None, length: float, limit: float, overlap: float, habits: Habits | None = None) -> list[tuple[str | None, float, float, list[int]]]:
    """(text, start, end, ends of sentences) of the pieces, in seconds from the item's start; time runs evenly over the characters.

    No piece is longer than the limit. The ends of sentences are places in the item's text, each given with the piece it
    lies in, up to and including its last character. An overlap that isn't below half the limit counts as half of it. An
    item within the limit is one piece. Text that is null or empty is cut by time alone and stays as it is.
    """
    bounds = boundaries(text, habits)
    ends = [p for p, s in bounds if s == 3]
    if not length > limit:
        return [(text, 0.0, length, ends)]
    overlap = min(max(overlap, 0.0), limit / 2)
    size = len(text or "")
    out = []
    start, last = 0.0, 0
    for at, second, _ in [*cuts_of(bounds, size, length, limit, overlap), (size, length, 3)]:
        begin = 0 if start == 0 or not text else round(start / length * size)
        if text and 0 < begin < size and not text[begin - 1].isspace():
            later = SPACE.search(text, begin, at)  # the overlap begins with a whole word
            begin = later.end() if later and later.end() < at else begin
        stop = bisect.bisect_right(ends, at)
        out.append((text[begin:at].strip() if text else text, start, second, ends[last:stop]))
        start, last = second - overlap, stop
    return out


def oversized_records(df: DataFrame, sources: DataFrame, key: str = "id", row: str = "seg_row") -> DataFrame:
    """(key, text, begins, length, limit, overlap) of each record longer than its source's limit, once.

    The length is end_s - start_s, or duration_s where either is null; NaN is no length, infinite is above any limit.
    Sources that aren't listed or have no positive limit hold no oversized record; a null overlap counts as 0. Of several
    deliveries the one with the least `row` counts.
    """
    bounded_rows(sources.select("source"), 100_000, "the list of sources")
    listed = F.broadcast(sources.where("source is not null and max_segment_seconds > 0 and not isnan(max_segment_seconds)").select("source", F.col("max_segment_seconds").alias("limit"), F.coalesce("overlap_seconds", F.lit(0.0)).alias("overlap")).dropDuplicates(["source"]))
    length = F.when(F.col("start_s").isNull() | F.col("end_s").isNull(), F.col("duration_s")).otherwise(F.col("end_s") - F.col("start_s"))
    own = df.select(*dict.fromkeys([key, row, "source", "text_original", "duration_s", "start_s", "end_s"]))
    long = own.where(F.col(key).isNotNull()).join(listed, "source").withColumn("length", length).where(F.col("length").isNotNull() & ~F.isnan("length") & (F.col("length") > F.col("limit")))
    kept = F.struct(F.col("text_original").alias("text"), F.coalesce(F.when(F.col("end_s").isNotNull(), F.col("start_s")), F.lit(0.0)).alias("begins"), "length", "limit", "overlap")
    return long.groupBy(key).agg(F.min_by(kept, row).alias("k")).select(key, "k.*")


def split_oversized(df: DataFrame, sources: DataFrame, key: str = "id") -> DataFrame:
    """(key, piece, n_pieces, text, start_s, end_s, sentence_ends) of the oversized records.

    start_s and end_s count from the record's start_s, or from 0 where its times are null. `sentence_ends` are the places in
    the record's text where one sentence ends and another begins, as the splitter weighed them, each with the one piece
    it lies in. A record of infinite length comes as one piece per sentence without times.
    """

    records = cut(oversized_records(df, sources, key))
    shared = df.sparkSession.sparkContext.broadcast(learn_habits(records))

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        habits = shared.value
        for batch in batches:
            rows = []
            for k, text, begins, length, limit, overlap in batch.itertuples(index=False):
                text = None if text is None or text != text else text
                if math.isinf(length):
                    at = [0, *sentence_ends(text, habits), len(text or "")]
                    parts = [(text[a:b].strip() if text else text, None, None, [b] if b < at[-1] else []) for a, b in zip(at, at[1:], strict=False)]
                else:
                    base = begins if math.isfinite(begins) else 0.0
                    parts = [(t, base + a, base + b, e) for t, a, b, e in pieces_of(text, length, limit, overlap, habits)]
                rows += [(k, i, len(parts), *p) for i, p in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["k", "piece", "n_pieces", "text", "start_s", "end_s", "sentence_ends"]).astype({"start_s": "float64", "end_s": "float64"}).rename(columns={"k": key})

    kind = df.schema[key].dataType.simpleString()
    return records.mapInPandas(cut_up, f"{key} {kind}, piece int, n_pieces int, text string, start_s double, end_s double, sentence_ends array<int>")


def record_boundaries(df: DataFrame, sources: DataFrame, key: str = "id") -> DataFrame:
    """(key, char_pos) of each end of a sentence, but the last, inside the oversized records: those the splitter weighed for its cuts."""
    return split_oversized(df, sources, key).select(key, F.explode("sentence_ends").alias("char_pos"))
