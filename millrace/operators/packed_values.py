"""Several values packed in one field: one row per value, with its place in the field.

Expectation-maximisation learns from the whole column how often values, forms of values (the sequence of word kinds and
marks in them) and further values in a field occur. A Viterbi lattice per field then picks the likeliest split. Spans in
quote marks, in brackets and names of an authority list are atoms that no split enters.

A value's probability is that of its form, or, if the value as a whole is frequent, that of the value itself. Both are
expected counts: a name that stands only in lists gains its frequency there, from every way to cut those lists. How often
a mark stands inside a value isn't set by hand either: it is counted in the values that can't be cut (alone in their
field or in quote marks), which teach the first model.

What EM learns about forms has a fixed size whatever the column's: those whose share of all values is above `RARE` (at
most 1 / RARE; what a rarer form loses by its symbols' probabilities is below that share) and the probability that another
value follows. Whole values are counted one by one, by a hash of 64 bits: every value whose expected count is above
`DISCOUNT` is frequent, however many there are. Up to `HELD` of them are held by each task, behind a sketch of `DEPTH` rows
of `WIDTH` cells that tells most other values apart; where there are more, spans are joined with the table of their counts.

The fields are parsed once for learning. Values that can't be cut are counted in that pass; each EM round runs over the
runs of two or more atoms alone, until forms and values stay as they are. While the frequent values are held, decoding is
one pass over the rows without a shuffle or join, so a creator that holds a third of the rows costs no more than any other.
"""

from __future__ import annotations

import gc
import itertools
import math
import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import bounded_rows, cut, drop

WIDTH, DEPTH = 1 << 17, 2
#: So many frequent values are held by each task (about 30 MB); more are joined from their table, with the same result.
HELD = 1 << 18
#: Least share of all values of a form that is kept by itself; the mass of other forms, shared out by their symbols.
RARE, NEW = 1e-5, 0.05
#: An exact value counts only beyond this many distinct fields, so that no field proves itself; share of values drawn as wholes.
DISCOUNT, WHOLE = 2.0, 0.1
#: Least probability of a word in a value that isn't known as a whole; in a small column it is one in all values.
WORD = 1e-4
#: What a symbol's count starts with: `PRIOR` of `PRIOR_SIZE` symbols.
PRIOR, PRIOR_SIZE = 0.1, 100.0
#: Share of all values, and at least one, by which a form that holds a separator falls short of its count: a form must be common to join what could be several values.
SPARSE = 0.004
#: Rounds of EM end when less than this share of all values changes its form, and of the sketch its cell.
SETTLED = 0.02
QUOTES = {'"': '"', "'": "'", "“": "”", "„": "“”", "«": "»", "‘": "’", "‹": "›", "「": "」"}
BRACKETS = {"(": ")", "[": "]", "{": "}"}
_BRACKET = re.compile(r"[(\[{)\]}]")
MARKS = set(",，&;；|｜/·•、\n\t")
_SEPARATOR = re.compile(
    r"\s*(?:[\r\n]+)\s*|[^\S\t]*(?:\t)\s*|\s*(?:[;；])\s*|\s*(?:[|｜])\s*|(?:\s+/\s*|\s*/\s+)|(?:/)|\s*(?:[•·])\s*|\s*(?:、)\s*"
    r"|\s*[,，]\s*(?:and\s+|&\s*)|\s*(?:[,，])\s*|(?:\s+and\s+)|(?:\s*&\s*)"
)
#: The same separators without the white space before them, for fields whose atoms are stripped anyway.
_CORE = re.compile(r"[,，]\s*(?:and\s+|&\s*)?|[;；|｜/•·、&]\s*|[\r\n\t]\s*|(?<=\S)[^\S\r\n\t]+and\s+")
_SPECIAL = re.compile(r"[\s,，;；|｜/•·、&(\[{\"]")
_TOKEN = re.compile(
    r"(?P<P>\([^()]*\)|\[[^\[\]]*\])|(?P<N>\"[^\"]*\"|“[^”]*”)|(?P<Y>(?:(?:b|d|ca|c|fl|active|born|died)\.?\s*)?\d{3,4}(?:\s*[-–—/]\s*(?:\d{2,4})?)?(?!\w))"
    r"|(?P<S>(?:Jr|Sr|Esq|Inc|Ltd|LLC|LLP|Co|Corp|GmbH|Ph\.?\s?D|M\.?D|II|III|IV)(?!\w)\.?)|(?P<I>[^\W\d_]\.)|(?P<a>and(?!\w))|(?P<w>[^\W\d_](?:[\w'’\-]|\.(?=\w))*\.?)|(?P<D>\d+)|(?P<x>[^\s\w]|[\r\n\t])"
)


#: Capital words alone, the commonest atoms, and the suffixes among them; both as `_TOKEN` reads them.
_PLAIN = re.compile(r"[A-Z][a-z]+(?: [A-Z][a-z]+)*")
_SUFFIXES = {"Jr", "Sr", "Esq", "Inc", "Ltd", "Co", "Corp"}


@lru_cache(maxsize=200_000)
def form_of(value: str) -> tuple[str, int]:
    """The form of a value and its number of words: W capital word, l small words, I initials, S suffix, Y years, P note in brackets, N nickname in quote marks, marks as they are."""
    if _PLAIN.fullmatch(value):
        own = value.split(" ")
        return "".join(["S" if w in _SUFFIXES else "W" for w in own]), len(own)
    out: list[str] = []
    words = 0
    for m in _TOKEN.finditer(value):
        kind = m.lastgroup or "x"
        if kind == "w":
            words += 1
            kind = "l" if m.group()[0].islower() else "W"
        elif kind == "x":
            kind = "\n" if m.group() == "\r" else m.group()
        elif kind == "a":
            kind = "&"
        if out and kind == out[-1] and kind in "Il\n":
            continue
        out.append(kind)
    return "".join(out), words


def _closing(s: str) -> dict[int, int]:
    """Index of each bracket that is closed -> index of the bracket that closes it."""
    out: dict[int, int] = {}
    open_: list[int] = []
    for m in _BRACKET.finditer(s):
        if m.group() in BRACKETS:
            open_.append(m.start())
        elif open_ and BRACKETS[s[open_[-1]]] == m.group():
            out[open_.pop()] = m.start()
    return out


def _ends(s: str, j: int, hi: int) -> bool:
    """Whether a value may end before index j of what ends at hi: only white space, or a separator, follows."""
    rest = j
    while rest < hi and s[rest].isspace():
        rest += 1
    return rest >= hi or (m := _SEPARATOR.match(s, j, hi)) is not None and m.end() > j


_STOPS = {mark: re.compile("[\\\\" + re.escape(close) + "]") for mark, close in QUOTES.items()}


def _quoted(s: str, i: int, hi: int) -> tuple[str, int] | None:
    """The content of a span in quote marks that begins at i and fills its place, and the index after it."""
    mark, close, j, out = s[i], QUOTES[s[i]], i + 1, []
    stop = _STOPS[mark]
    while m := stop.search(s, j, hi):
        at = m.start()
        out.append(s[j:at])
        j = at + 1
        if s[at] == "\\":
            if j < hi and (s[j] in close or s[j] in (mark, "\\")):
                out.append(s[j])
                j += 1
            else:
                out.append("\\")
        elif j < hi and s[j] == s[at] and mark == s[at] and any(out):
            out.append(s[at])
            j += 1
        elif _ends(s, j, hi):
            return "".join(out).strip(), j
        else:
            out.append(s[at])
    return None


#: Between the forms of a shape; forms hold no control characters but line ends and tabs.
JOINT = "\x1f"


class Run:
    """Atoms between which values may be cut: `bounds` are their places in the text, `shape` their forms and the separators' in turn, joined by `JOINT`. A run without atoms is one value, its text."""

    __slots__ = ("bounds", "shape", "text")

    def __init__(self, text: str, bounds: list[int] | None = None, shape: str = ""):
        self.text, self.bounds, self.shape = text, bounds or [], shape

    def span(self, i: int, j: int) -> str:
        """The text of the atoms i to j."""
        return self.text[self.bounds[2 * i] : self.bounds[2 * j + 1]].strip()

    def hashes(self, spans: list) -> list[int]:
        """The hash of each span's text."""
        text, bounds, digest = self.text, self.bounds, xxhash.xxh3_64_intdigest
        return [digest(text[bounds[2 * i] : bounds[2 * j + 1]].strip()) for i, j, _ in spans]


_FIRST = re.compile(r"\w+|\S")
_ENCLOSING = re.compile("[" + re.escape("".join({*QUOTES, *"".join(QUOTES.values()), *BRACKETS, *BRACKETS.values()})) + "]")


class Lattice:
    """Cuts fields into runs of atoms. The listed names stay whole wherever they stand; they are looked up by their first word."""

    def __init__(self, names: list[str]):
        self.names = {n.strip() for n in names if n and n.strip()}
        self.first: dict[str, list[str]] = defaultdict(list)
        for n in sorted(self.names, key=lambda n: (-len(n), n)):
            self.first[_FIRST.match(n).group()].append(n)
        self.first = dict(self.first)

    def _name(self, s: str, i: int, hi: int) -> int:
        """Where the longest listed name that begins at i and may end there ends, or -1."""
        if (m := _FIRST.match(s, i, hi)) and (own := self.first.get(m.group())):
            for n in own:
                if s.startswith(n, i, hi) and _ends(s, i + len(n), hi):
                    return i + len(n)
        return -1

    @staticmethod
    def _plain(s: str) -> list[Run]:
        """The runs of a field without quote marks, brackets and first words of listed names."""
        out: list[Run] = []
        bounds: list[int] = []
        shape: list[str] = []
        at, n = 0, len(s)
        for m in itertools.chain(_CORE.finditer(s), (None,)):
            start, end = m.span() if m else (n, n)
            atom = s[at:start].strip()
            if atom:
                first = s.index(atom, at)
                bounds += (first, first + len(atom))
                shape.append(form_of(atom)[0])
                if m:
                    shape.append(form_of(m.group())[0])
            elif bounds:  # nothing between two separators: both separate
                out.append(Run(s, bounds, JOINT.join(shape[: len(bounds) - 1])))
                bounds, shape = [], []
            at = end
        if bounds:
            out.append(Run(s, bounds, JOINT.join(shape[: len(bounds) - 1])))
        return out

    def runs(self, s: str) -> list[Run]:
        """The runs of a field from left to right. Brackets that enclose values are opened at any depth."""
        if not _ENCLOSING.search(s) and self.first.keys().isdisjoint(_FIRST.findall(s)):
            return self._plain(s.strip())
        out: list[Run] = []
        closing = _closing(s)
        bounds: list[int] = []
        shape: list[str] = []
        broken: set[str] = set()  # quote marks after which none closes
        todo = [(0, len(s))]

        def close() -> None:
            nonlocal bounds, shape
            if bounds:
                out.append(Run(s, bounds, JOINT.join(shape[: len(bounds) - 1])))
            bounds, shape = [], []

        while todo:
            i, n = todo.pop()
            while i < n and s[i].isspace():
                i += 1
            while i < n and s[n - 1].isspace():
                n -= 1
            if i < n and closing.get(i) == n - 1:
                todo.append((i + 1, n - 1))
                continue
            while i < n:
                while i < n and s[i].isspace() and not _SEPARATOR.match(s, i, n):
                    i += 1
                if i >= n:
                    break
                if s[i] in QUOTES and s[i] not in broken and (q := _quoted(s, i, n)):
                    close()
                    if q[0]:
                        out.append(Run(q[0]))
                    i = q[1]
                elif (e := self._name(s, i, n)) > 0:
                    close()
                    out.append(Run(s[i:e]))
                    i = e
                elif (b := closing.get(i, 0)) and b < n and _ends(s, b + 1, n):
                    close()
                    todo += [(b + 1, n), (i + 1, b)]
                    break
                else:
                    if s[i] in QUOTES:
                        broken.add(s[i])
                    start = i
                    while i < n:
                        if i > start and s[i - 1].isspace() and (e := self._name(s, i, n)) > 0:
                            i = e
                            continue
                        if not _SPECIAL.match(s, i, n):
                            i = m.start() if (m := _SPECIAL.search(s, i, n)) else n
                        elif _SEPARATOR.match(s, i, n):
                            break
                        elif (b := closing.get(i, 0)) and b < n:
                            i = b + 1
                        elif s[i] == '"' and i > start and (j := s.find('"', i + 1, n)) > 0:
                            i = j + 1
                        else:
                            i += 1
                    if s[start:i].strip():
                        bounds += (start, i)
                        shape.append(form_of(s[start:i])[0])
                    else:
                        close()  # nothing between two separators: both separate
                m = _SEPARATOR.match(s, i, n) if i < n else None
                if m is None or m.end() == i:
                    i += 1  # after a value always a separator or the end
                else:
                    if bounds:
                        shape.append(form_of(m.group())[0])
                    i = m.end()
            close()
        return out


def lattice_of(names: list[str]) -> Lattice:
    """A lattice builder for the listed names, which stay whole wherever they stand."""
    return Lattice(names)


def _cells(h):
    """The cell of a value's hash (or of an array of them) in each row of the sketch; 17 bits of it each."""
    return h % WIDTH, WIDTH + (h >> 32) % WIDTH


def marks_of(form: str) -> int:
    """The marks in a form that may separate values."""
    return sum([c in MARKS for c in form])


def new_form(form: str, symbols: dict[str, float], log_total: float) -> float:
    """Log probability of a form that isn't kept: each symbol by how often it stands in values that can't be cut; a value without a word hardly stands alone (a suffix, years, a note)."""
    rare = math.log(PRIOR * PRIOR_SIZE)
    return sum([symbols.get(c, rare) for c in form]) - log_total * len(form) + (0.0 if "W" in form else math.log(0.01))


class Model:
    """What EM has learnt: forms, symbols, how often another value follows, and the frequent values.

    `counts` are the hashes and counts of the frequent values, if they are held, and `longest` is the number of separators
    in the longest one. `sketch`, a flat array of all rows, is the most that any value of a cell can have been counted (made
    from `counts` by default): it only spares looking values up.
    """

    def __init__(self, forms: dict[str, float], follows: float, sketch: np.ndarray | None = None, symbols: dict[str, float] | None = None, total: float | None = None, counts: tuple[np.ndarray, np.ndarray] | None = None, longest: int = 0):
        self.total = max(sum(forms.values()) if total is None else total, 1.0)
        short = max(SPARSE * self.total, 1.0)
        self.forms = {f: n - short if any(c in MARKS for c in f) else n for f, n in forms.items() if n >= RARE * self.total}
        counted = symbols or {}
        self.symbols = {c: math.log(n + PRIOR * PRIOR_SIZE) for c, n in counted.items()}
        self.log_symbols = math.log(sum(counted.values()) + PRIOR_SIZE)
        #: log P(another value follows a separator); the same for all kinds, as a field mostly keeps to one kind
        self.follows = math.log(min(max(follows, 1e-3), 1 - 1e-3))
        #: separators in a value: one more than in any form that is kept, so longer forms can be learnt round by round, and as many as in any frequent value
        self.reach = max(longest, 1 + max((marks_of(f) for f, n in self.forms.items() if n > 0), default=1))
        self.counts = (np.zeros(0, "uint64"), np.zeros(0)) if counts is None else counts
        if sketch is None:
            sketch = np.zeros(DEPTH * WIDTH)
            for cells in _cells(self.counts[0]):
                np.add.at(sketch, cells.astype("int64"), self.counts[1])
        self.hot = (np.asarray(sketch, dtype=float).ravel() > DISCOUNT).tobytes()
        self.word = math.log(max(WORD, 1 / self.total))
        self._fresh()

    def _fresh(self) -> None:
        self.held: dict[int, float] = dict(zip(self.counts[0].tolist(), self.counts[1].tolist(), strict=True))
        self.shapes: dict[str, list] = {}
        self.scores: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("held", "shapes", "scores")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._fresh()

    def form(self, form: str) -> float:
        """log P(form)."""
        got = self.scores.get(form)
        if got is not None:
            return got
        new = math.log(NEW) + new_form(form, self.symbols, self.log_symbols)
        known = self.forms.get(form, 0.0) / self.total * (1 - NEW)
        got = max(math.log(known), new) if known > 0 else new
        if len(self.scores) < 100_000:
            self.scores[form] = got
        return got

    def frequent(self, value: str, n: float) -> float:
        """log P(value as a whole) against that of its words, of a value that was counted n times, or -inf if it isn't frequent."""
        return math.log(WHOLE * (n - DISCOUNT) / self.total) - form_of(value)[1] * self.word if n > DISCOUNT else -math.inf

    def whole(self, value: str) -> float:
        """`frequent` by the count that is held of the value."""
        h = xxhash.xxh3_64_intdigest(value)
        a, b = _cells(h)
        return self.frequent(value, self.held.get(h, 0.0)) if self.hot[a] and self.hot[b] else -math.inf

    def value(self, value: str) -> float:
        """log P(value) without what each of its words costs, which is the same for all splits."""
        return max(self.form(form_of(value)[0]), self.whole(value))

    def spans(self, shape: str) -> list[tuple[int, int, float]]:
        """The spans of a shape with their scores by form, in the order of their ends."""
        got = self.shapes.get(shape)
        if got is None:
            parts = shape.split(JOINT)
            n = (len(parts) + 1) // 2
            got = [(i, j, self.form("".join(parts[2 * i : 2 * j + 1]))) for j in range(n) for i in range(max(0, j - self.reach), j + 1)]
            if len(self.shapes) < 100_000:
                self.shapes[shape] = got
        return got

    def evidence(self, run: Run, spans: list, given: dict[int, float] | None = None) -> tuple[list[int], list | None]:
        """The hash of each span's text, and the spans with the scores of frequent values where these are higher (None if none is). Counts by the span's number (`given`) take the place of those held."""
        hashes = run.hashes(spans)
        if given is None:
            hot, held = self.hot, self.held
            given = {k: held[h] for k, h in enumerate(hashes) if hot[h % WIDTH] and hot[WIDTH + (h >> 32) % WIDTH] and h in held}
        out = None
        for k, n in given.items():
            i, j, score = spans[k]
            if (w := self.frequent(run.span(i, j), n)) > score:
                out = out or list(spans)
                out[k] = (i, j, w)
        return hashes, out


def best_split(n: int, spans: list, follows: float) -> list[tuple[int, int]]:
    """The likeliest split of n atoms (Viterbi); spans come in the order of their ends."""
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for i, j, score in spans:
        got = best[i] + score + (follows if i else 0.0)
        if got >= best[j + 1]:
            best[j + 1], back[j + 1] = got, i
    out, j = [], n
    while j:
        out.append((back[j], j - 1))
        j = back[j]
    return out[::-1]


def _plus(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def chances(n: int, spans: list, follows: float) -> list[tuple[int, int, int, float]]:
    """(number, i, j, probability) of each span that is at all likely, over all splits of n atoms (forward-backward)."""
    ahead, behind = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for i, j, score in spans:
        ahead[j + 1] = _plus(ahead[j + 1], ahead[i] + score + (follows if i else 0.0))
    for i, j, score in reversed(spans):
        behind[i] = _plus(behind[i], behind[j + 1] + score + (follows if i else 0.0))
    whole = ahead[n]
    all_ = ((k, i, j, math.exp(ahead[i] + score + (follows if i else 0.0) + behind[j + 1] - whole)) for k, (i, j, score) in enumerate(spans))
    return [x for x in all_ if x[3] > 1e-6]


def split_run(run: Run, model: Model, given: dict[int, float] | None = None) -> list[str]:
    """The values of a run; `given` as in `Model.evidence`."""
    n = len(run.bounds) // 2
    if n == 0:
        return [run.text]
    if n == 1:
        return [run.span(0, 0)]
    spans = model.spans(run.shape)
    known = model.evidence(run, spans, given)[1]
    return [run.span(i, j) for i, j in best_split(n, known or spans, model.follows)]


def split_field(field: str, lattice: Lattice, model: Model) -> list[str]:
    """The values of a field from left to right."""
    return [v for run in lattice.runs(field) for v in split_run(run, model) if v]


COUNTS = "kind string, key string, hash long, n double, marks int"
RUNS = "text string, bounds array<int>, shape string"


class Counts:
    """Sums of one task: forms, symbols, values by their hash (with the separators in them), values that stand first or follow."""

    def __init__(self) -> None:
        self.begin()

    def begin(self) -> None:
        self.sums: dict[tuple[str, str], float] = defaultdict(float)
        self.hashes, self.weights, self.marks = array("Q"), array("d"), array("i")

    def value(self, h: int, p: float, marks: int) -> None:
        """A value by its hash."""
        self.hashes.append(h)
        self.weights.append(p)
        self.marks.append(marks)

    def full(self) -> bool:
        return len(self.weights) > 500_000

    def batch(self) -> pa.RecordBatch:
        """The sums as rows of `COUNTS`; they begin anew after it."""
        hashes, at = np.unique(np.array(self.hashes, "uint64"), return_inverse=True)
        weights = np.bincount(at, weights=np.array(self.weights, float), minlength=len(hashes))
        marks = np.zeros(len(hashes), "int32")
        np.maximum.at(marks, at, np.array(self.marks, "int32"))
        keys = list(self.sums)
        columns = {
            "kind": pa.array([k for k, _ in keys] + ["v"] * len(hashes), pa.string()),
            "key": pa.array([x for _, x in keys] + [""] * len(hashes), pa.string()),
            "hash": pa.array(np.concatenate([np.zeros(len(keys), "int64"), hashes.view("int64")])),
            "n": pa.array(np.concatenate([np.array(list(self.sums.values()), dtype=float), weights])),
            "marks": pa.array(np.concatenate([np.zeros(len(keys), "int32"), marks])),
        }
        self.begin()
        return pa.RecordBatch.from_pydict(columns)


def _parse(lattice: Lattice) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Fields to runs of two or more atoms, and the counts of all values that can't be cut (Arrow)."""
    schema = pa.schema([("kind", pa.string()), ("key", pa.string()), ("hash", pa.int64()), ("n", pa.float64()), ("marks", pa.int32()), ("text", pa.string()), ("bounds", pa.list_(pa.int32())), ("shape", pa.string())])

    def filled(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if isinstance(columns.get(f.name), list) else columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def counted(counts: Counts) -> pa.RecordBatch:
        last = counts.batch()
        return filled(last.num_rows, **dict(zip(last.schema.names, last.columns, strict=True)))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.freeze()
        counts = Counts()
        for batch in batches:
            texts, bounds, shapes = [], [], []
            for field in batch.column("field").to_pylist():
                for run in lattice.runs(field):
                    n = len(run.bounds) // 2
                    if n > 1:
                        texts.append(run.text)
                        bounds.append(run.bounds)
                        shapes.append(run.shape)
                    elif n or run.text not in lattice.names:
                        value = run.span(0, 0) if n else run.text
                        form = form_of(value)[0]
                        counts.value(xxhash.xxh3_64_intdigest(value), 1.0, marks_of(form))
                        counts.sums["f", form] += 1.0
                        for c in form:
                            counts.sums["s", c] += 1.0
            yield filled(len(texts), kind=["run"] * len(texts), text=texts, bounds=bounds, shape=shapes)
            if counts.full():
                yield counted(counts)
        yield counted(counts)

    return step


def _runs_of(batch: pa.RecordBatch) -> Iterator[Run]:
    """The runs of a batch of `RUNS`."""
    column = batch.column("bounds")
    at, flat = column.offsets.to_pylist(), column.values.to_numpy().tolist()
    for text, lo, hi, shape in zip(batch.column("text").to_pylist(), at, at[1:], batch.column("shape").to_pylist(), strict=False):
        yield Run(text, flat[lo:hi], shape)


def _given(batch: pa.RecordBatch) -> list[dict[int, float] | None]:
    """The joined counts of each row by the number of the span; None where counts are held and not joined."""
    if "known" not in batch.schema.names:
        return [None] * batch.num_rows
    return [{x["span"]: x["n"] for x in own or ()} for own in batch.column("known").to_pylist()]


def _expect(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The E step: expected counts of the values of all splits of the runs (Arrow)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.freeze()  # what was imported needn't be looked through again and again
        counts = Counts()
        seen: dict[str, list] = {}  # shape -> its likely spans by form alone, runs: the same for all of a shape

        def add(shape: str, likely: list, times: float) -> None:
            parts = shape.split(JOINT)
            for _, i, j, p in likely:
                counts.sums["f", "".join(parts[2 * i : 2 * j + 1])] += p * times
                counts.sums["n", "after" if i else "first"] += p * times

        def flush() -> None:
            for shape, (likely, times) in seen.items():
                add(shape, likely, times)
            seen.clear()

        for batch in batches:
            for run, given in zip(_runs_of(batch), _given(batch), strict=True):
                n, spans = len(run.bounds) // 2, model.spans(run.shape)
                hashes, known = model.evidence(run, spans, given)
                if known is not None:
                    likely = chances(n, known, model.follows)
                    add(run.shape, likely, 1.0)
                else:
                    own = seen.get(run.shape)
                    if own is None:
                        own = seen[run.shape] = [chances(n, spans, model.follows), 0]
                    own[1] += 1
                    likely = own[0]
                    if len(seen) > 100_000:
                        flush()
                for k, i, j, p in likely:
                    counts.value(hashes[k], p, j - i)
            if counts.full():
                yield counts.batch()
        flush()
        yield counts.batch()

    return step


def _asked(model: Model, runs_of: Callable[[pa.RecordBatch], Iterator[list[Run]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The hashes of all spans of each row's runs, which are numbered from run to run (Arrow)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, spans, hashes = array("q"), array("i"), array("Q")
            for row, runs in zip(batch.column("row").to_pylist(), runs_of(batch), strict=True):
                n = 0
                for run in runs:
                    own = run.hashes(model.spans(run.shape)) if len(run.bounds) > 2 else []
                    rows.extend([row] * len(own))
                    spans.extend(range(n, n + len(own)))
                    hashes.extend(own)
                    n += len(own)
            yield pa.RecordBatch.from_pydict({"row": np.array(rows, "int64"), "span": np.array(spans, "int32"), "hash": np.array(hashes, "uint64").view("int64")})

    return step


def _recalled(df: DataFrame, model: Model, frequent: DataFrame, runs_of: Callable[[pa.RecordBatch], Iterator[list[Run]]]) -> DataFrame:
    """Rows (numbered by `row`) with the counts of their frequent spans, for tables of these that no task can hold."""
    found = df.mapInArrow(_asked(model, runs_of), "row long, span int, hash long").join(frequent, "hash").groupBy("row").agg(F.collect_list(F.struct("span", "n")).alias("known"))
    return df.join(found, "row", "left")


class Learnt:
    """The sums of one round. What comes to the driver is bounded: 1 / RARE forms, the symbols, `HELD` values."""

    def __init__(self, counts: DataFrame, held: int):
        sums = counts.groupBy("kind", "key", "hash").agg(F.sum("n").alias("n"), F.max("marks").alias("marks"))
        self.sums = cut(sums.where((F.col("kind") != "v") | (F.col("n") > DISCOUNT)))
        sizes = {r["kind"]: r for r in self.sums.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.max("marks").alias("marks")).collect()}
        self.total = sizes["f"]["n"] if "f" in sizes else 0.0
        self.table = self.sums.where("kind = 'v'").select("hash", "n")
        self.counts = None
        wanted = (F.col("kind") != "f") | (F.col("n") >= RARE * self.total)
        if "v" not in sizes or sizes["v"]["rows"] <= held:
            rows = self.sums.where(wanted).toPandas()
            values = rows[rows["kind"] == "v"].sort_values("hash")
            self.counts = values["hash"].to_numpy("int64").view("uint64"), values["n"].to_numpy(float)
        else:
            rows = self.sums.where(wanted & (F.col("kind") != "v")).toPandas()
        of = {kind: {k: float(n) for k, n in zip(own["key"], own["n"], strict=True)} for kind, own in rows.groupby("kind") if kind != "v"}
        self.forms, self.symbols = of.get("f", {}), of.get("s", {})
        first, after = (of.get("n", {}).get(k, 0.0) for k in ("first", "after"))
        self.model = Model(self.forms, after / max(1.0, first + after) if first else 0.5, None, self.symbols, self.total, self.counts, sizes["v"]["marks"] if "v" in sizes else 0)

    def moved(self, before: Learnt) -> float:
        """The larger one of the shares of all values that changed their form and that changed as frequent values."""
        a, b = max(self.total, 1.0), max(before.total, 1.0)
        forms = sum(abs(self.forms.get(f, 0.0) / a - before.forms.get(f, 0.0) / b) for f in {*self.forms, *before.forms})
        if forms >= SETTLED:
            return forms
        both = self.table.select("hash", (F.col("n") - DISCOUNT) / a).union(before.table.select("hash", (DISCOUNT - F.col("n")) / b)).toDF("hash", "n")
        return max(forms, both.groupBy("hash").agg(F.abs(F.sum("n")).alias("n")).agg(F.sum("n")).first()[0] or 0.0)


def learnt(fields: DataFrame, lattice: Lattice, rounds: int = 12, held: int = HELD) -> Learnt:
    """EM over the distinct fields (column `field`), until it settles or for so many rounds. Frequent values beyond `held` stay in their table."""
    parsed = cut(fields.mapInArrow(_parse(lattice), f"{COUNTS}, {RUNS}"))
    certain = cut(parsed.where("kind <> 'run'").groupBy("kind", "key", "hash").agg(F.sum("n").alias("n"), F.max("marks").alias("marks")))
    # each task gives its own counts: no more tasks than run at once
    runs = parsed.where("kind = 'run'").select(F.monotonically_increasing_id().alias("row"), "text", "bounds", "shape").coalesce(fields.sparkSession.sparkContext.defaultParallelism)
    now = Learnt(certain, held)
    for _ in range(rounds):
        known = runs if now.counts is not None else _recalled(runs, now.model, now.table, lambda batch: ([run] for run in _runs_of(batch)))
        before, now = now, Learnt(known.mapInArrow(_expect(now.model), COUNTS).union(certain), held)
        settled = now.moved(before) < SETTLED
        drop(before.sums)
        if settled:
            break
    drop(parsed)
    drop(certain)
    return now


def learn(fields: DataFrame, lattice: Lattice, rounds: int = 12) -> Model:
    """The model of `learnt`, for columns whose frequent values can be held."""
    last = learnt(fields, lattice, rounds)
    drop(last.sums)
    if last.counts is None:
        raise ValueError(f"the column has more than {HELD} frequent values; they must be joined (split_values)")
    return last.model


def split_values(df: DataFrame, column: str, authority: DataFrame | None = None, authority_column: str = "creator_name", out: str = "value", pos: str = "pos", rounds: int = 12, keep: list[str] | None = None, held: int = HELD) -> DataFrame:
    """One row per value of `column`: the kept columns of the row (`keep`, all others by default), `pos` from 0 and the value.

    Null and blank fields give no row; empty values aren't counted; a value that occurs twice comes twice. An authority
    table may hold 100,000 names at most (nulls and repeats in it are ignored). Existing columns named as `out` or `pos`
    are replaced. An empty table gives an empty one. More than `held` frequent values are joined, which changes no row.
    """
    names = [r[0] for r in bounded_rows(authority.select(authority_column), 100_000, "the authority list")] if authority is not None else []
    lattice = lattice_of(names)
    field: Column = F.col(f"`{column}`")
    full = df.where(field.isNotNull() & field.rlike(r"(?U)\S"))
    # few bytes, much computing: as many parts as the session shuffles into, whatever the size
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = full.select(field.alias("field")).distinct().repartition(parts)
    last = learnt(fields, lattice, rounds, held)
    model = last.model
    kept = [c for c in (keep if keep is not None else df.columns) if c not in (out, pos)]
    if last.counts is None:
        own = cut(fields).select(F.monotonically_increasing_id().alias("row"), "field")
        known = _recalled(own, model, last.table, lambda batch: (lattice.runs(f) for f in batch.column("field").to_pylist()))
        split_of = known.mapInArrow(_decoded(lattice, model), "__field string, __values array<string>")
        return full.join(split_of, field == F.col("__field")).select(*[F.col(f"`{c}`") for c in kept], F.posexplode("__values").alias(pos, out))
    drop(last.sums)
    shared = df.sparkSession.sparkContext.broadcast((lattice, model))

    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own_lattice, own_model = shared.value
        gc.freeze()
        cache: dict[str, list[str]] = {}
        for batch in batches:
            if len(cache) > 50_000:
                cache.clear()
            got = []
            for field in batch:
                values = cache.get(field)
                if values is None:
                    values = cache[field] = split_field(field, own_lattice, own_model)
                got.append(values)
            yield pd.Series(got)

    split = F.pandas_udf(decode, "array<string>")
    return full.select(*[F.col(f"`{c}`") for c in kept], F.posexplode(split(field)).alias(pos, out))


def _decoded(lattice: Lattice, model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Fields with the joined counts of their spans to their values (Arrow)."""

    def values(field: str, given: dict[int, float]) -> list[str]:
        out, n = [], 0
        for run in lattice.runs(field):
            size = len(model.spans(run.shape)) if len(run.bounds) > 2 else 0
            out += [v for v in split_run(run, model, {k: given[n + k] for k in range(size) if n + k in given}) if v]
            n += size
        return out

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = batch.column("field").to_pylist()
            split = [values(f, g) for f, g in zip(fields, _given(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(fields, pa.string()), pa.array(split, pa.list_(pa.string()))], names=["__field", "__values"])

    return step
