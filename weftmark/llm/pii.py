"""Personal data: rule spans, and candidate spans chosen by gradient-boosted trees (operator 9)."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, lean, slices, small_batches, table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def emails(text: str) -> list[Span]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, in time linear in the text.

    A match begins where the run of local characters before its @ begins, or where the match before ends.
    """
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            end = m.end()
        else:
            end = at + 1  # no local character reaches over an @
        at = text.find("@", max(end, at + 1))
    return out


def base_spans(text: str) -> dict[str, list[Span]]:
    """The rule spans of each kind: leftmost matches that do not overlap, less those that fail their check."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if _DIGIT.search(text):
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        found["card"] = [m.span() for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


#: Generators of high recall; they overlap each other and the rules.
_AT = re.compile(r"(?:\s?[\[({]\s?at\s?[\])}]\s?|\sat\s|\s?@\s?)(?=[A-Za-z0-9-]{1,63}(?:\.|\sdot\s|\s?[\[({]\s?dot))", re.I)
_BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
_AFTER_AT = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.|\sdot\s|\s?[\[({]\s?dot\s?[\])}]\s?)[A-Za-z0-9-]{1,63})+", re.I)
_LIKE = {
    "ip": re.compile(r"(?<![0-9])[0-9]{1,4}(?:(?:[.,: -]| ?[\[({](?:\.|dot)[\])}] ?)[0-9]{1,4}){3}(?![0-9])", re.I),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ ./-]?[0-9]){11,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+(])[+(]{0,2}[0-9](?:[ ()./-]{0,2}[0-9]){6,15}(?![0-9])"),
}
_HINTS = {
    "email": re.compile(r"mail|contact|write|correo|courriel|kontakt|@", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|addr|login|adresse", re.I),
    "card": re.compile(r"card|visa|credit|pay|karte|tarjeta|carte", re.I),
    "phone": re.compile(r"phone|tel|call|fax|mobile|telefon|llame|appel|\+", re.I),
}


def candidates(text: str) -> list[tuple[str, int, int]]:
    out = []
    for m in _AT.finditer(text):
        before = _BEFORE_AT.search(text, max(0, m.start() - 64), m.start())
        after = _AFTER_AT.match(text, m.end())
        if before and after:
            out.append(("email", before.start(), after.end()))
    if _DIGIT.search(text):
        for kind, pattern in _LIKE.items():
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return out


def rewritten(kind: str, span: str) -> tuple[list[str], list[str]]:
    """(forms in which writers hide or shorten a rule span, like forms of what is none), all of them found by the generators."""
    digits = _digits(span)
    if kind == "email":
        name, domain = span.split("@", 1)
        hidden = [f"{name} at {domain.replace('.', ' dot ')}", f"{name} [at] {domain.replace('.', ' [dot] ')}", f"{name}(at){domain.replace('.', '(dot)')}", f"{name}[at]{domain}", f"{name} @ {domain}"]
        return hidden, [f"{word} at {domain}" for word in ("look", "sold", "visit", "was")]
    if kind == "ip":
        parts = span.split(".")
        wrong = [str(int(parts[-1]) + 300), *parts[1:]]
        return [mark.join(parts) for mark in ("[.]", "(.)", "[dot]", " [.] ")], [mark.join(wrong) for mark in ("[.]", "(.)", ".", "[dot]")] + [mark.join(parts) for mark in (",", ":", " ", "-")]
    if kind == "card":
        groups = lambda d, mark: mark.join(d[i : i + 4] for i in range(0, len(d), 4))
        wrong = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        return [groups(digits, mark) for mark in ("./" if len(digits) % 4 != 1 else ".")], [groups(wrong, mark) for mark in ("", " ", "-", ".", "/")]
    area, middle, last = digits[-10:-7], digits[-7:-4], digits[-4:]
    hidden = [span[1:], f"00{span[1:]}", f"({digits[:-7][-4:]}) {middle}-{last}"] + ([f"{area}-{middle}-{last}", f"{area}.{middle}.{last}"] if len(area) == 3 else [])
    return hidden, [digits, digits[:9], f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}", f"{digits[:3]}.{digits[3:]}", f"{digits[:4]}/{digits[4:]}"]


def refuted(text: str, kind: str, start: int, end: int) -> bool:
    """Whether a candidate that no rule takes is a counterexample: it fails its kind's check, or stands in a number or identifier."""
    span, digits = text[start:end], _digits(text[start:end])
    if kind == "email":
        return " at " in span.lower() and "." in span and "dot" not in span.lower()
    if kind == "card":
        return not (13 <= len(digits) <= 19 and luhn(digits))
    if kind == "ip":
        return any(int(g) > 255 for g in re.findall(r"[0-9]+", span))
    return not 9 <= len(digits) <= 15 or text[max(0, start - 1) : start].isalnum() or text[end : end + 1].isalnum() or text[max(0, start - 1) : start] in tuple("#$%&*=_\"'")


def examples(text: str) -> list[tuple[bool, list[float]]]:
    """(whether it is one, features) of what a text teaches: its rule spans as they are and rewritten where they stand, and counterexamples."""
    base = base_spans(text)
    taken, known = Taken(s for spans in base.values() for s in spans), {k: set(v) for k, v in base.items()}
    out = []
    for kind, start, end in candidates(text):
        if (start, end) in known[kind]:
            out.append((True, describe(text, kind, start, end)))
        elif not taken.meets(start, end) and refuted(text, kind, start, end):
            out.append((False, describe(text, kind, start, end)))
    for kind, spans in base.items():
        for start, end in spans:
            before, after = text[max(0, start - 64) : start], text[end : end + 64]
            for good, forms in zip((True, False), rewritten(kind, text[start:end])):
                for form in forms:
                    window, place = before + form + after, (len(before), len(before) + len(form))
                    if (kind, *place) in candidates(window):
                        out.append((good, describe(window, kind, *place)))
    return out


FEATURE_NAMES = (
    *(f"is_{k}" for k in KINDS), "length", "digits", "letters", "separators", "kinds_of_separators", "groups", "shortest_group", "longest_group", "last_group", "repeated_digits",
    "largest_part", "plus", "parenthesis", "letter_before", "digit_near", "letter_after", "mark_near", "hint_before", "hint_after", "other_hint", "words_in", "dots",
    "luhn", "parts_to_255", "dot_word", "brackets",
)


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate; whether a rule takes it is not among them."""
    span, before, after = text[start:end], text[max(0, start - 32) : start], text[end : end + 32]
    groups = re.findall(r"[0-9]+", span)
    sizes = [len(g) for g in groups] or [0]
    seps = re.findall(r"[^A-Za-z0-9]", span)
    digits = sum(sizes)
    return [
        *(float(kind == k) for k in KINDS), end - start, digits, sum(c.isalpha() for c in span), len(seps), len(set(seps)), len(groups), min(sizes), max(sizes), sizes[-1], digits - len(set(_digits(span))),
        max((int(g[:6]) for g in groups), default=0), float(span[0] == "+"), float("(" in span), float(before[-1:].isalpha()), float(bool(_DIGIT.search(before[-3:] + after[:3]))), float(after[:1].isalpha()), float(before[-1:] in "#$%&*=_" and before != ""),
        float(bool(_HINTS[kind].search(before))), float(bool(_HINTS[kind].search(after))), float(any(p.search(before) for k, p in _HINTS.items() if k != kind)), len(re.findall(r"[A-Za-z]+", span)), span.count("."),
        float(13 <= digits <= 19 and luhn("".join(groups))), float(len(groups) == 4 and all(int(g) <= 255 for g in groups)), float(" dot " in span.lower()), float(any(c in span for c in "[({")),
    ]


#: Gradients are whole multiples of one part in so many, so that sums over tasks don't depend on the order of adding.
UNIT = 1 << 20
#: Thresholds are whole multiples of one part in so many.
CELLS = 1 << 16


class Part:
    """Distinct examples, with how many each stands for and how many of those are good; keeps their scores by the trees so far."""

    def __init__(self, x: np.ndarray, good: np.ndarray, n: np.ndarray):
        self.x, self.good, self.n = x, good, n
        self.bins: np.ndarray | None = None
        self.score, self.done = np.zeros(0), 0

    def scored(self, trees: BoostedTrees) -> np.ndarray:
        if self.bins is None:
            self.bins, self.score = trees.binned(self.x), np.full(len(self.x), trees.start)
        for feature, cut, values in trees.nodes[self.done :]:
            self.score += values[trees.leaf(self.bins, feature, cut, trees.depth)]
        self.done = len(trees.nodes)
        return self.score


Sums = tuple[np.ndarray, np.ndarray, np.ndarray]  # keys, and for each key two sums of whole numbers
#: Of a function that gives the sums of a part: the sums over all parts, by distinct keys.
Totals = Callable[[Callable[[Part], Sums]], Sums]


@dataclass
class BoostedTrees:
    """Gradient boosting of the logistic loss: trees of `depth` levels on binned features, one split a node."""

    depth: int = 3
    trees: int = 60
    rate: float = 0.2
    edges: list[np.ndarray] = field(default_factory=list)
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, bin, leaf values
    start: float = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape, np.uint8)
        for i, e in enumerate(self.edges):
            out[:, i] = np.searchsorted(e, x[:, i], side="left")
        return out

    @staticmethod
    def leaf(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row reaches after so many levels, from 0 on among those of its level."""
        at, rows = np.zeros(len(bins), int), np.arange(len(bins))
        for _ in range(levels):
            at = 2 * at + 1 + (bins[rows, feature[at]] > cut[at])
        return at - ((1 << levels) - 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, 33)[1:-1])) for i in range(x.shape[1])]
        part = Part(x, y, np.ones(len(y)))
        return self.grow(lambda sums: sums(part))

    def grow(self, totals: Totals) -> BoostedTrees:
        """Fit on all examples behind `totals`, which are binned by `edges`; each level of a tree is one pass over them."""
        width, features = 33, len(self.edges)
        _, good, n = totals(lambda part: (np.zeros(1, int), np.array([part.good.sum()]), np.array([part.n.sum()])))
        p = float(np.clip(good.sum() / n.sum(), 1e-3, 1 - 1e-3))
        self.start = float(np.log(p / (1 - p)))

        def slopes(feature: np.ndarray, cut: np.ndarray, level: int) -> Callable[[Part], Sums]:
            def sums(part: Part) -> Sums:
                prob = 1 / (1 + np.exp(-part.scored(self)))
                g, h = part.good * UNIT - part.n * np.rint(prob * UNIT), part.n * np.rint(prob * (1 - prob) * UNIT)
                at, size = self.leaf(part.bins, feature, cut, level) * width, width << level
                gs, hs = (np.stack([np.bincount(at + part.bins[:, f], w, size) for f in range(features)]).reshape(-1) for w in (g, h))
                keys = np.flatnonzero(hs + np.abs(gs))
                return keys, gs[keys], hs[keys]

            return sums

        for _ in range(self.trees):
            feature, cut = np.zeros((1 << self.depth) - 1, int), np.full((1 << self.depth) - 1, width)
            values = np.zeros((0, 2))
            for level in range(self.depth):
                first, count = (1 << level) - 1, 1 << level
                keys, *sums = totals(slopes(feature, cut, level))
                gs, hs = np.zeros((2, features * count * width))
                gs[keys], hs[keys] = sums[0] / UNIT, sums[1] / UNIT
                # by node, feature and bin
                gs, hs = (s.reshape(features, count, width).swapaxes(0, 1).cumsum(axis=2) for s in (gs, hs))
                gain = gs**2 / (hs + 1) + (gs[:, :, -1:] - gs) ** 2 / (hs[:, :, -1:] - hs + 1) - gs[:, :, -1:] ** 2 / (hs[:, :, -1:] + 1)
                gain = gain.reshape(count, -1)
                top, own = gain.argmax(axis=1), np.arange(count)
                better = gain[own, top] > 1e-6
                f, b = np.where(better, top // width, 0), np.where(better, top % width, width)
                feature[first : first + count], cut[first : first + count] = f, b
                left = [s[own, f, np.minimum(b, width - 1)] for s in (gs, hs)]
                sides = [np.stack([part, s[:, 0, -1] - part], axis=1) for part, s in zip(left, (gs, hs))]
                values = self.rate * sides[0] / (sides[1] + 1)
            self.nodes.append((feature, cut, values.reshape(-1)))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of each row."""
        return 1 / (1 + np.exp(-Part(x, np.zeros(0), np.zeros(0)).scored(self)))


@dataclass
class PiiModel:
    trees: BoostedTrees | None
    thresholds: dict[str, float]  # of each kind; above 1: nothing is added

    def added(self, text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
        """Candidates over their kind's threshold that overlap no rule span nor a better candidate."""
        out: dict[str, list[Span]] = {k: [] for k in KINDS}
        if not self.trees or min(self.thresholds.values()) > 1:
            return out
        taken = Taken(s for spans in base.values() for s in spans)
        open_ = [c for c in candidates(text) if not taken.meets(c[1], c[2])]
        if not open_:
            return out
        scores = self.trees.predict(np.array([describe(text, *c) for c in open_], dtype=float))
        for _, (kind, start, end) in sorted(((-s, c) for s, c in zip(scores, open_) if s >= self.thresholds[c[0]])):
            if not taken.meets(start, end):
                out[kind].append((start, end))
                taken.add(start, end)
        return out


class Taken:
    """Spans taken so far, merged where they meet, so that a lookup is a binary search."""

    def __init__(self, spans: Iterable[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return i < len(self.starts) and self.starts[i] < end

    def add(self, start: int, end: int) -> None:
        """Take a span that meets none."""
        i = bisect_right(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def _taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """test, x (features as 32-bit integers), good, n: the distinct examples of each slice of the texts."""
    for batch in (part for whole in batches for part in slices(whole, "text")):
        counts: dict[tuple[bool, bytes], list[int]] = {}
        for test, text in zip(batch.column("test").to_pylist(), batch.column("text").to_pylist()):
            for good, x in examples(text) if text else ():
                of = counts.setdefault((test, np.array(x, dtype="<i4").tobytes()), [0, 0])
                of[0] += good
                of[1] += 1
        columns = zip(*((*key, *of) for key, of in counts.items())) if counts else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.bool_(), pa.binary(), pa.int64(), pa.int64()))], names=["test", "x", "good", "n"])


def _part(batches: list[pa.RecordBatch]) -> Part:
    held = pa.Table.from_batches(batches)
    x = np.frombuffer(b"".join(held.column("x").to_pylist()), dtype="<i4").reshape(-1, len(FEATURE_NAMES))
    return Part(x, held.column("good").to_numpy().astype(float), held.column("n").to_numpy().astype(float))


def _totals(rows: DataFrame, most_held: int) -> Totals:
    """Totals over a stored table of examples: held by the driver if it has up to `most_held` rows, else a Spark job for each."""
    if rows.count() <= most_held:
        part = _part(rows.toArrow().to_batches() or [pa.RecordBatch.from_pylist([], pa.schema([("x", pa.binary()), ("good", pa.int64()), ("n", pa.int64())]))])
        return lambda sums: sums(part)

    def totals(sums: Callable[[Part], Sums]) -> Sums:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for batch in chain(batches, [None]):
                if batch is not None:
                    held.append(batch)
                    size += batch.num_rows
                if size and (batch is None or size >= 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in sums(_part(held))], names=["key", "a", "b"])
                    held, size = [], 0

        summed = rows.mapInArrow(run, "key long, a long, b long").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
        return tuple(summed.column(c).to_numpy() for c in ("key", "a", "b"))

    return totals


def _values(part: Part) -> Sums:
    """How often each feature has each value: keys feature * 2^32 + value."""
    found = [np.unique(column, return_inverse=True) for column in part.x.T]
    keys = np.concatenate([(i << 32) + values.astype(np.int64) for i, (values, _) in enumerate(found)])
    n = np.concatenate([np.bincount(at, part.n, len(values)) for values, at in found])
    return keys, n, np.zeros(len(n))


def quantiles(values: np.ndarray, n: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """As np.quantile of the values, each repeated n times."""
    order = np.argsort(values)
    values, ends = values[order], np.cumsum(n[order])
    place = shares * (ends[-1] - 1)
    low, high = (values[np.searchsorted(ends, at, side="right")] for at in (np.floor(place), np.ceil(place)))
    return low + (high - low) * (place - np.floor(place))


def train(docs: DataFrame, least_precision: float = 0.99, id_col: str = "doc_id", text_col: str = "text", most_held: int = 300_000) -> PiiModel:
    """Fit on all examples of all documents, read whole.

    Examples are rule spans, and the same spans rewritten in their place into the forms that rules miss; counterexamples are
    candidates and rewritten spans that fail a check of their kind or stand in a number or identifier. What is neither
    teaches nothing. Four fifths of the documents, by a hash of the id, teach the bins and trees; on all others each kind's threshold
    is set to the least of CELLS steps from which on the share of examples is at least `least_precision`. A kind without such a
    step, or with under ten held-out examples over it, adds nothing. Null texts teach nothing; without rows nothing is added.

    Equal examples are stored as one with its counts. Up to `most_held` of them are held by the driver; beyond, each pass of the
    fit is a Spark job over the stored table, with the same model: all sums are of whole numbers.
    """
    nothing = PiiModel(None, dict.fromkeys(KINDS, 2.0))
    small_batches(docs.sparkSession)
    space = Workspace(docs.sparkSession, "pii")
    place = F.pmod(F.xxhash64(F.lit(17), F.col(id_col)), F.lit(1_000_000))
    texts = docs.select((place % 5 == 0).alias("test"), F.col(text_col).cast("string").alias("text"))
    found = texts.mapInArrow(lean(_taught), "test boolean, x binary, good long, n long").groupBy("test", "x").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    rows = space.write(found, "examples", "snappy")
    teaching, held_out = (_totals(rows.where(side).select("x", "good", "n"), most_held) for side in ("NOT test", "test"))
    _, good, n = teaching(lambda part: (np.zeros(1, int), np.array([part.good.sum()]), np.array([part.n.sum()])))
    if not 0 < good.sum() < n.sum():
        space.drop("examples")
        return nothing
    keys, times, _ = teaching(_values)
    shares = np.linspace(0, 1, 33)[1:-1]
    trees = BoostedTrees(edges=[np.unique(quantiles(keys[own] - (i << 32), times[own], shares)) for i in range(len(FEATURE_NAMES)) for own in [keys >> 32 == i]]).grow(teaching)

    def cells(part: Part) -> Sums:
        at = part.x[:, : len(KINDS)].argmax(axis=1) * (CELLS + 1) + (CELLS / (1 + np.exp(-part.scored(trees)))).astype(int)
        good, n = (np.bincount(at, w, len(KINDS) * (CELLS + 1)) for w in (part.good, part.n))
        seen = np.flatnonzero(n)
        return seen, good[seen], n[seen]

    keys, good, n = held_out(cells)
    space.drop("examples")
    thresholds = {}
    for i, kind in enumerate(KINDS):
        own = np.flatnonzero(keys // (CELLS + 1) == i)
        own = own[np.argsort(-keys[own])]
        above = np.cumsum(n[own])
        fit = np.flatnonzero(np.cumsum(good[own]) >= least_precision * above)
        thresholds[kind] = float(max(keys[own][fit[-1]] % (CELLS + 1) / CELLS, 0.5)) if len(fit) and above[fit[-1]] >= 10 else 2.0
    return PiiModel(trees, thresholds)


def _joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def find(docs: DataFrame, model: PiiModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (rule spans), base_sha256, spans, n_added of each row.

    Null texts count as empty: no spans. Null ids stay, repeated rows give repeated rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in (part for whole in batches for part in slices(whole, "text")):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                base = base_spans(text or "")
                more = model.added(text or "", base)
                both = {k: base[k] + more[k] for k in KINDS}
                rows.append((doc, *(len(base[k]) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(both), sum(map(len, more.values()))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()])], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, model: PiiModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, with each span, or run of spans that overlap, replaced by its first kind in brackets.

    Null texts stay null, empty ones empty; null ids stay, repeated rows give repeated rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def cover(text: str) -> str:
        base = base_spans(text)
        more = shared.value.added(text, base)
        out, end = [], 0
        for start, stop, kind in sorted((a, b, k) for k in KINDS for a, b in base[k] + more[k]):
            if start >= end:
                out += [text[end:start], f"[{kind}]"]
            end = max(end, stop)
        return "".join([*out, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [t and cover(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document, by rules and by trees that learn from what the rules find."""
    docs = table(spark, sf_dir, "documents")
    return find(docs, train(docs))
