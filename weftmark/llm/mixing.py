"""Mixing documents to target token totals of soft domains, with built-in functions only (operator 6)."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, table

WORD = r"[^\x20\x09-\x0D]+"
#: What the classifier reads beside words, and the edges of the bins it is counted in: the shares of marks and of capital
#: letters among the characters, and the logarithm of different words over that of all words (1: no word comes twice).
SHARES = {
    "marks": (0.001, 0.01, 0.03, 0.1),
    "capitals": (0.005, 0.02, 0.05, 0.1, 0.3),
    "variety": (0.2, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
}
#: A word marks a domain if it is so many times as frequent there as elsewhere; only marks have weights.
MARKS = 3.0
#: A mark's weight shrinks by this over its log-likelihood ratio statistic, to nothing for what chance explains.
CHANCE = 25.0
#: Weight of the targets against staying at rate one: totals miss a target by this share of all tokens for each unit by which
#: the rates of its documents move.
PULL = 1e-4


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _constants(values: Sequence[str], kind: str = "string") -> Column:
    """An array that is one literal once the plan is optimised."""
    return F.split(F.lit("\x1f".join(values)), "\x1f").cast(f"array<{kind}>")


def _words(text: Column) -> Column:
    """The runs of letters and digits of the lower-cased text, with repeats."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _bin_of(edges: Sequence[float]) -> Callable[[Column], Column]:
    return lambda value: sum(((value >= F.lit(e)).cast("int") for e in edges), F.lit(0))


def _bins(text: Column, words: Column, distinct: Column) -> Column:
    """array<int>: the bin of each of SHARES."""
    size = F.greatest(F.length(text), F.lit(1))
    total = F.greatest(F.size(words), F.lit(1))
    variety = F.when(total > 1, F.log(F.greatest(F.size(distinct), F.lit(1)).cast("double")) / F.log(total.cast("double"))).otherwise(F.lit(1.0))
    values = {"marks": F.regexp_count(text, F.lit("[!#$%&*|]")) / size, "capitals": F.regexp_count(text, F.lit("[A-Z]")) / size, "variety": variety}
    return F.array(*(_let(values[n], _bin_of(edges)) for n, edges in SHARES.items()))


def _features(text: Column) -> Column:
    """struct(words: the different words of a text, bins)."""
    return _let(_words(text), lambda w: _let(F.array_distinct(w), lambda d: F.struct(d.alias("words"), _bins(text, w, d).alias("bins"))))


@dataclass
class DomainModel:
    """Naive Bayes: weights of the words that mark a domain, and log-likelihoods of the bins of SHARES."""

    domains: list[str]
    start: list[float] = field(default_factory=list)  # log prior, and what a document without any mark has, by domain
    telling: list[str] = field(default_factory=list)
    words: list[list[float]] = field(default_factory=list)  # what each telling word adds, by domain
    bins: list[list[list[float]]] = field(default_factory=list)  # by domain and share: the log-likelihood of each bin

    def posterior(self, text: Column) -> Column:
        """array<double> of the text: the probability of each domain."""
        if len(self.domains) == 1:
            return F.array(F.lit(1.0))
        telling, width = _constants(self.telling or [""]), len(self.telling) or 1
        # one literal of all weights: those of domain i begin at i * width
        weights = _constants([f"{w:.9g}" for own in (self.words if self.telling else [[0.0]] * len(self.domains)) for w in own], "double")

        def log(i: int, bins: Column, places: Column) -> Column:
            value = F.aggregate(places, F.lit(self.start[i]), lambda a, p: a + F.get(weights, p + F.lit(i * width - 1).cast("bigint")))
            for s, own in enumerate(self.bins[i]):
                value = value + F.get(F.array(*map(F.lit, own)), F.get(bins, F.lit(s)))
            return value

        def scored(f: Column) -> Column:
            places = F.transform(F.array_intersect(f["words"], telling), lambda w: F.array_position(telling, w))
            return _let(places, lambda p: F.array(*(log(i, f["bins"], p) for i in range(len(self.domains)))))

        def softmax(logs: Column) -> Column:
            powers = F.transform(logs, lambda x: F.exp(F.greatest(x - F.array_max(logs), F.lit(-700.0))))
            return _let(powers, lambda ps: _let(F.aggregate(ps, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(ps, lambda p: p / total)))

        return _let(_let(_features(text), scored), softmax)


def train(docs: DataFrame, labels: DataFrame, most: int = 12_000, id_col: str = "doc_id", text_col: str = "text", space: Workspace | None = None) -> DomainModel:
    """Fit on about `most` labelled documents (those with the smallest hash of their id), read whole.

    Domains are the values of (quality, toxic) that the labels hold; rows with a null label, id or text teach nothing; of
    an id with several labels the least domain by name counts. A document counts once for each of its words. A word has a weight
    where it marks a domain: at least MARKS times as frequent there as elsewhere, shrunk by CHANCE. Lacking a mark counts
    only if the domain has most of the word's documents and MARKS times its own share of all documents, for a text in another
    language lacks what is common in the largest domain. Without labels there is one domain, `all`.
    """
    space = space or Workspace(docs.sparkSession, "mixing-train")
    name = F.concat(F.lit("quality"), F.col("quality").cast("string"), F.lit("_toxic"), F.col("toxic").cast("string"))
    known = labels.where("quality IS NOT NULL AND toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("labelled"), name.alias("domain")).groupBy("labelled").agg(F.min("domain").alias("domain"))
    total = known.count()
    if not total:
        return DomainModel(["all"])
    grid = 1_000_000
    known = known.where(F.pmod(F.xxhash64(F.lit(5), "labelled"), F.lit(grid)) < min(grid, -(-grid * most // total)))  # about `most` rows: fit to broadcast
    rows = docs.select(F.col(id_col).alias("labelled"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    sample = space.write(rows.join(F.broadcast(known), "labelled").select("domain", _features(F.col("text")).alias("f")).select("domain", "f.*"), "sample", "snappy")
    n = {r.domain: r.n for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}  # a row a domain
    domains, every = sorted(n), sum(n.values())
    if not domains:
        return DomainModel(["all"])
    seen = sample.select("domain", F.posexplode("bins").alias("share", "bin")).groupBy("domain", "share", "bin").count()
    counted = {(r.domain, r.share, r.bin): r["count"] for r in seen.collect()}  # a row a domain and bin at most
    bins = []
    for d in domains:
        own = [[counted.get((d, s, b), 0) + 0.5 for b in range(len(edges) + 1)] for s, edges in enumerate(SHARES.values())]
        bins.append([[math.log(c / sum(row)) for c in row] for row in own])

    def surprise(count: Column, expected: Column) -> Column:
        return F.when(count > 0, count * F.log(count / expected)).otherwise(F.lit(0.0))

    held = [F.count_if(F.col("domain") == d).cast("double").alias(f"n{i}") for i, d in enumerate(domains)]
    counts = sample.select("domain", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").cast("double").alias("all"), *held).where(F.col("all") >= 3)
    for i, d in enumerate(domains):
        here, there, inside, outside = F.col(f"n{i}"), F.col("all") - F.col(f"n{i}"), float(n[d]), float(every - n[d])
        p, q = (here + 0.5) / (inside + 1), (there + 0.5) / (outside + 1)
        share = F.col("all") / every
        statistic = 2 * (surprise(here, share * inside) + surprise(there, share * outside) + surprise(inside - here, (1 - share) * inside) + surprise(outside - there, (1 - share) * outside))
        shrink = F.when((p >= MARKS * q) & (statistic > CHANCE), 1 - CHANCE / statistic).otherwise(F.lit(0.0))
        counts = counts.withColumns({f"w{i}": shrink * F.log(p / q), f"a{i}": F.when((here > there) & (here * every > MARKS * inside * F.col("all")), shrink * F.log((1 - p) / (1 - q))).otherwise(F.lit(0.0))})
    marks = counts.where(F.greatest(F.lit(0.0), *(F.col(f"w{i}") for i in range(len(domains)))) > 0)  # few: all others have no weight
    telling, words, absent = [], [[] for _ in domains], [0.0] * len(domains)
    for r in sorted(marks.select("word", *(f"{c}{i}" for c in "wa" for i in range(len(domains)))).collect()):
        telling.append(r.word)
        for i in range(len(domains)):
            words[i].append(r[f"w{i}"] - r[f"a{i}"])
            absent[i] += r[f"a{i}"]
    start = [math.log((n[d] + 0.5) / (every + 0.5 * len(domains))) + a for d, a in zip(domains, absent)]
    return DomainModel(domains, start, telling, words, bins)


def rate_of(posterior: Column, move: Sequence[float], cap: float) -> Column:
    """The rate of a document: one, moved against the gradient as far as its posterior says, projected on 0 .. cap."""
    ahead = F.lit(1.0)
    for i, m in enumerate(move):
        ahead = ahead - F.get(posterior, F.lit(i)) * F.lit(float(m))
    return F.least(F.greatest(ahead, F.lit(0.0)), F.lit(float(cap)))


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Of a small positive definite system, by elimination."""
    k, rows = len(right), [[*r, b] for r, b in zip(matrix, right)]
    for i in range(k):
        at = max(range(i, k), key=lambda j: abs(rows[j][i]))
        rows[i], rows[at] = rows[at], rows[i]
        for j in range(i + 1, k):
            f = rows[j][i] / rows[i][i]
            rows[j] = [a - f * b for a, b in zip(rows[j], rows[i])]
    out = [0.0] * k
    for i in reversed(range(k)):
        out[i] = (rows[i][k] - sum(rows[i][j] * out[j] for j in range(i + 1, k))) / rows[i][i]
    return out


def fit_rates(scored: DataFrame, targets: Sequence[float], cap: float = 8.0, most_steps: int = 60, tolerance: float = 1e-7) -> tuple[list[float], list[float], int]:
    """Projected-gradient steps to the rates with the target totals: (move, totals reached, steps).

    Minimises, over rates in 0 .. cap, the squares by which expected totals, sum(rate * tokens * posterior), miss the targets, over
    PULL times all tokens, plus tokens * (rate - 1)^2 of each document. The second part makes the solution unique and free of
    extreme rates. The gradient of a document's rate depends on the document by its posterior alone, so what all steps add up
    to is one number a domain, the `move`, and a rate is the projection of 1 - posterior . move: nothing is stored between steps
    and no step replays those before. Each step is one pass that sums totals and the curvature of the
    documents whose rates are inside the bounds; the curvature scales the gradient, and a step is halved until it
    descends. Ends when the gradient is within `tolerance` of all tokens; that it does is certain for a strictly convex problem, so
    not ending within `most_steps` passes is an error.
    """
    k = len(targets)

    def at(move: list[float]) -> tuple[float, list[float], list[list[float]], list[float]]:
        """What the steps descend on, its gradient and curvature, and the totals."""
        rows = scored.select("tokens", *(F.get("posterior", F.lit(i)).alias(f"p{i}") for i in range(k)), rate_of(F.col("posterior"), move, cap).alias("r"))
        weight, free = F.col("tokens").cast("double"), ((F.col("r") > 0) & (F.col("r") < cap)).cast("double")
        ahead = sum((F.col(f"p{i}") * float(m) for i, m in enumerate(move)), F.lit(0.0))
        sums = [F.sum(weight * F.col("r") * F.col(f"p{i}")).alias(f"t{i}") for i in range(k)]
        sums += [F.sum(weight * free * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]
        row = rows.agg(F.sum(weight).alias("all"), F.sum(weight * (-F.col("r") * ahead - F.pow(F.col("r") - 1, 2) / 2)).alias("value"), *sums).first()
        size = PULL * max(1.0, row["all"] or 0.0)
        totals = [row[f"t{i}"] or 0.0 for i in range(k)]
        value = (row["value"] or 0.0) + sum(size * m * m / 2 + m * t for m, t in zip(move, targets))
        gradient = [size * m + t - r for m, t, r in zip(move, targets, totals)]
        curve = [[(row[f"m{min(i, j)}_{max(i, j)}"] or 0.0) + size * (i == j) for j in range(k)] for i in range(k)]
        return value, gradient, curve, totals

    move, passes = [0.0] * k, 1
    value, gradient, curve, totals = at(move)
    size = max(1.0, sum(targets), sum(totals))
    while max(map(abs, gradient), default=0.0) > tolerance * size:
        step, part = _solve(curve, gradient), 1.0
        slope = sum(g * s for g, s in zip(gradient, step))
        while True:
            if passes == most_steps:
                raise RuntimeError(f"rates did not settle in {most_steps} passes: totals {totals} for targets {list(targets)}")
            ahead = [m - part * s for m, s in zip(move, step)]
            found, passes = at(ahead), passes + 1
            if found[0] <= value - 1e-4 * part * slope + 1e-12 * size or max(map(abs, found[1])) <= tolerance * size:
                break
            part /= 2
        move, (value, gradient, curve, totals) = ahead, found
    return move, totals, passes


@dataclass
class Mix:
    """A fitted mix: how rows get their rates, and for each domain its tokens before, its target, and its expected tokens after."""

    model: DomainModel
    move: list[float]
    cap: float
    had: list[float]
    targets: list[float]
    reached: list[float]
    scored: DataFrame

    def missed(self, share: float = 0.01) -> dict[str, tuple[float, float]]:
        """(target, reached) of the domains that are off by over `share` of all tokens: what rates in 0 .. cap can't reach."""
        size = share * max(1.0, sum(self.had))
        return {d: (t, r) for d, t, r in zip(self.model.domains, self.targets, self.reached) if abs(t - r) > size}

    def domain(self, posterior: Column) -> Column:
        """The likeliest domain; of several, the first by name."""
        return F.get(_constants(self.model.domains), (F.array_position(posterior, F.array_max(posterior)) - 1).cast("int"))

    def rate(self, posterior: Column) -> Column:
        return rate_of(posterior, self.move, self.cap)

    def copies(self, rate: Column, row_id: Column) -> Column:
        """The rate rounded up or down at random by a hash of the id."""
        chance = F.pmod(F.xxhash64(F.lit(3), row_id), F.lit(1_000_003)) / F.lit(1_000_003.0)
        return F.floor(rate + chance)

    def decide(self, text: Column, row_id: Column, body: Callable[[Column, Column], Column]) -> Column:
        """body(domain, copies) of a row from its own text and id, without any join."""
        text = F.coalesce(text.cast("string"), F.lit(""))
        return _let(self.model.posterior(text), lambda p: body(self.domain(p), self.copies(self.rate(p), row_id)))

    def rows(self) -> DataFrame:
        places = F.array_position(_constants(self.model.domains), F.col("domain")).cast("int") - 1
        of = lambda values: F.get(F.array(*(F.lit(float(v)) for v in values)), places)
        rated = self.scored.withColumns({"domain": self.domain(F.col("posterior")), "rate": self.rate(F.col("posterior"))})
        return rated.select("doc_id", "domain", "tokens", "posterior", "rate", self.copies(F.col("rate"), F.col("doc_id")).alias("copies"), of(self.targets).alias("domain_target"), of(self.reached).alias("domain_reached"))


def score(docs: DataFrame, model: DomainModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tokens (words), posterior; null texts count as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    tokens = F.regexp_count("text", F.lit(WORD)).cast("long").alias("tokens")
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select("doc_id", tokens, model.posterior(F.col("text")).alias("posterior"))


def plan(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float] | None = None, multiples: Mapping[str, float] | None = None, cap: float = 8.0, id_col: str = "doc_id", text_col: str = "text") -> Mix:
    """Learn the domains and fit the rates; see mix(). Warns of targets that rates in 0 .. cap can't reach."""
    space = Workspace(docs.sparkSession, "mixing")
    model = train(docs, labels, id_col=id_col, text_col=text_col, space=space)
    scored = space.write(score(docs, model, id_col, text_col), "scored", "snappy")
    k = len(model.domains)
    row = scored.agg(F.sum("tokens").alias("all"), *(F.sum(F.col("tokens") * F.col("posterior")[i]).alias(f"t{i}") for i in range(k))).first()
    had, every = [row[f"t{i}"] or 0.0 for i in range(k)], float(row["all"] or 0)
    if multiples is not None:
        targets = [had[i] * multiples.get(d, 1.0) for i, d in enumerate(model.domains)]
    else:
        wanted = [(weights or {}).get(d, 0.0 if weights else 1.0) if had[i] else 0.0 for i, d in enumerate(model.domains)]
        targets = [every * w / (sum(wanted) or 1.0) for w in wanted]
    move, reached, _ = fit_rates(scored, targets, cap)
    found = Mix(model, move, cap, had, targets, reached, scored)
    if found.missed():
        warnings.warn(f"targets out of reach (target, reached): {found.missed()}", stacklevel=2)
    return found


def mix(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float] | None = None, multiples: Mapping[str, float] | None = None, cap: float = 8.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, domain, tokens, posterior, rate, copies, domain_target, domain_reached of each row of docs.

    The expected tokens of each domain, sum(rate * tokens * posterior), meet the targets as nearly as rates in 0 .. cap
    can; domain_reached is what they come to, beside domain_target. `weights` are shares of all tokens, `multiples` factors of what a domain has
    (1 for those not named); without either, domains get equal shares. `copies` is the rate rounded up or down at random by a
    hash of the id, so that the same row always gets the same number. Null texts count as empty; a null id is hashed like any
    other; repeated rows get equal rates. Domains of which there is nothing get no target. An empty table gives no rows.
    """
    return plan(docs, labels, weights, multiples, cap, id_col, text_col).rows()


#: Target shares of the query: mostly the clean domain, some of low quality, little of the toxic.
TARGETS = {"quality1_toxic0": 0.85, "quality0_toxic0": 0.1, "quality1_toxic1": 0.05}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents to TARGETS, by the domains of the labels."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), weights=TARGETS)
