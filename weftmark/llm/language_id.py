"""Language identification by error-correcting output codes (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import lean, slices, small_batches, table

#: n-grams of 1 to 3 bytes of UTF-8 with A-Z lower-cased, hashed to this many features.
FEATURES, ORDERS = 4096, (1, 2, 3)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


def codewords(count: int, seed: int = 7) -> np.ndarray:
    """A row of +1/-1 a language. Up to five: all splits in two; more: random splits with rows far apart."""
    if count <= 1:
        return np.ones((count, 1), dtype=np.int8)
    if count <= 5:
        splits = range(1, 1 << (count - 1))
        return np.array([[-1 if s >> i & 1 else 1 for s in splits] for i in range(count)], dtype=np.int8)
    rng, bits = np.random.default_rng(seed), max(15, int(np.ceil(10 * np.log2(count))))
    best, apart = None, -1
    for _ in range(200):
        made = rng.choice(np.array([-1, 1], dtype=np.int8), size=(count, bits))
        made = made[:, np.abs(made.sum(axis=0, dtype=int)) < count]
        least = min(int((made[i] != made[j]).sum()) for i, j in combinations(range(count), 2))
        if least > apart:
            best, apart = made, least
    return best


def hashed(data: np.ndarray, order: int) -> np.ndarray:
    """Feature of the n-gram that begins at each byte."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    value = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
    for k in range(order):
        value = (value ^ data[k : k + n]) * np.uint32(0x01000193)
    return (value ^ (value >> np.uint32(15))) & np.uint32(FEATURES - 1)


def _texts(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [_FOLD[np.frombuffer(t or b"", dtype=np.uint8)] for t in batch.column("text").cast(pa.binary()).to_pylist()]


def features(data: np.ndarray) -> np.ndarray:
    """Share of each feature among the n-grams of a text."""
    counts = sum(np.bincount(hashed(data, n), minlength=FEATURES) for n in ORDERS)
    return (counts / max(1, counts.sum())).astype(np.float32)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            vectors = [features(d).tobytes() for d in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(vectors, pa.binary())], names=["lang", "x"])


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray  # feature x bit, on shares of n-grams
    bias: np.ndarray
    trust: np.ndarray  # of each bit, by its held-out accuracy

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its score in 0..1, and whether the runner-up is close.

        The loss of a codeword is the trust-weighted mean of log(1 + exp(-bit * margin)).
        """
        loss = np.logaddexp(0, -margins[:, None, :] * self.codes[None, :, :]) @ self.trust
        order = np.argsort(loss, axis=1, kind="stable")
        share = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * len(self.trust))
        score = share.max(axis=1) / share.sum(axis=1)
        if len(self.languages) < 2:
            return order[:, 0], score, np.zeros(len(loss), dtype=bool)
        near = np.take_along_axis(loss, order[:, 1:2], 1)[:, 0] - np.take_along_axis(loss, order[:, :1], 1)[:, 0]
        return order[:, 0], score, near * len(self.trust) < np.log(4)


def _fit_bits(x: np.ndarray, y: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions of the columns of y (+1/-1) on standardised features, by accelerated gradient.

    x is standardised in place, so that the driver holds it once.
    """
    centre, z = x.mean(axis=0), x
    z -= centre
    scale = np.sqrt(np.einsum("ij,ij->j", z, z) / len(z)) + np.float32(1e-4)
    z /= scale
    w, b = np.zeros((x.shape[1], y.shape[1]), dtype=np.float32), np.zeros(y.shape[1], dtype=np.float32)
    v, rate, decay = w.copy(), 4.0 / max(1.0, float(np.einsum("ij,ij->", z, z)) / len(z)), 1e-3
    for i in range(rounds):
        g = -y / (1 + np.exp(np.clip(y * (z @ v + b), -30, 30)))
        new = v - rate * (z.T @ g / len(z) + decay * v)
        v, w = new + i / (i + 3) * (new - w), new
        b -= 0.5 * g.mean(axis=0)
    w = w / scale[:, None]
    return w, b - centre @ w


def held_out(id_col: str | Column) -> Column:
    """Documents that are never learnt from: crc32 of the id as text divisible by five."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, per_language: int = 600, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on about `per_language` documents of each non-null language outside the held-out fifth.

    The documents are those with the smallest hash of their id, and are read whole; a fifth of them sets the
    trust of the bits. Without any labelled row the model has no language.
    """
    small_batches(docs.sparkSession)
    known = docs.where(~held_out(id_col)).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    totals = {r.lang: r.n for r in known.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()}  # a row a language
    languages = sorted(totals)
    if not languages:
        return LanguageModel([], codewords(0), np.zeros((FEATURES, 1)), np.zeros(1), np.ones(1))
    grid = 1_000_000
    wanted = F.create_map(*[F.lit(v) for lang in languages for v in (lang, min(grid, -(-grid * per_language // totals[lang])))])
    chosen = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.pmod(F.xxhash64(F.lit(11), F.col(id_col)), F.lit(grid)).alias("h")).where(F.col("h") < wanted[F.col("lang")])
    rows = chosen.select("lang", "text").mapInArrow(lean(_vectors), "lang string, x binary").toArrow()  # per_language vectors a language
    rows = rows.sort_by([("lang", "ascending"), ("x", "ascending")])
    y = np.array([languages.index(lang) for lang in rows.column("lang").to_pylist()])
    x = np.zeros((len(rows), FEATURES), np.float32)
    for i, vector in enumerate(rows.column("x")):
        x[i] = np.frombuffer(vector.as_buffer(), dtype=np.float32)
    del rows
    codes = codewords(len(languages))
    if len(languages) == 1 or not len(x):
        return LanguageModel(languages, codes, np.zeros((FEATURES, codes.shape[1])), np.zeros(codes.shape[1]), np.ones(codes.shape[1]) / codes.shape[1])
    test = np.arange(len(y)) % 5 == 0
    w, b = _fit_bits(x[~test], codes[y[~test]].astype(np.float32))
    right = (((x[test] @ w + b) * codes[y[test]]) > 0).mean(axis=0) if test.any() else np.ones(codes.shape[1])
    trust = np.log((right * 0.98 + 0.01) / (1 - (right * 0.98 + 0.01)))
    trust = np.maximum(trust, 0.05)
    w, b = _fit_bits(x, codes[y].astype(np.float32))
    return LanguageModel(languages, codes, w.astype(np.float64), b.astype(np.float64), trust / trust.sum())


def margins(data: list[np.ndarray], model: LanguageModel) -> np.ndarray:
    """Margins of the bits for each text: the mean weight of its n-grams and the bias."""
    out = np.zeros((len(data), model.codes.shape[1]))
    total = np.zeros(len(data))
    lengths = np.array([len(d) for d in data])
    joined = np.concatenate(data) if data else np.zeros(0, np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(int) if data else np.zeros(0, int)
    for order in ORDERS:
        grams = hashed(joined, order)
        n = np.maximum(lengths - order + 1, 0)
        total += n
        own = np.flatnonzero(n)
        if not len(own):
            continue
        cuts = np.stack([starts[own], starts[own] + n[own]], axis=1).ravel()
        for bit in range(out.shape[1]):
            values = np.append(model.weights[:, bit][grams], 0.0)
            out[own, bit] += np.add.reduceat(values, cuts)[::2]
    return out / np.maximum(total, 1)[:, None] + model.bias


def _letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _decide(batch: pa.RecordBatch, model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language or und, score, ambiguous) of each row, from its columns text and letters."""
    letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
    if not model.languages:
        return np.full(len(letters), "und", dtype=object), np.zeros(len(letters)), np.ones(len(letters), dtype=bool)
    best, score, close = model.decode(margins(_texts(batch), model))
    names = np.array([*model.languages, "und"], dtype=object)[np.where(letters, best, len(model.languages))]
    return names, np.where(letters, score, 0.0), np.where(letters, close, True)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of each row; the text is the only input of a prediction.

    `und`, score 0 and ambiguous: a text that is null or has no letter, or any text if nothing was learnt. Repeated
    rows give repeated rows; rows with a null id are predicted like others and are not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), _letters(text).alias("letters"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in slices(whole, "text", 1_000_000):
                names, score, close = _decide(batch, model)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score), pa.array(close)],
                    names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
                )

    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def known(docs: DataFrame, model: LanguageModel, least_score: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that have a language with at least the score; each is judged on its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = F.col(text_col).cast("string")
    whole = docs.select(F.struct("*").alias("row"), _letters(text).alias("letters"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                names, score, _ = _decide(part, shared.value)
                yield part.select(["row"]).filter(pa.array((names != "und") & (score >= least_score)))

    return whole.mapInArrow(lean(run), StructType([StructField("row", docs.schema)])).select("row.*")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
