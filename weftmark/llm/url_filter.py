"""URL filter: host and path rules, then the ratio of two character language models (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Workspace, join_uneven, slices, table

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Longest context in bytes, and weight of the shorter context's estimate.
ORDER, SHRINK = 4, 2.0
#: Weights, of 16 bytes, that an executor holds; more are joined.
HELD_MOST = 2_000_000
_BINS, _WIDEST = 2001, 4.0


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null and for urls without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def by_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does; of equal length, the first given."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _windows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of all urls, the ORDER bytes before it and itself as one number, and the url it is in.

    Bytes before the start of a url are zeros.
    """
    texts = [t or b"" for t in batch.column("url").cast(pa.binary()).to_pylist()]
    mark = bytes(ORDER)
    data = np.frombuffer(b"".join(mark + t for t in texts), dtype=np.uint8).astype(np.int64)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths + ORDER)
    starts = np.cumsum(np.concatenate([[0], lengths + ORDER]))[:-1]
    owner[(starts[:, None] + np.arange(ORDER)).ravel()] = -1
    window = np.zeros(len(data), dtype=np.int64)
    for back in range(ORDER + 1):
        window[back:] |= data[: len(data) - back] << 8 * back
    return window[owner >= 0], owner[owner >= 0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "url", 1_000_000):
            window, owner = _windows(batch)
            taught = np.asarray(batch.column("taught"), dtype=np.int64)[owner]
            keys, at = np.unique(window, return_inverse=True)
            n = [np.bincount(at[chosen], minlength=len(keys)) for chosen in (taught == 1, taught == 0, slice(None))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (keys, *n)], names=["window", "accepted", "rejected", "uses"])


def windows(urls: DataFrame) -> DataFrame:
    """(window, accepted, rejected, uses) of each distinct window of urls(url, taught).

    `taught` is 1 for an accepted url, 0 for a rejected one and -1 for one that teaches nothing, which counts in `uses` alone.
    """
    found = urls.mapInArrow(_count, "window long, accepted long, rejected long, uses long")
    return found.groupBy("window").agg(*(F.sum(c).alias(c) for c in ("accepted", "rejected", "uses")))


def weigh(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, uses, weight): log-likelihood of a window's last byte under accepted urls less that under rejected ones.

    Counts are exact at every order: those of shorter contexts are sums over the windows that end alike. A context never
    seen leaves the shorter one's estimate.
    """
    taught = counts.where("accepted + rejected > 0")
    found = wanted.select("window", "uses", F.lit(1 / 256).alias("good"), F.lit(1 / 256).alias("bad"))
    for order in range(ORDER + 1):
        gram = F.col("window").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1))
        hits = taught.groupBy(gram.alias("gram")).agg(F.sum("accepted").alias("hit_good"), F.sum("rejected").alias("hit_bad"))
        seen = hits.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("hit_good").alias("seen_good"), F.sum("hit_bad").alias("seen_bad"))
        if order <= 1:  # at most 65,536 grams
            hits, seen = F.broadcast(hits), F.broadcast(seen)
        found = found.withColumn("gram", gram).join(hits, "gram", "left").withColumn("context", F.shiftright("gram", 8)).join(seen, "context", "left")
        found = found.select("window", "uses", *(
            ((F.coalesce(f"hit_{c}", F.lit(0)) + SHRINK * F.col(c)) / (F.coalesce(f"seen_{c}", F.lit(0)) + SHRINK)).alias(c) for c in ("good", "bad")
        ))
    return found.select("window", "uses", (F.log("good") - F.log("bad")).alias("weight"))


@dataclass
class UrlModel:
    counts: DataFrame  # window, accepted, rejected, uses
    weights: DataFrame  # window, uses, weight of the urls that were counted
    threshold: float


def _by_table(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """rows with `score`; the weights, of a checked number, are held by each executor."""
    table_ = weights.select("window", "weight").toArrow()
    keys, values = (np.asarray(table_.column(c).combine_chunks()) for c in ("window", "weight"))
    order = np.argsort(keys)
    shared = rows.sparkSession.sparkContext.broadcast((keys[order], values[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = shared.value
        for whole in batches:
            for batch in slices(whole, "url", 1_000_000):
                window, owner = _windows(batch)
                sums = np.bincount(owner, weights=weight[np.searchsorted(known, window)], minlength=batch.num_rows)
                score = sums / np.maximum(np.bincount(owner, minlength=batch.num_rows), 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("score", DoubleType())]))


def _by_join(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """rows with `score`; windows of distinct urls meet their weights in a join that spreads common windows."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "url", 200_000):
                window, owner = _windows(batch)
                yield pa.RecordBatch.from_arrays([batch.column("url").take(pa.array(owner)), batch.column("copies").take(pa.array(owner)), pa.array(window)], names=["url", "copies", "window"])

    space = Workspace(rows.sparkSession, "urls")
    urls = space.write(rows.where("url <> ''").groupBy("url").agg(F.count("*").alias("copies")), "urls")
    total = weights.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    each = join_uneven(urls.mapInArrow(expand, "url string, copies long, window long"), weights, ["window"], "uses", total)
    scores = space.write(each.groupBy("url").agg(F.avg("weight").alias("score"), F.first("copies").alias("copies")), "scores")
    full = join_uneven(rows.where("url <> ''"), scores, ["url"], "copies", rows.count()).select(*rows.columns, "score")
    return full.unionByName(rows.where("url IS NULL OR url = ''").withColumn("score", F.lit(0.0)))


def scored(rows: DataFrame, weights: DataFrame, most: int = HELD_MOST) -> DataFrame:
    """rows(url, ..) with `score`, the mean weight of a url's windows, 0 for an empty one; `weights` is a stored table that has
    all windows of the urls. Up to `most` weights are held by each executor, more are joined, with equal results."""
    return _by_table(rows, weights) if weights.count() <= most else _by_join(rows, weights)


def train(urls: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url", most: int = HELD_MOST) -> UrlModel:
    """Count over all urls on which a rule decides; four fifths teach the models, a fifth sets the threshold.

    Counts and weights are stored tables with a row for each distinct window, so they grow with the input. What returns to the
    driver is the histogram of held-out scores, and up to `most` weights; the threshold is the score that best parts the
    held-out urls, by the mean of both classes' hit rates.
    """
    host, path = parts(F.col(url_col))
    all_ = urls.select(F.col(url_col).alias("url"), (by_rule(host, path, rules)[1] == "allow").alias("accepted"))
    held = F.crc32("url") % 5 == 0
    taught = F.when(F.col("accepted").isNull() | held, F.lit(-1)).otherwise(F.col("accepted").cast("int"))
    space = Workspace(urls.sparkSession, "url-model")
    counts = space.write(windows(all_.select("url", taught.alias("taught"))), "counts")
    model = UrlModel(counts, space.write(weigh(counts, counts), "weights"), 0.0)
    n = counts.agg(F.sum("accepted"), F.sum("rejected")).first()
    if not n[0] or not n[1]:
        model.threshold = -np.inf if not n[1] else np.inf
        return model
    score = F.least(F.greatest(F.col("score") / _WIDEST, F.lit(-1.0)), F.lit(1.0))
    at = F.rint((score + 1) / 2 * (_BINS - 1)).cast("long").alias("bin")
    found = np.zeros((2, _BINS))
    for row in scored(all_.where(held & F.col("accepted").isNotNull()), model.weights, most).groupBy("accepted", at).count().collect():  # at most two rows a bin
        found[int(row.accepted), row.bin] = row["count"]
    share = found.cumsum(axis=1) / np.maximum(found.sum(axis=1, keepdims=True), 1)
    if found.sum(axis=1).all():
        gain = share[0] - share[1]  # rejected at or below, less accepted at or below
        best = np.flatnonzero(gain >= gain.max() - 1e-12)
        model.threshold = ((best[0] + best[-1]) / 2 + 0.5) / (_BINS - 1) * 2 * _WIDEST - _WIDEST
    return model


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", model: UrlModel | None = None, most: int = HELD_MOST) -> DataFrame:
    """page_id, host, path, rule, verdict, score of each row.

    The longest rule that fits decides; else the models do: `block` for a score at or below the threshold. A url
    that is null or has no `://` has an empty host and path, and like any url that rules leave open goes by its score; a
    null or empty url scores 0. If rules accept no url, the models block; if they reject none, the models allow.
    Repeated rows give repeated rows, null ids stay. Other columns are not read.
    """
    if model is None:
        model = train(pages, rules, url_col, most)
        weights = model.weights
    else:
        wanted = windows(pages.select(F.col(url_col).alias("url"), F.lit(-1).alias("taught")))
        weights = Workspace(pages.sparkSession, "url-weights").write(weigh(wanted, model.counts), "weights")
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    rule, said = by_rule(F.col("host"), F.col("path"), rules)
    found = scored(rows.withColumns({"rule": rule, "said": said}), weights, most)
    verdict = F.coalesce("said", F.when(F.col("score") <= float(model.threshold), F.lit("block")).otherwise(F.lit("allow")))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
