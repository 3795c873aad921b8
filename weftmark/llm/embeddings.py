"""Embedding near duplicates: codes by iterative quantisation, multi-index tables, exact rerank (operator 7)."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, grouped, join_uneven, spread, table
from .components import components


@dataclass
class Codes:
    """Rotations learnt by iterative quantisation, and the tables cut from the bits of their codes."""

    mean: np.ndarray
    rotations: list[np.ndarray]  # dimension x bits
    tables: list[list[tuple[int, int]]]  # per table: (rotation, bit) pairs

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """A key for each row and table."""
        bits = [(unit - self.mean) @ r > 0 for r in self.rotations]
        out = np.zeros((len(unit), len(self.tables)), dtype=np.int64)
        for t, places in enumerate(self.tables):
            for i, (r, b) in enumerate(places):
                out[:, t] |= bits[r][:, b].astype(np.int64) << i
        return out


#: Bits that a key can have, tables that are tried at most, and sampled vectors whose pairs are counted.
WIDEST, MOST_TABLES, PAIRED = 62, 400, 1500


def _rotation(centred: np.ndarray, axes: np.ndarray, number: int, rounds: int, seed: int) -> np.ndarray:
    """Brings the centred sample nearest to the corners of a cube; each number starts from another rotation."""
    dim = centred.shape[1]
    bits, rng = min(dim, 64), np.random.default_rng(seed + number)
    base = axes[:bits].T if number == 0 else np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :bits]
    projected = centred @ base
    rotation = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(projected @ rotation > 0, 1.0, -1.0).T @ projected)
        rotation = (u @ v).T
    return base @ rotation


def _bit_order(rotations: list[np.ndarray], seed: int) -> list[tuple[int, int]]:
    order = []
    for r, rotation in enumerate(rotations):
        order += [(r, int(b)) for b in np.random.default_rng(seed + r).permutation(rotation.shape[1])]
    return order


def near_partners(sample: np.ndarray, least_cosine: float, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Sampled unit vectors and for each a partner at the least cosine, half of them in directions in which the sample differs."""
    rng, n = np.random.default_rng(seed), len(sample)
    own = sample[rng.integers(0, n, 4000)]
    away = rng.normal(size=own.shape)
    differ = sample[rng.integers(0, n, len(own) // 2)] - sample[rng.integers(0, n, len(own) // 2)]
    away[: len(differ)] = np.where((differ**2).sum(axis=1, keepdims=True) > 1e-12, differ, away[: len(differ)])
    away -= (away * own).sum(axis=1, keepdims=True) * own
    norm = np.sqrt((away**2).sum(axis=1, keepdims=True))
    good = norm[:, 0] > 1e-9
    return own[good], least_cosine * own[good] + math.sqrt(1 - least_cosine**2) * away[good] / norm[good]


def collision_rates(sample: np.ndarray, bits: list[np.ndarray], least_cosine: float) -> list[float]:
    """The share of pairs of unlike sampled vectors that agree in the first 0, 1, 2, .. bits; where under 50 pairs are left, as
    each of the eight bits before thinned them."""
    few = sample[:PAIRED]
    i, j = np.nonzero(np.triu(few @ few.T < least_cosine, 1))
    total, rates = max(1, len(i)), [1.0]
    for b in bits:
        if len(i) >= 50:
            same = b[i] == b[j]
            i, j = i[same], j[same]
        back = min(8, len(rates) - 1)
        thins = (rates[-1] / rates[-1 - back]) ** (1 / back) if back else 0.5
        rates.append(len(i) / total if len(i) >= 50 else rates[-1] * min(0.95, max(0.5, thins)))
    return rates


def learn(sample: np.ndarray, rows: int, least_cosine: float, recall: float = 0.98, bucket: int = 64, rounds: int = 40, seed: int = 13) -> Codes:
    """Rotations of the centred sample and tables planned by what is measured on it, so that offsets and spectra don't matter.

    There are as many tables as find the share `recall` of pairs at the least cosine, and keys as long as cost least: a copy of
    a row in a table counts like `bucket` comparisons, and rows are compared at the rate at which unlike sampled ones collide.
    """
    mean = sample.mean(axis=0)
    centred, dim = sample - mean, sample.shape[1]
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    if len(axes) < dim:
        axes = np.linalg.qr(np.concatenate([axes.T, np.random.default_rng(seed).normal(size=(dim, dim))], axis=1))[0].T[:dim]
    rotations: list[np.ndarray] = []
    a, b = near_partners(sample, least_cosine)
    agree, sampled = [], []  # of each bit: the pairs that agree in it, and the bits of sampled vectors

    left, right, few = a - mean, b - mean, sample[:PAIRED] - mean

    def more(count: int) -> None:
        while len(agree) < count:
            number = len(rotations)
            rotations.append(_rotation(centred, axes, number, rounds if number < 4 else rounds // 4, seed))
            same, bits = (left @ rotations[-1] > 0) == (right @ rotations[-1] > 0), few @ rotations[-1] > 0
            for r, bit in _bit_order(rotations, seed)[len(agree) :]:
                agree.append(same[:, bit])
                sampled.append(bits[:, bit] if number < 2 + WIDEST // len(bits[0]) else bits[:0, 0])

    more(WIDEST)
    rates = collision_rates(sample, sampled[:WIDEST], least_cosine)
    together, best, width = np.ones(len(a), dtype=bool), math.inf, 1
    for w in range(1, WIDEST + 1):
        together &= agree[w - 1]
        found = min(max(together.mean() if len(a) else 1.0, 1e-4), 1 - 1e-9)
        wanted = max(1.0, math.log(1 - recall) / math.log(1 - found))
        if wanted <= MOST_TABLES and wanted * (bucket + rows * rates[w]) < best:
            best, width = wanted * (bucket + rows * rates[w]), w
    met, tables = np.zeros(len(a), dtype=bool), 0
    while tables < MOST_TABLES and (not tables or met.mean() < recall if len(a) else not tables):
        more((tables + 1) * width)
        met |= np.logical_and.reduce(agree[tables * width : (tables + 1) * width])
        tables += 1
    if len(a) and met.mean() < recall:
        warnings.warn(f"{tables} tables find {met.mean():.3f} of the pairs at a cosine of {least_cosine}", stacklevel=2)
    order = _bit_order(rotations, seed)
    return Codes(mean, rotations, [order[t * width : (t + 1) * width] for t in range(tables)])


_PAIRED = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _compare(least: float):
    """Links of the vectors of each cell, counted in the first table alone in which a pair shares its key."""

    def same(batch: pa.RecordBatch) -> np.ndarray:
        out = np.ones(batch.num_rows - 1, dtype=bool)
        for name in ("grp", "size", "tab", "key", "left", "right"):
            v = batch.column(name).to_numpy()
            out &= v[1:] == v[:-1]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in grouped(batches, same):
            n = cell.num_rows
            if n < 2:
                continue
            node, block, copies = (cell.column(c).to_numpy() for c in ("node", "block", "copies"))
            unit = np.frombuffer(b"".join(cell.column("unit").to_pylist()), dtype="<f8").reshape(n, -1)
            keys = np.frombuffer(b"".join(cell.column("keys").to_pylist()), dtype="<i8").reshape(n, -1)
            left, right, tab = (cell.column(c)[0].as_py() for c in ("left", "right", "tab"))
            a, b = (np.arange(n), np.arange(n)) if left == right else (np.flatnonzero(block == left), np.flatnonzero(block == right))
            i, j = np.nonzero(unit[a] @ unit[b].T >= least)
            i, j = a[i], b[j]
            if left == right:
                i, j = i[i < j], j[i < j]
            if tab:
                first = ~(keys[i, :tab] == keys[j, :tab]).any(axis=1)
                i, j = i[first], j[first]
            if not len(i):
                continue
            links = np.bincount(i, weights=copies[j], minlength=n) + np.bincount(j, weights=copies[i], minlength=n)
            label = node.copy()  # smallest node reachable within the cell
            while True:
                new = label.copy()
                np.minimum.at(new, i, label[j])
                np.minimum.at(new, j, label[i])
                if (new == label).all():
                    break
                label = new
            own = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(links[own].astype(np.int64)), pa.array(label[own])], schema=_PAIRED)

    return run


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision; null for those that link with nothing."""
    for batch in batches:
        out = []
        for v in batch.column("embedding"):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if v.is_valid and len(v.values) else np.zeros(0)
            norm = float(np.sqrt(x @ x)) if len(x) and np.isfinite(x).all() else 0.0
            if np.isinf(norm) or len(x) and norm < 1e-150 and np.isfinite(x).all() and x.any():  # squares out of range
                x = x / np.abs(x).max()
                norm = float(np.sqrt(x @ x))
            out.append((x / norm).tobytes() if norm > 0 else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], names=["vec_id", "label", "unit"])


def near_vectors(vectors: DataFrame, least_cosine: float = 0.93, sample: int = 8192, block: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of each row.

    Vectors are compared when their labels are equal and not null and they have as many components. Those that are null, empty, zero, or
    hold null or non-finite components link with nothing. Equal vectors of a label are compared once and count as often as they
    come. Rows with a null id link with nothing and have a null component; ids are taken to be unique. The rotations are learnt on
    about `sample` vectors of each dimension, those with the smallest hash; every vector is indexed. A bucket
    of more than `block` vectors is compared in pairs of blocks, in many tasks.
    """
    spark = vectors.sparkSession
    space = Workspace(spark, "near-vectors")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    units = space.write(rows.mapInArrow(_units, "vec_id long, label long, unit binary"), "units")
    usable = F.col("unit").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    distinct = space.write(units.where(usable).groupBy("label", "unit").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")).withColumn("size", F.length("unit")), "distinct")
    largest = {r["size"]: (r.most, r.all) for r in distinct.groupBy("size", "label").count().groupBy("size").agg(F.max("count").alias("most"), F.sum("count").alias("all")).collect()}  # a row a dimension
    if not largest:
        return units.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    grid, codes = 1_000_000, {}
    for size, (most, every) in sorted(largest.items()):
        own = distinct.where(F.col("size") == size).select("node", "unit")
        chosen = own.where(F.pmod(F.xxhash64("node"), F.lit(grid)) < min(grid, -(-grid * sample // every))).collect() or own.limit(1).collect()
        codes[size] = learn(np.stack([np.frombuffer(r.unit, dtype="<f8") for r in sorted(chosen)]), most, least_cosine)
    shared = spark.sparkContext.broadcast(codes)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = whole.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                batch = whole.filter(pa.array(sizes == size))
                unit = np.frombuffer(b"".join(batch.column("unit").to_pylist()), dtype="<f8").reshape(batch.num_rows, -1)
                keys = shared.value[size].keys(unit).astype("<i8")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], names=[*batch.schema.names, "keys", "each"])

    coded = distinct.select("node", F.col("label").alias("grp"), "size", "copies", "unit").mapInArrow(code, "node long, grp long, size int, copies long, unit binary, keys binary, each array<long>")
    coded = space.write(coded, "coded")
    by = ["grp", "size", "tab", "key"]
    dealt = coded.select("node", "grp", "size", "copies", "unit", "keys", F.posexplode("each").alias("tab", "key"))
    cells = space.write(coded.select("grp", "size", F.posexplode("each").alias("tab", "key")).groupBy(*by).count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / block).cast("int")), "cells")
    dealt = join_uneven(dealt, cells, by, "count", distinct.count()).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = dealt.select("*", other).select("node", "copies", "unit", "keys", *by, "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    by = [*by, "left", "right"]
    found = space.write(pairs.repartition(spread(vectors), *by).sortWithinPartitions(*by).mapInArrow(_compare(least_cosine), "node long, links long, root long"), "found")
    classes = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), space)
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    of = distinct.join(linked, "node", "left").join(classes, "node", "left").select("label", "unit", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    joined = join_uneven(units.where(usable), space.write(of, "classes"), ["label", "unit"], "copies", units.count())
    known = joined.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = units.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    return known.unionByName(alone)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding with its links and class at a cosine of 0.93."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
