"""Near duplicates by SimHash, with pigeonring chains to prune candidates (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, join_uneven, slices, small_batches, table
from .components import components

BITS = 64


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of a UTF-8 text: a bit is set if over half of the shingles' XXH64 have it."""
    words = text.lower().split()  # bytes: only A-Z, and only ASCII white space
    if not words:
        return 0
    space, digest = b" ", xxhash.xxh64_intdigest
    parts = [space.join(words)] if len(words) < width else map(space.join, zip(*(words[i:] for i in range(width))))
    total = max(1, len(words) - width + 1)
    return simhash_of(np.fromiter((digest(p, seed) for p in parts), dtype="<u8", count=total))


def simhash_of(hashes: np.ndarray) -> int:
    """The bits that over half of the 64-bit hashes have; zero for none."""
    sums = np.zeros(BITS, dtype=np.int64)
    for done in range(0, len(hashes), 65536):
        part = np.ascontiguousarray(hashes[done : done + 65536], dtype="<u8")
        sums += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            prints = np.array([fingerprint(t or b"") for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "fp"])


def segments(count: int) -> list[tuple[int, int]]:
    """(shift, width) of the ring's segments, as even as can be."""
    edges = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def viable(a: np.ndarray, b: np.ndarray, start: int, ring: list[tuple[int, int]], distance: int) -> np.ndarray:
    """Whether the chain from `start` keeps, at each length l, within its budget distance * l / m, then the full check."""
    differ, total = a ^ b, np.zeros(np.broadcast(a, b).shape, dtype=np.int64)
    alive = np.ones(total.shape, dtype=bool)
    for length in range(1, len(ring) + 1):
        shift, width = ring[(start + length - 1) % len(ring)]
        total = total + np.bitwise_count((differ >> np.uint64(shift)) & np.uint64((1 << width) - 1))
        alive &= total <= distance * length // len(ring)
        if not alive.any():
            break
    return alive


def within(a: np.ndarray, b: np.ndarray, ring: list[tuple[int, int]], distance: int) -> np.ndarray:
    """Which pairs are within the distance: those with a start from which the chains keep their budgets go to the full check."""
    alive = np.zeros(len(a), dtype=bool)
    for start in range(len(ring)):
        left = np.flatnonzero(~alive)
        alive[left] = viable(a[left], b[left], start, ring, distance)
    return alive


def _bucket_links(count: int, distance: int):
    """Edges that join, within each bucket, what its viable pairs join; at most members - 1 a bucket."""
    ring = segments(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for start, members in zip(batch.column("start").to_pylist(), batch.column("members").to_pylist()):
                ids = np.array([m["node"] for m in members], dtype=np.int64)
                prints = np.array([m["fp"] for m in members], dtype=np.int64).view(np.uint64)
                order = np.argsort(ids)
                ids, prints = ids[order], prints[order]
                label = np.arange(len(ids))
                for i in range(1, len(ids)):
                    near = np.flatnonzero(viable(prints[:i], prints[i], start, ring, distance))
                    if len(near):
                        roots = np.unique(label[near])
                        label[np.isin(label, roots[1:])] = roots[0]
                        label[i] = roots[0]
                far = np.flatnonzero(label != np.arange(len(ids)))
                a += ids[far].tolist()
                b += ids[label[far]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def links(prints: DataFrame, space: Workspace, distance: int = 2, ring: int = 5, bucket_most: int = 256) -> DataFrame:
    """Edges (a, b) that connect what prints(fp, node), of distinct fp, within `distance` bits connect.

    By the pigeonring principle two prints within the distance have a start from which every chain of l
    segments differs in at most distance * l / ring bits. The chains whose budget is below one are equal, so
    they are the bucket key; the others are tested in the bucket before the full count of bits. A bucket of over
    `bucket_most` prints goes another, exact way: each print is dealt to its neighbours at up to one bit (for
    distance 2, two prints share such a neighbour just when they are within two bits), of which a neighbour has 65 at most.
    """
    if distance != 2:
        raise ValueError("the exact way for large buckets is made for a distance of two bits")
    parts = segments(ring)
    equal = max(length for length in range(1, ring + 1) if distance * length // ring == 0)

    def key(start: int):
        bits = [F.shiftrightunsigned("fp", shift).bitwiseAND((1 << width) - 1).cast("string") for shift, width in (parts[(start + i) % ring] for i in range(equal))]
        return F.struct(F.lit(start).alias("start"), F.concat_ws(",", *bits).alias("key"))

    keyed = prints.select("fp", "node", F.explode(F.array(*map(key, range(ring)))).alias("k")).select("fp", "node", "k.start", "k.key")
    sizes = space.write(keyed.groupBy("start", "key").count().where("count > 1"), "sizes", "snappy")
    shared = keyed.join(sizes, ["start", "key"])
    cold = shared.where(F.col("count") <= bucket_most).groupBy("start", "key").agg(F.collect_list(F.struct("fp", "node")).alias("members"))
    near = cold.select("start", "members").mapInArrow(_bucket_links(ring, distance), "a long, b long")
    hot = keyed.join(sizes.where(F.col("count") > bucket_most), ["start", "key"], "left_semi").select("fp", "node").distinct()
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(v)) for v in ([1 << i for i in range(63)] + [-(1 << 63)])))
    beside = hot.select("node", F.explode(flips).alias("beside"))
    met = beside.groupBy("beside").agg(F.min("node").alias("b"), F.collect_list("node").alias("n")).where(F.size("n") > 1)
    return near.unionByName(met.select(F.explode("n").alias("a"), "b").where("a <> b").distinct())


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, ring: int = 5) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row of docs.

    Null texts count as empty; a text without words has fingerprint zero and links like any other. Equal
    fingerprints link. Rows whose id is null get a fingerprint and, unless a row with the same fingerprint has an id, a
    null component. Repeated rows give repeated rows. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    space = Workspace(spark, "simhash")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = space.write(rows.mapInArrow(_fingerprints, "doc_id long, fp long"), "prints", "snappy")
    nodes = space.write(prints.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "nodes", "snappy")
    found = space.write(links(nodes.where("node IS NOT NULL").drop("n"), space, distance, ring), "links", "snappy")
    classes = components(found, space)
    of = space.write(nodes.join(classes, "node", "left").select("fp", "n", F.coalesce("component", "node").alias("component_id")), "classes", "snappy")
    return join_uneven(prints, of, ["fp"], "n", prints.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate group, by three words and two bits."""
    return simhash_dedup(table(spark, sf_dir, "documents"))
