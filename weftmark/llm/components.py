"""Connected components without driver-side edges: of few edges in one task, of more by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, join_uneven, lean

#: Edges, of 16 bytes each, that one task joins. A round over more of them is some 17 stages, whose tasks the driver keeps records
#: of: with 211 partitions that is 2,300 tasks, however few the edges.
ONE_TASK_MOST = 250_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges (a, b), by union-find towards the smallest node."""
    held = [np.stack([batch.column(c).to_numpy() for c in ("a", "b")]) for batch in batches]
    if not held:
        return
    nodes, place = np.unique(np.concatenate(held, axis=1), return_inverse=True)
    one, other = place.reshape(2, -1).tolist()
    label = list(range(len(nodes)))
    for p, q in zip(one, other):
        while label[p] != p:
            label[p] = p = label[label[p]]
        while label[q] != q:
            label[q] = q = label[label[q]]
        label[max(p, q)] = min(p, q)
    for i, up in enumerate(label):  # labels are never larger than their nodes, so those before are settled
        label[i] = label[up]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])


def _large(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return join_uneven(both, least, ["a"], "n", 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = join_uneven(down, least, ["a"], "n", total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, space: Workspace, name: str = "components", most_rounds: int = 60, one_task_most: int = ONE_TASK_MOST) -> DataFrame:
    """(node, component) for each node of edges(a, b), component being the smallest node reachable.

    Loops (a = b), repeated and reversed edges do no harm; rows with a null end are dropped; no edges give
    no rows. Up to `one_task_most` edges are joined in one task, with the same result. Of more, each round is written to the
    shared folder, so that a lost executor costs one round at most, and the loop ends when a round changes nothing.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    edges = space.write(edges, f"{name}-edges")
    total = edges.count()
    if total <= one_task_most:
        found = space.write(edges.coalesce(1).mapInArrow(lean(_joined), "node long, component long"), f"{name}-all", "snappy")
        space.drop(f"{name}-edges")
        return found
    now, sign = space.write(_small(edges, total), f"{name}-0"), None
    for i in range(1, most_rounds + 1):
        large = space.write(_large(now, total), f"{name}-large-{i}")
        new = space.write(_small(large, total), f"{name}-{i}")
        for old in (f"{name}-{i - 1}", f"{name}-large-{i}"):
            space.drop(old)
        now, before = new, sign
        sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if sign == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    space.drop(f"{name}-edges")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
