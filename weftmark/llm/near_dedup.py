"""Near duplicates of a stated Jaccard similarity: SimHash with pigeonring pruning (operator 4) over candidates that share a rare
shingle, then exact verification.

Two sets of similarity 0.8 have 64-bit fingerprints about 10 bits apart, 27 at six standard deviations, which is too wide to look
fingerprints up by. So candidates come from a prefix filter on the shingles, and the chains and the Hamming check prune them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, grouped, lean, sized, slices, small_batches
from .components import components
from .simhash import segments, simhash_of, within

_SLACK = 1e-9


def shingles(text: bytes, width: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted set of XXH64 of the text's shingles of `width` words, or of all its words if they are fewer."""
    words = text.lower().split()  # bytes: only A-Z, and only ASCII white space
    if not words:
        return np.zeros(0, dtype=np.int64)
    space, digest = b" ", xxhash.xxh64_intdigest
    parts = [space.join(words)] if len(words) < width else map(space.join, zip(*(words[i:] for i in range(width))))
    return np.unique(np.fromiter((digest(p, seed) for p in parts), dtype=np.uint64).view(np.int64))


def prefix(grams: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first grams in an order that all texts share (common ones last): two similar sets meet in one of them."""
    rank = np.zeros(len(grams), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        rank = np.where(common[at] == grams, counts[at], 0)
    return grams[np.lexsort((grams, rank))[: len(grams) - math.ceil(similarity * len(grams) - _SLACK) + 1]]


def _lists(values: list[np.ndarray]) -> pa.Array:
    edges = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate([*values, np.zeros(0, dtype=np.int64)])))


def _arrays(lists: pa.ListArray) -> list[np.ndarray]:
    """The values of each list, as views."""
    values, edges = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [values[a:b] for a, b in zip(edges, edges[1:])]


def _sets(width: int):
    """In place of `text`, the last column, the set of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = [shingles(t or b"", width) for t in batch.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(sets)], names=[*batch.schema.names[:-1], "grams"])

    return run


def _cell_links(similarity: float):
    """Edges that join what the similar pairs of each cell join, from rows sorted by cell, documents before pairs.

    A document is a row (group, i, j, a, null, grams), a candidate pair a row (group, i, j, a, b, null). Cells of large buckets,
    which have no candidate pairs yet, seek them among all their documents by the same chains and Hamming check. At most documents - 1 edges a cell.
    """

    def same(batch: pa.RecordBatch) -> np.ndarray:
        return np.logical_and.reduce([np.diff(batch.column(c).to_numpy()) == 0 for c in ("hot", "group", "i", "j")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in grouped(batches, same):
            held = cell.column("b").null_count
            ids, sets = cell.column("a").to_numpy()[:held], _arrays(cell.column("grams"))[:held]
            found = _all_links(ids, sets, similarity) if cell.column("hot")[0].as_py() else _pair_links(ids, sets, cell.slice(held), similarity)
            yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in found], names=["a", "b"])

    return run


def _pair_links(ids: np.ndarray, sets: list[np.ndarray], pairs: pa.RecordBatch, similarity: float) -> tuple[list[int], list[int]]:
    """Edges that join the pairs that are similar; a pair that is joined already isn't compared."""
    of: dict[int, list[np.ndarray]] = {}
    for i, grams in zip(ids.tolist(), sets):
        of.setdefault(i, []).append(grams)
    label = {i: i for i in of}

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = i = label[label[i]]
        return i

    for i, j in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
        p, q = root(i), root(j)
        if p != q and any(_similar(s, t, similarity) for s in of[i] for t in of[j]):
            label[max(p, q)] = min(p, q)
    far = [i for i in label if label[i] != i]
    return far, [label[i] for i in far]


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - _SLACK


def _close(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the sets are similar, as a matrix; grams that only one set holds take no part in the product."""
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    grams, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(int))
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[place]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    shared = np.zeros((len(sets), len(sets)))
    for start in range(0, int((times > 1).sum()), 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        held = np.zeros((len(sets), 4096), dtype=np.float32)
        held[owner[a:b], column[a:b] - start] = 1
        shared += held @ held.T
    return shared >= similarity * (sizes[:, None] + sizes - shared) - _SLACK


def _all_links(ids: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Edges that join what the similar ones of all pairs join: pairs that their fingerprints' chains let be similar, then verified."""
    order = np.argsort(ids, kind="stable")
    ids, sets = ids[order], [sets[i] for i in order]
    one, other = _near_prints(sets, similarity)
    used, place = np.unique(np.concatenate([one, other]), return_inverse=True)
    if not len(used):
        return [], []
    one, other = place[: len(one)], place[len(one) :]
    ids, met = ids[used], np.zeros((len(used), len(used)), dtype=bool)
    met[one, other] = True
    near = _close([sets[i] for i in used], similarity) & met
    label = np.arange(len(ids))
    for i in range(1, len(ids)):
        roots = np.unique(label[np.flatnonzero(near[i, :i])])
        if len(roots):
            label[np.isin(label, roots[1:])] = roots[0]
            label[i] = roots[0]
    far = np.flatnonzero(label != np.arange(len(ids)))
    return ids[far].tolist(), ids[label[far]].tolist()


def _near_prints(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (later, earlier) of sets whose sizes and fingerprints let them be similar, some 200,000 pairs at a time."""
    prints, sizes = np.array([simhash_of(s.view(np.uint64)) for s in sets], dtype=np.uint64), np.array([len(s) for s in sets])
    found, start, rows = [], 0, max(1, 200_000 // len(sets))
    while start < len(sets):
        stop = min(len(sets), start + rows)
        one, other = np.tril_indices(stop - start, start - 1, stop)
        one = one + start
        near = np.minimum(sizes[one], sizes[other]) >= similarity * np.maximum(sizes[one], sizes[other]) - _SLACK
        one, other = one[near], other[near]
        alive = _alive(prints[one], prints[other], np.minimum(sizes[one], sizes[other]), similarity)
        found.append((one[alive], other[alive]))
        start = stop
    return tuple(np.concatenate(side) for side in zip(*found))


def widest(similarity: float, deviations: float = 6.0, least: int = 1 << 20) -> int:
    """Bits by which fingerprints of two sets of the similarity and of `least` members or more differ at most, by so many standard deviations.

    A bit differs with the angle between the sets over pi, if they are large; the cosine of two sets is at least 2s / (1 + s) at
    similarity s. Of small sets, in which a tie of the members is likely, a bit differs more often, at most as in _differs().
    """
    differs = max([math.acos(2 * similarity / (1 + similarity)) / math.pi, *(_differs(similarity, n) for n in range(least, SMALL))])
    return min(64, math.ceil(64 * differs + deviations * math.sqrt(64 * differs * (1 - differs))))


#: Sets of fewer members have a wider bound on the bits by which they differ.
SMALL = 16


@cache
def _differs(similarity: float, least: int) -> float:
    """The largest share of bits by which a set of `least` members and a similar one of as many or more are expected to differ."""
    over = lambda have, more, size: sum(math.comb(more, k) for k in range(more + 1) if 2 * (have + k) > size) / 2**more
    worst = 0.0
    for size in range(least, int(least / similarity + _SLACK) + 1):
        both = math.ceil(similarity * (least + size) / (1 + similarity) - _SLACK)
        for shared in range(both, least + 1):
            sides = [(math.comb(shared, k) / 2**shared, over(k, least - shared, least), over(k, size - shared, size)) for k in range(shared + 1)]
            worst = max(worst, sum(p * (a * (1 - b) + b * (1 - a)) for p, a, b in sides))
    return worst


def _alive(a: np.ndarray, b: np.ndarray, least: np.ndarray, similarity: float, ring: int = 8) -> np.ndarray:
    """Which pairs of fingerprints keep, from some start, the budgets of the chains and of all bits; `least` are sizes of the smaller sets."""
    alive, parts = np.zeros(len(a), dtype=bool), segments(ring)
    for few, bound in ((True, 1), (False, SMALL)):
        own = np.flatnonzero((least < SMALL) == few)
        alive[own] = within(a[own], b[own], parts, widest(similarity, least=bound))
    return alive


def _pairs(similarity: float):
    """(a, b) of each bucket's members whose sizes, places of the shingle and fingerprints let them be similar.

    The first shingle in order that two sets share is in both followed by all else that they share, so they emerge from its bucket
    though other buckets, where too few shingles follow, leave them out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members")
            flat, sizes = members.flatten(), members.value_lengths().to_numpy()
            ids, grams, prints, places = (flat.field(c).to_numpy() for c in ("doc_id", "size", "fp", "pos"))
            left = grams - places  # shingles from the bucket's one on
            prints, ends = prints.view(np.uint64), np.repeat(np.cumsum(sizes), sizes)
            later = ends - 1 - np.arange(len(ids))  # members of the same bucket behind each
            done = np.concatenate([[0], np.cumsum(later)])
            start = 0
            while start < len(ids):  # some 100,000 pairs at a time, of all buckets of the batch
                stop = max(start + 1, int(np.searchsorted(done, done[start] + 100_000, side="right")) - 1)
                i = np.repeat(np.arange(start, stop), later[start:stop])
                j = i + 1 + np.arange(len(i)) - (done[i] - done[start])
                near = (ids[i] != ids[j]) & (np.minimum(grams[i], grams[j]) >= similarity * np.maximum(grams[i], grams[j]) - _SLACK)
                near &= np.minimum(left[i], left[j]) * (1 + similarity) >= similarity * (grams[i] + grams[j]) - 1e-6
                i, j = i[near], j[near]
                alive = _alive(prints[i], prints[j], np.minimum(grams[i], grams[j]), similarity)
                i, j = i[alive], j[alive]
                found = np.unique(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])
                start = stop

    return run


def _dealt(df: DataFrame, one: str, other: str) -> DataFrame:
    """df with i <= j, the blocks of its group, of which there are n, that hold the documents `one` and `other`."""
    block = lambda c: F.pmod(F.xxhash64(F.lit(13), c), F.col("n")).cast("int")
    return df.withColumns({"i": F.least(block(one), block(other)), "j": F.greatest(block(one), block(other))})


def _hot_cells(hot: DataFrame, space: Workspace, block: int, grams: int) -> DataFrame:
    """doc_id, hot, group, i, j: the cells in which the documents of large buckets meet, each two of a bucket in one at least.

    hot is (gram, doc_id, size). Buckets that share documents, as those of near copies do in most of their shingles, are one
    bucket where this moves fewer shingles and compares fewer pairs than bucket by bucket.
    """
    n = F.greatest(F.ceil(F.col("docs") / F.lit(block)), F.ceil(F.col("weight") / F.lit(grams))).cast("int")
    moved, compared = F.col("weight") * F.greatest(F.col("n") - 1, F.lit(1)), F.col("docs").cast("double") * F.col("docs")
    each = hot.groupBy("gram").agg(F.min("doc_id").alias("least"), F.count("*").alias("docs"), F.sum("size").alias("weight"))
    each = space.write(each.withColumn("n", n), "hot-grams", "snappy")  # few: each has over bucket_most rows
    edges = hot.join(sized(each.select("gram", "least")), "gram").select(F.col("doc_id").alias("a"), F.col("least").alias("b")).distinct()
    class_of = space.write(components(edges, space, "hot-classes"), "hot-class", "snappy")
    each = each.join(class_of, each.least == class_of.node, "left").withColumn("class", F.coalesce("component", "least"))
    each = space.write(each.select("gram", "class", "docs", "weight", "n"), "hot-each", "snappy")
    whole = hot.join(sized(each.select("gram", "class")), "gram").groupBy("class", "doc_id").agg(F.max("size").alias("size"))
    whole = space.write(whole, "hot-whole", "snappy")
    split = each.groupBy("class").agg(F.sum(moved).alias("moved"), F.sum(compared).alias("compared"))
    one = whole.groupBy("class").agg(F.count("*").alias("docs"), F.sum("size").alias("weight")).withColumn("n", n)
    one = one.join(split, "class").where((moved <= F.col("moved")) & (compared <= F.col("compared"))).select("class", "n")
    one = space.write(one, "hot-one", "snappy")
    apart = each.join(sized(one.select("class")), "class", "left_anti").select("gram", F.col("gram").alias("group"), "n")
    dealt = whole.join(sized(one), "class").select("doc_id", F.col("class").alias("group"), "n").unionByName(hot.join(apart, "gram").select("doc_id", "group", "n"))
    dealt = dealt.withColumn("k", F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.col("n")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda j: (j != F.col("k")) | (F.col("n") == 1))
    dealt = dealt.select("doc_id", "group", "k", F.explode(others).alias("other"))
    return dealt.select("doc_id", F.lit(1).alias("hot"), "group", F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, bucket_most: int = 256, block: int = 1024, block_grams: int = 1_000_000, block_pairs: int = 250_000) -> DataFrame:
    """doc_id, component_id (the smallest id) of each id that a chain of similar documents joins with another.

    Two documents are similar if their sets of `width`-word shingles have a Jaccard similarity of at least `similarity`. In any
    order of all shingles two such sets share one of their first few, so every similar pair meets in a bucket. Common
    shingles come last in the order; which those are is estimated from a sixteenth of the documents, which
    changes the size of the buckets, not what is found. Pairs of small buckets are pruned by the chains of their fingerprints'
    segments and by Hamming distance (see widest()), and the others verified by their whole sets: a set is moved once for the group of
    documents that candidate pairs join, not once a pair. A group of over `block_grams` shingles or `block_pairs` pairs is cut
    into blocks of documents, and a set is moved to each two blocks between which its document has pairs. A bucket of over
    `bucket_most` documents is cut into blocks of about `block` documents or `block_grams` shingles, each two of which are pruned by
    the same chains and verified in one task that returns fewer edges than it has documents; see _hot_cells(). Rows without an id or without words join
    nothing; rows that share an id are one document that has a copy of each of their texts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    space = Workspace(spark, "near")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    sets = lambda of: of.mapInArrow(lean(_sets(width)), "doc_id long, grams array<long>")
    sample = sets(rows.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(16)) == 0))
    often = sample.select(F.explode("grams").alias("gram")).groupBy("gram").count().where("count >= 4").orderBy(F.desc("count"), "gram").limit(500_000).toArrow()
    gram, count = (often.column(c).to_numpy() for c in ("gram", "count"))
    order = np.argsort(gram)
    shared = spark.sparkContext.broadcast((gram[order], count[order]))
    del often, gram, count

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1_000_000):
                found = [shingles(t or b"", width) for t in batch.column("text").cast(pa.binary()).to_pylist()]
                heads = [prefix(g, *shared.value, similarity) if len(g) else g for g in found]
                sizes = pa.array([len(g) for g in found], pa.int32())
                prints = np.array([simhash_of(g.view(np.uint64)) for g in found], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(prints), _lists(heads)], names=["doc_id", "size", "fp", "heads"])

    # a row a document, for the numbers beside each shingle would take more room than the shingles
    stored = space.write(rows.mapInArrow(lean(firsts), "doc_id long, size int, fp long, heads array<long>"), "heads", "snappy")
    heads = stored.select("doc_id", "size", "fp", F.posexplode("heads").alias("pos", "gram"))
    sizes = space.write(heads.groupBy("gram").count().where("count > 1"), "sizes", "snappy")
    # most shingles are of one document; the others are too many for a broadcast at any size that counts, and are merged at every size
    shared_heads = space.write(heads.join(sizes.hint("merge"), "gram"), "shared", "snappy")
    cold = shared_heads.where(F.col("count") <= bucket_most).groupBy("gram").agg(F.collect_list(F.struct("doc_id", "size", "fp", "pos")).alias("members"))
    pairs = space.write(cold.select("members").mapInArrow(lean(_pairs(similarity)), "a long, b long").distinct(), "pairs", "snappy")
    hot = space.write(shared_heads.where(F.col("count") > bucket_most).select("gram", "doc_id", "size"), "hot", "snappy")
    space.drop("sizes")
    space.drop("shared")

    group_of = components(pairs, space, "candidates").select(F.col("node").alias("a"), F.col("component").alias("group"))
    group_of = space.write(group_of, "group-of", "snappy")
    held = stored.select(F.col("doc_id").alias("a"), "size").join(sized(group_of), "a").groupBy("group").agg(F.sum("size").alias("grams"))
    counted = space.write(pairs.join(sized(group_of), "a").select("group", "a", "b"), "counted", "snappy")
    n = F.ceil(F.greatest(F.col("grams") / F.lit(block_grams), F.sqrt(F.col("count") / F.lit(block_pairs)))).cast("int")
    large = held.join(counted.groupBy("group").count(), "group").select("group", n.alias("n")).where("n > 1")
    large = space.write(large, "large", "snappy")  # few: each has over block_grams shingles or block_pairs pairs
    space.drop("heads")
    dealt = counted.join(sized(large), "group", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    dealt = _dealt(dealt, "a", "b").select(F.lit(0).alias("hot"), "group", "i", "j", "a", "b")
    cells = dealt.select(F.explode(F.array("a", "b")).alias("doc_id"), "hot", "group", "i", "j").unionByName(_hot_cells(hot, space, block, block_grams))
    cells = space.write(cells.groupBy("doc_id").agg(F.collect_set(F.struct("hot", "group", "i", "j")).alias("cells")), "cells", "snappy")
    texts = rows.join(sized(cells), "doc_id").select("doc_id", "cells", "text")
    members = texts.mapInArrow(lean(_sets(width)), "doc_id long, cells array<struct<hot int, group long, i int, j int>>, grams array<long>")
    members = members.select(F.explode("cells").alias("cell"), F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "grams").select("cell.*", "a", "b", "grams")
    met = members.unionByName(dealt.withColumn("grams", F.lit(None).cast("array<long>")))
    met = met.repartition("hot", "group", "i", "j").sortWithinPartitions("hot", "group", "i", "j", F.col("b").asc_nulls_first())
    found = space.write(met.mapInArrow(lean(_cell_links(similarity)), "a long, b long").distinct(), "links", "snappy")
    classes = components(found, space).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    for name in ("pairs", "hot", "hot-grams", "hot-class", "hot-each", "hot-whole", "hot-one", "group-of", "counted", "large", "cells", "links"):
        space.drop(name)
    return classes
