"""Exact duplicates through a sharded cuckoo-filter index of live digests (operator 10)."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, join_uneven, keyed, normalised, spread, table

#: Slots of a bucket, fingerprint bits, and moves before a table counts as full.
SLOTS, FINGERPRINT, KICKS = 4, 0xFFFF, 200


class CuckooFilter:
    """Cuckoo filter of 32-byte digests: two candidate buckets each, 16-bit fingerprints, deletion allowed."""

    def __init__(self, buckets: int = 64):
        self.buckets = 1 << max(1, (buckets - 1).bit_length())
        self.table = [0] * (self.buckets * SLOTS)
        self._turn = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        a, b = struct.unpack_from("<QH", digest)
        mark = b or 1
        first = a & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def contains(self, digest: bytes) -> bool:
        mark, i, j = self._places(digest)
        return mark in self.table[i * SLOTS : i * SLOTS + SLOTS] or mark in self.table[j * SLOTS : j * SLOTS + SLOTS]

    def _put(self, bucket: int, mark: int) -> bool:
        for k in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.table[k]:
                self.table[k] = mark
                return True
        return False

    def insert(self, digest: bytes) -> bool:
        """False when the filter overflows; it then misses one mark and has to be rebuilt from the stored keys."""
        mark, i, j = self._places(digest)
        if self._put(i, mark) or self._put(j, mark):
            return True
        for _ in range(KICKS):
            self._turn = (self._turn + 1) % SLOTS
            k = i * SLOTS + self._turn
            mark, self.table[k] = self.table[k], mark
            i = self._other(i, mark)
            if self._put(i, mark):
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        mark, i, j = self._places(digest)
        for bucket in (i, j):
            for k in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.table[k] == mark:
                    self.table[k] = 0
                    return True
        return False


class CuckooIndex:
    """A cuckoo filter in front of the stored keys of its live digests.

    A miss of the filter is final. A hit is verified against the bucket of stored content with that digest
    prefix: the full SHA-256 and the length of the normalised text. Overflow doubles the filter and fills it
    anew from the stored keys.
    """

    def __init__(self, expected: int = 0):
        self.filter = CuckooFilter(max(16, expected // 3))
        self.stored: dict[bytes, dict[tuple[bytes, int], list]] = {}
        self.live = 0
        self.hits = self.false_hits = self.resizes = 0

    def find(self, digest: bytes, length: int) -> list | None:
        """The live entry [keeper, copies] of this content, or None."""
        if not self.filter.contains(digest):
            return None
        entry = self.stored.get(digest[:8], {}).get((digest, length))
        self.hits += 1
        self.false_hits += entry is None
        return entry

    def insert(self, digest: bytes, length: int, keeper, copies: int = 1) -> bool:
        """Add copies of a content; True if it was new. The smaller keeper stays, null last."""
        if (entry := self.find(digest, length)) is not None:
            entry[1] += copies
            if keeper is not None and (entry[0] is None or keeper < entry[0]):
                entry[0] = keeper
            return False
        self.stored.setdefault(digest[:8], {})[(digest, length)] = [keeper, copies]
        self.live += 1
        if not self.filter.insert(digest):
            self._resize()
        return True

    def delete(self, digest: bytes, length: int) -> bool:
        """Remove a live content; False if it is not stored."""
        if self.find(digest, length) is None:
            return False
        bucket = self.stored[digest[:8]]
        del bucket[(digest, length)]
        if not bucket:
            del self.stored[digest[:8]]
        self.live -= 1
        return self.filter.delete(digest)

    def _resize(self) -> None:
        buckets = self.filter.buckets
        while True:
            buckets, self.resizes = buckets * 2, self.resizes + 1
            self.filter = CuckooFilter(buckets)
            if all(self.filter.insert(d) for b in self.stored.values() for d, _ in b):
                return

    def entries(self) -> Iterator[tuple[bytes, int, object, int]]:
        for bucket in self.stored.values():
            for (digest, length), (keeper, copies) in bucket.items():
                yield digest, length, keeper, copies


ENTRY = "digest binary, length int, keep_id long, group_size long"
_ARROW = pa.schema([("digest", pa.binary()), ("length", pa.int32()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _emit(index: CuckooIndex, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for entry in index.entries():
        held.append(entry)
        if len(held) == rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), _ARROW)], schema=_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), _ARROW)], schema=_ARROW)


def _fold(most: int | None):
    """Feed rows through an index; past `most` live digests, hand on what there is and start anew."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                index.insert(*row)
            if most and index.live >= most:
                yield from _emit(index)
                index = CuckooIndex()
        yield from _emit(index)

    return run


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (SHA-256 of the normalised text in UTF-8), length in characters."""
    text = normalised(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t")).select("doc_id", F.unhex(F.sha2("t", 256)).alias("digest"), F.length("t").alias("length"))


def shards(rows: int, spark_partitions: int, per_shard: int = 500_000) -> int:
    """Shards so that the stored keys of one, about 250 bytes each, fit a worker at any number of rows."""
    return max(spark_partitions, -(-rows // per_shard))


def index_of(keys: DataFrame, shard_count: int, local_most: int = 200_000) -> DataFrame:
    """The live entries of keys(doc_id, digest, length): one row a content.

    Each task first folds its own rows through a local index, so that a content with very many copies
    reaches its shard as a row a task, then each shard folds what it is dealt by digest.
    """
    local = keys.select("digest", "length", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")).mapInArrow(_fold(local_most), ENTRY)
    return local.repartition(shard_count, F.substring("digest", 1, 8)).mapInArrow(_fold(None), ENTRY)


def insert(index: DataFrame, keys: DataFrame, shard_count: int) -> DataFrame:
    """An index with further documents added to its live contents."""
    more = index_of(keys, shard_count)
    return index.unionByName(more).repartition(shard_count, F.substring("digest", 1, 8)).mapInArrow(_fold(None), ENTRY)


def delete(index: DataFrame, keys: DataFrame, shard_count: int) -> DataFrame:
    """An index without the contents of keys: each shard loads its entries and deletes what it is dealt."""

    def run(batches):
        held, gone = CuckooIndex(), []
        for batch in batches:
            for digest, length, keeper, copies, remove in zip(*(c.to_pylist() for c in batch.columns)):
                if remove:
                    gone.append((digest, length))
                else:
                    held.insert(digest, length, keeper, copies)
        for key in gone:
            held.delete(*key)
        yield from _emit(held)

    out = keys.select("digest", "length").distinct().select("digest", "length", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("remove"))
    return index.withColumn("remove", F.lit(False)).unionByName(out).repartition(shard_count, F.substring("digest", 1, 8)).mapInArrow(run, ENTRY)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of docs.

    Null and empty texts are equal to each other. Of equal texts the row with the smallest id stays; ids that
    are null come last, and in a group of null ids only, keep_id is null and no row is kept. Rows with
    the same id and text are all kept or all dropped. Other columns of docs are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "exact-dedup")
    keys = space.write(digests(docs, id_col, text_col), "keys", "snappy")
    total = keys.count()
    index = space.write(index_of(keys, shards(total, spread(docs))), "index", "snappy")
    return join_uneven(keys, index, ["digest", "length"], "group_size", total).select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, with all its columns, for each normalised text: that with the smallest id, null last.

    Of rows equal in id and text, and of those of a text that has null ids only, the row with the smallest hash of all columns stays.
    Rows are dropped by id and text, so a row never goes because another text has its id.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "unique")
    keys = space.write(digests(docs, id_col, text_col), "keys", "snappy")
    total = keys.count()
    index = space.write(index_of(keys, shards(total, spread(docs))), "index", "snappy")
    mark = F.xxhash64("digest", "length").alias("mark")
    copied = index.where("group_size > 1")
    of = space.write(join_uneven(keys, copied, ["digest", "length"], "group_size", total), "members", "snappy")
    dropped = space.write(of.where("keep_id IS NOT NULL AND NOT (doc_id <=> keep_id)").select("doc_id", mark).distinct(), "dropped", "snappy")
    repeated = space.write(of.where("doc_id <=> keep_id").groupBy("doc_id", mark).count().where("count > 1").drop("count"), "repeated", "snappy")
    text = normalised(text_col)
    on = {"doc_id": F.col(id_col).cast("long"), "mark": F.xxhash64(F.unhex(F.sha2(text, 256)), F.length(text))}
    left = keyed(docs, dropped, on, "left_anti")
    if repeated.isEmpty():
        return left
    again = keyed(left, repeated, on, "left_semi").select(F.struct("*").alias("row"), *(v.alias(k) for k, v in on.items()))
    once = again.groupBy("doc_id", "mark").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return keyed(left, repeated, on, "left_anti").unionByName(once)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its equal texts."""
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
