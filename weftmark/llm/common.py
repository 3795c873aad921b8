"""Shared helpers: inputs, tables in the shared folder, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts: [\x20\x09-\x0D].
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by Spark's reader, so that any store Spark knows works as input."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in tests a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="weftmark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Workspace:
    """Tables written to the shared folder to cut lineage; drop() removes those no longer read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        df.write.mode("overwrite").option("compression", compression).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a key set that is broadcast, about 100 bytes each; a larger one is joined by a shuffle.
BROADCAST_MOST = 1_000_000


def sized(keys: DataFrame, most: int = BROADCAST_MOST) -> DataFrame:
    """A stored table, marked for a broadcast if it has up to `most` rows."""
    return F.broadcast(keys) if keys.count() <= most else keys


def join_uneven(rows: DataFrame, ones: DataFrame, on: Sequence[str], size: str, total: int, parts: int = 10_000) -> DataFrame:
    """rows joined with ones, which has one row a key and in `size` the number of rows with that key.

    Keys with over a `parts`-th of all `total` rows, of which there are fewer than `parts`, are broadcast, so that no task gets
    all rows of one key; the others are shuffled.
    """
    floor = max(100, total // parts)
    hot = F.broadcast(ones.where(F.col(size) > floor))
    rest = rows.join(hot.select(*on), list(on), "left_anti")
    return rows.join(hot, list(on)).unionByName(rest.join(ones.where(F.col(size) <= floor), list(on)))


def keyed(rows: DataFrame, keys: DataFrame, on: Mapping[str, Column], how: str, most: int = BROADCAST_MOST) -> DataFrame:
    """rows with a key (left_semi) or without one (left_anti) in keys, a stored table; nulls are equal to each other.

    `on` gives for each column of keys the column of rows that it is held against. Keys are counted first: up to `most`
    are broadcast, so that rows, with their texts, stay where they are; more are joined by a shuffle of both sides.
    """
    named = sized(keys, most).select(*(F.col(k).alias(f"{k}-of-keys") for k in on))
    held = rows.withColumns({f"{k}-of-rows": value for k, value in on.items()})  # evaluated once, not once a use
    return held.join(named, [F.col(f"`{k}-of-rows`").eqNullSafe(F.col(f"`{k}-of-keys`")) for k in on], how).select(*(F.col(f"`{c}`") for c in rows.columns))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of long texts small: at most `rows` rows cross to Python at once."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that `column` has at most `most` bytes in a slice, or is one row."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which the worker, which lives on, gives freed memory back to the system."""

    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
            trim(0)

    return leaner


def grouped(batches: Iterator[pa.RecordBatch], same: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal keys from batches that are sorted by the key.

    `same` gives for a batch, from its second row on, whether the row has the key of the row before.
    Only the run in hand is kept in memory.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        joined = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch]).combine_chunks().to_batches()[0] if held else None
        if joined is not None and not same(joined.slice(0, 2))[0]:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        cuts = np.flatnonzero(~same(batch)) + 1 if batch.num_rows > 1 else np.array([], dtype=int)
        start = 0
        for cut in cuts.tolist():
            held.append(batch.slice(start, cut - start))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, start = [], cut
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def spread(df: DataFrame) -> int:
    """Shuffle partitions that the session asks for."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def normalised(text: str | Column) -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), ASCII_SPACE, " ")
