"""Best-fit packing planned on the histogram of lengths (operator 2)."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, lean, slices, small_batches, spread, table
from .tokens import public_path, tokenizer

CAPACITY = 2048
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def plan(histogram: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts: (length, first rank, count, first sequence, offset).

    The pieces of a length with ranks first .. first + count - 1 go to as many sequences in a row, all at the
    offset. Sequences of equal room are kept as runs of numbers, so the work depends on the number of
    lengths and runs, not on the number of pieces.
    """
    out: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []  # the rooms that have runs, sorted
    runs: dict[int, list[tuple[int, int]]] = {}
    made = 0

    def keep(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, count))

    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1 .. {capacity}")
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                fresh = -(-left // (capacity // length))
                keep(capacity, made, fresh)
                made += fresh
                continue
            room = rooms[at]
            first, count = runs[room].pop()
            if not runs[room]:
                del runs[room]
                rooms.pop(at)
            used = min(left, count)
            out.append((length, rank, used, first, capacity - room))
            keep(room, first + used, count - used)
            keep(room - length, first, used)
            rank, left = rank + used, left - used
    return out


def _cut(path: str, kind: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizer(path, kind)
        end = np.array([end_id], dtype="<u4")
        for whole in batches:
            for batch in slices(whole, "text", 1_000_000):
                rows = []
                for doc, raw in zip(batch.column("doc_id").to_pylist(), known.encode(batch.column("text").to_pylist())):
                    ids = np.concatenate([np.frombuffer(raw, dtype=known.dtype).astype("<u4"), end])
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        rows.append((doc, k, start, len(part), zlib.crc32(part.tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

    return run


def pieces(docs: DataFrame, path: str, kind: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of each row's ids and end id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(_cut(path, kind, end_id, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(cut: DataFrame, capacity: int = CAPACITY, per_group: int = 20_000) -> DataFrame:
    """sequence_id and offset for each row of cut(length, ...), which must be a stored table.

    A piece's rank within its length counts the pieces of that length in earlier groups, then those before it in its own
    group; groups hash the row, so a length that very many pieces share is spread over many tasks.
    """
    spark = cut.sparkSession
    groups = max(spread(cut), -(-cut.count() // per_group))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    counts = dealt.groupBy("length", "group").count()
    before = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).toLocalIterator()}  # at most `capacity` rows
    steps = sorted(plan(histogram, capacity))
    lengths, ranks, _, sequences, offsets = (np.array(c, dtype=np.int64) for c in zip(*steps)) if steps else (np.zeros(0, np.int64),) * 5
    starts = {int(n): int(i) for n, i in zip(*np.unique(lengths, return_index=True))}
    ends = {n: i + int((lengths == n).sum()) for n, i in starts.items()}
    shared = spark.sparkContext.broadcast((ranks, sequences, offsets, starts, ends))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, sequences, offsets, starts, ends = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            step = np.zeros(len(rank), dtype=np.int64)
            for n in np.unique(length).tolist():
                own = length == n
                step[own] = starts[n] + np.searchsorted(ranks[starts[n] : ends[n]], rank[own], side="right") - 1
            keep = [batch.column(c) for c in batch.schema.names if c != "rank"]
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequences[step] + rank - ranks[step]), pa.array(offsets[step])], names=[*names, "sequence_id", "offset"])

    own = Window.partitionBy("length", "group").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("own", F.row_number().over(own) - 1).join(firsts.select("length", "group", "before"), ["length", "group"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*columns, (F.col("before") + F.col("own")).cast("long").alias("rank")).mapInArrow(
        assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def pack(docs: DataFrame, path: str | None = None, kind: str = "word", end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and the end id; only documents of more than `capacity` ids are cut. Null texts count as empty
    and give one piece, the end id. Rows with a null id are packed with doc_id null; repeated rows
    are packed as often as they come. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    space = Workspace(spark, "packing")
    cut = space.write(pieces(docs, path or public_path("word_bpe_49k.json"), kind, end_id, capacity, id_col, text_col), "pieces")
    return place(cut, capacity)


def sequence_counts(histogram: Mapping[int, int], capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences that the plan makes, least number that could hold all)."""
    steps = plan(histogram, capacity)
    made = max(accumulate((s + c for _, _, c, s, _ in steps), max), default=0) if steps else 0
    return made, -(-sum(n * c for n, c in histogram.items()) // capacity)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
