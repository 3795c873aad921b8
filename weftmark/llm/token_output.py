"""Token-id files coded by a static range asymmetric numeral system (operator 1).

File format. A dataset is a folder of Parquet files without compression, one row a block, blocks in ascending
order of id within a file and over the files' part numbers. The folder `tables` beside `blocks` holds one
row: the shared frequency table. A block holds whole documents, up to about `block_ids` ids: `docs` (their ids
and lengths), `coded`, and where it stands. `coded` is

    magic b"RANS", u32 lanes, u32 ids, u32 checkpoints,
    per checkpoint: u32 first step, u32 words before it, u32 CRC-32 of the ids of its span, lanes x u64 states,
    u32 words,

all little-endian. Id number i of a block belongs to lane i mod lanes, step i div lanes. Every lane is a coder
of its own with a state in [2^31, 2^63), which takes 32-bit words from one shared stream. At a checkpoint
all states and the place in the stream are known, so its span can be decoded, and checked, without the
spans before it; blocks are independent altogether.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, lean, slices, small_batches, spread, table
from .tokens import public_path, tokenizer

SCALE_BITS, LANES, CHECKPOINT_STEPS, LOW = 18, 4096, 128, 1 << 31
_HEAD = struct.Struct("<4sIII")


def frequencies(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Counts scaled to a sum of 2^bits, at least one for each id that occurs."""
    total, size = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), dtype=np.uint32)
    scaled = np.maximum((counts.astype(np.float64) * size / total).astype(np.int64), counts > 0)
    excess = int(scaled.sum()) - size
    if excess < 0:
        scaled[int(np.argmax(scaled))] -= excess
    order = np.argsort(-scaled, kind="stable")
    while excess > 0:  # take from the most frequent, in proportion
        for i in order:
            if excess <= 0 or scaled[i] <= 1:
                break
            take = min(excess, max(1, int(scaled[i]) // 16), int(scaled[i]) - 1)
            scaled[i] -= take
            excess -= take
    return scaled.astype(np.uint32)


class Coder:
    """Encodes and decodes blocks by one frequency table."""

    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS):
        self.bits = np.uint64(bits)
        self.freq = freq.astype(np.uint64)
        self.first = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self._symbols: np.ndarray | None = None

    def encode(self, ids: np.ndarray, lanes: int | None = None, checkpoint_steps: int = CHECKPOINT_STEPS) -> bytes:
        """A block of the given ids; small blocks get fewer lanes, so that their states do not outweigh their words."""
        count = len(ids)
        lanes = lanes or min(LANES, 1 << max(3, (count // 64).bit_length()))
        steps = -(-count // lanes)
        state = np.full(lanes, LOW, dtype=np.uint64)
        words: list[np.ndarray] = []
        marks: list[tuple[int, int, bytes]] = []
        written, word = 0, np.uint64(32)
        limit_shift = np.uint64(63) - self.bits
        for step in range(steps - 1, -1, -1):
            part = ids[step * lanes : (step + 1) * lanes]
            n = len(part)
            f, x = self.freq[part], state[:n]
            full = x >= (f << limit_shift)
            out = (x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
            if len(out):
                words.append(out)
                written += len(out)
                x = np.where(full, x >> word, x)
            q = x // f
            state[:n] = (q << self.bits) + (x - q * f) + self.first[part]
            if step % checkpoint_steps == 0:
                marks.append((step, written, state.astype("<u8").tobytes()))
        marks.reverse()
        heads = []
        for step, behind, states in marks:
            span = ids[step * lanes : (step + checkpoint_steps) * lanes].astype("<u4").tobytes()
            heads.append(struct.pack("<III", step, written - behind, zlib.crc32(span)) + states)
        stream = b"".join(w.tobytes() for w in reversed(words))
        return _HEAD.pack(b"RANS", lanes, count, len(marks)) + b"".join(heads) + stream

    def decode(self, block: bytes, first: int = 0, spans: int | None = None) -> np.ndarray:
        """The ids of a block, or of `spans` of its checkpoints from number `first` on; checks each span."""
        magic, lanes, count, marks = _HEAD.unpack_from(block)
        if magic != b"RANS":
            raise ValueError("this is no coded block")
        if self._symbols is None:
            self._symbols = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        size, at = 12 + 8 * lanes, _HEAD.size
        heads = [struct.unpack_from("<III", block, at + i * size) for i in range(marks)]
        words = np.frombuffer(block, dtype="<u4", offset=at + marks * size)
        last = marks if spans is None else min(marks, first + spans)
        if first >= last:
            return np.zeros(0, dtype=np.uint32)
        mask, low, word = np.uint64((1 << int(self.bits)) - 1), np.uint64(LOW), np.uint64(32)
        out = []
        for k in range(first, last):
            step, place, crc = heads[k]
            end = heads[k + 1][0] if k + 1 < marks else -(-count // lanes)
            x = np.frombuffer(block, dtype="<u8", count=lanes, offset=at + k * size + 12).copy()
            got = np.empty(min(count, end * lanes) - step * lanes, dtype=np.uint32)
            for s in range(step, end):
                n = min(lanes, count - s * lanes)
                own = x[:n]
                slot = own & mask
                ids = self._symbols[slot]
                own = self.freq[ids] * (own >> self.bits) + slot - self.first[ids]
                need = np.flatnonzero(own < low)
                if len(need):
                    own[need] = (own[need] << word) | words[place : place + len(need)]
                    place += len(need)
                x[:n] = own
                got[(s - step) * lanes : (s - step) * lanes + n] = ids
            if zlib.crc32(got.astype("<u4").tobytes()) != crc:
                raise ValueError(f"checksum of span {k} differs")
            out.append(got)
        return np.concatenate(out)


def _tokenise(path: str, kind: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizer(path, kind, 300_000)
        end = np.array([end_id], dtype=known.dtype).tobytes()
        for whole in batches:
            for batch in slices(whole, "text", 1_000_000):
                ids = [raw + end for raw in known.encode(batch.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def _count(dtype: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, dtype=np.int64)
        for batch in batches:
            counts += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype=dtype), minlength=size)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["id", "n"])

    return run


_BLOCK = "part int, block int, part_start long, n_ids long, doc_ids array<long>, doc_lengths array<long>, coded binary"


def _encode(freq: np.ndarray, dtype: str, block_ids: int):
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("part_start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("coded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part = Coder(freq.value), TaskContext.get().partitionId()
        docs, held, size, start, number = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype=dtype)
            row = (part, number, start, len(ids), docs, [len(h) // np.dtype(dtype).itemsize for h in held], coder.encode(ids))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                docs.append(doc)
                held.append(raw)
                size += len(raw) // np.dtype(dtype).itemsize
                if size >= block_ids:
                    yield close()
                    start, number, docs, held, size = start + size, number + 1, [], [], 0
        if held:
            yield close()

    return run


def write_tokens(docs: DataFrame, target: str, path: str | None = None, kind: str = "byte", end_id: int = 2, block_ids: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of docs in the module's file format to the folder `target`, in ascending order of id.

    Null texts count as empty: the end id alone. Null ids come first. Repeated rows are written as often as they
    come; rows that share an id come in the order of their ids' bytes. A dataset without rows is a table without blocks. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    space = Workspace(spark, "token-ids")
    path = path or public_path("byte_bpe_50k.json")
    known = tokenizer(path, kind)
    dtype, size = known.dtype.str, max(known.tokenizer.get_vocab_size(), end_id + 1)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = space.write(rows.mapInArrow(lean(_tokenise(path, kind, end_id)), "doc_id long, ids binary"), "ids")
    counts = np.zeros(size, dtype=np.int64)
    for row in ids.select("ids").mapInArrow(_count(dtype, size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most a row for each id of the vocabulary
        counts[row.id] = row.n
    freq = frequencies(counts)
    shared = spark.sparkContext.broadcast(freq)
    files = max(spread(docs), int(counts.sum()) >> 26)  # so that a file holds about 2^26 ids at any size
    ordered = ids.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(_encode(shared, dtype, block_ids), _BLOCK).write.option("compression", "none").parquet(f"{target}/blocks")
    spark.createDataFrame([(SCALE_BITS, freq.astype("<u4").tobytes())], "bits int, freq binary").coalesce(1).write.parquet(f"{target}/tables")
    space.drop("ids")


def block_starts(blocks: DataFrame) -> dict[int, int]:
    """For each file, the ids of all files before it."""
    starts, start = {}, 0
    for part, n in sorted(blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):  # a row for each file
        starts[part] = start
        start += n
    return starts


def read_tokens(spark: SparkSession, source: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (array of int) of the documents of a dataset."""
    return _read(spark, source, False)


def token_digests(spark: SparkSession, source: str) -> DataFrame:
    """As read_tokens, with n_tokens and ids_crc32 in place of the ids."""
    return _read(spark, source, True)


def _read(spark: SparkSession, source: str, digest: bool) -> DataFrame:
    bits, raw = spark.read.parquet(f"{source}/tables").first()
    blocks = spark.read.parquet(f"{source}/blocks")
    shared = spark.sparkContext.broadcast((np.frombuffer(raw, dtype="<u4"), block_starts(blocks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, starts = shared.value
        coder = Coder(freq, bits)
        for batch in batches:
            for part, start, docs, lengths, coded in zip(*(c.to_pylist() for c in batch.columns)):
                ids = coder.decode(coded).astype("<u4")
                ends = np.cumsum([0, *lengths])
                parts = [ids[a:b] for a, b in zip(ends, ends[1:])]
                if digest:
                    values = [pa.array(lengths, pa.int64()), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
                else:
                    values = [pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))]
                names = ["doc_id", "start", *(["n_tokens", "ids_crc32"] if digest else ["ids"])]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ends[:-1] + starts[part] + start, pa.int64()), *values], names=names)

    return blocks.select("part", "part_start", "doc_ids", "doc_lengths", "coded").mapInArrow(run, "doc_id long, start long, " + ("n_tokens long, ids_crc32 long" if digest else "ids array<int>"))


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = f"{Workspace(spark, 'token-output').root}/dataset"
    write_tokens(table(spark, sf_dir, "documents"), target)
    return token_digests(spark, target)
