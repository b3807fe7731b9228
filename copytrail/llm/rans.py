"""Token ids as binary blocks: static range asymmetric numeral system with one shared frequency table."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copytrail.llm.common import shared_folder

LANES = 32
#: Ids between two checkpoints; coding can start at each of them, and so can a decoder.
SECTION = 8192
#: A block ends after the document that fills it.
BLOCK = 1 << 20
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
MASK = np.uint64(0xFFFFFFFF)
MAGIC = b"CTR1"
HEAD = struct.Struct("<4sIQI")  # magic, sections, ids, checksum of what follows
RAW = "part int, block int, within long, n_block long, ids binary, ends array<long>, docs array<long>"


@dataclass(frozen=True)
class Frequencies:
    """Frequencies that sum to 2**bits over the ids that occur; ``slots`` names the id of every value below 2**bits."""

    ids: np.ndarray
    freq: np.ndarray
    bits: int

    @staticmethod
    def of(counts: dict[int, int]) -> Frequencies:
        """Scaled from whole-corpus counts; each id that occurs keeps at least 1."""
        ids = np.array(sorted(counts), dtype=np.int64)
        n = np.array([counts[i] for i in ids.tolist()], dtype=np.float64)
        bits = max(12, int(np.ceil(np.log2(len(ids) + 1))) + 3)
        total = 1 << bits
        freq = np.maximum(1, np.floor(n / n.sum() * (total - len(ids)))).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        if len(ids):
            freq[np.argmax(freq)] += total - freq.sum()
        return Frequencies(ids, freq, bits)

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.freq) - self.freq


class Coder:
    """Encodes and decodes sections of ids, many at once: a step takes one id of every lane of every section."""

    def __init__(self, table: Frequencies):
        size = int(table.ids[-1]) + 1 if len(table.ids) else 1
        self.bits = np.uint64(table.bits)
        self.freq = np.zeros(size, dtype=np.uint64)
        self.start = np.zeros(size, dtype=np.uint64)
        self.freq[table.ids] = table.freq
        self.start[table.ids] = table.starts
        self.slots = np.repeat(table.ids, table.freq).astype(np.uint32)
        self.limit = (LOW >> self.bits) << WORD

    def encode(self, ids: np.ndarray) -> bytes:
        """One block: head, the sections' stream lengths, their states (checkpoints), their streams."""
        n = len(ids)
        sections = -(-n // SECTION)
        steps = -(-min(n, SECTION) // LANES)
        padded = np.full((sections, SECTION if sections > 1 else steps * LANES), ids[-1] if n else 0, dtype=np.uint32)
        padded.reshape(-1)[:n] = ids
        symbols = padded.reshape(sections, -1, LANES)
        state = np.full((sections, LANES), LOW, dtype=np.uint64)
        words = np.zeros(symbols.shape, dtype=np.uint32)
        full = np.zeros(symbols.shape, dtype=bool)
        for k in range(symbols.shape[1] - 1, -1, -1):
            f, s = self.freq[symbols[:, k]], self.start[symbols[:, k]]
            over = state >= self.limit * f
            words[:, k], full[:, k] = state & MASK, over
            state = np.where(over, state >> WORD, state)
            whole = state // f
            state = (whole << self.bits) + (state - whole * f) + s
        lengths = full.sum(axis=(1, 2)).astype("<u4")
        body = lengths.tobytes() + state.astype("<u8").tobytes() + words[full].astype("<u4").tobytes()
        return HEAD.pack(MAGIC, sections, n, zlib.crc32(body)) + body

    def decode(self, block: bytes, first: int = 0, count: int | None = None) -> np.ndarray:
        """The ids of ``count`` sections from checkpoint ``first`` on; a block with a wrong checksum is refused."""
        magic, sections, n, check = HEAD.unpack_from(block)
        if magic != MAGIC or zlib.crc32(memoryview(block)[HEAD.size:]) != check:
            raise ValueError("this block is damaged")
        lengths = np.frombuffer(block, "<u4", sections, HEAD.size).astype(np.int64)
        states = np.frombuffer(block, "<u8", sections * LANES, HEAD.size + 4 * sections).reshape(sections, LANES)
        stream = np.frombuffer(block, "<u4", offset=HEAD.size + (4 + 8 * LANES) * sections)
        last = sections if count is None else min(sections, first + count)
        state = states[first:last].astype(np.uint64)
        place = (np.cumsum(lengths) - lengths)[first:last]
        per = SECTION if sections > 1 else -(-n // LANES) * LANES
        out = np.empty((last - first, per // LANES, LANES), dtype=np.uint32)
        low = (np.uint64(1) << self.bits) - np.uint64(1)
        for k in range(out.shape[1]):
            slot = state & low
            s = self.slots[slot]
            out[:, k] = s
            state = self.freq[s] * (state >> self.bits) + slot - self.start[s]
            need = state < LOW
            at = place[:, None] + np.cumsum(need, axis=1) - 1
            state[need] = (state[need] << WORD) | stream[at[need]].astype(np.uint64)
            place = place + need.sum(axis=1)
        return out.reshape(-1)[:max(0, min(n, last * SECTION) - first * SECTION)]


def _narrow(ids: np.ndarray) -> bytes:
    """Plain ids in two bytes each where they fit, else in four."""
    return ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2" if len(data) == 2 * n else "<u4")


def write(docs: DataFrame, path: str, encode: Callable[[list[str | None]], list[np.ndarray]], end_id: int, block: int = BLOCK) -> None:
    """Writes the ids of every document, in ascending doc_id order and with ``end_id`` after each, below ``path``.

    Three tables: ``raw`` holds blocks of plain ids cut from sorted partitions and is only an intermediate; ``table`` the
    shared frequencies, counted over all ids; ``blocks`` one coded block a row, with the documents in it. A block holds
    whole documents, so a very long one makes a long block of many sections. Rows with a null doc_id come first; rows with
    the same doc_id follow each other in the order of their texts. Null and empty texts hold the end id alone.
    """
    spark = docs.sparkSession
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, within, held, ids, n = 0, 0, [], [], 0

        def one() -> pa.RecordBatch:
            ends = np.cumsum([len(i) for i in ids])
            columns = [pa.array([v], t) for v, t in ((part, pa.int32()), (number, pa.int32()), (within, pa.int64()), (n, pa.int64()),
                       (_narrow(np.concatenate(ids)), pa.binary()), (ends.tolist(), pa.list_(pa.int64())), (held, pa.list_(pa.int64())))]
            return pa.RecordBatch.from_arrays(columns, names=["part", "block", "within", "n_block", "ids", "ends", "docs"])

        part = TaskContext.get().partitionId()
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                some = batch.slice(begin, 256)
                for doc, found in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist()), strict=True):
                    held.append(doc)
                    ids.append(np.append(found, end_id))
                    n += len(found) + 1
                    if n >= block:
                        yield one()
                        number, within, held, ids, n = number + 1, within + n, [], [], 0
        if held:
            yield one()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ranged = rows.repartitionByRange(order[0]).sortWithinPartitions(*order)  # only ids are sampled for the ranges
    ranged.mapInArrow(cut, RAW).write.option("compression", "zstd").parquet(f"{path}/raw")
    raw = spark.read.schema(RAW).parquet(f"{path}/raw")
    _count(raw).write.parquet(f"{path}/table")
    table = read_table(spark, path)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(table)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                data = coder.encode(_wide(row.column(4)[0].as_buffer(), row.column(3)[0].as_py()))
                yield pa.RecordBatch.from_arrays([*(row.column(i) for i in range(4)), pa.array([data], pa.binary()), row.column(5), row.column(6)],
                                                 names=["part", "block", "within", "n_block", "data", "ends", "docs"])

    raw.mapInArrow(code, BLOCKS).write.parquet(f"{path}/blocks")


BLOCKS = "part int, block int, within long, n_block long, data binary, ends array<long>, docs array<long>"


def _count(raw: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs; every task adds up its own ids first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for ids, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                now = np.bincount(_wide(ids.as_buffer(), n))
                total, now = (total, now) if len(total) >= len(now) else (now, total)
                total[:len(now)] += now
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["id", "n"])

    return raw.select("ids", "n_block").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def read_table(spark: SparkSession, path: str) -> Frequencies:
    """The shared table: as many rows as the vocabulary has ids, whatever the corpus."""
    rows = spark.read.schema("id long, n long").parquet(f"{path}/table").collect()
    return Frequencies.of({r.id: r.n for r in rows})


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of the files; start counts the ids before it.

    Blocks are decoded independently. Only the sorted partitions' sizes are added up beforehand and sent to all tasks: one
    row each, and their number is a setting (spark.sql.shuffle.partitions).
    """
    table = read_table(spark, path)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sizes = blocks.groupBy("part").agg(F.sum("n_block").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(table)
        for batch in batches:
            for begin, data, ends, docs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids = coder.decode(data).astype("<u4")
                starts = [0, *ends[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array([begin + s for s in starts], pa.int64()), pa.array([e - s for s, e in zip(starts, ends, strict=True)], pa.int64()),
                     pa.array([ids[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    placed = blocks.join(F.broadcast(begins), "part").select((F.col("before") + F.col("within")).alias("begin"), "data", "ends", "docs")
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def digests(docs: DataFrame, folder: str, encode: Callable[[list[str | None]], list[np.ndarray]], end_id: int) -> DataFrame:
    """Writes the files below ``folder``, reads them back and gives (doc_id, start, n_tokens, ids_crc32)."""
    write(docs, folder, encode, end_id)
    found = read(docs.sparkSession, folder)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def new_folder(spark: SparkSession) -> str:
    """A fresh folder for files in the shared one."""
    return f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
