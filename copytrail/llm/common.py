"""Shared helpers: tables, written intermediates, Arrow runs."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a single-process session may go without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = tempfile.mkdtemp(prefix="copytrail-llm-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: it is computed once and survives lost executors."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def free_name(frame: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of the frame has it."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal keys, with the runs' first rows; the input is sorted by the keys (no nulls)."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        change = np.zeros(now.num_rows, dtype=bool)
        change[0] = True
        for key in keys:
            values = now.column(key).to_numpy()
            change[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(change)
        rest = now.slice(starts[-1])
        if len(starts) > 1:
            yield now.slice(0, starts[-1]), starts[:-1]
    if rest is not None:
        yield rest, np.zeros(1, dtype=np.int64)


def in_steps(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut into steps of a few million bytes of one column, or of one row."""
    for batch in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.flatnonzero(np.diff(total // most)) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            yield batch.slice(begin, end - begin)


def tidied(rows: Iterator[pa.RecordBatch], *memories: WordMemory) -> Iterator[pa.RecordBatch]:
    """The rows; at their end the memories are emptied and unused memory goes back to the system, for workers outlive their tasks."""
    try:
        yield from rows
    finally:
        for memory in memories:
            memory.known = [{}]
        pa.default_memory_pool().release_unused()
        gc.collect()
        with suppress(OSError, AttributeError):  # a C library that keeps no such pool
            ctypes.CDLL(None).malloc_trim(0)


class WordMemory:
    """Values of words, learned many at a time when first met. ``learn`` gives, for a list of words, one or more lists of values.

    When it is full, what was learned first stays: common words are met early. What is remembered never changes a result.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[list, ...]], most: int):
        self.known: list[dict] = [{}]
        self.learn, self.most = learn, most

    def prepare(self, texts: list[list[str]]) -> list[dict]:
        """One look-up for each list of values, at least of all words of the given texts."""
        met = set().union(*texts)
        fresh = list(met.difference(self.known[0]))
        if len(self.known[0]) + len(fresh) > self.most:
            self.known = [dict(islice(k.items(), self.most // 3)) for k in self.known]
            fresh = list(met.difference(self.known[0]))
        if fresh:
            values = self.learn(fresh)
            self.known += [{} for _ in values[len(self.known):]]
            for known, column in zip(self.known, values, strict=True):
                known.update(zip(fresh, column, strict=True))
        return self.known
