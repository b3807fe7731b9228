"""Work inside groups that share a key: every pair of rows of a key meets in a bounded block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copytrail.llm.common import whole_runs

CHUNK = 2048
SMALL = 24
MOST_BYTES = 16_000_000


def pair_blocks(keyed: DataFrame, row_id: str, chunk: int = CHUNK, *, weight: str | None = None) -> DataFrame:
    """Rows of keys that hold more than one row, with ``_part``, ``_lo`` and ``_hi``.

    A key of n rows is cut by a hash of the row id into ceil(n / chunk) parts, and each pair of parts is one block, so
    no task gets more than about two parts of it at a time and no pair of rows is missed. Rows alone in their key leave.
    With ``weight`` (a column of bytes that come with a row) parts are also cut to about ``MOST_BYTES``. Keyed rows are many
    more than Spark takes them for (a function made them), so the counts are merged: neither side is ever broadcast.
    """
    heavy = F.ceil(F.sum(weight) / MOST_BYTES) if weight else F.lit(1)
    counts = keyed.groupBy("key").agg(F.count("*").alias("_n"), heavy.alias("_heavy")).filter("_n > 1")
    parts = F.greatest(F.ceil(F.col("_n") / chunk), F.col("_heavy")).cast("int")
    cut = keyed.join(counts.hint("merge"), "key").withColumn("_parts", parts).withColumn("_part", F.expr(f"int(pmod(xxhash64({row_id}), _parts))"))
    other = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_other")
    spread = cut.select("*", other)
    return spread.select(*keyed.columns, "_part", F.least("_part", "_other").alias("_lo"), F.greatest("_part", "_other").alias("_hi"))


def in_blocks(blocks: DataFrame, kernel: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """Applies the kernel to tables of whole blocks, given with each block's first row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_runs(batches, ["key", "_lo", "_hi"]):
            yield from kernel(rows, starts).to_batches()

    dealt = blocks.repartition("key", "_lo", "_hi").sortWithinPartitions("key", "_lo", "_hi")
    return dealt.mapInArrow(run, schema)


def run_pairs(starts: np.ndarray, n: int, done: np.ndarray, tile: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the same run, many at a time; those of a long run without pairs whose rows are both ``done`` by then."""
    ends = np.append(starts[1:], n)
    sizes = ends - starts
    run_of = np.repeat(np.arange(len(starts)), sizes)
    few = np.repeat(sizes <= SMALL, sizes)
    for step in range(1, min(SMALL, n)):
        i = np.flatnonzero(few[:-step] & (run_of[:-step] == run_of[step:]))
        if not len(i):
            break
        yield i, i + step
    for k in np.flatnonzero(sizes > SMALL):
        for begin in range(starts[k], ends[k], tile):
            i, j = np.meshgrid(np.arange(begin, min(begin + tile, ends[k])), np.arange(begin, ends[k]), indexing="ij")
            open_pairs = (i < j) & ~(done[i] & done[j])
            yield i[open_pairs], j[open_pairs]


def spanning_links(starts: np.ndarray, n: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links (row numbers) that connect what ``near`` connects inside each run.

    Runs of a few rows give all their links, compared at fixed distances over the whole table at once. Longer ones are
    walked breadth first: a row taken up is compared only with rows not yet reached, which leaves a spanning forest.
    """
    ends = np.append(starts[1:], n)
    sizes = ends - starts
    run_of = np.repeat(np.arange(len(starts)), sizes)
    few = np.repeat(sizes <= SMALL, sizes)
    left, right = [], []
    for step in range(1, min(SMALL, n)):
        i = np.flatnonzero(few[:-step] & (run_of[:-step] == run_of[step:]))
        if not len(i):
            break
        i = i[near(i, i + step)]
        left.append(i)
        right.append(i + step)
    for k in np.flatnonzero(sizes > SMALL):
        open_rows = np.arange(starts[k], ends[k])
        while len(open_rows):
            wave, open_rows = [open_rows[0]], open_rows[1:]
            while wave and len(open_rows):
                row = wave.pop()
                close = near(np.full(len(open_rows), row), open_rows)
                found = open_rows[close]
                open_rows = open_rows[~close]
                left.append(np.full(len(found), row))
                right.append(found)
                wave.extend(found.tolist())
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)
