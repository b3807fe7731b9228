"""Embedding near-duplicates: random-hyperplane signs in several tables, exact cosine, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copytrail.llm.blocks import SMALL, in_blocks, pair_blocks
from copytrail.llm.common import written
from copytrail.llm.graph import components

SEED = 20260701
TILE = 256
#: Places of a key that hold the number of its table, and the least and most that hold signs.
TABLE_BITS, LEAST_BITS, MOST_BITS = 10, 12, 32
OUT = "a long, b long, n long"


def tables_for(cosine: float, bits: int, recall: float) -> int:
    """Tables after which a pair at exactly this cosine shares a bucket of one of them with probability ``recall``."""
    same = (1 - acos(cosine) / pi) ** bits
    return ceil(log(1 - recall) / log(1 - same))


def bits_for(nodes: int) -> int:
    """Signs a key so that about a sixteenth of an unrelated vector falls into each bucket; more only cost more tables."""
    return min(max(ceil(log2(max(nodes, 1))) + 4, LEAST_BITS), MOST_BITS)


def _signs(nodes: DataFrame, tables: int, bits: int, kind: str) -> DataFrame:
    """(node, copies, size, signs, vector): signs holds the bucket of each table. One row a vector."""
    weights = 1 << np.arange(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                some = batch.slice(begin, 500)
                lists = some.column(2)
                sizes = np.diff(lists.offsets.to_numpy())
                for size in np.unique(sizes).tolist():
                    rows = some.take(pa.array(np.flatnonzero(sizes == size)))
                    flat = rows.column(2).flatten().to_numpy().reshape(-1, size).astype(np.float64)
                    if size not in planes:
                        planes[size] = np.random.default_rng([SEED, size]).standard_normal((size, tables * bits))
                    buckets = ((flat @ planes[size] > 0).reshape(len(flat), tables, bits) @ weights).astype("<u4")
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0), rows.column(1), pa.array(np.full(len(flat), size)), pa.array([r.tobytes() for r in buckets], pa.binary()),
                         pa.array([r.tobytes() for r in flat.astype(kind)], pa.binary())], names=["node", "copies", "size", "signs", "vector"])

    return nodes.select("node", "copies", "vector").mapInArrow(run, "node long, copies long, size long, signs binary, vector binary")


def _keys(signed: DataFrame, tables: int, bits: int) -> DataFrame:
    """(key, node): one narrow row for each table. Vectors of different size never share a key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype="<u4").reshape(-1, tables).astype(np.int64)
            first = (batch.column(1).to_numpy() << TABLE_BITS)[:, None] + np.arange(tables)
            yield pa.RecordBatch.from_arrays([pa.array(((first << bits) + buckets).ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), tables))],
                                             names=["key", "node"])

    return signed.select("node", "size", "signs").mapInArrow(run, "key long, node long")


def _kernel(cosine: float, tables: int, bits: int, kind: str):
    def kernel(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        n = rows.num_rows
        node, copies, part, lo, hi, key = (rows.column(c).to_numpy() for c in ("node", "copies", "_part", "_lo", "_hi", "key"))
        signs = np.frombuffer(b"".join(rows.column("signs").to_pylist()), dtype="<u4").reshape(n, tables)
        sizes = np.diff(np.append(starts, n))
        run_of = np.repeat(np.arange(len(starts)), sizes)
        table = (key >> bits) & ((1 << TABLE_BITS) - 1)
        raw = rows.column("vector").to_pylist()
        counts = np.zeros(n, dtype=np.int64)
        left, right = [], []

        def counted(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Pairs that belong to this block and to no earlier table."""
            mine = np.where(part[i] == part[j], lo[i] == hi[i], True)
            met = signs[i] == signs[j]
            return mine & (np.argmax(met, axis=1) == table[i])

        few = np.repeat(sizes <= SMALL, sizes)
        order = np.flatnonzero(few)
        by_size: dict[int, list[int]] = {}
        for i in order.tolist():
            by_size.setdefault(len(raw[i]), []).append(i)
        for own in by_size.values():
            own = np.array(own)
            unit = np.frombuffer(b"".join([raw[i] for i in own.tolist()]), dtype=kind).reshape(len(own), -1).astype(np.float64)
            unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
            for step in range(1, min(SMALL, len(own))):
                at = np.flatnonzero(run_of[own[:-step]] == run_of[own[step:]])
                if not len(at):
                    break
                at = at[np.einsum("ij,ij->i", unit[at], unit[at + step]) >= cosine]
                i, j = own[at], own[at + step]
                left.append(i)
                right.append(j)
                once = counted(i, j)
                np.add.at(counts, i[once], copies[j[once]])
                np.add.at(counts, j[once], copies[i[once]])
        for k in np.flatnonzero(sizes > SMALL):
            own = np.arange(starts[k], starts[k] + sizes[k])
            unit = np.frombuffer(b"".join([raw[i] for i in own.tolist()]), dtype=kind).reshape(len(own), -1).astype(np.float64)
            unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
            near = np.zeros((len(own), len(own)), dtype=bool)
            for t in range(0, len(own), TILE):
                near[t:t + TILE] = unit[t:t + TILE] @ unit.T >= cosine
                i, j = np.nonzero(near[t:t + TILE])
                i = i + t
                other = i != j
                i, j = own[i[other]], own[j[other]]
                once = counted(i, j)
                np.add.at(counts, i[once], copies[j[once]])
            np.fill_diagonal(near, True)
            label, before = np.arange(len(own)), None
            while before is None or (label != before).any():
                before = label
                label = np.concatenate([np.where(near[t:t + TILE], label, len(own)).min(axis=1) for t in range(0, len(own), TILE)])
            linked = np.flatnonzero(label != np.arange(len(own)))
            left.append(own[linked])
            right.append(own[label[linked]])
        some = np.flatnonzero(counts)
        none = np.zeros(0, dtype=np.int64)
        a, b = np.concatenate(left or [none]), np.concatenate(right or [none])
        return pa.table({"a": np.concatenate([node[a], node[some]]), "b": pa.array(np.concatenate([node[b], node[some]])),
                         "n": pa.array(np.concatenate([np.zeros(len(a), dtype=np.int64), counts[some]]))})

    return kernel


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, bits: int | None = None, recall: float = 0.999) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding).

    Pairs that share the signs of ``bits`` random hyperplanes in one of the tables are compared by their exact cosine in
    double precision and link when it is at least ``cosine``; tables follow from ``recall`` for pairs right at that cosine, and
    bits, unless given, from the number of different vectors, so that buckets of unrelated ones do not grow with the input.
    Keys are dealt as narrow rows; the vector and its signs, stored once, join only the rows whose key another vector shares.
    n_links counts the other rows linked directly, component_id is the smallest vec_id reachable, kept marks it.

    Equal vectors are one node with a number of copies, so copies are never paired; a bucket of any size is compared in
    bounded blocks that give counts and connecting links, not pairs: a pair is counted only in the first table where both
    meet. A null vector, one that is zero or empty, or that holds a null, infinite or not-a-number component, links with
    nothing and is its own component; vectors of different length do not link. A null vec_id links with nothing and has no component.
    """
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    wide, kind = ("float", "<f4") if single else ("double", "<f8")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{wide}>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("vector", F.when(F.col("vec_id").isNotNull() & sound, F.col("vector")))
    nodes = written(rows.filter("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "vectors")
    bits = bits or bits_for(nodes.count())
    tables = tables_for(cosine, bits, recall)
    if bits > MOST_BITS or tables >= 1 << TABLE_BITS:
        raise ValueError(f"this recall needs {tables} tables of {bits} signs; use fewer bits")
    signed = written(_signs(nodes, tables, bits, kind), "signs")
    shared = pair_blocks(_keys(signed, tables, bits), "node").join(signed.drop("size"), "node")
    found = written(in_blocks(shared, _kernel(cosine, tables, bits, kind), OUT), "links")
    counts = found.filter("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    classes = components(found.filter("n = 0").select("a", "b"))
    known = nodes.join(counts, "node", "left").join(classes, "node", "left").select(
        "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    out = rows.join(known, "vector", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
