"""SimHash near-duplicates: pigeonhole blocks, joined on blocks, verified by Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, lgamma, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copytrail.llm.blocks import in_blocks, pair_blocks, run_pairs, spanning_links
from copytrail.llm.common import free_name, in_steps, tidied, written
from copytrail.llm.graph import components

SEED = 42
SLICE = 1 << 14


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``words`` words of the lower-cased text, repeats included; fewer words: of all."""
    parts = text.lower().split() if text else []  # bytes: ASCII letters and the six ASCII white-space characters only
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), SEED)] if parts else [], dtype=np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:len(parts) - words + 1].tolist(), ends[words - 1:].tolist(), strict=True)
    return np.array([digest(line[a:b], SEED) for a, b in spans], dtype=np.uint64)


def _widened(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """``lanes`` hashes of 64 bits for each hash; the first is the hash itself."""
    out = np.empty((len(hashes), lanes), dtype=np.uint64)
    out[:, 0] = hashes
    for lane in range(1, lanes):
        x = hashes + np.uint64((lane * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, lane] = x ^ (x >> np.uint64(31))
    return out


def fingerprint(text: bytes | None, words: int, bits: int) -> bytes:
    """A bit is 1 if it is set in over half of the hashes; no words: all bits zero. Most significant bit first."""
    return majority(shingle_hashes(text, words), bits)


def majority(hashes: np.ndarray, bits: int) -> bytes:
    """The fingerprint of shingle hashes."""
    counts = np.zeros(bits, dtype=np.int64)
    for i in range(0, len(hashes), SLICE):
        wide = np.unpackbits(_widened(hashes[i:i + SLICE], bits // 64).astype(">u8").view(np.uint8), axis=1)
        for j in range(0, len(wide), 255):
            counts += wide[j:j + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """(doc_id, fp) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(t.as_py(), words, bits) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp binary")


def block_keys(marks: DataFrame, bits: int, blocks: int, agree: int) -> DataFrame:
    """(key, node, fp): one row for each choice of ``agree`` of the fingerprint's ``blocks`` blocks."""
    edges = np.linspace(0, bits, blocks + 1).round().astype(int)
    chosen = list(combinations(range(blocks), agree))
    if sum(sorted(np.diff(edges))[-agree:]) > 48:
        raise ValueError("the chosen blocks hold more than 48 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            flat = np.unpackbits(_matrix(batch.column(1), bits), axis=1).astype(np.int64)
            values = [flat[:, a:b] @ (1 << np.arange(b - a)[::-1]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            keys = []
            for k, parts in enumerate(chosen):
                key = np.full(n, k, dtype=np.int64)
                for p in parts:
                    key = (key << int(edges[p + 1] - edges[p])) | values[p]
                keys.append(key)
            rows = pa.array(np.tile(np.arange(n), len(chosen)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), batch.column(0).take(rows), batch.column(1).take(rows)], names=["key", "node", "fp"])

    return marks.select("node", "fp").mapInArrow(run, "key long, node long, fp binary")


def _matrix(column: pa.Array, bits: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, bits // 8)


def near_links(keyed: DataFrame, bits: int, distance: int) -> DataFrame:
    """(a, b): links between nodes at most ``distance`` bits apart, enough to connect all such nodes that share a key."""
    def kernel(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        wide = _matrix(rows.column("fp"), bits).view(np.uint64)
        nodes = rows.column("node").to_numpy()

        def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.bitwise_count(wide[a] ^ wide[b]).sum(axis=1, dtype=np.int32) <= distance

        a, b = spanning_links(starts, rows.num_rows, near)
        return pa.table({"a": nodes[a], "b": nodes[b]})

    return in_blocks(pair_blocks(keyed, "node"), kernel, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, bits: int = 64, blocks: int = 6, agree: int = 2, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of ``docs``.

    Documents link when their fingerprints differ in at most ``distance`` bits; component_id is the smallest doc_id
    reachable. With ``blocks - distance >= agree`` the blocks miss no link (64 bits, distance 4: 6 blocks, 2 agree).
    Texts that share a given part of their shingles are found by ``text_groups``.

    Equal fingerprints are one node, so copies cost one row. Null and empty texts have the all-zero fingerprint and link
    like any other. A null doc_id has a fingerprint, no links and a null component. Repeated rows come out repeated.
    """
    marks = written(fingerprints(docs, words, bits), "fingerprints")
    nodes = marks.groupBy("fp").agg(F.min("doc_id").alias("node")).filter("node is not null")
    links = near_links(block_keys(nodes, bits, blocks, agree), bits, distance)
    classes = nodes.join(components(links), "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    known = marks.join(classes, "fp", "left")
    return known.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


class Layout:
    """Blocks of a fingerprint for texts of at least a similarity: ``keys`` blocks of ``width`` bits from bits in mixed orders.

    The first order cuts the fingerprint as it stands. Two fingerprints that differ in fewer bits than an order has blocks
    share one of them for sure; a pair right at the similarity differs in more, and shares one of all blocks with
    probability ``recall``, from which their number follows. The width follows the number of texts, so that an unrelated pair
    meets as rarely as before when the corpus grows: about ``2 ** CROWD`` unrelated texts come to a block.
    """

    CROWD = 6

    def __init__(self, texts: int, bits: int, similarity: float, recall: float):
        # Shingle sets of this similarity are vectors at this angle; a bit differs with the share of pi that it is.
        apart = acos(2 * similarity / (1 + similarity)) / pi
        self.bits = bits
        self.width = min(40, max(8, ceil(log2(max(2, texts))) - self.CROWD))
        self.keys = _keys_for(recall, bits, apart, self.width)
        #: Bits beyond which a pair is not compared: over four standard deviations above what differs at the similarity.
        self.distance = int(bits * apart + 4.2 * sqrt(bits * apart * (1 - apart)))
        rng = np.random.default_rng(SEED)
        orders = [np.arange(bits), *(rng.permutation(bits) for _ in range(self.keys // (bits // self.width)))]
        self.places = np.concatenate([o[:bits // self.width * self.width].reshape(-1, self.width) for o in orders])[:self.keys]

    def values(self, marks: np.ndarray) -> np.ndarray:
        """The keys of fingerprints (rows of bytes): a number for each block, different for different blocks."""
        out = np.empty((len(marks), self.keys), dtype=np.int64)
        for begin in range(0, len(marks), 1000):
            bits = np.unpackbits(marks[begin:begin + 1000], axis=1).astype(np.int64)
            out[begin:begin + 1000] = np.stack([bits[:, p] @ (1 << np.arange(self.width)) for p in self.places], axis=1)
        return out + (np.arange(self.keys) << self.width)


def _keys_for(recall: float, bits: int, apart: float, width: int) -> int:
    """So many blocks that a pair whose bits differ with probability ``apart`` shares one with probability ``recall``."""
    differ = range(bits - width + 1)
    chances = np.exp([lgamma(bits + 1) - lgamma(d + 1) - lgamma(bits - d + 1) + d * log(apart) + (bits - d) * log(1 - apart) for d in differ])
    shares = np.exp([lgamma(bits - d + 1) - lgamma(bits - d - width + 1) - lgamma(bits + 1) + lgamma(bits - width + 1) for d in differ])
    keys = 1
    while chances @ (1 - (1 - shares) ** keys) < recall:
        keys += 1
    return keys


def _text_marks(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """(doc_id, text_key, fp) of every row; the fingerprint is that of the text's different shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches):
            marks = [majority(np.unique(shingle_hashes(t.as_py(), words)), bits) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(marks, pa.binary())], names=["doc_id", "text_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), text_key(F.col("text")).alias("text_key"))
    return rows.mapInArrow(lambda batches: tidied(run(batches)), "doc_id long, text_key binary, fp binary")


def text_key(text: Column) -> Column:
    """Stands for a text, null counting as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def _keyed(nodes: DataFrame, layout: Layout) -> DataFrame:
    """(key, node, fp): a row for each block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                some = batch.slice(begin, 1000)
                values = layout.values(_matrix(some.column(1), layout.bits))
                rows = pa.array(np.repeat(np.arange(len(some)), layout.keys))
                yield pa.RecordBatch.from_arrays([pa.array(values.ravel()), some.column(0).take(rows), some.column(1).take(rows)], names=["key", "node", "fp"])

    return nodes.select("node", "fp").mapInArrow(run, "key long, node long, fp binary")


def _members(keyed: DataFrame, layout: Layout) -> DataFrame:
    """(key, node): nodes with a near fingerprint among those of a key. Each pair counts in the first block it shares only."""
    def kernel(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        marks = _matrix(rows.column("fp"), layout.bits)
        wide, key = marks.view(np.uint64), rows.column("key").to_numpy()
        met = np.zeros(len(wide), dtype=bool)

        def mark(i: np.ndarray, j: np.ndarray) -> None:
            near = np.bitwise_count(wide[i] ^ wide[j]).sum(axis=1, dtype=np.int32) <= layout.distance
            i, j = i[near], j[near]
            some, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            values = layout.values(marks[some])
            same = values[at[:len(i)]] == values[at[len(i):]]
            first = np.argmax(same, axis=1) == key[i] >> layout.width
            met[i[first]], met[j[first]] = True, True

        for i, j in run_pairs(starts, len(wide), met):
            mark(i, j)
        return pa.table({"key": key[met], "node": rows.column("node").to_numpy()[met]})

    return in_blocks(pair_blocks(keyed, "node"), kernel, "key long, node long").distinct()


def _shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, shingles, size): the sorted shingle hashes of the texts of ``wanted`` (node, text_key), and their bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches):
            sets = [np.unique(shingle_hashes(t.as_py(), words)).astype("<u8").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), pa.array(map(len, sets), pa.int64())], names=["node", "shingles", "size"])

    texts = docs.select(text_key(F.col("text")).alias("text_key"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    found = texts.join(wanted, "text_key").select("node", "text").mapInArrow(run, "node long, shingles binary, size long")
    return found.dropDuplicates(["node"])


def similar_links(sets: DataFrame, members: DataFrame, layout: Layout, similarity: float) -> DataFrame:
    """(a, b): links that connect all nodes of a key that are alike: the exact share of shingles is at least ``similarity``."""
    def kernel(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        wide, nodes = _matrix(rows.column("fp"), layout.bits).view(np.uint64), rows.column("node").to_numpy()
        sets = [np.frombuffer(s, "<u8") for s in rows.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)

        def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            close = np.bitwise_count(wide[a] ^ wide[b]).sum(axis=1, dtype=np.int32) <= layout.distance
            # The share is at most that of the sizes.
            close &= np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b]) - 1e-9
            at = np.flatnonzero(close)
            for left in np.unique(a[at]).tolist():
                own = at[a[at] == left]
                both = shared(sets[left], [sets[j] for j in b[own].tolist()])
                close[own] = both >= similarity * (sizes[left] + sizes[b[own]] - both) - 1e-9
            return close

        a, b = spanning_links(starts, rows.num_rows, near)
        return pa.table({"a": nodes[a], "b": nodes[b]})

    # Members are small as a file, for their keys repeat, and wider in memory.
    blocks = pair_blocks(members.join(sets.select("node", "size").hint("merge"), "node"), "node", weight="size")
    return in_blocks(blocks.join(sets.select("node", "fp", "shingles"), "node"), kernel, "a long, b long").distinct()


def shared(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many of the values of each of the others are in ``own``; all are sorted and without repeats."""
    sizes = np.array([len(o) for o in others], dtype=np.int64)
    flat = np.concatenate(others)
    inside = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat if len(own) else np.zeros(len(flat), dtype=bool)
    return np.diff(np.concatenate([[0], np.cumsum(inside)])[np.concatenate([[0], np.cumsum(sizes)])])


def text_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = 256, recall: float = 0.99) -> DataFrame:
    """(text_key, doc_id, group): a row for each different text of the rows that have a doc_id.

    doc_id is the smallest of the text's rows; texts of one group are connected by links, and every link is verified: the
    two texts share at least ``similarity`` of all their different shingles of ``words`` words (texts of fewer words are one
    shingle; texts without words are alike). Candidates share a block of their fingerprints (``Layout``), of which a pair right at
    the similarity has one with probability ``recall``, and closer pairs sooner. Only members of a block with a near fingerprint
    fetch their shingles, and a pair in the first block it shares. An empty table gives no rows.
    """
    marks = _text_marks(docs, words, bits).filter("doc_id is not null")
    nodes = marks.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "texts")
    layout = Layout(nodes.count(), bits, similarity, recall)
    members = written(_members(_keyed(nodes, layout), layout), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "text_key", "fp").hint("merge"), "node")
    sets = _shingle_sets(docs, wanted.select("node", "text_key"), words).join(wanted.select("node", "fp"), "node")
    groups = components(similar_links(written(sets, "shingles"), members, layout, similarity))
    return nodes.join(groups, "node", "left").select("text_key", "doc_id", F.coalesce("component", "node").alias("group"))


def keep_representatives(docs: DataFrame, **options: float) -> DataFrame:
    """The rows of ``docs`` with the representative of each group of ``text_groups``: the text whose smallest doc_id is the
    group's smallest. One row of it stays, with that doc_id; a doc_id with several texts stays with each that is its
    group's representative. Rows without an id belong to no group and stay.
    """
    key = free_name(docs, "_text_key")
    first = F.min(F.struct("doc_id", "text_key"))
    kept = text_groups(docs, **options).groupBy("group").agg(first.alias("r")).select(F.col("r.doc_id").alias("doc_id"), F.col("r.text_key").alias(key))
    one = docs.withColumn(key, text_key(F.col("text"))).join(kept, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
    return one.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.filter("doc_id is null"))
