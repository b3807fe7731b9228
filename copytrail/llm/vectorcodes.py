"""Vector code compression: product codes fitted by Lloyd rounds that walk a tree over parts together with a tree over entries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copytrail.llm.common import written

#: Vectors of one block, the unit that is read, walked and held at a time.
BLOCK = 4096
#: Points of a leaf, about; a leaf that stays uncertain is compared point by point.
LEAF = 32
LARGEST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Tree:
    """A balanced tree over integer points. Node i has the children 2i + 1 and 2i + 2, and the points ``begin[i]`` up to
    ``end[i]`` in tree order; boxes and sums of every node are kept."""

    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @staticmethod
    def build(points: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
        """The tree and the places of the points in tree order: every node is cut in half along its widest side."""
        n, order = len(points), np.arange(len(points))
        depth = _depth(n, leaf)
        lows, highs, sums = [], [], []
        for level in range(depth + 1):
            cuts = (np.arange((1 << level) + 1) * n) >> level
            lows.append(np.minimum.reduceat(points, cuts[:-1]))
            highs.append(np.maximum.reduceat(points, cuts[:-1]))
            sums.append(np.add.reduceat(points, cuts[:-1]))
            if level < depth:
                node = np.repeat(np.arange(1 << level), np.diff(cuts))
                side = np.argmax(highs[-1] - lows[-1], axis=1)
                moved = np.lexsort((points[np.arange(n), side[node]], node))
                points, order = points[moved], order[moved]
        return Tree(points, np.concatenate(lows), np.concatenate(highs), np.concatenate(sums)), order

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First point and the one after the last of every node."""
        levels = range(len(self.low).bit_length())
        cuts = [(np.arange((1 << level) + 1) * len(self.points)) >> level for level in levels]
        return np.concatenate([c[:-1] for c in cuts]), np.concatenate([c[1:] for c in cuts])


def _depth(n: int, leaf: int) -> int:
    return max(0, (max(1, n) // leaf).bit_length() - 1)


@dataclass(frozen=True)
class Entries:
    """A tree over the entries of one codebook. ``entry`` is the entry of a node that holds one alone, else -1; other nodes
    have ``children`` nodes from ``first`` on."""

    low: np.ndarray
    high: np.ndarray
    entry: np.ndarray
    first: np.ndarray
    children: np.ndarray

    @staticmethod
    def build(entries: np.ndarray) -> Entries:
        tree, order = Tree.build(entries, 1)
        begin, end = tree.runs()
        nodes, inner = len(begin), len(begin) // 2
        alone = end - begin == 1
        first, children = 2 * np.arange(nodes) + 1, np.full(nodes, 2)
        # A leaf of two entries gets one node for each of them.
        crowded = np.flatnonzero((np.arange(nodes) >= inner) & ~alone)
        first[crowded] = nodes + np.cumsum(end[crowded] - begin[crowded]) - (end[crowded] - begin[crowded])
        children[crowded] = end[crowded] - begin[crowded]
        singles = np.concatenate([np.arange(begin[c], end[c]) for c in crowded.tolist()] or [np.zeros(0, dtype=np.int64)])
        entry = np.concatenate([np.where(alone, order[begin], -1), order[singles]])
        return Entries(np.concatenate([tree.low, tree.points[singles]]), np.concatenate([tree.high, tree.points[singles]]), entry,
                       np.append(first, np.zeros(len(singles), dtype=np.int64)), np.append(children, np.zeros(len(singles), dtype=np.int64)))


def walk(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, their entries, points, their keys): which nodes lie wholly with one entry, and the points of the other leaves.

    A key is the squared distance times the number of entries plus the entry, so the least key is the nearest entry and of
    equals the lower one. Pairs of a node of the tree and one of the entries go down together. A pair is dropped when its
    boxes are further apart than the farthest that any point of the node can be from the entries of another pair; a node
    with one entry left is assigned whole. What is uncertain in a leaf is compared by integers.
    """
    entries, k = Entries.build(book), len(book)
    begin, end = tree.runs()
    inner = len(begin) // 2
    p, e = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    whole_nodes, whole_entries, leaf_nodes, leaf_entries = [], [], [], []
    while len(p):
        gap = np.maximum(0, np.maximum(entries.low[e] - tree.high[p], tree.low[p] - entries.high[e]))
        far = np.maximum(tree.high[p] - entries.low[e], entries.high[e] - tree.low[p])
        starts = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        most = np.minimum.reduceat((far ** 2).sum(axis=1), starts)
        keep = (gap ** 2).sum(axis=1) <= np.repeat(most, np.diff(np.append(starts, len(p))))
        p, e = p[keep], e[keep]
        starts = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        sizes = np.diff(np.append(starts, len(p)))
        single = entries.entry[e] >= 0
        sure = np.repeat(sizes == 1, sizes) & single
        whole_nodes.append(p[sure])
        whole_entries.append(entries.entry[e[sure]])
        last = np.repeat(np.logical_and.reduceat(single, starts), sizes) & (p >= inner) & ~sure
        leaf_nodes.append(p[last])
        leaf_entries.append(e[last])
        rest = ~sure & ~last
        p, e, single = p[rest], e[rest], single[rest]
        times = np.where(single, 1, entries.children[e])
        begins = np.cumsum(times) - times
        offset = np.arange(times.sum()) - np.repeat(begins, times)
        p, e = np.repeat(p, times), np.where(np.repeat(single, times), np.repeat(e, times), np.repeat(entries.first[e], times) + offset)
        down = p < inner
        p, e = np.concatenate([p[~down], 2 * p[down] + 1, 2 * p[down] + 2]), np.concatenate([e[~down], e[down], e[down]])
        order = np.argsort(p, kind="stable")
        p, e = p[order], e[order]
    nodes, ends = np.concatenate(leaf_nodes), np.concatenate(leaf_entries)
    sizes = end[nodes] - begin[nodes]
    at = np.repeat(begin[nodes] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    near = ((tree.points[at] - np.repeat(entries.low[ends], sizes, axis=0)) ** 2).sum(axis=1) * k + np.repeat(entries.entry[ends], sizes)
    best = np.full(len(tree.points), LARGEST)
    np.minimum.at(best, at, near)
    points = np.flatnonzero(best < LARGEST)
    return np.concatenate(whole_nodes), np.concatenate(whole_entries), points, best[points]


def totals(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points and their sums by nearest entry; nodes that are assigned whole give their kept sums."""
    nodes, chosen, points, keys = walk(tree, book)
    begin, end = tree.runs()
    counts, sums = np.zeros(len(book), dtype=np.int64), np.zeros(book.shape, dtype=np.int64)
    np.add.at(counts, chosen, (end - begin)[nodes])
    np.add.at(sums, chosen, tree.sums[nodes])
    np.add.at(counts, keys % len(book), 1)
    np.add.at(sums, keys % len(book), tree.points[points])
    return counts, sums


def assign(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every point, in tree order, and the squared distance to it."""
    nodes, chosen, points, keys = walk(tree, book)
    begin, end = tree.runs()
    sizes = end[nodes] - begin[nodes]
    at = np.repeat(begin[nodes] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    codes = np.empty(len(tree.points), dtype=np.int64)
    codes[at], codes[points] = np.repeat(chosen, sizes), keys % len(book)
    return codes, ((tree.points - book[codes]) ** 2).sum(axis=1)


TREES = "ids array<long>, carried array<string>, places binary, points binary, boxes binary, sums binary"


def _forest(vectors: DataFrame, parts: int, width: int, scale: int) -> DataFrame:
    """Blocks of vectors (vec_id, carried, vector) as one tree for each part position, written once for all rounds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                some = batch.slice(first, BLOCK)
                flat = some.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                cut = np.floor(flat * scale).astype(np.int64).reshape(len(some), parts, width)
                built = [Tree.build(cut[:, j]) for j in range(parts)]
                binary = [np.stack(x).astype(kind).tobytes() for x, kind in (
                    ([order for _, order in built], "<i4"), ([t.points for t, _ in built], "<i4"), ([np.stack([t.low, t.high]) for t, _ in built], "<i4"),
                    ([t.sums for t, _ in built], "<i8"))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([some.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([some.column(1).to_pylist()], pa.list_(pa.string())),
                     *(pa.array([b], pa.binary()) for b in binary)], names=["ids", "carried", "places", "points", "boxes", "sums"])

    return written(vectors.mapInArrow(run, TREES), "part_trees")


def _trees(row: dict, parts: int, width: int) -> list[Tree]:
    """The trees of a block, by part position."""
    points, boxes, sums = (np.frombuffer(row[c], kind).astype(np.int64) for c, kind in (("points", "<i4"), ("boxes", "<i4"), ("sums", "<i8")))
    points, boxes, sums = points.reshape(parts, -1, width), boxes.reshape(parts, 2, -1, width), sums.reshape(parts, -1, width)
    return [Tree(points[j], boxes[j, 0], boxes[j, 1], sums[j]) for j in range(parts)]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _seeds(vectors: DataFrame, entries: int) -> list[tuple[float, ...]]:
    """The vectors of the ``entries`` smallest ids, ascending; every task names its own smallest first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, tuple[float, ...]] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i in np.flatnonzero(ids <= (max(least) if len(least) >= entries else LARGEST)).tolist():
                vector = tuple(batch.column(1)[i].as_py())
                least[int(ids[i])] = min(vector, least.get(int(ids[i]), vector))
                if len(least) > entries:
                    del least[max(least)]
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int64()), pa.array(list(map(list, least.values())), pa.list_(pa.float64()))], names=["vec_id", "vector"])

    own = vectors.filter("vec_id is not null").select("vec_id", "vector").mapInArrow(run, "vec_id long, vector array<double>")
    least = own.groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id").limit(entries)
    return [tuple(r.vector) for r in least.collect()]


def _moved(forest: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: every entry is the floor of its parts' mean, entries without parts stay."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), dtype=np.int64), np.zeros(books.shape, dtype=np.int64)
        for row in _rows(batches):
            for j, tree in enumerate(_trees(row, parts, width)):
                n, s = totals(tree, books[j])
                counts[j] += n
                sums[j] += s
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts.ravel()[used]), pa.array(sums.reshape(-1, width)[used].tolist(), pa.list_(pa.int64()))], names=["cell", "n", "sums"])

    found = forest.select("points", "boxes", "sums").mapInArrow(run, "cell long, n long, sums array<long>")
    # Sums of all tasks' sums do not fit 64 bits for every input.
    wide = [F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(width)]
    new = books.copy()
    for r in found.groupBy("cell").agg(F.sum("n").alias("n"), *wide).collect():  # one row an entry
        new[r.cell // entries, r.cell % entries] = [int(r[f"s{i}"]) // r.n for i in range(width)]
    return new


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, carry: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """Codes of vectors (vec_id, embedding) and the codebooks they name, an integer array (parts, entries, width).

    The codes come as (vec_id, carried, code, error): ``code`` holds one byte a part, ``error`` the squared distance between
    the vector's integers, floor(scale * component), and what the code stands for; ``carried`` is the column ``carry`` as
    text, null without one. Codebooks begin with the parts of the smallest vec_ids; each round assigns every part to its nearest
    entry, of equals to the lower one, and moves entries to the floor of their parts' mean. All arithmetic is on integers.

    Rows whose vector is null or holds a null, infinite or not-a-number component are left out. The length of most vectors
    (of equals the shorter) is the codebooks'; vectors of another length, empty ones too, get a null code and error. A null
    vec_id is coded but starts no entry; of a repeated one the least vector does. With fewer ids there are fewer entries,
    and without any no rows. Components so large that 64 bits cannot hold the distances are refused by a ValueError, as
    is a length that the parts do not divide. Other columns of any name are ignored.

    Vectors are read into blocks of trees once; every round reads these and sends one row an entry from each task.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code byte names one of 1 to 256 entries")
    carried = F.col(f"`{carry}`").cast("string") if carry else F.lit(None).cast("string")
    rows = vectors.select(F.col("vec_id").cast("long"), carried.alias("carried"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.filter(F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)))
    bulk = rows.filter("size(vector) > 0").groupBy(F.size("vector").alias("length")).agg(
        F.count("*").alias("n"), F.count("vec_id").alias("named"), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x)))).alias("largest"))
    common = bulk.filter("named > 0").orderBy(F.desc("n"), "length").limit(1).collect()
    if not common:
        return rows.select("vec_id", "carried", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), np.zeros((parts, 0, 0), dtype=np.int64)
    length, reach = common[0].length, int(common[0].largest * scale) + 1
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    width = length // parts
    if reach >= 1 << 31 or (2 * reach) ** 2 * length * entries > LARGEST:
        raise ValueError(f"components up to {common[0].largest} need more than 64 bits")
    sound = rows.filter(F.size("vector") == length)
    books = np.floor(np.array(_seeds(sound, entries)) * scale).astype(np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    forest = _forest(sound, parts, width, scale)
    for _ in range(rounds):
        books = _moved(forest, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            places = np.frombuffer(row["places"], "<i4").reshape(parts, -1)
            codes, error = np.empty((len(row["ids"]), parts), dtype=np.uint8), np.zeros(len(row["ids"]), dtype=np.int64)
            for j, tree in enumerate(_trees(row, parts, width)):
                code, far = assign(tree, books[j])
                codes[places[j], j] = code
                error[places[j]] += far
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.int64()), pa.array(row["carried"], pa.string()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
                names=["vec_id", "carried", "code", "error"])

    coded = forest.mapInArrow(run, "vec_id long, carried string, code binary, error long")
    odd = rows.filter(F.size("vector") != length).select("vec_id", "carried", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    return coded.unionByName(odd), books


def expand(codes: DataFrame, books: np.ndarray, scale: int = 4096) -> DataFrame:
    """(vec_id, embedding) that codes (vec_id, code) stand for: the middle of each component's step; null for a null code."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if c is None else ((books[np.arange(parts), list(c)].ravel() + 0.5) / scale).tolist() for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["vec_id", "embedding"])

    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    return codes.select(F.col("vec_id").cast("long"), "code").mapInArrow(run, schema)
