"""Quality classifier: a factorisation machine over hashed words, structure statistics and length."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copytrail.llm.common import free_name

#: Word features are hashed to this many places; statistics follow behind them.
WORDS = 1 << 15
BINS = 16
FACTORS = 8
#: The model is fitted on at most so many labelled rows of each class, those with the smallest hashes of their ids.
SAMPLE = 3000
STEPS = 800
RATE = 0.05
DECAY = 1e-5
BATCH = 64
SEED = 7
THRESHOLD = 0.3
#: Whole-text statistics, each cut at fixed edges; shares of characters, words and lines, and logarithms of sizes.
SHARES = [0.0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.55, 0.7, 0.85]
SIZES = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14]
NAMES = ("letters", "digits", "upper", "symbols", "words_repeated", "top_word", "lines_repeated", "short_words", "long_words", "ends", "pairs_repeated", "doubled",
         "log_chars", "log_words", "word_length", "line_words")
DIMENSIONS = WORDS + BINS * len(NAMES)
WORD = re.compile(r"\S+")


def statistics(text: str) -> list[float]:
    """The whole text's statistics, in the order of NAMES; an empty text has all zero."""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    data = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lower = ((data >= 97) & (data <= 122)) | (data > 191)
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    marks = (data == 46) | (data == 44)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    k = len(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    share = [(lower | upper).sum() / n, digit.sum() / n, upper.sum() / n, (~(lower | upper | digit | space | marks)).sum() / n, 1 - len(counts) / k,
             max(counts.values()) / k, 1 - len(set(lines)) / len(lines), (sizes <= 2).sum() / k, (sizes > 12).sum() / k, marks.sum() / n,
             1 - pairs / max(1, k - 1), sum(map(str.__eq__, words, words[1:])) / k]
    return [*share, np.log2(n + 1), np.log2(k + 1), sizes.mean(), np.log2(k / len(lines) + 1)]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of a whole text: words by the square root of their counts, scaled to length 1, and one place for
    each statistic, by the bin it falls in. A null text counts as empty."""
    text = text or ""
    found: dict[int, int] = {}
    for w in text.lower().split():
        at = zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS
        found[at] = found.get(at, 0) + 1
    places = np.fromiter(found.keys(), dtype=np.int64, count=len(found))
    weights = np.sqrt(np.fromiter(found.values(), dtype=np.float64, count=len(found)))
    weights /= max(1.0, np.linalg.norm(weights))
    bins = [WORDS + i * BINS + int(np.searchsorted(SIZES if name in ("log_chars", "log_words", "word_length", "line_words") else SHARES, v))
            for i, (name, v) in enumerate(zip(NAMES, statistics(text), strict=True))]
    return np.concatenate([places, bins]), np.concatenate([weights, np.full(len(bins), 1 / np.sqrt(len(bins)))])


@dataclass(frozen=True)
class Machine:
    """bias + linear part + pairwise interactions of low rank."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Probabilities, in time linear in the features: half of (the squared sum less the sum of squares)."""
        if not rows:
            return np.zeros(0)
        at, x, row = _flat(rows)
        return _logistic(self._raw(at, x, row, len(rows))[0])

    def _raw(self, at: np.ndarray, x: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.factors[at] * x[:, None]
        starts = np.searchsorted(row, np.arange(n))
        total = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx ** 2).sum(axis=1), starts)
        linear = np.add.reduceat(self.linear[at] * x, starts)
        return self.bias + linear + 0.5 * ((total ** 2).sum(axis=1) - squares), vx, total


def _flat(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = [len(a) for a, _ in rows]
    return np.concatenate([a for a, _ in rows]), np.concatenate([x for _, x in rows]), np.repeat(np.arange(len(rows)), sizes)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
    """Logistic loss by a fixed number of adaptive gradient steps on small batches, in a fixed random order."""
    rng = np.random.default_rng(SEED)
    model = Machine(0.0, np.zeros(DIMENSIONS), rng.normal(0, 0.05, (DIMENSIONS, FACTORS)))
    bias, seen_bias = 0.0, 1.0
    seen_w, seen_v = np.full(DIMENSIONS, 1e-2), np.full((DIMENSIONS, FACTORS), 1e-2)
    order = np.zeros(0, dtype=np.int64)
    for _ in range(STEPS):
        while len(order) < BATCH:
            order = np.append(order, rng.permutation(len(rows)))
        some, order = order[:BATCH], order[BATCH:]
        at, x, row = _flat([rows[i] for i in some])
        z, vx, total = model._raw(at, x, row, len(some))
        error = _logistic(z) - labels[some]
        step = error[row] * x
        grad_v = step[:, None] * (total[row] - vx)
        touched, place = np.unique(at, return_inverse=True)
        gw = np.bincount(place, step, len(touched)) + DECAY * model.linear[touched]
        gv = np.stack([np.bincount(place, grad_v[:, f], len(touched)) for f in range(FACTORS)], axis=1) + DECAY * model.factors[touched]
        seen_w[touched] += gw ** 2
        seen_v[touched] += gv ** 2
        model.linear[touched] -= RATE * gw / np.sqrt(seen_w[touched])
        model.factors[touched] -= RATE * gv / np.sqrt(seen_v[touched])
        seen_bias += error.sum() ** 2
        bias -= RATE * error.sum() / np.sqrt(seen_bias)
        model = Machine(bias, model.linear, model.factors)
    return model


def held_out(doc_id: F.Column) -> F.Column:
    """One fifth of all ids, by a checksum of the id as text; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | None:
    """A machine fitted on at most ``sample`` labelled rows of each class that are not held out, the ones whose ids have the smallest hashes.

    Conflicting or repeated labels of one id count by their smallest. Without labelled rows there is no machine.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = [known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most two samples of two numbers
    rows = docs.select("doc_id", "text").join(few, "doc_id").dropDuplicates(["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()),
                                              pa.array([x.astype("<f4").tobytes() for _, x in found], pa.binary())], names=["doc_id", "quality", "places", "weights"])

    table = rows.select(F.col("doc_id").cast("long"), "text", "quality").mapInArrow(run, "doc_id long, quality int, places binary, weights binary")
    got = sorted(table.collect(), key=lambda r: r.doc_id)
    if not got:
        return None
    y = np.array([r.quality for r in got], dtype=np.float64)
    each = [(np.frombuffer(r.places, "<i4").astype(np.int64), np.frombuffer(r.weights, "<f4").astype(np.float64)) for r in got]
    return fit(each, y)


def scored(docs: DataFrame, model: Machine | None, score: str) -> DataFrame:
    """The rows of ``docs`` with a new column ``score``; without a machine every score is 1, so nothing is rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 128):
                some = batch.slice(begin, 128)
                rows = [features(t) for t in some.column(at).to_pylist()]
                scores = sent.value.scores(rows) if sent.value else np.ones(len(rows))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(scores)], names=[*some.schema.names, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row: predicted is 1 from a score of 0.3 on.

    Scores use the text alone, never labels, language, source or id. Null and empty texts are scored like any other.
    """
    found = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), train(docs, labels, sample), "_score")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"),
                        (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with their own columns only."""
    score = free_name(docs, "_score")
    return scored(docs, train(docs, labels, sample), score).filter(F.col(score) >= THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])
