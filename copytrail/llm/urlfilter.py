"""URL filters: exact membership by a cascade of Bloom filters over every key of the corpus, without joins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copytrail.llm.common import written

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A filter is sent to every task, so one with more bits than this is refused (128 MB).
MOST_BITS = 1 << 30


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), LETTERS, LETTERS.lower())


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every rule key that could fit a url: each suffix of whole labels of the host before each prefix of the path that
    has the length of some rule's path; longest first, of equals the longer host first."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(
        (-F.length(s) - F.length(p)).alias("order"), (-F.length(s)).alias("host_order"), F.concat(s, p).alias("key")))))
    return F.transform(F.array_sort(F.array_distinct(pairs)), lambda x: x["key"])


@dataclass(frozen=True)
class Bloom:
    """A bit array with ``k`` positions for each key, found from two halves of one hash."""

    words: np.ndarray
    bits: int
    k: int
    salt: int

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), dtype=bool)
        for at in positions(hashes, self.bits, self.k, self.salt):
            found &= (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return found


def positions(hashes: np.ndarray, bits: int, k: int, salt: int) -> Iterator[np.ndarray]:
    """The ``k`` bit positions of each hash; the salt gives every level its own."""
    x = hashes.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for _ in range(k):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        z = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        yield ((z ^ (z >> np.uint64(31))) % np.uint64(bits)).astype(np.int64)


@dataclass(frozen=True)
class Cascade:
    """Levels in turn: listed keys, what of the rest passes by mistake, what of the listed passes that, and so on."""

    levels: list[Bloom]

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Exact for every key of the universe it was built over."""
        listed = np.zeros(len(hashes), dtype=bool)
        open_rows = np.arange(len(hashes))
        for depth, level in enumerate(self.levels):
            passed = level.holds(hashes[open_rows])
            # Who stops at an even depth is not listed; at an odd depth, listed.
            listed[open_rows[~passed]] = depth % 2 == 1
            open_rows = open_rows[passed]
        listed[open_rows] = len(self.levels) % 2 == 1
        return listed


def build_level(keys: DataFrame, n: int, rate: float, salt: int) -> Bloom:
    """One filter over the ``n`` rows (hash) of ``keys``. Tasks set bits of their own and send words that are not zero."""
    bits = max(64, 64 * ceil(n * -log(rate) / log(2) ** 2 / 64))
    if bits > MOST_BITS:
        raise ValueError(f"{n} keys need a filter of {bits} bits; split the list")
    k = max(1, round(log2(1 / rate)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 64, dtype=np.uint64)
        for batch in batches:
            for at in positions(batch.column(0).to_numpy().view(np.uint64), bits, k, salt):
                np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(words[used].view(np.int64))], names=["word", "value"])

    rows = keys.select("hash").mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toPandas()
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[rows["word"].to_numpy(dtype=np.int64)] = rows["value"].to_numpy(dtype=np.int64).view(np.uint64)
    return Bloom(words, bits, k, salt)


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade that tells listed keys (key) from all others of the universe (key). Both may hold repeats; null is no key.

    The first level lets about one unlisted key through for each listed one, the later ones half of theirs, so the levels
    shrink with the list and not with the corpus. Each level's keys stay distributed; counts and filters reach the driver.
    """
    spark = universe.sparkSession
    mark = F.xxhash64("key").alias("hash")
    yes = written(listed.filter("key is not null").select(mark).distinct(), "listed")
    every = universe.filter("key is not null").select(mark).distinct()
    no = written(every.join(yes, "hash", "left_anti"), "unlisted")
    n_yes, n_no = yes.count(), no.count()
    levels: list[Bloom] = []
    rate = 0.5 if n_yes == 0 else min(0.5, max(n_yes / max(1, n_no), 1e-9))
    sides, sizes = [yes, no], [n_yes, n_no]
    while sizes[0]:
        level = build_level(sides[0], sizes[0], rate, len(levels))
        levels.append(level)
        sent = spark.sparkContext.broadcast(level)

        def passing(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(sent.value.holds(batch.column(0).to_numpy().view(np.uint64))))

        mistaken = written(sides[1].mapInArrow(passing, "hash long"), f"level{len(levels)}")
        sides, sizes, rate = [mistaken, sides[0]], [mistaken.count(), sizes[0]], 0.5
    return Cascade(levels)


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages (page_id, url) by rules (key, path_length, verdict).

    A rule's key is its host and path. It fits its host and all subdomains when the path starts with the rule's path; the
    longest key wins, block before allow where one key is in both. Without a rule that fits, rule is null and the verdict is
    what membership in no list means: allow. A null url and one without ``://`` have an empty host and path, and no rule.

    Blocked and allowed keys are two cascades over the complete universe, that is every candidate key of every url, so the
    look-up in each task is exact. Hashes of keys stand for keys (64 bits).
    """
    lengths = sorted(r.path_length for r in rules.select("path_length").distinct().collect())  # no more than path lengths
    split = pages.select(pages.page_id.cast("long").alias("page_id"), host_of(pages.url).alias("host"), path_of(pages.url).alias("path"))
    keyed = split.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths) if lengths else F.array().cast("array<string>"))
    universe = keyed.select(F.explode("keys").alias("key")).distinct()
    universe = written(universe, "universe")
    block = build_cascade(rules.filter("verdict = 'block'").select("key"), universe)
    allow = build_cascade(rules.filter("verdict = 'allow'").select("key"), universe)
    sent = pages.sparkSession.sparkContext.broadcast((block, allow))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocked, allowed = sent.value
        for batch in batches:
            hashes = batch.column(batch.schema.get_field_index("hashes"))
            sizes = np.array([len(h) for h in hashes.to_pylist()], dtype=np.int64)
            flat = hashes.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            bad = blocked.holds(flat)
            listed = np.append(bad | allowed.holds(flat), True)
            hits = np.flatnonzero(listed)
            begins = np.cumsum(sizes) - sizes
            first = hits[np.searchsorted(hits, begins)]
            inside = first < begins + sizes
            place = np.where(inside, first - begins, -1).astype(np.int32)
            verdict = np.where(inside & np.append(bad, False)[first], "block", "allow")
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(place), pa.array(verdict.tolist(), pa.string())],
                                             names=["page_id", "host", "path", "keys", "place", "verdict"])

    hashed = keyed.withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k)))
    judged = hashed.mapInArrow(run, "page_id long, host string, path string, keys array<string>, place int, verdict string")
    return judged.select("page_id", "host", "path", F.when(F.col("place") >= 0, F.get("keys", F.col("place"))).alias("rule"), "verdict")
