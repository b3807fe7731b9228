"""Benchmark decontamination by spaced seeds: built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copytrail.llm.common import free_name

#: A 1 compares the token at that place, a 0 ignores it, so a hit survives substitutions at the ignored places.
MASKS = ("1101101", "1011011")
#: Of items below the window also this one: all three meet every pattern of a fifth substituted in 8 to 23 tokens.
SHORT_MASKS = ("1100011",)
#: Overlaps are judged over this many tokens, or the whole item if it is shorter.
WINDOW = 24
SIMILARITY = 0.8
MIN_TOKENS = 8


def token_hashes(text: Column) -> Column:
    """One number for each run of letters and digits, lower-cased."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]++", " "))
    return F.when(words == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(words, " "), lambda w: F.xxhash64(w)))


def seeds(tokens: Column, masks: tuple[str, ...]) -> Column:
    """The hash of every mask at every place: an array of (seed, place)."""
    def of(mask: str, number: int) -> Column:
        kept = [i for i, c in enumerate(mask) if c == "1"]
        places = F.sequence(F.lit(0), F.size(tokens) - len(mask))
        hashed = F.transform(places, lambda p: F.struct(F.xxhash64(F.lit(number), *[F.get(tokens, p + i) for i in kept]).alias("seed"), p.alias("place")))
        return F.when(F.size(tokens) >= len(mask), hashed).otherwise(F.array().cast("array<struct<seed:bigint,place:int>>"))

    return F.concat(*[of(mask, number) for number, mask in enumerate(masks)])


def benchmark_tokens(benchmark: DataFrame, min_tokens: int) -> DataFrame:
    """(item_id, item_tokens) of each different item with enough tokens."""
    items = benchmark.select(F.col("item_id").cast("long"), token_hashes(F.col("text")).alias("item_tokens")).distinct()
    return items.filter(F.size("item_tokens") >= min_tokens)


def overlap(tokens: Column, item: Column, shift: Column, window: int) -> Column:
    """(matched, start, length) of the window with most equal tokens when the item lies ``shift`` tokens into the text.

    Windows have min(window, item) tokens. Of equals the first counts.
    """
    n = F.size(item)
    width = F.least(n, F.lit(window))
    equal = F.transform(item, lambda x, j: (F.coalesce(F.get(tokens, shift + j) == x, F.lit(False)) & (shift + j >= 0)).cast("int"))
    windows = F.transform(F.sequence(F.lit(0), n - width), lambda j: F.struct(
        F.aggregate(F.slice(equal, j + 1, width), F.lit(0), lambda total, x: total + x).alias("matched"), (-j).alias("at")))
    best = F.array_max(windows)
    return F.struct(best["matched"].alias("matched"), (shift - best["at"]).alias("start"), width.alias("length"))


def overlaps(keyed: DataFrame, benchmark: DataFrame, masks: tuple[str, ...], window: int, similarity: float, min_tokens: int, names: list[str]) -> DataFrame:
    """``names`` of the rows of ``keyed`` (text, key) with item_id and ``o``, for every sufficient overlap of a hit."""
    items = benchmark_tokens(benchmark, min_tokens)
    item_seeds = F.when(F.size("item_tokens") < window, seeds(F.col("item_tokens"), masks + SHORT_MASKS)).otherwise(seeds(F.col("item_tokens"), masks))
    wanted = items.select("item_id", F.explode(item_seeds).alias("s")).select("item_id", "s.seed", F.col("s.place").alias("item_place"))
    tokens = keyed.select("key", F.explode(F.array(token_hashes(F.col("text")))).alias("tokens"))
    met = tokens.select("key", F.explode(seeds(F.col("tokens"), masks + SHORT_MASKS)).alias("s")).select("key", "s.seed", F.col("s.place").alias("place"))
    hits = met.join(wanted, "seed").select("key", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    placed = hits.join(items, "item_id")
    both = keyed.join(placed, "key").select(*names, "item_id", "shift", "item_tokens", F.explode(F.array(token_hashes(F.col("text")))).alias("tokens"))
    judged = both.select(*names, "item_id", F.explode(F.array(overlap(F.col("tokens"), F.col("item_tokens"), F.col("shift"), window))).alias("o"))
    return judged.filter(F.col("o.matched") >= F.lit(similarity) * F.col("o.length"))


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW,
                 similarity: float = SIMILARITY, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(doc_id, item_id, start, length, matched, similarity): the best overlap of each document with each item it holds.

    Both sides' seeds are joined; each hit names how far into the text the item lies, and the texts are compared there
    token by token. An overlap counts when at least ``similarity`` of its tokens are equal: over the whole item, or any
    ``window`` tokens of a longer one. Items with fewer than ``min_tokens`` tokens are too short to tell a copy from
    chance and are left out; so are null and empty texts, which hold nothing. Hits are found once for equal texts, and
    repeated rows of a document are reported once. A null doc_id is reported like any other value.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("key")).filter("text is not null")
    good = overlaps(keyed, benchmark, masks, window, similarity, min_tokens, ["doc_id"])
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct("o.matched", (-F.col("o.start")).alias("early"), "o.length")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.early")).alias("start"), F.col("b.length").alias("length"), F.col("b.matched").alias("matched"),
                       (F.col("b.matched") / F.col("b.length")).alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, similarity: float = SIMILARITY, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, as ``contaminated`` judges it; null texts stay."""
    own = free_name(docs, "_key")
    keyed = docs.withColumn(own, F.xxhash64("text"))
    found = overlaps(keyed.filter("text is not null").select(F.col(own).alias("key"), "text"), benchmark, masks, window, similarity, min_tokens, ["key"])
    return keyed.join(found.select(F.col("key").alias(own)).distinct(), own, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
