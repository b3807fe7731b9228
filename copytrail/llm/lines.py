"""Line dedup: a log-template tree whose recurring templates are dropped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copytrail.llm.common import free_name, written
from copytrail.llm.graph import components

DEPTH = 3
#: Share of equal tokens from which a line joins a template of its leaf.
ALIKE = 0.7
MIN_DOCUMENTS = 10
#: A line of more words recurs from ``LONG_DOCUMENTS`` texts on that are mostly different.
LONG = 50
LONG_DOCUMENTS = 2
#: Texts that share all but a tenth of their words have a similarity of 0.8: whole-document deduplication deals with them.
OWN_SHARE = 0.1
#: Texts are copies of each other if so much of what one has besides common lines is in the other.
SHARED_REST = 0.25
SEED = 42
WILD = "<*>"


def masked(line: Column) -> Column:
    """The line's tokens, one space between them; a token with a digit or an at sign is a variable field."""
    fields = F.regexp_replace(line, r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+", WILD)
    return F.trim(F.regexp_replace(fields, r"\s+", " "))


def leaf_of(line: Column) -> Column:
    """The leaf of a line as it stands: its number of spaces and its leading tokens, masked. Cheap, for every line needs it."""
    spaces = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" ")))
    return F.xxhash64(spaces, masked(F.substring_index(line, " ", DEPTH)))


def slots(line: Column) -> Column:
    """The numbers that stand for a line's tokens in order, 0 for a variable field."""
    return F.transform(F.split(line, " "), lambda t: F.when(t == WILD, F.lit(0)).otherwise(F.xxhash64(t)))


def templates(lines: DataFrame) -> DataFrame:
    """(line_key, template): the template of every different line of (leaf, line_key, slots, n).

    The tree's levels are the number of spaces and the first three tokens. In a leaf, lines come in descending order of
    their texts; one joins the template most like it if at least ``ALIKE`` of the slots agree, and slots that differ become
    variable, else it starts a template. A template's id is a hash of its leaf and first line. A task keeps the templates
    of one leaf at a time, not its lines.
    """
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, known, first = None, np.zeros((0, 0), dtype=np.int64), []
        for batch in batches:
            found = []
            leaves, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for this, key, values in zip(leaves, keys, batch.column(2), strict=True):
                row = values.values.to_numpy()
                if this != leaf:
                    leaf, known, first = this, np.zeros((0, len(row)), dtype=np.int64), []
                if first:
                    some = known[:len(first)]
                    share = ((some == row) | (some == 0)).mean(axis=1)
                    best = int(np.argmax(share))
                    if share[best] >= ALIKE:
                        known[best] = np.where(some[best] == row, row, 0)
                        found.append(first[best])
                        continue
                if len(first) == len(known):
                    known = np.concatenate([known, np.zeros((max(4, len(known)), len(row)), dtype=np.int64)])
                known[len(first)] = row
                first.append(key)
                found.append(key)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.int64()), batch.column(0)], names=["line_key", "first", "leaf"])

    dealt = lines.select(F.col("leaf").cast("long"), "line_key", "slots", "n").repartition("leaf").sortWithinPartitions("leaf", F.desc("n"), "line_key")
    return dealt.mapInArrow(parse, "line_key long, first long, leaf long").select("line_key", F.xxhash64("leaf", "first").alias("template"))


def sketch(line: bytes) -> list[int]:
    """Hashes of about every eighth run of three words of a line, chosen by hash, and always the least."""
    words = line.lower().split()
    runs = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), SEED) >> 1 for i in range(max(1, len(words) - 2))] if words else []
    return [h for h in runs if h % 8 == 0] + [min(runs)] if runs else []


def contexts(keyed: DataFrame, common: DataFrame) -> DataFrame:
    """(text_key, words, own, context): what each text that holds common lines is besides them.

    ``own`` counts the words outside the common lines. Texts whose rests are copies of each other's text have one context:
    a text is linked to the one that shares most of its rest, from a quarter of the rest's hashed word runs on.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            rows = []
            for key, text, held in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key in seen:  # exact copies
                    continue
                seen.add(key)
                common_raws = set(held)
                words = own = 0
                every, rest = set(), set()
                for line in text.split(b"\n"):
                    n, runs = len(line.split()), sketch(line)
                    words += n
                    every.update(runs)
                    if np.uint64(xxhash.xxh64_intdigest(line, SEED)).astype(np.int64) not in common_raws:
                        own += n
                        rest.update(runs)
                rows.append((key, words, own, list(every), list(rest)))
            types = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, names=["text_key", "words", "own", "every", "rest"])

    held = common.groupBy("text_key").agg(F.flatten(F.collect_list("raws")).alias("held"))
    joined = keyed.join(held, "text_key").select("text_key", F.col("text").cast("binary"), "held")
    found = joined.mapInArrow(run, "text_key string, words long, own long, every array<long>, rest array<long>")
    found = written(found.dropDuplicates(["text_key"]).withColumn("id", F.xxhash64("text_key")), "contexts")
    first = found.select("id", F.explode("every").alias("run")).groupBy("run").agg(F.min("id").alias("label"), F.count("*").alias("n")).filter("n > 1")
    # Both sides are exploded, so Spark takes them for far smaller than they are: merged, never broadcast.
    met = found.select("id", F.size("rest").alias("size"), F.explode("rest").alias("run")).join(first.hint("merge"), "run")
    shares = met.groupBy("id", "size", "label").agg(F.count("*").alias("n"))
    near = shares.groupBy("id", "size").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label"))["label"].alias("label"))
    links = near.filter((F.col("n") >= SHARED_REST * F.col("size")) & (F.col("id") != F.col("label")))
    grouped = components(links.select(F.col("id").alias("a"), F.col("label").alias("b")))
    return found.join(grouped.withColumnRenamed("node", "id"), "id", "left").select(
        "text_key", "words", "own", F.coalesce("component", "id").alias("context"))


def recurring(keyed: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(text_key, drop): for each different text of (text_key, text) with recurring lines the hashes of these.

    A template recurs when texts of at least ``min_documents`` different contexts hold it: a text carries a line if a tenth
    of its words is outside the common lines, however short it is, and texts that are copies of each other outside them
    count once. A text of common lines alone says nothing about recurrence, unless it is one line; whole-document
    deduplication deals with it. For a line of more than ``LONG`` words ``LONG_DOCUMENTS`` contexts are enough, of texts that
    have at least as much of their own as in other common lines. Only leaves with so many texts are parsed, so nearly all
    prose leaves the work after one count. Equal texts count once.
    """
    few = min(LONG_DOCUMENTS, min_documents)
    raw = keyed.select("text_key", F.explode(F.split("text", "\n", -1)).alias("raw")).filter("trim(raw) <> ''")
    # All lines of a leaf have the same number of spaces, so a long line's leaf has long lines only, but for repeated spaces.
    spaces = F.octet_length("raw") - F.octet_length(F.replace("raw", F.lit(" ")))
    placed = raw.withColumn("leaf", leaf_of(F.col("raw"))).withColumn("long", spaces >= LONG)
    busy = placed.select("text_key", "leaf", "long").distinct().groupBy("leaf", "long").agg(F.count("*").alias("_texts")).filter(
        F.col("_texts") >= F.when(F.col("long"), few).otherwise(min_documents))
    near = placed.join(busy.select("leaf").hint("merge"), "leaf").select("text_key", "leaf", F.xxhash64("raw").alias("raw_key"), F.explode(F.array(masked(F.col("raw")))).alias("line"))
    n_words = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "))) + 1
    some = near.select("text_key", "leaf", F.xxhash64("leaf", "line").alias("line_key"), "raw_key", "line", n_words.alias("n_words"))
    some = written(some.groupBy("text_key", "leaf", "line_key").agg(
        F.first("line").alias("line"), F.first("n_words").alias("n_words"), F.collect_set("raw_key").alias("raws")), "busy_lines")
    distinct = some.groupBy("leaf", "line_key").agg(slots(F.first("line")).alias("slots"), F.count("*").alias("n"))
    distinct = distinct.withColumn("leaf", F.xxhash64("leaf", F.size("slots")))  # repeated spaces: fewer tokens than the leaf's others
    found = written(templates(distinct), "templates")
    held = written(some.select("text_key", "line_key", "n_words", "raws").join(found, "line_key"), "held_lines")
    counts = held.groupBy("template").agg(F.count("*").alias("n"), F.max("n_words").alias("most")).filter(
        F.col("n") >= F.when(F.col("most") > LONG, few).otherwise(min_documents))
    # Written, the templates have the size of their rows, not of a share of all lines, nor can the lines be broadcast in their place.
    common = held.join(written(counts.select("template"), "recurring"), "template")
    alone = common.groupBy("text_key").agg(F.count("*").alias("lines"))
    judged = common.join(contexts(keyed, common), "text_key").join(alone, "text_key")
    # A single common line cannot tell a copy from a text that is little more than its boilerplate.
    carry = judged.filter((F.col("own") > 0) & (F.col("own") >= OWN_SHARE * F.col("words")) | (F.col("lines") == 1))
    different = (F.col("n_words") > LONG) & (F.col("own") > 0) & (2 * F.col("own") >= F.col("words") - F.col("n_words"))
    carried = carry.groupBy("template", "context").agg(F.bool_or(different).alias("different"))
    carriers = carried.groupBy("template").agg(F.count("*").alias("n"), F.count_if("different").alias("different")).filter(
        (F.col("n") >= min_documents) | (F.col("different") >= few))
    drops = common.join(carriers.select("template"), "template").groupBy("text_key").agg(F.flatten(F.collect_list("raws")).alias("drop"))
    return drops


def drop_recurring(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, count: str | None = "n_dropped") -> DataFrame:
    """The rows of ``docs`` with text without its recurring lines, n_chars (if there) of what is left, and as ``count`` the
    number of dropped lines (None: no such column; one of that name in ``docs`` is replaced).

    Null texts stay null and empty ones empty; nothing is dropped from a text whose lines do not recur, and a text of
    nothing else becomes empty. Repeated rows stay. The lines that stay keep their order. Other columns pass through.
    """
    key, drop = free_name(docs, "_text_key"), free_name(docs, "_drop")
    keyed = docs.withColumn(key, F.md5(F.coalesce(F.col("text"), F.lit(""))))
    drops = recurring(keyed.select(F.col(key).alias("text_key"), "text"), min_documents).select(F.col("text_key").alias(key), F.col("drop").alias(drop))
    stays = F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains(F.col(drop), F.xxhash64(x)))
    kept = free_name(docs, "_kept")
    # Behind a one-element explode, or each of the columns below would filter the lines anew.
    joined = keyed.join(drops, key, "left").select("*", F.explode(F.array(F.when(F.col(drop).isNotNull(), stays))).alias(kept))
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    dropped = F.when(F.col(drop).isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n", -1)) - F.size(kept)).cast("long")
    new = {"text": text, "n_chars": F.when(F.col(drop).isNull(), F.col("n_chars")).otherwise(F.length(text)).cast("long") if "n_chars" in docs.columns else None}
    columns = [new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns if c != count]
    return joined.select(*columns, *([dropped.alias(count)] if count else []))
