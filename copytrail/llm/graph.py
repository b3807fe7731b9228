"""Connected components of a link table, without any group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copytrail.llm.common import written

#: A table of more links may not be broadcast: its file is a fraction of what its rows take in the driver's memory.
FEW = 50_000


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node reachable.

    Alternating large and small stars: each round hangs every node below the smallest of its neighbours, so the depth
    shrinks by a constant factor. A node with very many links is a reduced minimum first and a splittable join after.
    Self-links and rows with a null end name no link. An empty table gives an empty table. Each round is a table in the
    shared folder; only its row count and a checksum reach the driver. Beyond ``FEW`` links rounds are merge joins, and
    the result asks for one where it is joined.
    """
    stars = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars, mark = _round(stars)
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _beside(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), mark)
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        roots = _beside(large.groupBy("u").agg(F.min("v").alias("m")), mark)
        small = large.join(roots, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        stars, now = _round(small.select("e.u", "e.v").filter("u <> v").distinct())
        if now == mark:
            break
        mark = now
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return _beside(stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), mark)


def _beside(rows: DataFrame, mark: tuple) -> DataFrame:
    """Rows made from the links that ``mark`` counts, as one side of a join."""
    return rows.hint("merge") if mark[0] > FEW else rows


def _round(stars: DataFrame) -> tuple[DataFrame, tuple]:
    # Rounds are many and their rows few beside the corpus: an eighth of the shuffle's partitions is written.
    parts = max(4, int(stars.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    stars = written(stars.coalesce(parts), "stars")
    return stars, tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
