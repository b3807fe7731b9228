"""Region and tile operators: overlap, crop eligibility, keyed orders and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copytrail.functions.geometry import crop_geometry
from copytrail.session import materialize
from copytrail.skew import SALTS, lookup_join, rank_in_key


#: Rectangles up to which a tile is swept; a fuller one is cut again, into four times four.
TILE_MOST = 48
#: Tiles of this side are swept whatever they hold: edges closer than that cannot be told apart by cutting.
FINEST = 1 << 30
TILE = ["case_id", "t", "i", "j"]
#: Pieces that a task takes. The adaptive planner goes by compressed bytes, which are few for coordinates that recur.
TASK_PIECES = 1 << 18


def _dealt(rows: DataFrame, pieces: int, keys: Sequence[str]) -> DataFrame:
    """Rows by ``keys`` in as many parts as ``pieces`` need."""
    parts = -(-pieces // TASK_PIECES)
    return rows.repartition(max(parts, rows.sparkSession.sparkContext.defaultParallelism), *keys) if parts > 1 else rows.repartition(*keys)


def _total(rows: DataFrame, weight: Column) -> int:
    return int(rows.agg(F.sum(weight)).first()[0] or 0)


def _clipped(boxes: DataFrame) -> DataFrame:
    """Boxes (case_id, side, t, x0, x1, y0, y1) cut along the grid of ``t`` by ``t`` tiles, without those that add nothing.

    Equal pieces count once, and where one covers its tile wholly the others of its side leave. ``n`` counts a tile's pieces.
    """
    step = F.lit(1.0) / F.col("t")

    def ends(low: str, high: str) -> tuple[Column, Column]:
        first = F.floor(F.col(low) * F.col("t"))
        return first, F.greatest(first, F.ceil(F.col(high) * F.col("t")) - 1)

    def span(low: str, high: str) -> Column:
        return F.sequence(*ends(low, high))

    def places(low: str, high: str) -> Column:
        first, last = ends(low, high)
        return (last - first + 1).cast("double")

    total = _total(boxes, places("x0", "x1") * places("y0", "y1"))
    pieces = _dealt(boxes, total, boxes.columns).select("*", F.explode(span("x0", "x1")).alias("i")).select("*", F.explode(span("y0", "y1")).alias("j")).select(
        *TILE, "side", F.greatest("x0", F.col("i") * step).alias("x0"), F.least("x1", (F.col("i") + 1) * step).alias("x1"),
        F.greatest("y0", F.col("j") * step).alias("y0"), F.least("y1", (F.col("j") + 1) * step).alias("y1")).distinct()
    whole = (F.col("x0") == F.col("i") * step) & (F.col("x1") == (F.col("i") + 1) * step) & (F.col("y0") == F.col("j") * step) & (F.col("y1") == (F.col("j") + 1) * step)
    covered = F.max(F.col("_whole")).over(Window.partitionBy(*TILE, "side"))
    open_pieces = _dealt(pieces.withColumn("_whole", whole), total, TILE).withColumn("_covered", covered).filter("_whole OR NOT _covered")
    return open_pieces.drop("_whole", "_covered").withColumn("n", F.count("*").over(Window.partitionBy(*TILE)))


def _leaf_tiles(boxes: DataFrame) -> DataFrame:
    """The pieces of a quadtree's leaves, with their tile's number ``n``. Only tiles that are still too full go on to the next level."""
    leaves = None
    while True:
        level = materialize(_clipped(boxes), "tiles")
        crowded = (F.col("n") > TILE_MOST) & (F.col("t") < FINEST)
        done = level.filter(~crowded)
        leaves = done if leaves is None else leaves.unionByName(done)
        if level.filter(crowded).isEmpty():
            return leaves
        boxes = level.filter(crowded).select("case_id", "side", (F.col("t") * 4).alias("t"), "x0", "x1", "y0", "y1")


def union_iou(rects: DataFrame, cases: DataFrame) -> DataFrame:
    """Intersection over union of two rectangle unions per case; both empty is 1, one empty is 0.

    The unit square of a case is cut into the leaves of a quadtree: into tiles, the more the more rectangles it has, and
    tiles that are still crowded into smaller ones, so neither a huge case nor a crowded corner is one task's. Where one
    rectangle covers a tile wholly, the others of its side add nothing there and leave before anything is paired. Inside a leaf,
    vertical slabs between neighbouring edges are measured by merging their intervals in order.
    """
    counts = rects.groupBy("case_id").agg(F.count("*").alias("_n"))
    tiles = F.when(F.col("_n") <= 16, 1).when(F.col("_n") <= 256, 4).when(F.col("_n") <= 4096, 16).when(F.col("_n") <= 65536, 64).otherwise(256)
    sized = lookup_join(rects.select("case_id", "side", "x", "y", "width", "height"), counts, ["case_id"], "inner", spread=["x", "y", "width", "height"])
    leaves = _leaf_tiles(materialize(sized.select("case_id", "side", tiles.cast("long").alias("t"), F.col("x").alias("x0"), (F.col("x") + F.col("width")).alias("x1"),
                                     F.col("y").alias("y0"), (F.col("y") + F.col("height")).alias("y1")), "boxes"))
    # Distributed by tile once: the cuts, the slabs, their join and the interval merge below all keep that layout. A piece meets
    # about as many slabs as its tile has pieces, usually four.
    tile = TILE
    boxes = _dealt(leaves, _total(leaves, F.col("n")) // 4, tile).drop("n")
    cuts = boxes.select(*tile, F.explode(F.array("x0", "x1")).alias("s0")).distinct()
    slabs = cuts.withColumn("s1", F.lead("s0").over(Window.partitionBy(*tile).orderBy("s0"))).filter(F.col("s1").isNotNull())
    inside = slabs.join(boxes, tile).filter((F.col("x0") <= F.col("s0")) & (F.col("x1") >= F.col("s1")))
    marked = inside.select(*tile, "s0", "s1", "y0", "y1", F.explode(F.array("side", F.lit("any"))).alias("side"))
    earlier = Window.partitionBy(*tile, "s0", "side").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("y1").over(earlier), F.col("y0"))
    added = F.greatest(F.lit(0.0), F.col("y1") - F.greatest(F.col("y0"), reach)) * (F.col("s1") - F.col("s0"))
    area = marked.withColumn("_a", added).groupBy("case_id").agg(
        *[F.sum(F.when(F.col("side") == s, F.col("_a"))).alias(f"_{s}") for s in ("expected", "predicted", "any")])
    shared = F.coalesce("_expected", F.lit(0.0)) + F.coalesce("_predicted", F.lit(0.0)) - F.col("_any")
    iou = F.when(F.col("_any").isNull(), 1.0).when(F.col("_expected").isNull() | F.col("_predicted").isNull(), 0.0).otherwise(
        F.greatest(F.lit(0.0), shared) / F.col("_any"))
    return cases.select("case_id").distinct().join(area, "case_id", "left").select("case_id", iou.alias("iou"))


def crop_eligibility(rows: DataFrame, tiles: DataFrame, page: str = "page_id") -> DataFrame:
    """Whether at least two sampled tiles survive each row's crop; other rows are eligible by default.

    Tiles are tested once per distinct (page, fraction), not once per row.
    """
    applies = F.col("crop_fraction").isNotNull() & F.col("positive") & ~F.col("failed")
    crops = rows.filter(applies).select(page, "crop_fraction", "page_height", "page_width").distinct().withColumn(
        "_c", crop_geometry(F.col("crop_fraction"), F.col("page_height"), F.col("page_width")))
    fits = (
        (F.col("x") >= F.col("_c.x0")) & (F.col("y") >= F.col("_c.y0"))
        & (F.col("x") + F.col("size") <= F.col("_c.x0") + F.col("_c.kept_width"))
        & (F.col("y") + F.col("size") <= F.col("_c.y0") + F.col("_c.kept_height")))
    # Sizes after an explode or a count are only guessed before it runs: a merge join asks no driver to hold what was guessed small.
    counted = crops.join(tiles.select(page, "x", "y", "size").hint("merge"), page, "left").groupBy(
        page, "crop_fraction", "page_height", "page_width").agg(F.count_if(F.coalesce(fits, F.lit(False))).alias("_n"))
    joined = lookup_join(rows, counted.hint("merge"), [page, "crop_fraction", "page_height", "page_width"])
    remaining = F.when(applies, F.col("_n"))
    reason = (F.when(~applies, "eligible").when(F.col("_n") >= 2, "at_least_two_complete_embedded_tiles_remain")
              .otherwise("fewer_than_two_complete_embedded_tiles_remain"))
    return joined.withColumn("remaining_tiles", remaining).withColumn("eligibility_reason", reason).withColumn(
        "eligible", F.col("eligibility_reason") != "fewer_than_two_complete_embedded_tiles_remain").drop("_n")


def keyed_hash(key: str, *parts: Column) -> Column:
    """Keyed order value. Spark has no HMAC; the key is hashed in front of NUL-joined parts."""
    return F.sha2(F.concat_ws("\x00", F.lit(key), *[p.cast("string") for p in parts]), 256)


def partner_ring(regions: DataFrame, key: str, shifts: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Partner of each region per shift: pages are rings ordered by keyed hash.

    Hash prefixes slice a page evenly, so a page of any size is ranked by many tasks. Pages too small for
    independent shifts come out as error rows.
    """
    hashed = regions.select("page_id", "region_index").withColumn("_h", keyed_hash(key, F.col("page_id"), F.col("region_index")))
    slot = F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")
    ranked = rank_in_key(hashed, ["page_id"], [F.col("_h"), F.col("region_index")], slot)
    sizes = regions.groupBy("page_id").agg(F.count("*").alias("_n"))
    placed = lookup_join(ranked, sizes, ["page_id"], counted=regions, spread=["region_index"])
    steps = F.array(*[F.lit(s) for s in shifts])
    effective = F.transform(steps, lambda s: s % F.col("_n"))
    bad = F.array_contains(effective, 0) | (F.size(F.array_distinct(effective)) < len(shifts))
    errors = placed.filter(bad).select("page_id", "region_index", F.lit(None).cast("int").alias("shift"),
                                       F.lit(None).cast(regions.schema["region_index"].dataType).alias("partner_index"),
                                       F.lit("replica_mappings_not_independent").alias("error_code"))
    wanted = placed.filter(~bad).select("page_id", "region_index", F.explode(steps).alias("shift"), "rank", "_n").withColumn(
        "_at", (F.col("rank") + F.col("shift")) % F.col("_n"))
    seats = ranked.select("page_id", F.col("rank").alias("_at"), F.col("region_index").alias("partner_index"))
    found = wanted.join(seats, ["page_id", "_at"]).select("page_id", "region_index", "shift", "partner_index",
                                                          F.lit(None).cast("string").alias("error_code"))
    return found.unionByName(errors)


def keyed_sample(tiles: DataFrame, key: str, count: int, prefer: Column | None = None) -> DataFrame:
    """The first ``count`` tiles of each page in keyed order, preferred ones first.

    Pages are cut into slices, of which each sorts its own narrow rows and keeps its first ``count``, whatever the input's splits
    hold; the slices' heads are ranked together. A page with too few tiles yields one error row and no tiles.
    """
    first = (~prefer if prefer is not None else F.lit(False)).cast("int")
    hashed = tiles.select("page_id", "tile_index", F.unhex(keyed_hash(key, F.col("page_id"), F.col("tile_index"))).alias("_h"), first.alias("_late"))
    sliced = hashed.withColumn("_slice", F.pmod(F.crc32("_h"), F.lit(SALTS))).repartition("page_id", "_slice")
    order = ["_late", "_h", "tile_index"]
    heads = sliced.withColumn("_at", F.row_number().over(Window.partitionBy("page_id", "_slice").orderBy(*order))).filter(F.col("_at") <= count)
    top = heads.drop("_slice", "_at").withColumn("ordinal", F.row_number().over(Window.partitionBy("page_id").orderBy(*order))).filter(F.col("ordinal") <= count)
    short = tiles.groupBy("page_id").agg(F.count("*").alias("_n")).filter(F.col("_n") < count)
    kept = top.join(short.hint("merge"), "page_id", "left_anti").select("page_id", "tile_index", (F.col("ordinal") - 1).alias("ordinal"),
                                                          F.lit(None).cast("string").alias("error_code"))
    errors = short.select("page_id", F.lit(None).cast("int").alias("tile_index"), F.lit(None).cast("int").alias("ordinal"),
                          F.lit("too_few_tiles").alias("error_code"))
    return kept.unionByName(errors)
