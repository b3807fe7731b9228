"""Rectangles and homographies in the unit square as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from copytrail import constants as C
from copytrail.functions.text import let

SIDES = ("x", "y", "width", "height")


def rect(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def rect_valid(r: Column) -> Column:
    """Finite, non-empty and inside the unit square."""
    finite = F.lit(True)
    for side in SIDES:
        finite = finite & _finite(r[side])
    return F.coalesce(finite & (r["x"] >= 0) & (r["y"] >= 0) & (r["width"] > 0) & (r["height"] > 0)
                      & (r["x"] + r["width"] <= 1) & (r["y"] + r["height"] <= 1), F.lit(False))


def compose_transforms(after: Column, before: Column) -> Column:
    """Row-major 3x3 product; ``before`` acts first."""
    def cell(row: int, column: int) -> Column:
        return after[row * 3] * before[column] + after[row * 3 + 1] * before[3 + column] + after[row * 3 + 2] * before[6 + column]

    return F.array(*[cell(r, c) for r in range(3) for c in range(3)])


IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)


def transform_regions(regions: Column, matrix: Column) -> Column:
    """(regions, error): mapped corner envelopes clipped to the unit square, empties dropped.

    The identity returns its input; a corner sent to infinity gives an error and no regions.
    """
    # Each step names its values in a struct, so that none is computed twice per region.
    names = ("a", "b", "c", "d")
    finite = F.lit(1e-15)

    def corners(r: Column) -> Column:
        return F.struct(r["x"].alias("x0"), r["y"].alias("y0"), (r["x"] + r["width"]).alias("x1"), (r["y"] + r["height"]).alias("y1"))

    def projected(c: Column) -> Column:
        points = ((c["x0"], c["y0"]), (c["x1"], c["y0"]), (c["x1"], c["y1"]), (c["x0"], c["y1"]))
        parts = []
        for n, (x, y) in zip(names, points):
            for label, row in (("x", 0), ("y", 3), ("w", 6)):
                parts.append((matrix[row] * x + matrix[row + 1] * y + matrix[row + 2]).alias(f"{label}{n}"))
        return F.struct(*parts)

    def envelope(p: Column) -> Column:
        xs, ys = [p[f"x{n}"] / p[f"w{n}"] for n in names], [p[f"y{n}"] / p[f"w{n}"] for n in names]
        zero, one = F.lit(0.0), F.lit(1.0)
        return F.struct(F.greatest(zero, F.least(*xs)).alias("l"), F.greatest(zero, F.least(*ys)).alias("t"),
                        F.least(one, F.greatest(*xs)).alias("r"), F.least(one, F.greatest(*ys)).alias("b"))

    def result(points: Column) -> Column:
        lost = F.exists(points, lambda p: ~((F.abs(p["wa"]) > finite) & (F.abs(p["wb"]) > finite) & (F.abs(p["wc"]) > finite) & (F.abs(p["wd"]) > finite)))
        boxes = F.filter(F.transform(points, envelope), lambda e: (e["r"] > e["l"]) & (e["b"] > e["t"]))
        moved = F.transform(boxes, lambda e: rect(e["l"], e["t"], e["r"] - e["l"], e["b"] - e["t"]))
        return F.struct(F.when(~lost, moved).alias("regions"), F.when(lost, "corner_at_infinity").alias("error"))

    unchanged = matrix == F.array(*[F.lit(v) for v in IDENTITY])
    same = F.struct(regions.alias("regions"), F.lit(None).cast("string").alias("error"))
    return F.when(unchanged, same).otherwise(let(F.transform(F.transform(regions, corners), projected), result))


def merge_regions(*groups: Column) -> Column:
    """All regions in order, exact repeats removed."""
    return F.array_distinct(F.concat(*groups))


def crop_geometry(fraction: Column, height: Column, width: Column) -> Column:
    """Centred crop that removes about ``fraction`` of the area, with half-even rounding."""
    scale = F.sqrt(F.lit(1.0) - fraction)
    kept_w = F.greatest(F.lit(1), F.bround(width * scale).cast("long"))
    kept_h = F.greatest(F.lit(1), F.bround(height * scale).cast("long"))
    x0, y0 = F.floor((width - kept_w) / 2), F.floor((height - kept_h) / 2)
    return F.struct(
        x0.alias("x0"), y0.alias("y0"), kept_w.alias("kept_width"), kept_h.alias("kept_height"),
        rect(x0 / width, y0 / height, kept_w / width, kept_h / height).alias("retained"),
        (F.lit(1.0) - (kept_w * kept_h) / (width * height)).alias("removed_fraction"))


def region_grid(height: Column, width: Column, size: int) -> Column:
    """Complete, non-overlapping squares in reading order, as an array of (region_index, x, y)."""
    columns, rows = F.floor(width / size).cast("int"), F.floor(height / size).cast("int")
    count = columns * rows
    cells = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(
        i.alias("region_index"), ((i % columns) * size).alias("x"), (F.floor(i / columns).cast("int") * size).alias("y")))
    return F.when(count > 0, cells).otherwise(F.array().cast("array<struct<region_index:int,x:int,y:int>>"))


def grid_limitation(height: Column, width: Column, size: int) -> Column:
    return F.when(F.floor(width / size) * F.floor(height / size) < C.MIN_REGIONS, "integrity.insufficient_complete_regions")


def survives_crops(x: Column, y: Column, size: int, height: Column, width: Column, scales: tuple[float, ...]) -> Column:
    """Whether a tile lies inside every centred crop of the given side scales."""
    inside = F.lit(True)
    for scale in scales:
        kept_h, kept_w = F.bround(height * scale).cast("long"), F.bround(width * scale).cast("long")
        y0, x0 = F.floor((height - kept_h) / 2), F.floor((width - kept_w) / 2)
        inside = inside & (x0 <= x) & (y0 <= y) & (x + size <= x0 + kept_w) & (y + size <= y0 + kept_h)
    return inside


def erasure_rank(confidences: Column) -> Column:
    """Byte positions from the least to the most reliable, ties by position."""
    pairs = F.transform(confidences, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def erasure_ladder(claim: Column, ranking: Column, budget: int = 16) -> Column:
    """Erasure sets to try: the claim, then ever smaller sets of the weakest positions, without repeats."""
    counts = [budget]
    while counts[-1] > 0:
        counts.append(counts[-1] // 2)
    steps = [F.when(F.size(ranking) >= n, F.array_sort(F.slice(ranking, 1, n))) for n in counts]
    return F.array_distinct(F.filter(F.array(claim, *steps), lambda s: s.isNotNull()))


RECTS = "array<struct<x:double,y:double,width:double,height:double>>"


def operation(matrix: Column, removed: Column | None = None, regions: Column | None = None) -> Column:
    """One step of a chain: the homography it applies, the share of the area it removes, the regions it changes."""
    return F.struct(matrix.cast("array<double>").alias("matrix"), (F.lit(0.0) if removed is None else removed.cast("double")).alias("removed"),
                    (F.array() if regions is None else regions).cast(RECTS).alias("regions"))


def crop_operation(fraction: Column, height: Column, width: Column) -> Column:
    """The centred crop as a step: what it keeps becomes the unit square."""
    def built(c: Column) -> Column:
        kept, zero, one = c["retained"], F.lit(0.0), F.lit(1.0)
        matrix = F.array(one / kept["width"], zero, -kept["x"] / kept["width"], zero, one / kept["height"], -kept["y"] / kept["height"], zero, zero, one)
        return operation(matrix, c["removed_fraction"])

    return let(crop_geometry(fraction, height, width), built)


def fold_operations(operations: Column) -> Column:
    """(matrix, regions, removed, error) of steps in their order; no step is the identity.

    Regions that a step changes move through all later steps; areas that steps remove multiply.
    """
    start = F.struct(F.array(*[F.lit(v) for v in IDENTITY]).alias("matrix"), F.array().cast(RECTS).alias("regions"), F.lit(0.0).alias("removed"),
                     F.lit(None).cast("string").alias("error"))

    def step(so_far: Column, op: Column) -> Column:
        return let(transform_regions(so_far["regions"], op["matrix"]), lambda moved: F.struct(
            compose_transforms(op["matrix"], so_far["matrix"]).alias("matrix"), merge_regions(moved["regions"], op["regions"]).alias("regions"),
            (F.lit(1.0) - (F.lit(1.0) - so_far["removed"]) * (F.lit(1.0) - op["removed"])).alias("removed"),
            F.coalesce(so_far["error"], moved["error"]).alias("error")))

    return F.aggregate(operations, start, step)
