"""Queries over rectangles, tiles and keyed orders."""

from pyspark.sql import functions as F

from copytrail.catalog import query
from copytrail.catalog.tracing import r6
from copytrail.functions import geometry as G
from copytrail.operators import regions as R

RECTS = """SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, l_discount * 5 AS x, l_tax * 5 AS y,
    CASE WHEN l_quantity > 48 THEN 0.0e0 ELSE 0.1e0 + (l_partkey % 6) / 10.0e0 END AS width, 0.1e0 + (l_suppkey % 6) / 10.0e0 AS height,
    0.5e0 + l_tax * 5 AS m0, l_discount AS m1, l_tax AS m2, l_discount * 2 AS m4, CASE WHEN l_quantity < 3 THEN 0.0e0 ELSE 1.0e0 END AS m8
    FROM {t}"""


def _rects(i):
    i.table("lineitem").createOrReplaceTempView("src_lineitem")
    rows = i.spark.sql(RECTS.replace("{t}", "src_lineitem"))
    return rows.withColumn("r", G.rect(*[F.col(s) for s in G.SIDES]))


SQL_RECTS = "WITH r AS (" + RECTS.replace("{t}", "lineitem") + ")"


@query("rect_valid", SQL_RECTS + """
    SELECT id, line, part, x >= 0 AND y >= 0 AND width > 0 AND height > 0 AND x + width <= 1 AND y + height <= 1 AS valid FROM r""")
def _(i):
    return _rects(i).select("id", "line", "part", G.rect_valid(F.col("r")).alias("valid"))


def _matrix():
    return F.array(*[F.lit(v) if isinstance(v, float) else F.col(v) for v in ("m0", "m1", "m2", 0.0, "m4", "m1", 0.0, 0.0, "m8")])


@query("compose_transforms", SQL_RECTS + """
    SELECT id, line, part, concat_ws(',', printf('%.6f', m0 + m1 * 0.0), printf('%.6f', 2 * m1), printf('%.6f', m0 * 0.5 + m1 * 0.25 + m2),
      printf('%.6f', 0.0), printf('%.6f', 2 * m4), printf('%.6f', m4 * 0.25 + m1), printf('%.6f', 0.0), printf('%.6f', 0.0), printf('%.6f', m8)) AS product FROM r""")
def _(i):
    before = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.5, 0.0, 2.0, 0.25, 0.0, 0.0, 1.0)])
    product = F.transform(G.compose_transforms(_matrix(), before), lambda v: F.format_string("%.6f", v))
    return _rects(i).select("id", "line", "part", F.array_join(product, ",").alias("product"))


@query("transform_regions", SQL_RECTS + """,
    c AS (SELECT id, line, part, m8, x, y, width AS w, height AS h, m0, m1, m2, m4,
      greatest(0, least((m0 * x + m1 * y + m2) / nullif(m8, 0), (m0 * (x + w) + m1 * y + m2) / nullif(m8, 0),
         (m0 * x + m1 * (y + h) + m2) / nullif(m8, 0), (m0 * (x + w) + m1 * (y + h) + m2) / nullif(m8, 0))) AS l,
      least(1, greatest((m0 * x + m1 * y + m2) / nullif(m8, 0), (m0 * (x + w) + m1 * y + m2) / nullif(m8, 0),
         (m0 * x + m1 * (y + h) + m2) / nullif(m8, 0), (m0 * (x + w) + m1 * (y + h) + m2) / nullif(m8, 0))) AS rr,
      greatest(0, least((m4 * y + m1) / nullif(m8, 0), (m4 * (y + h) + m1) / nullif(m8, 0))) AS t,
      least(1, greatest((m4 * y + m1) / nullif(m8, 0), (m4 * (y + h) + m1) / nullif(m8, 0))) AS b FROM r)
    SELECT id, line, part, CASE WHEN m8 = 0 THEN 'corner_at_infinity' END AS error,
      CASE WHEN m8 = 0 THEN NULL WHEN rr > l AND b > t THEN 1 ELSE 0 END AS regions,
      round(CASE WHEN m8 <> 0 AND rr > l AND b > t THEN l END, 6) AS x, round(CASE WHEN m8 <> 0 AND rr > l AND b > t THEN t END, 6) AS y,
      round(CASE WHEN m8 <> 0 AND rr > l AND b > t THEN rr - l END, 6) AS width, round(CASE WHEN m8 <> 0 AND rr > l AND b > t THEN b - t END, 6) AS height FROM c""")
def _(i):
    t = _rects(i).select("id", "line", "part", G.transform_regions(F.array("r"), _matrix()).alias("t"))
    one = F.get("t.regions", F.lit(0))
    return r6(t.select("id", "line", "part", "t.error", F.when(F.col("t.regions").isNotNull(), F.size("t.regions")).alias("regions"),
                       *[one[s].alias(s) for s in G.SIDES]), *G.SIDES)


@query("merge_regions", SQL_RECTS + """
    SELECT id, line, part, CASE WHEN x = y AND width = height THEN 1 ELSE 2 END AS kept FROM r""")
def _(i):
    flipped = G.rect(F.col("y"), F.col("x"), F.col("height"), F.col("width"))
    return _rects(i).select("id", "line", "part", F.size(G.merge_regions(F.array("r"), F.array(flipped), F.array("r"))).alias("kept"))


@query("union_iou", """
    WITH xs AS (SELECT DISTINCT case_id, unnest([x, x + width]) AS v FROM rects),
    ys AS (SELECT DISTINCT case_id, unnest([y, y + height]) AS v FROM rects),
    xi AS (SELECT case_id, v AS x0, lead(v) OVER (PARTITION BY case_id ORDER BY v) AS x1 FROM xs),
    yi AS (SELECT case_id, v AS y0, lead(v) OVER (PARTITION BY case_id ORDER BY v) AS y1 FROM ys),
    cells AS (SELECT xi.case_id, x0, x1, y0, y1, (x1 - x0) * (y1 - y0) AS area FROM xi JOIN yi ON xi.case_id = yi.case_id
              WHERE x1 IS NOT NULL AND y1 IS NOT NULL),
    cover AS (SELECT c.case_id, c.x0, c.y0, any_value(c.area) AS area, bool_or(side = 'expected') AS e, bool_or(side = 'predicted') AS p
              FROM cells c JOIN rects r ON r.case_id = c.case_id AND r.x <= (c.x0 + c.x1) / 2 AND r.x + r.width >= (c.x0 + c.x1) / 2
                AND r.y <= (c.y0 + c.y1) / 2 AND r.y + r.height >= (c.y0 + c.y1) / 2 GROUP BY 1, 2, 3)
    SELECT case_id, round(coalesce(sum(area) FILTER (e AND p), 0) / sum(area) + 1e-9, 6) AS iou FROM cover GROUP BY 1""")
def _(i):
    # The nudge keeps values that end exactly on half a digit from rounding by summation order.
    return R.union_iou(i.rects, i.rects).withColumn("iou", F.round(F.col("iou") + 1e-9, 6))


PAGES = """SELECT p_partkey AS page_id, CAST(1024 + p_size * 20 AS BIGINT) AS width, CAST(700 + p_partkey % 9 * 100 AS BIGINT) AS height,
    CASE p_partkey % 3 WHEN 0 THEN 0.10e0 WHEN 1 THEN 0.25e0 ELSE 0.50e0 END AS fraction FROM {t}"""


def _pages(i):
    i.table("part").createOrReplaceTempView("src_part")
    return i.spark.sql(PAGES.replace("{t}", "src_part"))


SQL_PAGES = "WITH p AS (" + PAGES.replace("{t}", "part") + ")"
CROP = """
    c AS (SELECT *, greatest(1, CAST(round_even(width * sqrt(1.0 - fraction), 0) AS BIGINT)) AS kw,
            greatest(1, CAST(round_even(height * sqrt(1.0 - fraction), 0) AS BIGINT)) AS kh FROM p)"""


@query("crop_geometry", SQL_PAGES + "," + CROP + """
    SELECT page_id, (width - kw) // 2 AS x0, (height - kh) // 2 AS y0, kw AS kept_width, kh AS kept_height,
      round(((width - kw) // 2) / width, 6) AS x, round(1.0 - (kw * kh) / (width * height), 6) AS removed_fraction FROM c""")
def _(i):
    g = _pages(i).select("page_id", G.crop_geometry(F.col("fraction"), F.col("height"), F.col("width")).alias("g"))
    return r6(g.select("page_id", "g.x0", "g.y0", "g.kept_width", "g.kept_height", F.col("g.retained.x").alias("x"), "g.removed_fraction"),
              "x", "removed_fraction")


GRID = """
    grid AS (SELECT page_id, width, height, fraction, CAST(unnest(range((width // {s}) * (height // {s}))) AS INT) AS tile_index FROM p),
    cells AS (SELECT *, tile_index % (width // {s}) * {s} AS x, tile_index // (width // {s}) * {s} AS y FROM grid)"""


@query("region_grid", SQL_PAGES + "," + GRID.replace("{s}", "256") + """
    SELECT page_id, tile_index AS region_index, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM cells""")
def _(i):
    return _pages(i).select("page_id", F.explode(G.region_grid(F.col("height"), F.col("width"), 256)).alias("g")).select("page_id", "g.*")


@query("grid_limitation", SQL_PAGES + """
    SELECT page_id, CASE WHEN (width // 600) * (height // 600) < 4 THEN 'integrity.insufficient_complete_regions' END AS limitation FROM p""")
def _(i):
    return _pages(i).select("page_id", G.grid_limitation(F.col("height"), F.col("width"), 600).alias("limitation"))


def _tiles(i):
    # A page is a short row that becomes many: pages are dealt to as many tasks as a shuffle has before they grow.
    pages = _pages(i).repartition(int(i.spark.conf.get("spark.sql.shuffle.partitions")), "page_id")
    return pages.select("page_id", "width", "height", F.explode(G.region_grid(F.col("height"), F.col("width"), 256)).alias("g")).select(
        "page_id", "width", "height", F.col("g.region_index").alias("tile_index"), "g.x", "g.y")


ORDERED = """
    o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {late}, sha256(concat('k1', chr(0), CAST(page_id AS STRING), chr(0),
            CAST(tile_index AS STRING))), tile_index) AS rn, count(*) OVER (PARTITION BY page_id) AS n FROM cells)"""
LATE = """CASE WHEN (width - CAST(round_even(width * 0.8660254037844386e0, 0) AS BIGINT)) // 2 <= x
    AND (height - CAST(round_even(height * 0.8660254037844386e0, 0) AS BIGINT)) // 2 <= y
    AND x + 256 <= (width - CAST(round_even(width * 0.8660254037844386e0, 0) AS BIGINT)) // 2 + CAST(round_even(width * 0.8660254037844386e0, 0) AS BIGINT)
    AND y + 256 <= (height - CAST(round_even(height * 0.8660254037844386e0, 0) AS BIGINT)) // 2 + CAST(round_even(height * 0.8660254037844386e0, 0) AS BIGINT)
    THEN 0 ELSE 1 END"""
SAMPLED = """
    SELECT page_id, tile_index, CAST(rn - 1 AS INT) AS ordinal, NULL AS error_code FROM o WHERE n >= 12 AND rn <= 12
    UNION ALL SELECT DISTINCT page_id, CAST(NULL AS INT), NULL, 'too_few_tiles' FROM o WHERE n < 12"""


@query("keyed_sample", SQL_PAGES + "," + GRID.replace("{s}", "256") + "," + ORDERED.replace("{late}", "0") + SAMPLED)
def _(i):
    return R.keyed_sample(_tiles(i), "k1", 12)


@query("keyed_sample_crop_first", SQL_PAGES + "," + GRID.replace("{s}", "256") + "," + ORDERED.replace("{late}", LATE) + SAMPLED)
def _(i):
    keep = G.survives_crops(F.col("x"), F.col("y"), 256, F.col("height"), F.col("width"), (0.8660254037844386,))
    return R.keyed_sample(_tiles(i), "k1", 12, keep)


@query("crop_eligibility", SQL_PAGES + "," + CROP + "," + GRID.replace("{s}", "256").replace(
    "cells AS", "cells AS") + "," + ORDERED.replace("{late}", "0") + """,
    t AS (SELECT page_id, x, y FROM o WHERE rn <= 5),
    k AS (SELECT c.page_id, c.fraction, count(t.page_id) FILTER (t.x >= (width - kw) // 2 AND t.y >= (height - kh) // 2
            AND t.x + 256 <= (width - kw) // 2 + kw AND t.y + 256 <= (height - kh) // 2 + kh) AS remaining
          FROM c LEFT JOIN t ON t.page_id = c.page_id GROUP BY 1, 2),
    r AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS page_id, l_returnflag <> 'N' AND l_tax <= 0.065 AND l_quantity <= 48 AS applies FROM lineitem)
    SELECT id, line, r.page_id, CASE WHEN applies THEN remaining END AS remaining_tiles, NOT applies OR remaining >= 2 AS eligible,
      CASE WHEN NOT applies THEN 'eligible' WHEN remaining >= 2 THEN 'at_least_two_complete_embedded_tiles_remain'
           ELSE 'fewer_than_two_complete_embedded_tiles_remain' END AS eligibility_reason FROM r JOIN k ON k.page_id = r.page_id""")
def _(i):
    tiles = R.keyed_sample(_tiles(i), "k1", 5).filter(F.col("tile_index").isNotNull()).select("page_id", "tile_index").join(
        _tiles(i).hint("merge"), ["page_id", "tile_index"]).select("page_id", "x", "y", F.lit(256).alias("size"))
    cases = i.table("lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("page_id"),
        (F.col("l_returnflag") != "N").alias("positive"), (F.col("l_quantity") > 48).alias("failed"),
        (F.col("l_tax") <= 0.065).alias("_crop"))
    rows = cases.join(_pages(i).hint("merge"), "page_id").select(
        "id", "line", "page_id", "positive", "failed", F.when(F.col("_crop"), F.col("fraction")).alias("crop_fraction"),
        F.col("height").alias("page_height"), F.col("width").alias("page_width"))
    return R.crop_eligibility(rows, tiles).select("id", "line", "page_id", "remaining_tiles", "eligible", "eligibility_reason")


@query("partner_ring", """
    WITH r AS (SELECT DISTINCT page_id // 4 AS page_id, region_index + 7 * (page_id % 4) AS region_index FROM replica_votes),
    o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY sha256(concat('k2', chr(0), CAST(page_id AS STRING), chr(0),
            CAST(region_index AS STRING))), region_index) - 1 AS rk, count(*) OVER (PARTITION BY page_id) AS n FROM r)
    SELECT a.page_id, a.region_index, s.shift, b.region_index AS partner_index, NULL AS error_code
    FROM o a, (VALUES (1), (2), (3)) s(shift), o b WHERE a.n > 3 AND b.page_id = a.page_id AND b.rk = (a.rk + s.shift) % a.n
    UNION ALL SELECT page_id, region_index, NULL, NULL, 'replica_mappings_not_independent' FROM o WHERE n <= 3""")
def _(i):
    regions = i.replica_votes.selectExpr("page_id div 4 AS page_id", "region_index + 7 * (page_id % 4) AS region_index").distinct()
    return R.partner_ring(regions, "k2")


@query("erasure_ladder", """
    WITH e AS (SELECT vec_id, embedding, [x[2] FOR x IN list_sort(list_transform(embedding, lambda v, n: row(v, n - 1)))] AS ranking,
                 list_filter(list_transform(embedding, lambda v, n: CASE WHEN v < -0.2 THEN n - 1 END), lambda v: v IS NOT NULL) AS claim FROM embeddings),
    l AS (SELECT vec_id, ranking, [claim, list_sort(ranking[1:16]), list_sort(ranking[1:8]), list_sort(ranking[1:4]), list_sort(ranking[1:2]),
            list_sort(ranking[1:1]), []] AS steps FROM e),
    d AS (SELECT vec_id, ranking, list_filter(steps, lambda s, n: list_position(steps, s) = n) AS ladder FROM l)
    SELECT vec_id, array_to_string(ranking, '.') AS ranking,
      array_to_string(list_transform(ladder, lambda s: concat('[', array_to_string(s, '.'), ']')), '|') AS ladder FROM d""")
def _(i):
    v = F.col("embedding")
    claim = F.filter(F.transform(v, lambda c, n: F.when(c < F.lit(-0.2).cast("float"), n)), lambda n: n.isNotNull())
    rows = i.table("embeddings").withColumn("ranking", G.erasure_rank(v)).withColumn("ladder", G.erasure_ladder(claim, F.col("ranking")))
    steps = F.transform("ladder", lambda s: F.concat(F.lit("["), F.array_join(s.cast("array<string>"), "."), F.lit("]")))
    return rows.select("vec_id", F.array_join(F.col("ranking").cast("array<string>"), ".").alias("ranking"), F.array_join(steps, "|").alias("ladder"))
