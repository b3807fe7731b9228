"""Hot keys take another path to the same rows."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from copytrail import skew
from copytrail.operators import regions
from copytrail.operators.regions import partner_ring, union_iou
from copytrail.streaming.limits import rate_limit


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def skewed(spark):
    random.seed(7)
    data = [(n, "hot" if n % 3 == 0 else f"k{random.randrange(40)}", random.randrange(500)) for n in range(900)]
    return spark.createDataFrame(data, "id bigint, k string, v bigint")


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_is_the_plain_join(spark, skewed, tiny_hot_keys, how):
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("k2", 4), ("other", 5)], "k string, w bigint")
    assert rows_of(skew.lookup_join(skewed, right, ["k"], how).select("id", "k", "v", "w")) == rows_of(
        skewed.join(right, "k", how).select("id", "k", "v", "w"))


def test_hot_keys_are_found(skewed, tiny_hot_keys):
    assert "hot" in {r.k for r in skew.hot_keys(skewed, ["k"]).collect()}


def test_lookup_join_really_spreads_the_hot_key(spark, skewed, tiny_hot_keys):
    right = spark.createDataFrame([("hot", 1)], "k string, w bigint")
    plan = skew.lookup_join(skewed, right, ["k"])._jdf.queryExecution().analyzed().toString()
    assert "_salt" in plan and "GlobalLimit" not in plan


def test_lookup_join_is_a_plain_join_by_default(spark, skewed):
    right = spark.createDataFrame([("hot", 1)], "k string, w bigint")
    assert "_salt" not in skew.lookup_join(skewed, right, ["k"])._jdf.queryExecution().analyzed().toString()


def test_rank_and_running_values(skewed):
    order = [F.col("v"), F.col("id")]
    w = Window.partitionBy("k").orderBy(*order)
    slot = F.floor(F.col("v") / 50)
    expected = skewed.withColumn("rank", F.row_number().over(w) - 1).withColumn("s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "p", F.lag("v").over(w)).withColumn("m", F.max("id").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = skew.rank_in_key(skewed, ["k"], order, slot)
    assert rows_of(got.select("id", "rank")) == rows_of(expected.select("id", "rank"))
    assert rows_of(skew.running_sum(skewed, ["k"], order, "v", slot, "s").select("id", "s")) == rows_of(expected.select("id", "s"))
    assert rows_of(skew.running_max(skewed, ["k"], order, "id", slot, "m").select("id", "m")) == rows_of(expected.select("id", "m"))
    assert rows_of(skew.previous_in_key(skewed, ["k"], ["v", "id"], ["v"], slot).select("id", "previous_v")) == rows_of(expected.select("id", "p"))


def test_exact_percentiles(spark, skewed, tiny_hot_keys):
    found = {r.k: r for r in skew.exact_percentiles(skewed, ["k"], "v", {"median": 0.5, "p95": 0.95, "low": 0.0, "high": 1.0}).collect()}
    pdf = skewed.toPandas()
    assert set(found) == set(pdf.k)
    for key, part in pdf.groupby("k"):
        for label, q in (("median", 0.5), ("p95", 0.95), ("low", 0.0), ("high", 1.0)):
            assert found[key][label] == pytest.approx(np.quantile(part.v, q))


def test_union_iou_against_a_grid(spark):
    """Rectangles on a 20 x 20 grid, so the true areas are counts of cells; one case has many rectangles."""
    random.seed(3)
    data, truth = [], {}
    for case, n in (("few", 3), ("some", 40), ("many", 600), ("one-sided", 2)):
        cells = {"expected": set(), "predicted": set()}
        for k in range(n):
            side = "expected" if k % 2 == 0 or case == "one-sided" else "predicted"
            x, y = random.randrange(19), random.randrange(19)
            w, h = random.randrange(1, min(5, 20 - x) + 1), random.randrange(1, min(5, 20 - y) + 1)
            data.append((case, side, x / 20, y / 20, w / 20, h / 20))
            cells[side] |= {(a, b) for a in range(x, x + w) for b in range(y, y + h)}
        both = cells["expected"] | cells["predicted"]
        truth[case] = len(cells["expected"] & cells["predicted"]) / len(both)
    rects = spark.createDataFrame(data, "case_id string, side string, x double, y double, width double, height double")
    cases = spark.createDataFrame([(c,) for c in [*truth, "empty"]], "case_id string")
    found = {r.case_id: r.iou for r in union_iou(rects, cases).collect()}
    assert found.pop("empty") == 1.0
    assert found == pytest.approx(truth, abs=1e-9)


def test_a_crowded_corner_is_cut_on(spark, monkeypatch):
    """Thin rectangles in a 256th of the square, on a grid of 4096 of them a side: the leaves stay small, the areas exact."""
    monkeypatch.setattr(regions, "TILE_MOST", 12)
    rng, unit = random.Random(5), 1 / (16 * 4096)
    data, cells = [], {"expected": set(), "predicted": set()}
    for k in range(1500):
        side, x, y = ("expected", "predicted")[k % 2], rng.randrange(4000), rng.randrange(4000)
        w, h = rng.choice([(1, 40), (30, 1), (3, 3), (90, 2)])
        data.append(("c", side, x * unit, y * unit, w * unit, h * unit))
        cells[side] |= {(a, b) for a in range(x, x + w) for b in range(y, y + h)}
    rects = spark.createDataFrame(data, "case_id string, side string, x double, y double, width double, height double")
    truth = len(cells["expected"] & cells["predicted"]) / len(cells["expected"] | cells["predicted"])
    assert union_iou(rects, rects).first().iou == pytest.approx(truth, abs=1e-9)
    boxes = rects.selectExpr("case_id", "side", "1L AS t", "x AS x0", "x + width AS x1", "y AS y0", "y + height AS y1")
    leaves = regions._leaf_tiles(boxes).groupBy(*regions.TILE).count()
    assert leaves.agg({"count": "max"}).first()[0] <= 12 and leaves.select("t").distinct().count() >= 2


def test_partner_ring_is_a_bijection_per_shift(spark):
    regions = spark.createDataFrame([("p", n) for n in range(50)] + [("q", n) for n in range(3)], "page_id string, region_index int")
    rows = partner_ring(regions, "key").collect()
    good = [r for r in rows if r.error_code is None]
    assert {r.page_id for r in rows if r.error_code} == {"q"}
    for shift in (1, 2, 3):
        pairs = [(r.region_index, r.partner_index) for r in good if r.shift == shift]
        assert len(pairs) == 50 and {b for _, b in pairs} == set(range(50)) and all(a != b for a, b in pairs)
    assert rows_of(partner_ring(regions, "key")) != rows_of(partner_ring(regions, "other"))


def test_rate_limit_against_brute_force(spark):
    random.seed(11)
    data, truth, event = [], {}, 0
    for key, pace, n in (("dense", 5, 400), ("medium", 40, 150), ("sparse", 90, 60)):
        now, allowed = 0, []
        for _ in range(n):
            now += random.randrange(pace)
            data.append((key, now, event))
            recent = [t for t in allowed if t > now - 60]
            truth[event] = len(recent) < 5
            if truth[event]:
                allowed.append(now)
            event += 1
    hits = spark.createDataFrame(data, "key string, s bigint, event_id bigint").select("key", F.timestamp_seconds("s").alias("ts"), "event_id")
    assert {r.event_id: r.allowed for r in rate_limit(hits, 5, 60).collect()} == truth


def test_sparse_join_is_the_plain_left_join(spark, skewed):
    left = skewed.withColumn("k", F.when(F.col("id") % 2 == 0, F.col("k")))
    right = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, w bigint")
    assert rows_of(skew.sparse_join(left, right, ["k"], ["id"]).select("id", "k", "w")) == rows_of(left.join(right, "k", "left").select("id", "k", "w"))


def test_hot_slices_follow_the_order(spark, skewed, tiny_hot_keys):
    sliced = skew.slice_hot(skewed, ["k"], "v", slices=16).filter("k = 'hot'").toPandas().sort_values("v")
    assert sliced["_slice"].is_monotonic_increasing and sliced["_slice"].nunique() > 8
    assert sliced.groupby("_slice").size().max() < len(sliced) / 4


def test_sliced_operators_give_the_same_rows(spark, tiny_hot_keys):
    """With every key hot, the request limit and the transition audit still match their plain definitions."""
    from copytrail.operators.lifecycle import transition_audit

    random.seed(5)
    states = ["created", "queued", "processing", "retryable_failed", "succeeded"]
    rows = [(n % 4, 1000 + n // 3, n, random.choice(states), random.randrange(3)) for n in range(400)]
    history = spark.createDataFrame(rows, "job_id bigint, s bigint, change_id bigint, status string, attempt int").select(
        "job_id", F.timestamp_seconds("s").alias("changed_at"), "change_id", "status", "attempt")
    found = {r.change_id: r.previous_status for r in transition_audit(history).collect()}
    w = Window.partitionBy("job_id").orderBy("changed_at", "change_id")
    plain = {r.change_id: r.p for r in history.withColumn("p", F.lag("status").over(w)).collect()}
    assert found and all(plain[change] == previous for change, previous in found.items())
    test_rate_limit_against_brute_force(spark)
