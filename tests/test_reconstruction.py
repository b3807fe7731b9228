"""Evidence and summaries computed again, on rows small enough to work out by hand."""

from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from copytrail.functions import geometry as G
from copytrail.operators import reconstruction as R

IDENTITY = [float(v) for v in G.IDENTITY]
ROW = f"row_id string, plan_id string, artifact_absent boolean, source_to_output array<double>, tamper_ground_truth {G.RECTS}, removed_area_fraction double"


def plan(spark, infinite=False):
    """A page of 400 by 300 pixels, a quarter of which is cropped away; a third of the last column hits infinity if asked."""
    frame = spark.createDataFrame([("p", [(0.4, 0.4, 0.2, 0.2)], IDENTITY)], f"plan_id string, source_regions {G.RECTS}, canvas array<double>")
    steps = [G.crop_operation(F.lit(0.25), F.lit(400), F.lit(300))]
    if infinite:
        steps.append(G.operation(F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0)])))
    return frame.withColumn("operations", F.array(*steps)).withColumn("planned_removed", F.lit(1 - 346 * 260 / 120000))


def good():
    sx, sy, x0, y0 = 300 / 260, 400 / 346, 20 / 300, 27 / 400
    matrix = [sx, 0.0, -x0 * sx, 0.0, sy, -y0 * sy, 0.0, 0.0, 1.0]
    return matrix, [((0.4 - x0) * sx, (0.4 - y0) * sy, 0.2 * sx, 0.2 * sy)], 1 - 346 * 260 / 120000


def audit(spark, rows, **kind):
    found = R.evidence_audit(spark.createDataFrame(rows, ROW), plan(spark, **kind), ["plan_id"])
    return {(r.row_id, r.code) for r in found.collect()}


def test_tampered_evidence_is_named(spark):
    matrix, regions, removed = good()
    moved = [(regions[0][0] + 0.01, *regions[0][1:])]
    rows = [("ok", "p", False, matrix, regions, removed), ("rounded", "p", False, matrix, regions, removed + 1e-13),
            ("region", "p", False, matrix, moved, removed), ("count", "p", False, matrix, regions * 2, removed), ("none", "p", False, matrix, None, removed),
            ("removed", "p", False, matrix, regions, removed - 0.01), ("nan", "p", False, matrix, regions, float("nan")), ("null", "p", False, matrix, regions, None),
            ("matrix", "p", False, [2.0] + matrix[1:], regions, removed), ("short", "p", False, matrix[:4], regions, removed), ("stray", "q", False, matrix, regions, removed)]
    assert audit(spark, rows) == {
        ("region", "ground_truth_mismatch"), ("count", "ground_truth_mismatch"), ("none", "ground_truth_mismatch"), ("removed", "removed_fraction_mismatch"),
        ("nan", "removed_fraction_mismatch"), ("null", "removed_fraction_mismatch"), ("matrix", "transform_mismatch"), ("short", "transform_mismatch"), ("stray", "unplanned")}


def test_either_state_may_hold_where_the_row_does_not_say(spark):
    matrix, regions, removed = good()
    source = [(0.4, 0.4, 0.2, 0.2)]
    rows = [("with", "p", None, matrix, regions, removed), ("without", "p", None, None, source, removed), ("mixed", "p", None, None, regions, removed),
            ("absent", "p", True, None, source, removed), ("claims", "p", True, matrix, regions, removed)]
    assert audit(spark, rows) == {("mixed", "transform_mismatch"), ("claims", "transform_mismatch"), ("claims", "ground_truth_mismatch")}


def test_corner_at_infinity_cannot_be_reconstructed(spark):
    matrix, regions, removed = good()
    found = audit(spark, [("a", "p", False, matrix, regions, removed)], infinite=True)
    assert ("a", "unreconstructable") in found and ("a", "ground_truth_mismatch") not in found


def test_steps_compose_in_order_and_removed_areas_multiply(spark):
    crop = G.crop_operation(F.lit(0.25), F.lit(400), F.lit(400))
    mark = G.operation(F.array(*[F.lit(v) for v in G.IDENTITY]), regions=F.array(G.rect(*[F.lit(v) for v in (0.25, 0.25, 0.5, 0.5)])))
    row = spark.range(1).select(G.fold_operations(F.array(mark, crop)).alias("before"), G.fold_operations(F.array(crop, mark)).alias("after"),
                                G.fold_operations(F.array(crop, crop)).alias("twice")).first()
    side = 346 / 400
    assert row.before.regions[0].width == pytest.approx(0.5 / side) and row.after.regions[0].width == 0.5
    assert row.twice.removed == pytest.approx(1 - side ** 4) and row.twice.matrix[0] == pytest.approx(1 / side ** 2)


def digest(spark, rows, **kind):
    return R.rows_digest(spark.createDataFrame(rows, "row_id string, a string, b int"), "row_id", ["a", "b"], **kind).first()


def test_digest_sees_every_change_and_no_order(spark):
    rows = [(f"r{k}", "x" if k % 3 else None, k) for k in range(500)]
    base = digest(spark, rows)
    assert digest(spark, rows[::-1]) == base
    changed = [rows[:-1], [*rows, rows[7]], [("r0", "~", 0), *rows[1:]], [("r0", None, None), *rows[1:]], [("r0", rows[1][1], 1), ("r1", None, 0), *rows[2:]]]
    assert len({base, *[digest(spark, c) for c in changed]}) == 1 + len(changed)
    assert digest(spark, []) is None


def test_summary_diff_names_each_field(spark):
    rows = spark.createDataFrame([(f"r{k}", "p" if k < 4 else "q", "i", "i" if k % 2 else None, "decoded" if k % 2 else "not_detected", 38.0 + k, 0.95) for k in range(8)],
                                 "row_id string, run string, expected_id string, decoded_id string, reason string, psnr_db double, ssim double")
    whole = R.evidence_summary(rows, ["run"], ["decoded_id", "reason"])
    assert R.summary_diff(whole, whole, ["run"]).collect() == []
    stored = whole.withColumn("status", F.when(F.col("run") == "p", "complete_with_errors").otherwise(F.col("status"))).withColumn(
        "mean_psnr_db", F.when(F.col("run") == "q", None).otherwise(F.col("mean_psnr_db") + 1e-12)).withColumn(
        "rows_sha256", F.when(F.col("run") == "p", F.lit("0" * 64)).otherwise(F.col("rows_sha256")))
    found = {(r.run, r.field) for r in R.summary_diff(stored, whole, ["run"]).collect()}
    assert found == {("p", "status"), ("p", "rows_sha256"), ("q", "mean_psnr_db")}
    sides = R.summary_diff(whole.filter("run = 'p'").unionAll(whole.filter("run = 'p'")), whole, ["run"])
    assert {(r.run, r.field) for r in sides.collect()} == {("p", "repeated"), ("q", "missing")}


def test_digest_is_the_tree_it_says_and_deals_rows_once(spark):
    rows = [("r0", "x"), ("r0", "x"), ("r0", None), (None, "y"), *[(f"r{k}", "z") for k in range(1, 300)]]
    frame = spark.createDataFrame(rows, "row_id string, a string")
    found = R.rows_digest(frame, "row_id", ["a"], digits=2)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 2

    def sha(text):
        return sha256(text.encode()).hexdigest()

    leaves = {}
    for (key, a), n in Counter(rows).items():
        if key is not None:
            leaves.setdefault(sha(key)[:2], []).append((sha(key), sha(f"{key}\0" + ("~" if a is None else f"={a}")), n))
    nodes = sorted((leaf, sha("\n".join(f"{p}:{d}*{n}" for p, d, n in sorted(members)))) for leaf, members in leaves.items())
    assert sha("\n".join(f"{p}:{d}" for p, d in nodes)) in {r.rows_sha256 for r in found.collect()}
