"""Queries that compute reported evidence and stored summaries again."""

from pyspark.sql import functions as F

from copytrail.catalog import query
from copytrail.functions import geometry as G
from copytrail.operators import reconstruction as R


def _affine(sx, ox, sy, oy):
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(sx, zero, ox, zero, sy, oy, zero, zero, one)


def _plan(i):
    plan = i.evidence_plan
    narrow = G.operation(_affine(F.lit(0.8), F.lit(0.1), F.lit(1.0), F.lit(0.0)))
    changed = G.operation(F.array(*[F.lit(v) for v in G.IDENTITY]), regions=F.array(G.rect(*[F.lit(v) for v in (0.4, 0.4, 0.2, 0.1)])))
    crop = G.crop_operation(F.lit(0.25), F.col("page_height"), F.col("page_width"))
    none = F.array().cast("array<struct<matrix:array<double>,removed:double,regions:" + G.RECTS + ">>")
    steps = F.when(F.col("chain") == 1, F.array(narrow)).when(F.col("chain") == 2, F.array(crop)).when(
        F.col("chain") == 3, F.array(narrow, changed, crop)).otherwise(none)
    truth = F.when(F.col("has_truth"), F.array(G.rect(F.col("x"), F.col("y"), F.lit(0.2), F.lit(0.15)))).otherwise(F.array().cast(G.RECTS))
    return plan.select("plan_id", truth.alias("source_regions"), _affine(F.col("canvas_scale"), F.col("canvas_shift"), F.lit(1.0), F.lit(0.0)).alias("canvas"),
                       steps.alias("operations"), F.when(F.col("chain") == 2, crop["removed"]).alias("planned_removed"))


def _reported(i):
    rows = i.evidence_rows
    first = F.when(F.col("seen"), G.rect(F.col("l"), F.col("t"), F.col("r") - F.col("l"), F.col("b") - F.col("t")))
    second = F.when(F.col("marked"), G.rect(F.col("tl"), F.col("tt"), F.col("tw"), F.col("th")))
    matrix = F.when(F.col("sx").isNotNull(), _affine(F.col("sx"), F.col("ox"), F.col("sy"), F.col("oy")))
    # Rows of orders that the plan leaves out are under no plan, whatever they report.
    key = F.coalesce(F.col("plan_id"), F.lit(-1))
    return rows.select("row_id", key.alias("plan_id"), "artifact_absent", matrix.alias("source_to_output"), F.array_compact(F.array(first, second)).alias("tamper_ground_truth"),
                       F.col("removed").alias("removed_area_fraction"))


@query("evidence_audit", """
    WITH w AS (SELECT p.*, canvas_scale * x + canvas_shift AS cl, canvas_scale * (x + 0.2) + canvas_shift AS cr FROM evidence_plan p),
    c AS (SELECT *, greatest(0, sx * cl + ox) AS pl, least(1, sx * cr + ox) AS pr, greatest(0, sy * y + oy) AS pt, least(1, sy * (y + 0.15) + oy) AS pb FROM w),
    j AS (SELECT e.row_id, e.artifact_absent, e.plan_id IS NULL AS unplanned, e.sx IS NOT NULL AS has_matrix, abs(e.sx - c.sx) <= 1e-12 AS same_sx,
        CASE WHEN e.seen THEN 1 ELSE 0 END + CASE WHEN e.marked THEN 1 ELSE 0 END AS n, e.seen, e.l, e.t, e.r, e.b, e.removed, c.removed AS want_removed, c.chain,
        c.has_truth AND pr > pl AND pb > pt AS p_seen, c.has_truth AND least(1, cr) > greatest(0, cl) AND least(1, y + 0.15) > y AS a_seen,
        pl, pr, pt, pb, greatest(0, cl) AS al, least(1, cr) AS ar, y AS at_, least(1, y + 0.15) AS ab
      FROM evidence_rows e LEFT JOIN c ON c.plan_id = e.plan_id),
    s AS (SELECT *, NOT (has_matrix AND coalesce(same_sx, false)) AS m1, has_matrix AS m0,
        NOT (n = CASE WHEN p_seen THEN 1 ELSE 0 END + CASE WHEN chain = 3 THEN 1 ELSE 0 END AND (NOT p_seen OR (seen AND abs(l - pl) <= 1e-12
          AND abs(t - pt) <= 1e-12 AND abs((r - l) - (pr - pl)) <= 1e-12 AND abs((b - t) - (pb - pt)) <= 1e-12))) AS g1,
        NOT (n = CASE WHEN a_seen THEN 1 ELSE 0 END AND (NOT a_seen OR (seen AND abs(l - al) <= 1e-12
          AND abs(t - at_) <= 1e-12 AND abs((r - l) - (ar - al)) <= 1e-12 AND abs((b - t) - (ab - at_)) <= 1e-12))) AS g0,
        NOT coalesce(abs(removed - want_removed) <= 1e-12, false) AS f1,
        CASE WHEN chain = 2 THEN NOT coalesce(abs(removed - want_removed) <= 1e-12, false) ELSE removed IS NOT NULL END AS f0 FROM j WHERE NOT unplanned),
    d AS (SELECT *, CASE WHEN artifact_absent THEN 0 WHEN NOT artifact_absent THEN 1 WHEN NOT (m1 OR g1 OR f1) OR NOT (m0 OR g0 OR f0) THEN 2 ELSE 1 END AS state FROM s)
    SELECT row_id, 'unplanned' AS code FROM j WHERE unplanned
    UNION ALL SELECT row_id, 'transform_mismatch' FROM d WHERE (state = 1 AND m1) OR (state = 0 AND m0)
    UNION ALL SELECT row_id, 'ground_truth_mismatch' FROM d WHERE (state = 1 AND g1) OR (state = 0 AND g0)
    UNION ALL SELECT row_id, 'removed_fraction_mismatch' FROM d WHERE (state = 1 AND f1) OR (state = 0 AND f0)""")
def _(i):
    return R.evidence_audit(_reported(i), _plan(i), ["plan_id"])


DIGESTED = ("expected_id", "decoded_id", "reason", "limitation")
LEAF = "sha256(concat(row_id, " + ", ".join(f"chr(0), coalesce('=' || {c}, '~')" for c in DIGESTED) + "))"
DIGEST = f"""
    d0 AS (SELECT profile_id, path, concat(d, '*', count(*)) AS d FROM (SELECT profile_id, sha256(row_id) AS path, {LEAF} AS d FROM result_rows) GROUP BY profile_id, path, d),
    d1 AS (SELECT profile_id, substr(path, 1, 6) AS path, sha256(string_agg(concat(path, ':', d), chr(10) ORDER BY path, d)) AS d FROM d0 GROUP BY 1, 2),
    d2 AS (SELECT profile_id, substr(path, 1, 4) AS path, sha256(string_agg(concat(path, ':', d), chr(10) ORDER BY path, d)) AS d FROM d1 GROUP BY 1, 2),
    d3 AS (SELECT profile_id, substr(path, 1, 2) AS path, sha256(string_agg(concat(path, ':', d), chr(10) ORDER BY path, d)) AS d FROM d2 GROUP BY 1, 2),
    d4 AS (SELECT profile_id, sha256(string_agg(concat(path, ':', d), chr(10) ORDER BY path, d)) AS rows_sha256 FROM d3 GROUP BY 1)"""


@query("rows_digest", f"WITH {DIGEST} SELECT profile_id, rows_sha256 FROM d4")
def _(i):
    return R.rows_digest(i.result_rows, "row_id", DIGESTED, ["profile_id"])


def _counts(rows):
    return f"""SELECT profile_id, count(*) AS completed_rows, count(*) FILTER (reason = 'execution_error') AS execution_errors,
        count(*) FILTER (decoded_id = expected_id AND reason <> 'execution_error') AS true_attribution,
        count(*) FILTER (decoded_id IS NOT NULL AND decoded_id IS DISTINCT FROM expected_id) AS false_attribution,
        avg(psnr_db) AS mean_psnr_db, avg(ssim) AS mean_ssim, md5(string_agg(concat(row_id, '|', coalesce(decoded_id, ''), '|', reason), ',' ORDER BY row_id, decoded_id, reason)) AS content FROM {rows} GROUP BY 1"""


TAMPERED = """SELECT * REPLACE (CASE WHEN profile_id = 'prof2' AND page_index = 1 THEN expected_id ELSE decoded_id END AS decoded_id,
      CASE WHEN profile_id = 'prof1' AND page_index = 0 THEN psnr_db + 0.5 ELSE psnr_db END AS psnr_db) FROM result_rows WHERE profile_id <> 'prof4'"""


@query("summary_diff", f"""
    WITH t AS ({TAMPERED}), a AS ({_counts('t')}), b AS ({_counts('result_rows')}),
    j AS (SELECT b.profile_id, a.profile_id IS NULL AS gone, a.true_attribution <> b.true_attribution AS f1, a.false_attribution <> b.false_attribution AS f2,
            abs(a.mean_psnr_db - b.mean_psnr_db) > 1e-9 AS f3, a.content <> b.content AS f4, a.execution_errors <> b.execution_errors AS f5 FROM b LEFT JOIN a USING (profile_id))
    SELECT profile_id, 'missing' AS field FROM j WHERE gone UNION ALL SELECT profile_id, 'true_attribution' FROM j WHERE f1
    UNION ALL SELECT profile_id, 'false_attribution' FROM j WHERE f2 UNION ALL SELECT profile_id, 'mean_psnr_db' FROM j WHERE f3
    UNION ALL SELECT profile_id, 'rows_sha256' FROM j WHERE f4 UNION ALL SELECT profile_id, 'execution_errors' FROM j WHERE f5""")
def _(i):
    rows = i.result_rows
    # The stored summary was made of other rows: one profile left out, one with better quality, one with decodes that never were.
    other = rows.filter("profile_id <> 'prof4'").withColumn(
        "decoded_id", F.when((F.col("profile_id") == "prof2") & (F.col("page_index") == 1), F.col("expected_id")).otherwise(F.col("decoded_id"))).withColumn(
        "psnr_db", F.when((F.col("profile_id") == "prof1") & (F.col("page_index") == 0), F.col("psnr_db") + 0.5).otherwise(F.col("psnr_db")))
    stored = R.evidence_summary(other, ["profile_id"], DIGESTED)
    return R.summary_diff(stored, R.evidence_summary(rows, ["profile_id"], DIGESTED), ["profile_id"])
