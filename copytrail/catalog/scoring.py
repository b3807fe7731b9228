"""Queries that score benchmark rows."""

from pyspark.sql import functions as F

from copytrail.catalog import query
from copytrail.catalog.tracing import r6
from copytrail.operators import scoring as S

METRICS = """
    count(*) FILTER (expected_id IS NOT NULL AND (eligible OR reason = 'execution_error') AND decoded_id = expected_id) AS true_attribution,
    count(*) FILTER (expected_id IS NOT NULL AND (eligible OR reason = 'execution_error') AND decoded_id IS NULL) AS missed_detection,
    count(*) FILTER (decoded_id IS NOT NULL AND decoded_id IS DISTINCT FROM expected_id) AS false_attribution,
    count(*) FILTER (decoded_id IS NULL AND reason = 'not_detected') AS not_detected,
    count(*) FILTER (decoded_id IS NULL AND reason = 'partial') AS partial,
    count(*) FILTER (decoded_id IS NULL AND reason = 'invalid_crc') AS invalid_crc,
    count(*) FILTER (reason = 'execution_error') AS execution_errors,
    count(*) FILTER (expected_id IS NOT NULL AND eligible) AS eligible_positive_cases,
    count(*) FILTER (expected_id IS NOT NULL AND (eligible OR reason = 'execution_error')) AS decode_denominator_positive_cases,
    count(*) FILTER (eligible) AS eligible_evaluated_cases, count(*) AS scheduled_evaluated_cases"""


@query("detection_metrics", f"""
    WITH m AS (SELECT profile_id, attack_id, {METRICS} FROM result_rows GROUP BY 1, 2)
    SELECT *, round(true_attribution / decode_denominator_positive_cases, 6) AS decode_rate,
           round(false_attribution / scheduled_evaluated_cases, 6) AS false_attribution_rate FROM m""")
def _(i):
    return r6(S.detection_metrics(i.result_rows, ["profile_id", "attack_id"]), "decode_rate", "false_attribution_rate")


def score_sql(rows, by, rules, word, gates, pages, gradient="NULL", attacks=4):
    """The scoring statement; ``gates`` lists the gate names after the rate gates."""
    quality = "expected_id IS NOT NULL" + ("" if rules.quality_from_errors else " AND reason <> 'execution_error'")
    agg = "min" if rules.use_minimum else "avg"
    rates = ""
    for name, attack, more in (("jpeg70", "jpeg-q70", ""), ("resize075", "resize-s0p75", ""), ("crop025", "crop-f0p25", " AND eligible")):
        scope = f"expected_id IS NOT NULL AND attack_id = '{attack}'{more}"
        rates += f"""count(*) FILTER ({scope} AND reason <> 'execution_error' AND decoded_id = expected_id) AS {name}_true_attribution,
            count(*) FILTER ({scope}) AS {name}_denominator,"""
    cases = {
        f"{word}_psnr_db_at_least_38": f"coalesce({word}_psnr_db, 0) < 38",
        f"{word}_ssim_at_least_0.95": f"coalesce({word}_ssim, 0) < 0.95",
        "complete_quality_population_12": f"quality_observations <> {pages}",
        "gradient_completed_all_four_attacks": f"gradient_completed_attacks <> {attacks}",
    }
    tests = [(rules.errors_gate, "execution_errors <> 0"), (rules.false_gate, "false_attribution <> 0")]
    tests += [(f"{n}_decode_rate_at_least_{t:.2f}", f"coalesce({n}_true_attribution / nullif({n}_denominator, 0), 0) < {t}")
              for n, t in (("jpeg70", 0.95), ("resize075", 0.95), ("crop025", 0.90))]
    tests += [(g, cases[g]) for g in gates]
    failed = ", ".join(f"CASE WHEN {t} THEN '{g}' END" for g, t in tests)
    keys = ", ".join(by)
    return f"""
    WITH q AS (SELECT {keys}, fixture_id, page_index, min(psnr_db) AS p, min(ssim) AS s FROM {rows} WHERE {quality} GROUP BY ALL),
    qa AS (SELECT {keys}, count(*) AS quality_observations, {agg}(p) AS {word}_psnr_db, {agg}(s) AS {word}_ssim FROM q GROUP BY ALL),
    c AS (SELECT {keys}, min(candidate_id) AS candidate_id, count(*) AS scheduled_rows,
            count(*) FILTER (reason = 'execution_error') AS execution_errors,
            count(*) FILTER (decoded_id IS NOT NULL AND decoded_id IS DISTINCT FROM expected_id) AS false_attribution,
            count(*) FILTER (fixture_id = {gradient} AND reason <> 'execution_error') AS gradient_completed_attacks,
            {rates} avg(elapsed_ms) AS processing_ms_per_page FROM {rows} GROUP BY {keys}),
    scored AS (SELECT c.*, qa.quality_observations, qa.{word}_psnr_db, qa.{word}_ssim FROM c LEFT JOIN qa USING ({keys})),
    scores AS (SELECT *, concat_ws(',', {failed}) AS failed_gates FROM scored)"""


ROUNDED = """ {keys}, candidate_id, scheduled_rows, execution_errors, false_attribution, gradient_completed_attacks,
    jpeg70_true_attribution, jpeg70_denominator, resize075_true_attribution, resize075_denominator,
    crop025_true_attribution, crop025_denominator, quality_observations, round({w}_psnr_db, 6) AS {w}_psnr_db,
    round({w}_ssim, 6) AS {w}_ssim, round(processing_ms_per_page, 6) AS processing_ms_per_page,
    round(jpeg70_true_attribution / jpeg70_denominator, 6) AS jpeg70_rate,
    round(resize075_true_attribution / resize075_denominator, 6) AS resize075_rate,
    round(crop025_true_attribution / crop025_denominator, 6) AS crop025_rate, failed_gates"""


def _score_query(name, rules, word, gradient="NULL"):
    oracle = score_sql("result_rows", ["profile_id"], rules, word, rules.quality_gates, 12, gradient) + " SELECT" + ROUNDED.format(
        keys="profile_id", w=word) + " FROM scores"

    @query(name, oracle)
    def _(i):
        fixture = gradient.strip("'") if gradient != "NULL" else None
        scores = S.profile_scores(i.result_rows, rules, gradient_fixture=fixture)
        scores = scores.drop("identity_consistent", "quality_consistent").withColumn("failed_gates", F.array_join("failed_gates", ","))
        return r6(scores, f"{word}_psnr_db", f"{word}_ssim", "processing_ms_per_page", "jpeg70_rate", "resize075_rate", "crop025_rate")


_score_query("profile_scores_v1", S.PROFILE_V1, "mean")
_score_query("profile_scores_v2", S.PROFILE_V2, "mean")
_score_query("pregate_scores_v2", S.PREGATE_V2, "mean", "'fx3'")
_score_query("pregate_scores_v3", S.PREGATE_V3, "minimum")


@query("quality_observations", """
    SELECT profile_id, fixture_id, page_index, CASE WHEN a = b THEN p END AS psnr_db, CASE WHEN a = b THEN round(s, 6) END AS ssim,
           CASE WHEN a <> b THEN 'inconsistent_quality' END AS error_code
    FROM (SELECT profile_id, fixture_id, page_index, min(psnr_db) AS p, min(ssim) AS s, min(row(psnr_db, ssim)) AS a,
                 max(row(psnr_db, ssim)) AS b FROM result_rows
          WHERE expected_id IS NOT NULL AND reason <> 'execution_error' GROUP BY ALL)""")
def _(i):
    return r6(S.quality_observations(i.result_rows), "ssim")


def _run_scores(i, rules):
    return S.profile_scores(i.run_rows, rules, ["run_id", "profile_id"], positive_pages=35, gradient_fixture="fx3")


@query("eligible_profiles", score_sql("run_rows", ["run_id", "profile_id"], S.PROFILE_V1, "mean", S.PROFILE_V1.quality_gates, 35) + """,
    e AS (SELECT *, sum(execution_errors) OVER (PARTITION BY run_id) AS errs,
            jpeg70_true_attribution / jpeg70_denominator AS r1, resize075_true_attribution / resize075_denominator AS r2,
            crop025_true_attribution / crop025_denominator AS r3 FROM scores)
    SELECT run_id, profile_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY round(mean_ssim, 9) DESC, least(r1, r2, r3) DESC,
           processing_ms_per_page, profile_id) AS INT) AS rank, round(least(r1, r2, r3), 6) AS worst_rate FROM e
    WHERE errs = 0 AND false_attribution = 0 AND r1 >= 0.95 AND r2 >= 0.95 AND r3 >= 0.90 AND mean_psnr_db >= 38 AND mean_ssim >= 0.95""")
def _(i):
    return r6(S.eligible_profiles(_run_scores(i, S.PROFILE_V1), ["run_id"]), "worst_rate").select("run_id", "profile_id", "rank", "worst_rate")


def _planned(i, short=0):
    """Planned rows per run; ``short`` makes one run lack that many."""
    return i.run_rows.groupBy("run_id").agg(
        (F.count("*") + F.when(F.col("run_id") == "run1", short).otherwise(0)).alias("planned_rows"))


STATUS = """
    st AS (SELECT run_id, count(*) + CASE WHEN run_id = 'run1' THEN {x} ELSE 0 END AS planned_rows, count(*) AS completed_rows,
           count(*) FILTER (reason = 'execution_error') AS failed_rows FROM run_rows GROUP BY 1),
    status AS (SELECT *, CASE WHEN completed_rows = planned_rows AND failed_rows > 0 THEN 'complete_with_errors'
                              WHEN completed_rows = planned_rows THEN 'complete' ELSE 'incomplete' END AS status FROM st)"""


@query("run_status", "WITH" + STATUS.replace("{x}", "1") + "SELECT * FROM status")
def _(i):
    return S.run_status(i.run_rows, _planned(i, 1), ["run_id"])


@query("qualified_selection_v2", score_sql("run_rows", ["run_id", "profile_id"], S.PREGATE_V2, "mean", S.PREGATE_V2.quality_gates[:3], 35)
       + "," + STATUS.replace("{x}", "0") + """
    SELECT run_id, candidate_id FROM scores JOIN status USING (run_id)
    WHERE status = 'complete' AND failed_gates = '' AND crop025_denominator > 0""")
def _(i):
    from dataclasses import replace

    rules = replace(S.PREGATE_V2, quality_gates=S.PREGATE_V2.quality_gates[:3])
    status = S.run_status(i.run_rows, _planned(i), ["run_id"])
    return S.qualified_selection(_run_scores(i, rules), status, ["run_id"], False, None, None)


@query("qualified_selection_v3", score_sql("run_rows", ["run_id", "profile_id"], S.PREGATE_V3, "minimum", S.PREGATE_V3.quality_gates, 35)
       + "," + STATUS.replace("{x}", "0") + """
    SELECT run_id, candidate_id FROM scores JOIN status USING (run_id) WHERE status = 'complete'
    AND run_id NOT IN (SELECT run_id FROM scores WHERE failed_gates <> '')""")
def _(i):
    status = S.run_status(i.run_rows, _planned(i), ["run_id"])
    return S.qualified_selection(_run_scores(i, S.PREGATE_V3), status, ["run_id"], True)


@query("error_details", """
    SELECT fixture_id, CASE WHEN limitation LIKE 'embedding %' THEN limitation ELSE 'execution error without a specific diagnostic' END
      AS message, count(*) AS rows FROM result_rows WHERE reason = 'execution_error' GROUP BY 1, 2""")
def _(i):
    return S.error_details(i.result_rows.withColumn("limitations", F.array(F.lit("limit.memory"), "limitation")))


@query("attack_envelope", """
    SELECT coalesce(attack, 'TOTAL') AS attack, count(*) FILTER (positive) AS positives,
      count(*) FILTER (positive AND decoded_matches_expected AND attributed_quorum2) AS quorum2_hits,
      count(*) FILTER (positive AND decoded_matches_expected AND attributed_quorum1) AS quorum1_hits,
      count(*) FILTER (NOT positive AND attributed_quorum2) AS quorum2_false,
      count(*) FILTER (NOT positive AND attributed_quorum1) AS quorum1_false,
      round(count(*) FILTER (positive AND decoded_matches_expected AND attributed_quorum2) / count(*) FILTER (positive), 6) AS quorum2_rate,
      round(count(*) FILTER (positive AND decoded_matches_expected AND attributed_quorum1) / count(*) FILTER (positive), 6) AS quorum1_rate
    FROM envelope_rows GROUP BY ROLLUP (attack) HAVING count(*) FILTER (positive) > 0""")
def _(i):
    return r6(S.attack_envelope(i.envelope_rows), "quorum2_rate", "quorum1_rate")


@query("undecided_breakdown", """
    SELECT attack, decode_status, count(*) AS rows FROM envelope_rows
    WHERE positive AND NOT (attributed_quorum1 AND decoded_matches_expected) GROUP BY 1, 2""")
def _(i):
    return S.undecided_breakdown(i.envelope_rows)


@query("variant_matrix", """
    SELECT variant, count(*) FILTER (attack = 'atk0' AND matched) AS atk0_correct, count(*) FILTER (attack = 'atk0') AS atk0_total,
           count(*) FILTER (attack = 'atk7' AND matched) AS atk7_correct, count(*) FILTER (attack = 'atk7') AS atk7_total,
           round(min(psnr_db), 6) AS minimum_psnr_db, round(min(ssim), 6) AS minimum_ssim FROM envelope_rows GROUP BY 1""")
def _(i):
    return r6(S.variant_matrix(i.envelope_rows, ["atk0", "atk7"]), "minimum_psnr_db", "minimum_ssim")


@query("variant_failures", """
    SELECT variant, fixture_id, page_index, string_agg(entry, ', ' ORDER BY entry) AS failures FROM (
      SELECT DISTINCT variant, fixture_id, page_index, concat(attack, '(votes=', CAST(valid_vote_count AS STRING), ')') AS entry
      FROM envelope_rows WHERE NOT matched) GROUP BY 1, 2, 3""")
def _(i):
    return S.variant_failures(i.envelope_rows)


@query("probe_hits", "SELECT attack, variant, count(*) FILTER (matched) AS hits, count(*) AS total FROM envelope_rows GROUP BY 1, 2")
def _(i):
    return S.probe_hits(i.envelope_rows)


def _tamper(i):
    return i.tamper_rows.withColumn("limitations", F.array_compact(F.array("limitation")))


TAMPER = """
    SELECT coalesce(tamper_id, 'TOTAL') AS tamper_id, count(*) AS scheduled_cases,
      round(avg(CASE WHEN limitation IS NOT NULL OR failure IS NOT NULL THEN 0 ELSE measured_iou END), 6) AS aggregate_iou,
      count(failure) AS failed_cases, count(limitation) AS limited_cases FROM tamper_rows GROUP BY ROLLUP (tamper_id)"""


@query("tamper_summary", TAMPER)
def _(i):
    return r6(S.tamper_summary(_tamper(i)), "aggregate_iou")


@query("tamper_lines", f"""
    SELECT tamper_id, concat('| `', tamper_id, '` | ', CAST(scheduled_cases AS STRING), ' | ', printf('%.6f', aggregate_iou), ' | ',
      CAST(failed_cases AS STRING), ' | ', CAST(limited_cases AS STRING), ' |') AS line FROM ({TAMPER}) WHERE tamper_id <> 'TOTAL'""")
def _(i):
    return S.tamper_lines(S.tamper_summary(_tamper(i)))


@query("limitation_counts", """
    SELECT limitation, count(*) AS cases FROM tamper_rows WHERE limitation IS NOT NULL GROUP BY 1""")
def _(i):
    return S.limitation_counts(_tamper(i))


@query("timing_distribution", """
    SELECT attack_id, count(elapsed_ms) AS n, round(avg(elapsed_ms), 6) AS mean, min(elapsed_ms) AS minimum, max(elapsed_ms) AS maximum,
      round(quantile_cont(elapsed_ms, 0.5), 6) AS median, round(quantile_cont(elapsed_ms, 0.95), 6) AS p95 FROM result_rows GROUP BY 1""")
def _(i):
    return r6(S.timing_distribution(i.result_rows, ["attack_id"], "elapsed_ms"), "mean", "median", "p95")


@query("population_counts", """
    WITH p AS (SELECT candidate_id, fixture_id, page_index, bool_or(fixture_kind <> 'negative_external') AS pos, count(*) AS n
               FROM result_rows GROUP BY 1, 2, 3)
    SELECT candidate_id, count(*) FILTER (pos) AS positive_pages, count(*) FILTER (NOT pos) AS negative_pages,
           CAST(sum(n) AS BIGINT) AS scheduled_rows FROM p GROUP BY 1""")
def _(i):
    return S.population_counts(i.result_rows)


@query("population_equal", """
    WITH o AS (SELECT row_id, count(*) AS n FROM observed_rows GROUP BY 1)
    SELECT coalesce(o.row_id, p.row_id) AS row_id,
           CASE WHEN n IS NULL THEN 'missing' WHEN p.row_id IS NULL THEN 'unexpected' ELSE 'duplicate' END AS code
    FROM o FULL JOIN (SELECT DISTINCT row_id FROM planned_rows) p ON o.row_id = p.row_id
    WHERE n IS NULL OR p.row_id IS NULL OR n > 1""")
def _(i):
    return S.population_equal(i.observed_rows, i.planned_rows, "row_id")


FAILED = """
    bad AS (SELECT DISTINCT fixture_id, page_index, attack_id FROM result_rows
          WHERE expected_id IS NOT NULL AND decoded_id IS DISTINCT FROM expected_id)"""
PAGE_ROWS = """
    page_rows AS (SELECT concat(fixture_id, '/', profile_id, '/', substr(row_id, 1, 3)) AS fixture_id, page_index, attack_id,
                  expected_id, decoded_id FROM result_rows),"""


def _pages(i):
    # A finer page identity than the seven fixtures, so that pages differ in the attacks they fail.
    return i.result_rows.withColumn("fixture_id", F.concat_ws("/", "fixture_id", "profile_id", F.substring("row_id", 1, 3)))


@query("shared_failures", "WITH" + PAGE_ROWS + FAILED.replace("result_rows", "page_rows") + """
    SELECT fixture_id, page_index FROM bad WHERE attack_id = 'jpeg-q70'
    INTERSECT SELECT fixture_id, page_index FROM bad WHERE attack_id = 'crop-f0p25'""")
def _(i):
    return S.shared_failures(_pages(i), ["jpeg-q70", "crop-f0p25"])


@query("failures_beyond_baseline", "WITH" + PAGE_ROWS + FAILED.replace("result_rows", "page_rows") + """,
    base AS (SELECT fixture_id, page_index FROM bad WHERE attack_id = 'identity'),
    other AS (SELECT * FROM bad WHERE attack_id <> 'identity')
    SELECT attack_id, count(*) AS failing_pages, count(*) FILTER (b.fixture_id IS NULL) AS beyond_baseline,
      count(*) FILTER (b.fixture_id IS NULL) = 0 AND count(*) = (SELECT count(*) FROM base) AS same_pages
    FROM other o LEFT JOIN base b ON o.fixture_id = b.fixture_id AND o.page_index = b.page_index GROUP BY 1""")
def _(i):
    return S.failures_beyond_baseline(_pages(i), ["jpeg-q70", "resize-s0p75", "crop-f0p25"])


@query("schedule_diff", """
    WITH o AS (SELECT fixture_id, page_index, profile_id, attack_id, count(*) AS n, list(row_id) AS rids, list(candidate_id) AS cids,
                 count(expected_id) AS truths, min(expected_id) AS t0, max(expected_id) AS t1, min(row_id) AS r0, max(row_id) AS r1,
                 min(candidate_id) AS c0, max(candidate_id) AS c1 FROM observed_rows GROUP BY 1, 2, 3, 4),
    j AS (SELECT coalesce(o.fixture_id, p.fixture_id) AS fixture_id, coalesce(o.page_index, p.page_index) AS page_index,
            coalesce(o.profile_id, p.profile_id) AS profile_id, coalesce(o.attack_id, p.attack_id) AS attack_id,
            o.n, o.n IS NOT NULL AND p.row_id IS NOT NULL AS paired, p.row_id IS NULL AS stray, r0, r1, c0, c1, t0, t1, truths,
            p.row_id, p.candidate_id, p.expected_id
          FROM o FULL JOIN planned_rows p ON o.fixture_id = p.fixture_id AND o.page_index = p.page_index
            AND o.profile_id = p.profile_id AND o.attack_id = p.attack_id)
    SELECT fixture_id, page_index, profile_id, attack_id, NULL AS row_id, 'missing' AS code FROM j WHERE n IS NULL
    UNION ALL SELECT fixture_id, page_index, profile_id, attack_id, NULL, 'unexpected' FROM j WHERE stray
    UNION ALL SELECT fixture_id, page_index, profile_id, attack_id, NULL, 'duplicate_key' FROM j WHERE n > 1
    UNION ALL SELECT fixture_id, page_index, profile_id, attack_id, NULL, 'id_mismatch' FROM j WHERE paired AND (r0 <> row_id OR r1 <> row_id)
    UNION ALL SELECT fixture_id, page_index, profile_id, attack_id, NULL, 'provenance_mismatch' FROM j
      WHERE paired AND (c0 <> candidate_id OR c1 <> candidate_id)
    UNION ALL SELECT fixture_id, page_index, profile_id, attack_id, NULL, 'truth_mismatch' FROM j
      WHERE paired AND (truths < n OR t0 <> expected_id OR t1 <> expected_id)
    UNION ALL SELECT NULL, NULL, NULL, NULL, row_id, 'duplicate_id' FROM observed_rows GROUP BY row_id HAVING count(*) > 1""")
def _(i):
    return S.schedule_diff(i.planned_rows, i.observed_rows)


CONTRACT = {"schema_version": 1, "corpus_contract_sha256": "corpus", "profile_contract_sha256": "profiles", "attack_matrix_sha256": "attacks",
            "benchmark_plan_sha256": "plan", "seed": 20260827}
AUDITED = ("candidate_id", "fixture_kind", "attack_kind", "attack_parameters")


@query("row_audit", f"""
    WITH j AS (SELECT r.*, p.candidate_id IS NOT NULL AS due, p.remaining_tiles AS n, {", ".join(f"p.{c} AS p_{c}" for c in AUDITED)}
      FROM audited_rows r LEFT JOIN audit_plan p USING (fixture_id, page_index, profile_id, attack_id)),
    e AS (SELECT *, n IS NOT NULL AND reason <> 'execution_error' AS cropped FROM j)
    SELECT row_id, 'unplanned' AS code FROM e WHERE NOT due
    {" ".join(f"UNION ALL SELECT row_id, '{c}_mismatch' FROM e WHERE {c} IS DISTINCT FROM {repr(v)}" for c, v in CONTRACT.items())}
    {" ".join(f"UNION ALL SELECT row_id, '{c}_mismatch' FROM e WHERE due AND {c} IS DISTINCT FROM p_{c}" for c in AUDITED)}
    UNION ALL SELECT row_id, 'reason_invalid' FROM e WHERE reason NOT IN ('decoded', 'not_detected', 'partial', 'invalid_crc', 'execution_error')
    UNION ALL SELECT row_id, 'remaining_invalid' FROM e WHERE remaining_embedded_tiles < 0
    UNION ALL SELECT row_id, 'eligibility_mismatch' FROM e WHERE due AND (eligible <> (NOT cropped OR n >= 2)
      OR remaining_embedded_tiles IS DISTINCT FROM CASE WHEN cropped THEN n END
      OR eligibility_reason <> CASE WHEN NOT cropped THEN 'eligible' WHEN n >= 2 THEN 'at_least_two_complete_embedded_tiles_remain'
         ELSE 'fewer_than_two_complete_embedded_tiles_remain' END)""")
def _(i):
    return S.row_audit(i.audited_rows, i.audit_plan, CONTRACT)


@query("resume_plan", "SELECT row_id FROM planned_rows p WHERE NOT EXISTS (SELECT 1 FROM observed_rows o WHERE o.row_id = p.row_id)")
def _(i):
    return S.resume_plan(i.planned_rows, i.observed_rows).select("row_id")


@query("select_candidates", """
    WITH grid AS (SELECT DISTINCT candidate_id FROM planned_rows), chosen AS (SELECT DISTINCT candidate_id FROM observed_rows)
    SELECT c.candidate_id, CASE WHEN g.candidate_id IS NULL THEN 'unknown_candidate' END AS error_code
    FROM chosen c LEFT JOIN grid g ON c.candidate_id = g.candidate_id""")
def _(i):
    return S.select_candidates(i.planned_rows.select("candidate_id").distinct(), i.observed_rows)


@query("run_field_diff", """
    WITH b AS (SELECT * REPLACE (CASE WHEN l_tax > 0.075 THEN 'X' ELSE l_returnflag END AS l_returnflag,
                                 CASE WHEN l_discount > 0.095 THEN NULL ELSE l_linestatus END AS l_linestatus) FROM
        (SELECT l_orderkey, l_partkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus,
                min(l_tax) AS l_tax, min(l_discount) AS l_discount FROM lineitem GROUP BY 1, 2, 3) WHERE l_tax < 0.079 OR l_discount < 0.05)
    , a AS (SELECT l_orderkey, l_partkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus
            FROM lineitem GROUP BY 1, 2, 3),
    j AS (SELECT concat(a.l_orderkey, '-', a.l_linenumber, '-', a.l_partkey) AS row_id, b.l_orderkey IS NULL AS gone,
            a.l_returnflag IS DISTINCT FROM b.l_returnflag AS d1, a.l_linestatus IS DISTINCT FROM b.l_linestatus AS d2
          FROM a LEFT JOIN b USING (l_orderkey, l_partkey, l_linenumber))
    SELECT row_id, 'row' AS field FROM j WHERE gone
    UNION ALL SELECT row_id, 'flag' FROM j WHERE NOT gone AND d1 UNION ALL SELECT row_id, 'state' FROM j WHERE NOT gone AND d2""")
def _(i):
    rows = i.table("lineitem").groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(
        F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("state"), F.min("l_tax").alias("tax"),
        F.min("l_discount").alias("discount")).withColumn("row_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    first = rows.select("row_id", "flag", "state", F.col("tax").alias("elapsed_ms"))
    second = rows.filter("tax < 0.079 OR discount < 0.05").select(
        "row_id", F.when(F.col("tax") > 0.075, "X").otherwise(F.col("flag")).alias("flag"),
        F.when(F.col("discount") > 0.095, None).otherwise(F.col("state")).alias("state"), (F.col("tax") + 1).alias("elapsed_ms"))
    return S.run_field_diff(first, second)


@query("score_lines", score_sql("result_rows", ["profile_id"], S.PROFILE_V1, "mean", S.PROFILE_V1.quality_gates, 12) + """
    SELECT profile_id, concat('| `', profile_id, '` | `', candidate_id, '` | ', false_attribution, ' / ', scheduled_rows, ' | ',
      execution_errors, ' / ', scheduled_rows, ' | ',
      jpeg70_true_attribution, ' / ', jpeg70_denominator, ' (', printf('%.6f', jpeg70_true_attribution / jpeg70_denominator), ') | ',
      resize075_true_attribution, ' / ', resize075_denominator, ' (', printf('%.6f', resize075_true_attribution / resize075_denominator), ') | ',
      crop025_true_attribution, ' / ', crop025_denominator, ' (', printf('%.6f', crop025_true_attribution / crop025_denominator), ') | ',
      printf('%.6f', mean_psnr_db), ' | ', printf('%.9f', mean_ssim), ' | ', printf('%.6f', processing_ms_per_page), ' | ',
      CASE WHEN failed_gates = '' THEN 'none' ELSE replace(failed_gates, ',', ', ') END, ' |') AS line FROM scores""")
def _(i):
    return S.score_lines(S.profile_scores(i.result_rows, S.PROFILE_V1))


@query("psnr", """
    SELECT pair_id, round(10 * log10(1.0 / (list_sum(list_transform(list_zip(a, b), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE))
      * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)))) / len(a))), 6) AS psnr_db FROM vectors""")
def _(i):
    return r6(S.psnr(i.vectors, data_range=1.0), "psnr_db").select("pair_id", "psnr_db")
