"""Queries that reduce votes to decisions."""

from copytrail.catalog import query
from copytrail.catalog.tracing import r6
from copytrail.operators import voting as V

REPETITIONS = {"c0": 3, "c1": 5}
REP = "CASE candidate_id WHEN 'c0' THEN 3 ELSE 5 END"


@query("soft_vote", """
    WITH t AS (SELECT subject_id, candidate_id, tile_ordinal, count(DISTINCT row(reason, issuance_id, bit_error_rate)) AS variants,
                 min(row(reason, coalesce(issuance_id, ''), bit_error_rate)) AS v FROM votes GROUP BY 1, 2, 3),
    t2 AS (SELECT subject_id, candidate_id, variants > 1 AS conflict, v[1] AS reason, nullif(v[2], '') AS id, v[3] AS ber FROM t),
    total AS (SELECT subject_id, candidate_id, count(*) AS n FROM t2 GROUP BY 1, 2),
    g AS (SELECT t2.subject_id, t2.candidate_id, id, count(*) AS votes, count(*) / any_value(total.n) AS support, sum(ber) AS e
          FROM t2 JOIN total USING (subject_id, candidate_id) WHERE reason = 'decoded' AND id IS NOT NULL GROUP BY 1, 2, 3),
    best AS (SELECT subject_id, max(row(support, votes, e, candidate_id)) AS b FROM g GROUP BY 1),
    fit AS (SELECT subject_id, min(id) AS lo, max(id) AS hi, max(support) AS fs, max(votes) AS fm, CAST(sum(votes) AS BIGINT) AS fv,
                   sum(e) AS fe FROM g WHERE votes >= 2 AND support >= 0.60 GROUP BY 1),
    s AS (SELECT subject_id, bool_or(conflict) AS conflict, bool_or(reason = 'invalid_crc') AS crc FROM t2 GROUP BY 1),
    d AS (SELECT *, CASE WHEN conflict THEN 'conflicting_duplicate' WHEN b IS NULL AND crc THEN 'invalid_crc' WHEN b IS NULL THEN 'not_detected'
                 WHEN lo = hi THEN 'decoded' ELSE 'partial' END AS why
          FROM s LEFT JOIN best USING (subject_id) LEFT JOIN fit USING (subject_id))
    SELECT subject_id, CASE WHEN why = 'decoded' THEN lo END AS issuance_id,
      round(CASE WHEN conflict THEN NULL WHEN b IS NULL THEN 0 WHEN lo IS NULL THEN b[1] ELSE fs END, 6) AS confidence,
      CASE WHEN conflict THEN NULL WHEN b IS NULL THEN 0 WHEN lo IS NULL THEN b[2] WHEN lo = hi THEN fv ELSE fm END AS valid_votes,
      round(CASE WHEN conflict OR b IS NULL THEN NULL WHEN lo IS NULL THEN b[3] / b[2] WHEN lo = hi THEN fe / fv END, 6) AS bit_error_rate,
      why AS reason FROM d""")
def _(i):
    return r6(V.soft_vote(i.votes), "confidence", "bit_error_rate")


SILENT = """
    SELECT s.subject_id, CASE WHEN status = 'decoded' THEN id END AS issuance_id, round(coalesce(support, 0.25), 6) AS confidence,
      coalesce(n, 0) AS valid_votes, round(e / n, 6) AS bit_error_rate, coalesce(status, 'payload_not_detected') AS status
    FROM (SELECT DISTINCT subject_id FROM votes) s LEFT JOIN d USING (subject_id)"""


@query("payload_votes_v2", f"""
    WITH t AS (SELECT subject_id, candidate_id, tile_ordinal, count(DISTINCT row(issuance_id, bit_error_rate)) AS variants,
                 min(row(issuance_id, bit_error_rate)) AS v FROM votes WHERE reason = 'decoded' GROUP BY 1, 2, 3),
    t2 AS (SELECT subject_id, candidate_id, variants > 1 AS conflict, v[1] AS id, v[2] AS ber FROM t),
    g AS (SELECT subject_id, candidate_id, id, count(*) AS n, count(*) / {REP} AS support, sum(ber) AS e FROM t2 GROUP BY 1, 2, 3),
    m AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY support DESC, n DESC, candidate_id DESC, id DESC) AS rn,
            count(*) OVER (PARTITION BY subject_id) AS k, min(id) OVER (PARTITION BY subject_id) AS lo, max(id) OVER (PARTITION BY subject_id) AS hi FROM g),
    c AS (SELECT subject_id, bool_or(conflict) AS conflict FROM t2 GROUP BY 1),
    d AS (SELECT m.*, CASE WHEN conflict THEN 'conflicting_duplicate' WHEN lo <> hi THEN 'partial_payload_evidence'
            WHEN n >= 2 AND support >= 0.60 THEN 'decoded' ELSE 'partial_payload_evidence' END AS status
          FROM m JOIN c USING (subject_id) WHERE rn = 1) {SILENT}""")
def _(i):
    return r6(V.payload_votes_v2(i.votes, REPETITIONS, 0.25), "confidence", "bit_error_rate")


@query("payload_votes_v3", f"""
    WITH t AS (SELECT subject_id, candidate_id, issuance_id AS id, tile_ordinal,
                 first(bit_error_rate ORDER BY observed_at, bit_error_rate) AS ber
               FROM votes WHERE reason = 'decoded' GROUP BY 1, 2, 3, 4),
    g AS (SELECT subject_id, candidate_id, id, count(*) AS n, count(*) / {REP} AS support, sum(ber) AS e FROM t GROUP BY 1, 2, 3),
    m AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY support DESC, n DESC, candidate_id DESC, id DESC) AS rn,
            min(id) OVER (PARTITION BY subject_id) AS lo, max(id) OVER (PARTITION BY subject_id) AS hi FROM g),
    d AS (SELECT *, CASE WHEN lo <> hi THEN 'conflicting_payload_evidence' WHEN n >= 2 AND support >= 0.60 THEN 'decoded'
                         ELSE 'partial_payload_evidence' END AS status FROM m WHERE rn = 1) {SILENT}""")
def _(i):
    votes = V.payload_votes_v3(i.votes, REPETITIONS, ["observed_at", "bit_error_rate"], 0.25)
    return r6(votes, "confidence", "bit_error_rate")


REGIONS = """
    r AS (SELECT page_id, region_index, count(*) FILTER (confidence >= 0.2 AND is_match) AS m,
            count(*) FILTER (confidence >= 0.2 AND NOT is_match) AS x, sum(confidence) AS c, count(confidence) AS k
          FROM replica_votes GROUP BY 1, 2),
    v AS (SELECT *, CASE WHEN m >= 2 THEN 'match' WHEN x >= 2 THEN 'mismatch' ELSE 'indeterminate' END AS verdict FROM r),
    p AS (SELECT page_id, count(*) AS n, count(*) FILTER (verdict = 'match') AS good, count(*) FILTER (verdict = 'mismatch') AS bad,
            count(*) FILTER (verdict = 'indeterminate') AS open, sum(c) / sum(k) AS conf FROM v GROUP BY 1),
    l AS (SELECT *, CASE WHEN n < 4 THEN 'integrity.insufficient_complete_regions' WHEN open * 2 >= n THEN 'integrity.indeterminate'
            WHEN bad / n >= 0.25 AND conf >= 0.85 THEN 'integrity.geometry_failure'
            WHEN bad / n >= 0.10 AND conf < 0.85 THEN 'integrity.strong_compression' END AS limitation FROM p)"""


def _replicas(i):
    # Lines of 64 neighbouring orders form one page of 56 regions, so that regions collect several replica votes.
    return i.replica_votes.selectExpr("page_id div 64 AS page_id", "region_index + 7 * (page_id % 8) AS region_index",
                                      "replica", "is_match", "confidence")


@query("integrity_decision", "WITH pages8 AS (SELECT page_id // 64 AS page_id, region_index + 7 * (page_id % 8) AS region_index, is_match, confidence FROM replica_votes),"
       + REGIONS.replace("replica_votes", "pages8") + """
    SELECT page_id, CASE WHEN n < 4 THEN 0 ELSE n END AS evaluated_regions, round(CASE WHEN n < 4 THEN 0 ELSE good / n END, 6) AS score,
           limitation, CASE WHEN limitation IS NULL THEN bad ELSE 0 END AS suspicious_regions FROM l""")
def _(i):
    return r6(V.integrity_decision(_replicas(i)), "score")


@query("suspicious_regions", "WITH pages8 AS (SELECT page_id // 64 AS page_id, region_index + 7 * (page_id % 8) AS region_index, is_match, confidence FROM replica_votes),"
       + REGIONS.replace("replica_votes", "pages8") + """
    SELECT v.page_id, v.region_index FROM v JOIN l USING (page_id) WHERE v.verdict = 'mismatch' AND l.limitation IS NULL""")
def _(i):
    return V.suspicious_regions(_replicas(i))
