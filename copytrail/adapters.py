"""Views that shape the driver's tables into the engine's input schemas.

Each view is plain SQL that Spark and the checking database both accept, so that an operator and its
check start from the same rows. ``{name}`` marks a source table; ``SHA256(x)`` is spelled per engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def uuid_sql(expr: str) -> str:
    """Lower-case canonical id text from a hex digest."""
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return "concat(" + ", '-', ".join(f"substr({expr}, {a}, {n})" for a, n in cuts) + ")"


VIEWS: dict[str, str] = {
    # --- tracing -------------------------------------------------------------------------------
    "registry": """
        SELECT concat('iss-', CAST(doc_id AS STRING)) AS issuance_id, lang AS organization_id,
               SHA256(text) AS output_sha256
        FROM {documents}""",
    "suspects": """
        SELECT concat('doc-', CAST(doc_id AS STRING)) AS suspect_id, lang AS organization_id,
               SHA256(text) AS input_sha256 FROM {documents}
        UNION ALL
        SELECT concat('bench-', CAST(item_id AS STRING)), 'en', SHA256(text) FROM {benchmark}
        UNION ALL
        SELECT concat('page-', CAST(page_id AS STRING)), 'en', SHA256(html) FROM {pages}
        UNION ALL
        SELECT concat('conv-', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)), 'en', SHA256(text)
        FROM {conversations}""",
    "suspect_decodes": """
        SELECT concat('conv-', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS suspect_id,
               CASE turn % 3 WHEN 0 THEN 'decoded' WHEN 1 THEN 'partial_payload_evidence'
                             ELSE 'payload_not_detected' END AS status,
               CASE WHEN turn % 3 = 0 THEN concat('iss-', CAST(conv_id AS STRING)) ELSE NULL END AS issuance_id
        FROM {conversations}
        UNION ALL
        SELECT concat('bench-', CAST(item_id AS STRING)), 'partial_payload_evidence', NULL FROM {benchmark}""",
    "issuances": """
        SELECT concat('iss-', CAST(doc_id AS STRING)) AS issuance_id, lang AS organization_id, doc_id AS document_id,
               concat('outputs/', lang, '/', CAST(doc_id AS STRING), '.pdf') AS output_object_key,
               SHA256(text) AS output_sha256,
               CASE WHEN doc_id % 17 = 0 THEN TIMESTAMP '2024-06-01 00:00:00' ELSE NULL END AS output_deleted_at,
               TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * doc_id AS issued_at
        FROM {documents}""",
    "issuance_results": """
        SELECT concat('iss-', CAST(doc_id AS STRING)) AS issuance_id,
               CASE WHEN doc_id % 37 = 0 THEN 'other' ELSE lang END AS organization_id,
               concat('job-', CAST(doc_id AS STRING)) AS job_id,
               CASE WHEN doc_id % 13 = 0 THEN 'cleaned' ELSE 'committed' END AS output_state,
               CAST(doc_id % 3 AS INT) AS attempt,
               concat('outputs/', lang, '/', CAST(doc_id AS STRING), CASE WHEN doc_id % 41 = 0 THEN '.png' ELSE '.pdf' END)
                 AS output_object_key,
               SHA256(text) AS output_sha256, CAST(1 + doc_id % 5 AS INT) AS page_count,
               CASE WHEN doc_id % 43 = 0 THEN 'unknown_label'
                    ELSE 'experimental_unreleased_fingerprint_v2' END AS algorithm_label
        FROM {documents} WHERE source <> 'src19'""",
    "issuance_jobs": """
        SELECT concat('job-', CAST(doc_id AS STRING)) AS job_id,
               CASE WHEN doc_id % 53 = 0 THEN 'other' ELSE lang END AS organization_id,
               concat('iss-', CAST(doc_id AS STRING)) AS issuance_id,
               CASE WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'succeeded' END AS status,
               CAST(CASE WHEN doc_id % 47 = 0 THEN 0 ELSE doc_id % 3 END AS INT) AS attempt
        FROM {documents}""",
    "source_documents": """
        SELECT doc_id AS document_id, lang AS organization_id,
               CAST(CASE WHEN doc_id % 29 = 0 THEN 9 ELSE 1 + doc_id % 5 END AS INT) AS page_count
        FROM {documents}""",
    "receipts": """
        SELECT concat('job-', CAST(doc_id AS STRING)) AS job_id, lang AS organization_id,
               CAST(CASE WHEN doc_id % 37 = 0 THEN 5 WHEN doc_id % 47 = 0 THEN 0 ELSE doc_id % 3 END AS INT) AS attempt
        FROM {documents} WHERE n_chars > 40""",
    "manifests": """
        SELECT concat('iss-', CAST(doc_id AS STRING)) AS issuance_id, lang AS organization_id,
               concat('key', CAST(doc_id % 120 AS STRING)) AS key_id,
               concat('key', CAST((CASE WHEN doc_id % 31 = 0 THEN doc_id + 1 ELSE doc_id END) % 120 AS STRING))
                 AS envelope_key_id,
               CASE WHEN doc_id % 61 = 0 THEN 'RS256' ELSE 'Ed25519' END AS algorithm,
               doc_id % 19 <> 0 AS signature_ok,
               concat('{"fingerprint_algorithm":"none","integrity_algorithm":"integrity_release_v1","issuance_id":"iss-',
                      CAST(doc_id AS STRING), '","issued_at":"2024-01-01T00:00:00Z","output_sha256":"',
                      CASE WHEN doc_id % 23 = 0 THEN 'zz' ELSE SHA256(text) END,
                      '","schema_version":1,"signing_key_id":"key', CAST(doc_id % 120 AS STRING), '"}') AS public_payload,
               TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' DAY * (doc_id % 400) AS checked_at
        FROM {documents} WHERE source <> 'src7'""",
    "signing_keys": """
        SELECT concat('key', CAST(s_suppkey AS STRING)) AS key_id,
               CASE s_nationkey % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'en' WHEN 2 THEN 'fr' WHEN 3 THEN 'de' ELSE 'es' END
                 AS organization_id,
               CASE WHEN s_suppkey % 5 = 4 THEN 'revoked' WHEN s_suppkey % 5 = 3 THEN 'verify_only' ELSE 'active' END
                 AS status,
               'Ed25519' AS algorithm,
               TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' DAY * (s_suppkey % 60) AS valid_from,
               CASE WHEN s_suppkey % 4 = 0 THEN NULL
                    ELSE TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' DAY * (s_suppkey % 60 + s_suppkey % 7 * 30) END
                 AS valid_until,
               CASE WHEN s_suppkey % 5 = 4 OR s_suppkey % 31 = 0
                    THEN TIMESTAMP '2024-02-15 00:00:00' ELSE NULL END AS revoked_at,
               CASE WHEN s_acctbal < 0 THEN '{"label":"primary","owner":"x"}' ELSE '{"label":"primary"}' END
                 AS metadata_json
        FROM {supplier}""",
    "page_decisions": """
        SELECT l_orderkey AS document_id, l_linenumber - 1 AS page_index,
               CASE WHEN l_returnflag = 'A' THEN 'decoded' WHEN l_discount > 0.085 THEN 'partial_payload_evidence'
                    WHEN l_linestatus = 'O' THEN 'payload_not_detected' WHEN l_tax > 0.06 THEN 'geometry_rejected'
                    ELSE 'insufficient_sync_evidence' END AS status,
               CASE WHEN l_returnflag = 'A' THEN concat('i', CAST(l_suppkey % 3 AS STRING)) ELSE NULL END AS issuance_id,
               l_discount * 10 AS confidence, CAST(FLOOR(l_quantity) AS INT) % 4 AS valid_votes
        FROM {lineitem}""",
    # --- benchmark -----------------------------------------------------------------------------
    "audit_plan": """
        SELECT DISTINCT concat('prof', CAST(l_partkey % 5 AS STRING)) AS profile_id, concat('fx', CAST(l_suppkey % 7 AS STRING)) AS fixture_id, l_linenumber - 1 AS page_index,
               CASE l_orderkey % 4 WHEN 0 THEN 'identity' WHEN 1 THEN 'jpeg-q70' WHEN 2 THEN 'resize-s0p75' ELSE 'crop-f0p25' END AS attack_id,
               concat('cand', CAST(l_partkey % 5 AS STRING)) AS candidate_id,
               CASE WHEN l_suppkey % 7 >= 5 THEN 'negative_external' ELSE 'clean_image' END AS fixture_kind,
               CASE l_orderkey % 4 WHEN 0 THEN 'identity' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'resize' ELSE 'crop' END AS attack_kind,
               CASE l_orderkey % 4 WHEN 1 THEN '{"quality":70}' WHEN 3 THEN '{"fraction":0.25}' ELSE '{}' END AS attack_parameters,
               CASE WHEN l_orderkey % 4 = 3 AND l_suppkey % 7 < 5 THEN CAST((l_linenumber + l_suppkey % 7) % 4 AS INT) END AS remaining_tiles
        FROM {lineitem} WHERE l_partkey % 5 < 4 OR l_suppkey % 7 > 0""",
    "audited_rows": """
        SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING)) AS row_id,
               concat('prof', CAST(l_partkey % 5 AS STRING)) AS profile_id, concat('fx', CAST(l_suppkey % 7 AS STRING)) AS fixture_id, l_linenumber - 1 AS page_index,
               CASE l_orderkey % 4 WHEN 0 THEN 'identity' WHEN 1 THEN 'jpeg-q70' WHEN 2 THEN 'resize-s0p75' ELSE 'crop-f0p25' END AS attack_id,
               CAST(CASE WHEN l_partkey % 41 = 0 THEN 2 ELSE 1 END AS INT) AS schema_version,
               CASE WHEN l_partkey % 43 = 0 THEN 'other' ELSE 'corpus' END AS corpus_contract_sha256,
               CASE WHEN l_partkey % 47 = 0 THEN NULL ELSE 'profiles' END AS profile_contract_sha256,
               CASE WHEN l_partkey % 53 = 0 THEN 'other' ELSE 'attacks' END AS attack_matrix_sha256,
               CASE WHEN l_partkey % 59 = 0 THEN 'other' ELSE 'plan' END AS benchmark_plan_sha256,
               CAST(CASE WHEN l_partkey % 61 = 0 THEN 1 ELSE 20260827 END AS BIGINT) AS seed,
               concat('cand', CAST(CASE WHEN l_partkey % 67 = 0 THEN l_partkey + 1 ELSE l_partkey END % 5 AS STRING)) AS candidate_id,
               CASE WHEN l_suppkey % 7 >= 5 AND l_partkey % 71 <> 0 THEN 'negative_external' ELSE 'clean_image' END AS fixture_kind,
               CASE l_orderkey % 4 WHEN 0 THEN 'identity' WHEN 1 THEN 'jpeg' WHEN 2 THEN CASE WHEN l_partkey % 73 = 0 THEN 'crop' ELSE 'resize' END ELSE 'crop' END AS attack_kind,
               CASE l_orderkey % 4 WHEN 1 THEN '{"quality":70}' WHEN 3 THEN CASE WHEN l_partkey % 79 = 0 THEN '{"fraction":0.5}' ELSE '{"fraction":0.25}' END ELSE '{}' END AS attack_parameters,
               CASE WHEN l_discount >= 0.095 THEN 'execution_error' WHEN l_partkey % 83 = 0 THEN 'guessed' WHEN l_tax > 0.07 THEN 'invalid_crc'
                    WHEN l_tax > 0.05 THEN 'not_detected' WHEN l_tax > 0.03 THEN 'partial' ELSE 'decoded' END AS reason,
               CASE WHEN l_orderkey % 4 = 3 AND l_suppkey % 7 < 5 AND l_discount < 0.095 AND l_partkey % 31 <> 0
                    THEN CAST(CASE WHEN l_partkey % 37 = 0 THEN -1 ELSE (l_linenumber + l_suppkey % 7) % 4 END AS INT) END AS remaining_embedded_tiles,
               NOT (l_orderkey % 4 = 3 AND l_suppkey % 7 < 5 AND l_discount < 0.095 AND (l_linenumber + l_suppkey % 7) % 4 < 2) AS eligible,
               CASE WHEN NOT (l_orderkey % 4 = 3 AND l_suppkey % 7 < 5 AND l_discount < 0.095) THEN 'eligible'
                    WHEN (l_linenumber + l_suppkey % 7) % 4 < 2 THEN 'fewer_than_two_complete_embedded_tiles_remain'
                    ELSE 'at_least_two_complete_embedded_tiles_remain' END AS eligibility_reason
        FROM {lineitem}""",
    # Closed-form geometry of a chain, which the evidence queries fold again from its steps.
    "evidence_plan": """
        SELECT plan_id, chain, page_height, page_width, has_truth, x, y, canvas_scale, canvas_shift, kept_w, kept_h, x0, y0,
               CASE WHEN chain IN (1, 3) THEN 0.8e0 ELSE 1.0e0 END * CASE WHEN chain >= 2 THEN page_width / kept_w ELSE 1.0e0 END AS sx,
               CASE WHEN chain >= 2 THEN (CASE WHEN chain = 3 THEN 0.1e0 ELSE 0.0e0 END - x0 / page_width) * page_width / kept_w WHEN chain = 1 THEN 0.1e0 ELSE 0.0e0 END AS ox,
               CASE WHEN chain >= 2 THEN page_height / kept_h ELSE 1.0e0 END AS sy, CASE WHEN chain >= 2 THEN (0 - y0) / kept_h ELSE 0.0e0 END AS oy,
               CASE WHEN chain >= 2 THEN 1 - kept_w * kept_h / (page_width * page_height) ELSE 0.0e0 END AS removed
        FROM (SELECT *, FLOOR((page_width - kept_w) / 2) * 1.0e0 AS x0, FLOOR((page_height - kept_h) / 2) * 1.0e0 AS y0
              FROM (SELECT *, FLOOR(page_width * SQRT(0.75e0) + 0.5e0) * 1.0e0 AS kept_w, FLOOR(page_height * SQRT(0.75e0) + 0.5e0) * 1.0e0 AS kept_h
                    FROM (SELECT o_orderkey AS plan_id, CAST(o_custkey % 4 AS INT) AS chain, 300.0e0 + o_orderkey % 7 * 10 AS page_height,
                                 200.0e0 + o_custkey % 9 * 10 AS page_width, o_orderkey % 11 <> 0 AS has_truth, (o_orderkey % 8) / 10.0e0 AS x, (o_custkey % 8) / 10.0e0 AS y,
                                 CASE WHEN o_orderkey % 3 = 0 THEN 0.9e0 ELSE 1.0e0 END AS canvas_scale, CASE WHEN o_orderkey % 3 = 0 THEN 0.05e0 ELSE 0.0e0 END AS canvas_shift
                          FROM {orders} WHERE o_orderkey % 13 <> 0) p) q) r""",
    "evidence_rows": """
        SELECT row_id, plan_id, chain, artifact_absent, CASE WHEN ran THEN CASE WHEN part % 29 = 0 THEN sx + 0.001e0 ELSE sx END END AS sx,
               ox, sy, oy, CASE WHEN part % 31 = 0 THEN l + 0.01e0 ELSE l END AS l, t, r, b, has_truth AND r > l AND b > t AS seen,
               (0.4e0 - x0 / page_width) * page_width / kept_w AS tl, (0.4e0 - y0 / page_height) * page_height / kept_h AS tt,
               0.2e0 * page_width / kept_w AS tw, 0.1e0 * page_height / kept_h AS th, ran AND chain = 3 AND part % 43 <> 0 AS marked,
               CASE WHEN part % 37 = 0 THEN removed - 0.01e0 WHEN part % 41 = 0 THEN NULL WHEN ran OR chain = 2 THEN removed END AS removed
        FROM (SELECT *, GREATEST(0.0e0, CASE WHEN ran THEN sx * (x * canvas_scale + canvas_shift) + ox ELSE x * canvas_scale + canvas_shift END) AS l,
                     GREATEST(0.0e0, CASE WHEN ran THEN sy * y + oy ELSE y END) AS t,
                     LEAST(1.0e0, CASE WHEN ran THEN sx * ((x + 0.2e0) * canvas_scale + canvas_shift) + ox ELSE (x + 0.2e0) * canvas_scale + canvas_shift END) AS r,
                     LEAST(1.0e0, CASE WHEN ran THEN sy * (y + 0.15e0) + oy ELSE y + 0.15e0 END) AS b
              FROM (SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING)) AS row_id, l_partkey AS part,
                           CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_suppkey % 5 = 0 END AS artifact_absent, l_suppkey % 5 <> 0 AS ran, l_orderkey
                    FROM {lineitem}) a
              LEFT JOIN (EVIDENCE_PLAN) p ON p.plan_id = a.l_orderkey) e""",
    "result_lines": """
        SELECT concat('{"row_id":', CASE WHEN l_partkey % 23 = 0 THEN CAST(l_orderkey AS STRING) ELSE concat('"', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '"') END,
               ',"page_index":', CAST(l_linenumber - 1 AS STRING), CASE WHEN l_partkey % 29 = 0 THEN '.5' ELSE '' END,
               CASE WHEN l_partkey % 31 = 0 THEN '' ELSE concat(',"eligible":', CASE WHEN l_partkey % 37 = 0 THEN '1' WHEN l_tax > 0.05 THEN 'true' ELSE 'false' END) END,
               ',"decoded_id":', CASE WHEN l_discount > 0.05 THEN 'null' ELSE '"i"' END, ',"ssim":', CASE WHEN l_partkey % 3 = 0 THEN '1' ELSE '0.97' END,
               ',"tamper_ground_truth":', CASE WHEN l_linenumber = 1 THEN '[]' ELSE concat('[{"x":0.25,"y":0,', CASE WHEN l_partkey % 41 = 0 THEN '"z":1,' WHEN l_partkey % 43 = 0 THEN '"x":0.5,' ELSE '' END,
                 '"width":0.5,"height":0.5}]') END, CASE WHEN l_partkey % 47 = 0 THEN ',"extra":[]' WHEN l_partkey % 53 = 0 THEN ',"page_index":1' ELSE '' END,
               CASE WHEN l_partkey % 59 = 0 THEN '' ELSE '}' END) AS value
        FROM {lineitem}""",
    "result_rows": """
        SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING))
                 AS row_id,
               concat('prof', CAST(l_partkey % 5 AS STRING)) AS profile_id,
               concat('cand', CAST(l_partkey % 5 AS STRING)) AS candidate_id,
               concat('fx', CAST(l_suppkey % 7 AS STRING)) AS fixture_id,
               l_linenumber - 1 AS page_index,
               CASE l_orderkey % 4 WHEN 0 THEN 'identity' WHEN 1 THEN 'jpeg-q70'
                                   WHEN 2 THEN 'resize-s0p75' ELSE 'crop-f0p25' END AS attack_id,
               CASE WHEN l_suppkey % 7 >= 5 THEN NULL
                    ELSE concat('id-', CAST(l_suppkey % 7 AS STRING), '-', CAST(l_linenumber AS STRING)) END AS expected_id,
               CASE WHEN CAST(FLOOR(l_quantity) AS INT) % 10 < 7 AND l_suppkey % 7 < 5 THEN
                      CASE WHEN l_discount >= 0.095 THEN 'id-other'
                           ELSE concat('id-', CAST(l_suppkey % 7 AS STRING), '-', CAST(l_linenumber AS STRING)) END
                    WHEN CAST(FLOOR(l_quantity) AS INT) % 10 = 0 AND l_discount >= 0.095 THEN 'id-other'
                    ELSE NULL END AS decoded_id,
               CASE WHEN CAST(FLOOR(l_quantity) AS INT) % 10 = 9 THEN 'execution_error'
                    WHEN CAST(FLOOR(l_quantity) AS INT) % 10 < 7 AND l_suppkey % 7 < 5 THEN 'decoded'
                    WHEN CAST(FLOOR(l_quantity) AS INT) % 10 = 0 AND l_discount >= 0.095 THEN 'decoded'
                    WHEN CAST(FLOOR(l_quantity) AS INT) % 10 = 8 THEN 'partial'
                    WHEN l_tax > 0.07 THEN 'invalid_crc' ELSE 'not_detected' END AS reason,
               l_tax < 0.055 AS eligible,
               36.0e0 + (l_partkey % 5 + l_suppkey % 7 + l_linenumber) % 8 AS psnr_db,
               0.93e0 + ((l_partkey % 5 + l_suppkey % 7 + l_linenumber) % 8) / 100.0e0 AS ssim,
               l_extendedprice / 100.0e0 AS elapsed_ms,
               CASE WHEN l_suppkey % 7 >= 5 THEN 'negative_external' ELSE 'clean_image' END AS fixture_kind,
               CASE WHEN CAST(FLOOR(l_quantity) AS INT) % 10 = 9 AND l_tax > 0.03 THEN 'embedding failed'
                    WHEN l_tax > 0.05 THEN 'limit.rss' ELSE 'limit.scope' END AS limitation
        FROM {lineitem}""",
    "run_rows": """
        SELECT concat('run', CAST(l_orderkey % 3 AS STRING)) AS run_id,
               concat('prof', CAST(l_partkey % 5 AS STRING)) AS profile_id,
               concat('cand', CAST(l_partkey % 5 AS STRING)) AS candidate_id,
               concat('fx', CAST(l_suppkey % 7 AS STRING)) AS fixture_id, l_linenumber - 1 AS page_index,
               CASE l_orderkey % 4 WHEN 0 THEN 'identity' WHEN 1 THEN 'jpeg-q70'
                                   WHEN 2 THEN 'resize-s0p75' ELSE 'crop-f0p25' END AS attack_id,
               CASE WHEN l_suppkey % 7 >= 5 THEN NULL
                    ELSE concat('id-', CAST(l_suppkey % 7 AS STRING), '-', CAST(l_linenumber AS STRING)) END AS expected_id,
               CASE WHEN l_suppkey % 7 >= 5 OR (l_orderkey % 3 = 0 AND l_partkey % 5 = 4 AND l_discount > 0.085)
                      OR (l_orderkey % 3 = 2 AND l_partkey % 5 = 0 AND l_quantity > 49) THEN NULL
                    ELSE concat('id-', CAST(l_suppkey % 7 AS STRING), '-', CAST(l_linenumber AS STRING)) END AS decoded_id,
               CASE WHEN l_orderkey % 3 = 2 AND l_partkey % 5 = 0 AND l_quantity > 49 THEN 'execution_error'
                    WHEN l_suppkey % 7 >= 5 OR (l_orderkey % 3 = 0 AND l_partkey % 5 = 4 AND l_discount > 0.085)
                      THEN 'not_detected' ELSE 'decoded' END AS reason,
               l_tax < 0.055 AS eligible,
               38.0e0 + (l_suppkey % 7 + l_linenumber) % 8 + (l_partkey % 5) / 10.0e0 AS psnr_db,
               0.95e0 + ((l_suppkey % 7 + l_linenumber) % 8) / 1000.0e0 + (l_partkey % 5) / 1000.0e0 AS ssim,
               l_extendedprice / 100.0e0 AS elapsed_ms
        FROM {lineitem}""",
    "planned_rows": """
        SELECT DISTINCT concat('fx', CAST(l_orderkey AS STRING)) AS fixture_id, l_linenumber - 1 AS page_index,
               concat('prof', CAST(l_partkey % 2 AS STRING)) AS profile_id,
               concat('atk', CAST(l_suppkey % 2 AS STRING)) AS attack_id,
               SHA256(concat('fx', CAST(l_orderkey AS STRING), chr(0), CAST(l_linenumber - 1 AS STRING), chr(0), 'prof',
                      CAST(l_partkey % 2 AS STRING), chr(0), 'atk', CAST(l_suppkey % 2 AS STRING))) AS row_id,
               concat('cand', CAST(l_partkey % 2 AS STRING)) AS candidate_id,
               concat('id-', CAST(l_orderkey AS STRING)) AS expected_id
        FROM {lineitem}""",
    "observed_rows": """
        SELECT concat('fx', CAST(l_orderkey AS STRING)) AS fixture_id,
               l_linenumber - 1 + CASE WHEN l_tax > 0.065 AND l_tax < 0.075 THEN 10 ELSE 0 END AS page_index,
               concat('prof', CAST(l_partkey % 2 AS STRING)) AS profile_id,
               concat('atk', CAST(l_suppkey % 2 AS STRING)) AS attack_id,
               SHA256(concat('fx', CAST(l_orderkey AS STRING), chr(0), CAST(l_linenumber - 1 AS STRING), chr(0), 'prof',
                      CAST(l_partkey % 2 AS STRING), chr(0), 'atk', CAST(l_suppkey % 2 AS STRING),
                      CASE WHEN l_discount > 0.095 THEN 'x' ELSE '' END)) AS row_id,
               concat('cand', CAST(l_partkey % 2 + CASE WHEN l_discount > 0.085 AND l_discount < 0.095 THEN 1 ELSE 0 END
                      AS STRING)) AS candidate_id,
               CASE WHEN l_discount > 0.075 AND l_discount < 0.085 THEN NULL
                    ELSE concat('id-', CAST(l_orderkey AS STRING)) END AS expected_id
        FROM {lineitem} WHERE l_tax < 0.075""",
    "envelope_rows": """
        SELECT l_orderkey AS row_key, concat('atk', CAST(l_suppkey % 13 AS STRING)) AS attack,
               l_linestatus = 'O' AS positive,
               CASE WHEN l_returnflag = 'R' THEN 'decoded' WHEN l_returnflag = 'A' THEN 'partial_payload_evidence'
                    ELSE 'payload_not_detected' END AS decode_status,
               l_returnflag = 'R' AS attributed_quorum2, l_returnflag = 'R' OR l_tax > 0.06 AS attributed_quorum1,
               l_discount < 0.08 AS decoded_matches_expected,
               CASE WHEN l_partkey % 2 = 0 THEN 'raw' ELSE 'stripped' END AS variant,
               l_returnflag = 'R' AND l_discount < 0.08 AS matched,
               CAST(FLOOR(l_quantity) AS INT) % 5 AS valid_vote_count,
               concat('fx', CAST(l_suppkey % 7 AS STRING)) AS fixture_id, l_linenumber - 1 AS page_index,
               40.0e0 + l_discount * 50 AS psnr_db, 0.95e0 + l_tax / 2 AS ssim
        FROM {lineitem}""",
    "tamper_rows": """
        SELECT l_orderkey AS case_key, concat('tamper-', CAST(l_suppkey % 4 AS STRING)) AS tamper_id,
               l_discount * 9 AS measured_iou,
               CASE WHEN l_returnflag = 'R' THEN 'integrity.strong_compression'
                    WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'integrity.indeterminate' ELSE NULL END AS limitation,
               CASE WHEN l_tax > 0.075 THEN 'RuntimeError: attack failed' ELSE NULL END AS failure
        FROM {lineitem}""",
    # --- votes ---------------------------------------------------------------------------------
    "votes": """
        SELECT l_orderkey AS subject_id, concat('c', CAST(l_suppkey % 2 AS STRING)) AS candidate_id,
               l_linenumber AS tile_ordinal,
               CASE WHEN l_returnflag = 'N' THEN NULL ELSE concat('i', CAST(l_partkey % 2 AS STRING)) END AS issuance_id,
               CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'invalid_crc'
                    WHEN l_returnflag = 'N' THEN 'not_detected' ELSE 'decoded' END AS reason,
               l_discount AS bit_error_rate, l_shipdate AS observed_at
        FROM {lineitem}""",
    "replica_votes": """
        SELECT l_orderkey AS page_id, l_linenumber AS region_index, CAST(l_partkey % 3 AS INT) AS replica,
               l_returnflag <> 'R' AS is_match, l_discount * 10 AS confidence
        FROM {lineitem}""",
    "rects": """
        SELECT l_orderkey AS case_id, CASE WHEN l_linestatus = 'O' THEN 'expected' ELSE 'predicted' END AS side,
               l_discount * 5 AS x, l_tax * 5 AS y, 0.1e0 + (l_partkey % 4) / 10.0e0 AS width,
               0.1e0 + (l_suppkey % 4) / 10.0e0 AS height
        FROM {lineitem}""",
    # --- jobs, uploads, access -----------------------------------------------------------------
    "jobs": """
        SELECT o_orderkey AS job_id, concat('org', CAST(o_custkey % 4 AS STRING)) AS organization_id,
               o_custkey AS owner_id,
               CASE WHEN o_orderkey % 2 = 0 THEN 'issuance' ELSE 'verification' END AS kind,
               CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderpriority < '3' THEN 'succeeded' ELSE 'failed' END
                    WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderpriority < '3' THEN 'queued' ELSE 'created' END
                    ELSE CASE WHEN o_orderpriority < '3' THEN 'processing' ELSE 'retryable_failed' END END AS status,
               CAST(o_orderkey % 4 AS INT) AS attempt, CAST(o_orderdate AS TIMESTAMP) AS created_at,
               CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' DAY * (o_custkey % 9) AS updated_at,
               CAST(o_orderdate AS TIMESTAMP) + INTERVAL '10' MINUTE AS deadline_at,
               CASE WHEN o_custkey % 6 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '5' MINUTE ELSE NULL END
                 AS cancel_requested_at,
               CASE WHEN o_orderkey % 2 = 0 THEN concat('iss-', CAST(o_orderkey AS STRING)) ELSE NULL END AS issuance_id,
               CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE concat('ver-', CAST(o_orderkey AS STRING)) END AS verification_id,
               CASE WHEN o_custkey % 5 = 0 THEN 'DEMO_JOB_DEADLINE_EXCEEDED' WHEN o_custkey % 5 = 1 THEN 'DEMO_PDF_INVALID'
                    WHEN o_custkey % 5 = 2 THEN 'SOMETHING_ELSE' ELSE NULL END AS safe_error_code
        FROM {orders}""",
    "job_owners": """
        SELECT l_orderkey AS job_id,
               CASE l_returnflag WHEN 'R' THEN 'cleanup_required' WHEN 'A' THEN 'committed'
                                 ELSE CASE WHEN l_linestatus = 'O' THEN 'reserved' ELSE 'uploading' END END AS state,
               CASE WHEN l_discount > 0.05 THEN 'DEMO_STALE_RECOVERY_FENCED' ELSE NULL END AS safe_error_code,
               l_tax < 0.06 AS replay_ok, l_linenumber AS sequence, l_partkey AS part
        FROM {lineitem}""",
    "job_history": """
        SELECT l_orderkey AS job_id, CAST(l_shipdate AS TIMESTAMP) AS changed_at, l_partkey AS change_id,
               CASE l_linenumber WHEN 1 THEN 'created' WHEN 2 THEN 'queued' WHEN 3 THEN 'processing'
                                 WHEN 4 THEN 'retryable_failed' WHEN 5 THEN 'queued' WHEN 6 THEN 'succeeded'
                                 ELSE 'cancelled' END AS status,
               CAST(FLOOR(l_quantity) AS INT) % 3 AS attempt
        FROM {lineitem}""",
    "related_jobs": """
        SELECT l_orderkey AS upload_id,
               CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'succeeded'
                                 ELSE CASE WHEN l_linestatus = 'O' AND l_tax > 0.05 THEN 'processing'
                                           ELSE 'cancelled' END END AS status,
               CAST(l_shipdate AS TIMESTAMP) AS updated_at
        FROM {lineitem}""",
    "uploads": """
        SELECT o_orderkey AS upload_id, concat('org', CAST(o_custkey % 4 AS STRING)) AS organization_id,
               o_custkey AS requested_by,
               CASE WHEN o_orderkey % 2 = 0 THEN 'issuance' ELSE 'verification' END AS purpose,
               CASE o_orderstatus WHEN 'F' THEN 'attached' WHEN 'O' THEN 'copying'
                                  ELSE CASE WHEN o_orderpriority < '3' THEN 'none' ELSE 'failed' END END AS promotion_status,
               CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE CAST(FLOOR(o_totalprice) AS BIGINT) END AS size_bytes,
               SHA256(CAST(o_orderkey AS STRING)) AS expected_sha256,
               CAST(o_orderdate AS TIMESTAMP) AS created_at,
               CAST(o_orderdate AS TIMESTAMP) + INTERVAL '15' MINUTE AS expires_at,
               CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' MINUTE END
                 AS finalized_at,
               CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' HOUR AS status_changed_at,
               CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE concat('k/', CAST(o_orderkey AS STRING)) END AS target_key,
               CASE WHEN o_custkey % 11 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '2' DAY ELSE NULL END AS deleted_at,
               CASE WHEN o_custkey % 3 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' DAY ELSE NULL END
                 AS orphan_deleted_at
        FROM {orders}""",
    "observed_objects": """
        SELECT l_orderkey AS upload_id, CAST(FLOOR(o.o_totalprice) AS BIGINT) + CASE WHEN l_tax > 0.075 THEN 1 ELSE 0 END
                 AS size_bytes,
               SHA256(CAST(CASE WHEN l_discount > 0.095 THEN l_orderkey + 1 ELSE l_orderkey END AS STRING)) AS sha256
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey WHERE l_linenumber = 1""",
    "actors": """
        SELECT c_custkey AS actor_id, concat('org', CAST(c_custkey % 4 AS STRING)) AS organization_id,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'administrator' WHEN 'BUILDING' THEN 'auditor'
                                 WHEN 'FURNITURE' THEN 'issuer' WHEN 'MACHINERY' THEN 'issuer' ELSE 'verifier' END AS role
        FROM {customer}""",
    "recipients": """
        SELECT concat('org', CAST(c_nationkey % 4 AS STRING)) AS organization_id,
               concat(CASE WHEN c_custkey % 2 = 0 THEN 'USER' ELSE ' user' END, CAST(c_custkey % 50 AS STRING),
                      '@example.org') AS email,
               CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS display_name, c_custkey AS ordinal
        FROM {customer}""",
    "audit": """
        SELECT event_id, concat('org', CAST(user_id % 4 AS STRING)) AS organization_id, user_id AS actor_id,
               event_type AS action, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS outcome,
               props AS metadata_json, CAST(ts AS TIMESTAMP) AS created_at, CAST(user_id AS STRING) AS target_id, value
        FROM {events}""",
    "hits": """
        SELECT CAST(user_id AS STRING) AS key, CAST(ts AS TIMESTAMP) AS ts, event_id FROM {events}""",
    "api_requests": """
        SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN user_id % 7 = 0 THEN NULL ELSE CAST(user_id AS STRING) END AS account_id,
               concat('10.0.0.', CAST(user_id % 40 AS STRING)) AS source_ip,
               CASE event_type WHEN 'purchase' THEN 'issuance_job' WHEN 'click' THEN 'verification_job' END AS job_kind
        FROM {events}""",
    "issuance_recipients": """
        SELECT concat('iss-', CAST(o_orderkey AS STRING)) AS issuance_id,
               concat('user', CAST(c_custkey AS STRING), '@example.org') AS recipient_email, c_name AS recipient_name
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "verification_states": """
        SELECT concat('ver-', CAST(o_orderkey AS STRING)) AS verification_id,
               CASE o_orderstatus WHEN 'F' THEN 'VERIFIED_INTACT' WHEN 'O' THEN 'NO_WATERMARK' ELSE 'PARTIAL_EVIDENCE' END
                 AS verification_status
        FROM {orders}""",
    "known_recipients": """
        SELECT concat('org', CAST(s_nationkey % 4 AS STRING)) AS organization_id,
               concat('user', CAST(s_suppkey % 50 AS STRING), '@Example.org') AS external_reference,
               max(CASE WHEN s_acctbal > 3000 THEN s_name ELSE ' ' END) AS display_name
        FROM {supplier} GROUP BY 1, 2""",
    "cancel_requests": """
        SELECT l_partkey AS request_id, l_linenumber AS line, l_orderkey AS job_id, l_suppkey AS actor_id,
               concat('org', CAST(o_custkey % 4 + CASE WHEN l_tax > 0.075 THEN 1 ELSE 0 END AS STRING)) AS organization_id,
               CASE l_returnflag WHEN 'R' THEN 'auditor' WHEN 'A' THEN 'administrator'
                                 ELSE CASE WHEN l_linestatus = 'O' THEN 'issuer' ELSE 'verifier' END END AS role,
               CASE WHEN l_returnflag = 'N' AND l_discount > 0.02 THEN o_custkey ELSE l_suppkey END AS as_owner,
               concat('corr-', CAST(l_partkey % 10 AS STRING)) AS correlation_id
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "cancel_audit": """
        SELECT concat('org', CAST(o_custkey % 4 AS STRING)) AS organization_id, l_suppkey AS actor_id,
               'job.cancel_requested' AS action, l_orderkey AS target_id,
               concat('corr-', CAST(l_partkey % 10 AS STRING)) AS correlation_id, 'succeeded' AS outcome
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_discount < 0.055""",
    "attempt_log": """
        SELECT l_orderkey AS target_id, CAST(l_shipdate AS TIMESTAMP) AS at, l_partkey AS attempt_key,
               l_discount < 0.085 AS owner_exists, l_tax < 0.065 AS eligible, l_quantity < 45 AS key_ok,
               l_returnflag <> 'R' AS storage_ok
        FROM {lineitem}""",
    "messages": """
        SELECT o_orderkey AS job_key, CASE WHEN o_custkey % 17 = 0 THEN '{"schema_version":1,"message_type":' ELSE
          concat('{"schema_version":', CASE WHEN o_custkey % 19 = 0 THEN '2' ELSE '1' END,
            ',"message_type":"', CASE WHEN o_orderkey % 2 = 0 THEN 'issuance.requested' ELSE 'verification.requested' END,
            '","message_id":"', CASE WHEN o_custkey % 23 = 0 THEN 'not-an-id' ELSE UUID_M END, '","job_id":"', UUID_J,
            '","attempt":', CAST(o_orderkey % 4 AS STRING),
            ',"issuance_id":', CASE WHEN o_orderkey % 2 = 0 OR o_custkey % 29 = 0 THEN concat('"', UUID_I, '"') ELSE 'null' END,
            ',"verification_id":', CASE WHEN o_orderkey % 2 = 0 THEN 'null' ELSE concat('"', UUID_V, '"') END,
            ',"input_object_key":"', CASE o_custkey % 13 WHEN 0 THEN 'https://x/y' WHEN 1 THEN '/abs/key' WHEN 2 THEN 'a/../b'
              WHEN 3 THEN 'a/b?sig=1' ELSE concat('inputs/', CAST(o_orderkey AS STRING), '.bin') END,
            '","input_sha256":"', CASE WHEN o_custkey % 7 = 0 THEN upper(SHA256(CAST(o_orderkey AS STRING)))
                                       ELSE SHA256(CAST(o_orderkey AS STRING)) END,
            '","deadline_at":"', replace(CAST(o_orderdate AS STRING), ' ', 'T'), CASE WHEN o_custkey % 11 = 0 THEN '' ELSE 'Z' END,
            '","correlation_id":"', UUID_C, '"', CASE WHEN o_custkey % 31 = 0 THEN ',"extra":1' WHEN o_custkey % 37 = 0 THEN ',"attempt":1' ELSE '' END, '}') END AS body,
          CAST(o_orderdate AS TIMESTAMP) AS received_at
        FROM {orders}""",
    "sources": """
        SELECT doc_id AS ordinal, concat('doc-', CAST(doc_id AS STRING)) AS fixture_id,
               CASE lang WHEN 'en' THEN 'clean_pdf' WHEN 'fr' THEN 'negative_external' WHEN 'de' THEN 'clean_image'
                         ELSE 'tamper_ground_truth' END AS kind,
               SHA256(text) AS sha256, CAST(1 + FLOOR(n_chars / 2000) AS INT) AS pages
        FROM {documents}""",
    "corpus_entries": """
        SELECT doc_id AS ordinal, concat('doc-', CAST(CASE WHEN doc_id % 97 = 0 AND doc_id > 0 THEN doc_id - 1 ELSE doc_id END AS STRING)) AS fixture_id,
               CASE WHEN doc_id % 29 = 0 THEN 'odd' WHEN lang = 'en' THEN 'clean_pdf' WHEN lang = 'fr' THEN 'negative_external' WHEN lang = 'de' THEN 'clean_image'
                    ELSE 'tamper_ground_truth' END AS kind,
               concat(CASE WHEN doc_id % 31 = 0 THEN '../' WHEN doc_id % 37 = 0 THEN '/' ELSE 'set/' END, CAST(doc_id AS STRING)) AS relative_path,
               CASE WHEN doc_id % 41 = 0 THEN md5(text) ELSE SHA256(text) END AS sha256, CAST(CASE WHEN doc_id % 43 = 0 THEN 0 ELSE 1 + FLOOR(n_chars / 2000) END AS INT) AS pages,
               doc_id % 3 > 0 AND lang NOT IN ('fr', 'de') AS region, (doc_id % 8) / 8.0e0 AS x
        FROM {documents}""",
    "small_sources": """
        SELECT item_id AS ordinal, concat('item-', CAST(item_id AS STRING)) AS fixture_id,
               CASE WHEN length(text) % 4 = 0 THEN 'negative_external' ELSE 'clean_image' END AS kind,
               SHA256(text) AS sha256, CAST(1 + FLOOR(length(text) / 400) AS INT) AS pages
        FROM {benchmark}""",
    "upload_intents": """
        SELECT l_orderkey AS intent_id, l_linenumber AS line, l_partkey AS part,
               CASE l_suppkey % 4 WHEN 0 THEN 'administrator' WHEN 1 THEN 'issuer' WHEN 2 THEN 'verifier' ELSE 'auditor' END AS role,
               CASE WHEN l_tax > 0.075 THEN 'other' WHEN l_partkey % 2 = 0 THEN 'issuance_input' ELSE 'verification_input' END AS kind,
               CASE WHEN l_discount > 0.095 THEN 'text/html' WHEN l_linenumber % 2 = 0 THEN 'application/pdf' ELSE 'image/png' END
                 AS content_type,
               CASE WHEN l_quantity > 48 THEN 0 ELSE CAST(FLOOR(l_extendedprice * 1000) AS BIGINT) + CAST(FLOOR(l_quantity) AS BIGINT) * 100000 END
                 AS size_bytes,
               CASE WHEN l_quantity < 3 THEN 'abc' ELSE SHA256(CAST(l_orderkey AS STRING)) END AS sha256
        FROM {lineitem}""",
    "file_names": """
        SELECT doc_id, concat(CASE doc_id % 5 WHEN 0 THEN concat('C:', chr(92), 'temp', chr(92)) WHEN 1 THEN 'dir/sub/' WHEN 2 THEN ' ..' WHEN 3 THEN ' "<x>|' ELSE '' END,
                 text, CASE doc_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '' WHEN 3 THEN '.' WHEN 4 THEN '.toolongext' ELSE '.jpg ' END)
                 AS name,
               substr(SHA256(CAST(doc_id AS STRING)), 1, 32) AS issuance_id,
               CASE doc_id % 3 WHEN 0 THEN 'outputs/a.png' WHEN 1 THEN 'outputs/a.pdf' ELSE NULL END AS object_key
        FROM {documents}""",
    "storage_keys": """
        SELECT o_orderkey AS object_key_id, CASE WHEN o_orderkey % 2 = 0 THEN 'issuance' ELSE 'verification' END AS purpose,
               UUID_O AS organization_id, UUID_I AS object_id,
               CASE o_custkey % 8
                 WHEN 0 THEN concat('uploads/orphan/', CASE WHEN o_orderkey % 2 = 0 THEN 'issuance' ELSE 'verification' END, '_input/', UUID_O, '/',
                                    replace(UUID_I, '-', ''), '.bin')
                 WHEN 1 THEN concat('inputs/', CASE WHEN o_orderkey % 3 = 0 THEN 'issuance' ELSE 'verification' END, '/', UUID_O, '/', UUID_I, '.bin')
                 WHEN 2 THEN concat('outputs/issuance/', UUID_O, '/', UUID_I, CASE WHEN o_orderkey % 3 = 0 THEN '.png' ELSE '.pdf' END)
                 WHEN 3 THEN concat('inputs/issuance/', UUID_O, '/', UUID_M, '.bin') WHEN 4 THEN concat('inputs/issuance/../', UUID_O, '.bin')
                 WHEN 5 THEN concat('outputs/issuance/', upper(UUID_O), '/', UUID_I, '.pdf') WHEN 6 THEN 'https://bucket/key'
                 ELSE concat('inputs/verification/', UUID_O, '/', UUID_I, '.bin') END AS key,
               concat('inputs/', CASE WHEN o_custkey % 5 = 0 THEN 'issuance' ELSE 'verification' END, '/', UUID_O, '/', UUID_I, '.bin') AS target_key,
               CASE o_custkey % 8 WHEN 0 THEN 'orphan' WHEN 2 THEN 'issuance_output' WHEN 7 THEN 'verification_input' ELSE 'stale_promotion' END
                 AS category
        FROM {orders}""",
    "audit_metadata": """
        SELECT event_id, concat('{"kind":', CASE user_id % 5 WHEN 0 THEN '"issuance_input"' WHEN 1 THEN '["a"]' WHEN 2 THEN 'null'
                 WHEN 3 THEN '"https://host/path"' ELSE '"//host/path"' END,
                 ',"Role":"x","role":"', event_type, '","object_size":', CAST(user_id AS STRING), ',"attempt":',
                 CASE WHEN user_id % 2 = 0 THEN 'true' ELSE '1' END, ',"status":"', repeat('s', CAST(user_id % 7 * 60 AS INT)),
                 '","secret":"token","extra":', props, '}') AS metadata_json
        FROM {events}""",
    "evidence": """
        SELECT l_orderkey AS evidence_id, l_linenumber AS line, l_partkey AS part,
               concat('{"algorithm_label":"', CASE l_partkey % 3 WHEN 0 THEN 'integrity_release_v1' WHEN 1 THEN
                 'experimental_unreleased_fingerprint_v2' ELSE 'secret_label' END, '","decode_status":"',
                 CASE l_returnflag WHEN 'R' THEN 'decoded' WHEN 'A' THEN 'cancelled' ELSE 'unknown' END, '","fingerprint_confidence":',
                 CASE WHEN l_tax > 0.065 THEN '1.5' WHEN l_tax > 0.055 THEN '"0.5"' ELSE CAST(l_discount AS STRING) END,
                 ',"integrity_score":', CASE WHEN l_linestatus = 'O' THEN 'null' ELSE CAST(l_tax AS STRING) END,
                 ',"valid_vote_count":', CAST(CAST(FLOOR(l_quantity) AS INT) % 5 - 1 AS STRING),
                 ',"exact_file_hash_match":', CASE l_returnflag WHEN 'R' THEN 'true' WHEN 'A' THEN 'false' ELSE 'null' END,
                 ',"suspicious_regions":[{"x":0.1,"y":0.2,"width":', CASE WHEN l_discount > 0.05 THEN '0' ELSE '0.25' END,
                 ',"height":0.5},{"x":0.5,"y":0.5,"width":0.1,"height":0.1', CASE WHEN l_tax > 0.045 THEN ',"z":1' ELSE '' END, '}]',
                 ',"limitations":["a.b","Bad Value","c_', l_linenumber, '"],"internal":"x"}') AS body,
               concat('{"processing_ms":', CAST(l_partkey AS STRING), ',"pages_processed":', CAST(CAST(FLOOR(l_quantity) AS INT) - 10 AS STRING),
                 ',"peak_rss_bytes":"many","other":5}') AS metrics
        FROM {lineitem}""",
    "manifest_rows": """
        SELECT o_orderkey AS manifest_id, CAST(CASE WHEN o_custkey % 11 = 0 THEN 2 ELSE 1 END AS INT) AS schema_version,
               UUID_I AS issuance_id, CASE WHEN o_custkey % 13 = 0 THEN upper(UUID_V) ELSE UUID_V END AS document_id,
               CASE WHEN o_custkey % 7 = 0 THEN 'recipient' ELSE UUID_M END AS recipient_id,
               concat(replace(CAST(o_orderdate AS STRING), ' ', 'T'), CASE o_custkey % 9 WHEN 0 THEN '' WHEN 1 THEN '.25Z' ELSE 'Z' END) AS issued_at,
               SHA256(CAST(o_orderkey AS STRING)) AS source_sha256,
               CASE WHEN o_custkey % 17 = 0 THEN 'ABC' ELSE SHA256(CAST(o_custkey AS STRING)) END AS output_sha256,
               CASE WHEN o_custkey % 19 = 0 THEN 'Bad Algorithm' ELSE 'none' END AS fingerprint_algorithm,
               'integrity_release_v1' AS integrity_algorithm,
               CASE WHEN o_custkey % 23 = 0 THEN '' ELSE concat('key', CAST(o_custkey AS STRING)) END AS signing_key_id,
               'policy-1' AS retention_policy_id
        FROM {orders}""",
    "measurements": """
        SELECT l_orderkey AS measure_id, l_linenumber AS line, l_partkey AS part,
               CASE WHEN l_suppkey % 7 >= 5 THEN 'negative_external' ELSE 'clean_image' END AS fixture_kind,
               CASE WHEN l_tax > 0.075 THEN 1.5e0 ELSE l_discount * 10 END AS confidence,
               CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_quantity > 48 THEN -0.1e0 ELSE l_discount END AS bit_error_rate,
               CASE WHEN l_returnflag = 'A' THEN 'Infinity' WHEN l_quantity < 3 THEN 'high' ELSE '41.5' END AS psnr_db,
               0.9e0 + l_tax AS ssim, CASE WHEN l_partkey % 11 = 0 THEN 65535.0e0 ELSE 255.0e0 END AS quality_data_range,
               CASE WHEN l_suppkey % 6 = 5 THEN 'negative_control_original_vs_unmodified' ELSE 'original_vs_watermarked_before_attack' END
                 AS quality_scope,
               l_extendedprice - 1000 AS elapsed_ms, CAST(CASE WHEN l_discount > 0.095 THEN 10 ELSE 0 END AS BIGINT) AS temp_peak_bytes,
               CASE WHEN l_linenumber = 7 THEN 'maybe' ELSE 'eligible' END AS eligibility_reason
        FROM {lineitem}""",
    "issue_requests": """
        SELECT c_custkey AS request_id, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'id' WHEN 2 THEN 'id' ELSE '' END AS recipient_id,
               CASE c_custkey % 4 WHEN 0 THEN concat(' ', c_name, '@example.org ') WHEN 1 THEN NULL WHEN 2 THEN 'x@example.org' ELSE '' END
                 AS recipient_email, concat(' ', c_name, ' ') AS recipient_name
        FROM {customer}""",
    "outbox": """
        SELECT o_orderkey AS job_key, UUID_J AS job_id, concat('org', CAST(o_custkey % 4 AS STRING)) AS organization_id,
               CAST(o_orderkey % 4 AS INT) AS attempt, UUID_M AS message_id,
               CASE WHEN o_orderkey % 2 = 0 THEN 'issuance' ELSE 'verification' END AS kind,
               CASE WHEN o_orderkey % 2 = 0 THEN UUID_I ELSE NULL END AS issuance_id,
               CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE UUID_V END AS verification_id,
               concat('inputs/', CAST(o_orderkey AS STRING), '.bin') AS input_object_key,
               CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE SHA256(CAST(o_orderkey AS STRING)) END AS input_sha256,
               concat(replace(CAST(o_orderdate AS STRING), ' ', 'T'), 'Z') AS deadline_text, UUID_C AS correlation_id
        FROM {orders}""",
    "outbox_events": """
        SELECT UUID_J AS job_id, concat('org', CAST((CASE WHEN o_custkey % 37 = 0 THEN o_custkey + 1 ELSE o_custkey END) % 4 AS STRING)) AS organization_id,
               CAST(o_orderkey % 4 AS INT) AS attempt, UUID_M AS message_id,
               concat(CASE WHEN o_orderkey % 2 = 0 THEN 'issuance' ELSE 'verification' END, '.requested') AS topic,
               CASE WHEN o_custkey % 41 = 0 THEN CAST(o_orderdate AS TIMESTAMP) ELSE NULL END AS published_at, m.body AS payload
        FROM {orders} JOIN (MESSAGES) m ON m.job_key = o_orderkey
        UNION ALL
        SELECT UUID_J, 'org0', 0, concat(UUID_M, '-2'), 'issuance.requested', NULL, '{}' FROM {orders} WHERE o_totalprice > 450000""",
    "page_sizes": """
        SELECT l_orderkey AS document_id, l_partkey AS page_index, l_linenumber AS line, CAST(l_extendedprice * 1500 AS BIGINT) AS document_bytes,
               l_linenumber * 8 AS document_pages,
               CAST(FLOOR(l_quantity * 100) AS BIGINT) AS width, CAST(FLOOR(l_extendedprice / 10) AS BIGINT) AS height
        FROM {lineitem}""",
    "vectors": """
        SELECT l.vec_id AS pair_id, l.embedding AS a, r.embedding AS b
        FROM {embeddings} l JOIN {embeddings} r ON r.vec_id = l.vec_id + 1""",
}
VIEWS["evidence_rows"] = VIEWS["evidence_rows"].replace("EVIDENCE_PLAN", VIEWS["evidence_plan"])
VIEWS["outbox_events"] = VIEWS["outbox_events"].replace("MESSAGES", VIEWS["messages"])
# The five ids of an order are digests; they are taken once per row and cut into id text above that.
_KEYED = "(SELECT *, " + ", ".join(f"md5(concat('{m}', CAST(o_orderkey AS STRING))) AS hash_{m.lower()}" for m in "MJIVC") + (
    ", md5(concat('org', CAST(o_custkey % 4 AS STRING))) AS hash_o FROM {orders}) keyed")
for _name in ("messages", "storage_keys", "manifest_rows", "outbox", "outbox_events"):
    VIEWS[_name] = VIEWS[_name].replace("FROM {orders}", f"FROM {_KEYED}")
    for _mark in "MJIVCO":
        VIEWS[_name] = VIEWS[_name].replace(f"UUID_{_mark}", uuid_sql(f"hash_{_mark.lower()}"))

#: Views that join a table to what is built from its own rows. Texts are built longer than their estimate, so the join is a merge.
MERGED = {"outbox_events": "orders"}

_PLACE = re.compile(r"\{([a-z]+)\}")


def _spark_text(sql: str) -> str:
    return re.sub(r"SHA256\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)", r"sha2(\1, 256)", sql)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same table as a stream of its files, be it one file or a folder of them.

    A finite table is replayed as one micro-batch, so its answer does not depend on how it is cut into files. An endless
    one may bound the files of a batch; then its watermark delay must cover the disorder between files.
    """
    schema = read_table(spark, folder, name).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getFileStatus(path).isDirectory():
        return reader.option("recursiveFileLookup", "true").parquet(f"{folder}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def view(spark: SparkSession, folder: str, name: str, streaming: bool = False) -> DataFrame:
    """One adapter view over the tables of a folder, or over streams of them."""
    sql = _spark_text(VIEWS[name])
    read = stream_table if streaming else read_table
    used = {table: read(spark, folder, table) for table in set(_PLACE.findall(sql)) if table in TABLES}
    # JSON literals hold braces, so the source names are filled by hand instead of by str.format.
    for table, frame in used.items():
        if MERGED.get(name) == table and not streaming:
            frame = frame.hint("merge")
        alias = f"stream_{table}" if streaming else f"src_{table}"
        frame.createOrReplaceTempView(alias)
        sql = sql.replace("{" + table + "}", alias)
    return spark.sql(sql)


def view_sql(name: str) -> str:
    """The same view as text for the checking database."""
    return _PLACE.sub(lambda m: m.group(1) if m.group(1) in TABLES else m.group(0), VIEWS[name]).strip()
