"""Queries that trace suspect files."""

from pyspark.sql import functions as F

from copytrail.catalog import query
from copytrail.functions.ids import receipt_id
from copytrail.operators import tracing as T
from copytrail.session import materialize


def r6(df, *names):
    """Round the named doubles, because summation order differs between engines."""
    for name in names:
        df = df.withColumn(name, F.round(name, 6))
    return df


EXACT = """
exact AS (SELECT s.suspect_id, s.organization_id, s.input_sha256, coalesce(g.n, 0) AS exact_matches,
                 CASE WHEN g.n = 1 THEN g.id END AS exact_issuance_id
          FROM suspects s LEFT JOIN (SELECT organization_id, output_sha256, count(*) AS n, min(issuance_id) AS id
                                     FROM registry GROUP BY 1, 2) g
            ON s.organization_id = g.organization_id AND s.input_sha256 = g.output_sha256)"""

TRUST = """
trust AS (SELECT m.*, k.key_id IS NOT NULL AS key_known,
                 CASE WHEN m.algorithm <> 'Ed25519' THEN 'INVALID_ENVELOPE'
                      WHEN m.envelope_key_id <> m.key_id OR k.key_id IS NULL THEN 'KEY_ID_MISMATCH'
                      WHEN NOT m.signature_ok THEN 'INVALID_SIGNATURE'
                      WHEN k.status = 'revoked' THEN 'VALID_REVOKED'
                      WHEN k.status NOT IN ('active', 'verify_only') THEN 'VALID_UNTRUSTED_STATUS'
                      WHEN m.checked_at < k.valid_from OR coalesce(m.checked_at >= k.valid_until, false)
                        THEN 'VALID_UNTRUSTED_WINDOW'
                      ELSE 'VALID_TRUSTED' END AS trust_code
          FROM manifests m LEFT JOIN signing_keys k ON m.organization_id = k.organization_id AND m.key_id = k.key_id)"""

RETAINED = """
agreed AS (SELECT i.issuance_id, i.organization_id, i.output_sha256,
                  coalesce(j.status = 'succeeded' AND r.output_state = 'committed' AND r.attempt = j.attempt
                    AND r.output_object_key = i.output_object_key AND r.output_sha256 = i.output_sha256
                    AND r.page_count = d.page_count AND c.job_id IS NOT NULL, false) AS evidence_valid
           FROM issuances i
           LEFT JOIN issuance_results r ON r.issuance_id = i.issuance_id AND r.organization_id = i.organization_id
           LEFT JOIN issuance_jobs j ON j.job_id = r.job_id
           LEFT JOIN source_documents d ON d.document_id = i.document_id
           LEFT JOIN receipts c ON c.job_id = r.job_id AND c.organization_id = i.organization_id AND c.attempt = j.attempt),
retained AS (SELECT a.issuance_id, a.organization_id, a.evidence_valid,
                    CASE WHEN NOT a.evidence_valid OR t.trust_code IS NULL THEN NULL
                         WHEN NOT t.key_known OR t.trust_code <> 'VALID_TRUSTED' THEN false
                         ELSE json_extract_string(t.public_payload, '$.issuance_id') = a.issuance_id
                          AND json_extract_string(t.public_payload, '$.output_sha256') = a.output_sha256 END AS manifest_valid
             FROM agreed a LEFT JOIN trust t ON t.issuance_id = a.issuance_id AND t.organization_id = a.organization_id)"""

VERDICT = """
joined AS (SELECT e.*, x.evidence_valid AS xe, x.manifest_valid AS xm, d.status AS ds, d.issuance_id AS did,
                  y.issuance_id AS known, coalesce(y.evidence_valid, false) AS de, y.manifest_valid AS dm
           FROM exact e
           LEFT JOIN retained x ON x.issuance_id = e.exact_issuance_id AND x.organization_id = e.organization_id
           LEFT JOIN suspect_decodes d ON d.suspect_id = e.suspect_id
           LEFT JOIN retained y ON y.issuance_id = d.issuance_id AND y.organization_id = e.organization_id),
ruled AS (SELECT *, CASE
    WHEN exact_matches = 1 AND xe AND xm THEN 1
    WHEN exact_matches = 1 AND xe AND xm IS NULL THEN 2
    WHEN exact_matches = 1 THEN 3
    WHEN exact_matches > 1 THEN 4
    WHEN ds = 'decoded' AND did IS NOT NULL AND known IS NULL THEN 5
    WHEN ds = 'decoded' AND did IS NOT NULL AND (NOT de OR coalesce(NOT dm, false)) THEN 6
    WHEN ds = 'decoded' AND did IS NOT NULL AND dm IS NULL THEN 7
    WHEN ds = 'decoded' AND did IS NOT NULL THEN 8
    WHEN ds = 'partial_payload_evidence' THEN 9 ELSE 10 END AS rule FROM joined),
verdicts AS (SELECT suspect_id, organization_id,
    CASE WHEN rule <= 2 THEN 'VERIFIED_INTACT' WHEN rule IN (3, 6) THEN 'INVALID_MANIFEST'
         WHEN rule IN (4, 5, 9) THEN 'PARTIAL_EVIDENCE' WHEN rule IN (7, 8) THEN 'SOURCE_IDENTIFIED_MODIFIED'
         ELSE 'NO_WATERMARK' END AS verdict,
    CASE WHEN rule <= 2 THEN exact_issuance_id WHEN rule IN (7, 8) THEN did END AS matched_issuance_id,
    rule <= 4 AS exact_file_hash_match,
    CASE WHEN rule IN (1, 3) THEN xm WHEN rule IN (6, 8) THEN dm END AS manifest_signature_valid,
    CASE rule WHEN 1 THEN '' WHEN 2 THEN 'manifest.signed_evidence_unavailable'
      WHEN 3 THEN 'evidence.retained_issuance_invalid'
      WHEN 4 THEN 'evidence.exact_hash_ambiguous,manifest.signed_evidence_unavailable'
      WHEN 5 THEN 'fingerprint.decoded_source_not_available,manifest.signed_evidence_unavailable'
      WHEN 6 THEN 'evidence.retained_issuance_invalid' WHEN 7 THEN 'manifest.signed_evidence_unavailable' WHEN 8 THEN ''
      WHEN 9 THEN 'fingerprint.partial_payload_evidence,manifest.signed_evidence_unavailable'
      ELSE 'fingerprint.no_watermark_not_exclusion,manifest.signed_evidence_unavailable' END AS limitations
  FROM ruled)"""


@query("exact_trace", "WITH" + EXACT + "SELECT * FROM exact")
def _(i):
    return T.exact_trace(i.suspects, i.registry)


@query("manifest_trust", "WITH" + TRUST + "SELECT issuance_id, trust_code FROM trust")
def _(i):
    return T.manifest_trust(i.manifests, i.signing_keys).select("issuance_id", "trust_code")


@query("active_signing_key", """
    SELECT i.issuance_id, CASE WHEN count(k.key_id) = 1 THEN min(k.key_id) END AS signing_key_id,
           CASE WHEN count(k.key_id) = 1 THEN NULL ELSE 'MANIFEST_SIGNING_KEY_UNREGISTERED' END AS error_code
    FROM issuances i LEFT JOIN signing_keys k ON k.organization_id = i.organization_id AND k.status = 'active'
      AND k.valid_from <= i.issued_at AND (k.valid_until IS NULL OR i.issued_at < k.valid_until)
    GROUP BY i.issuance_id""")
def _(i):
    requests = i.issuances.select("issuance_id", "organization_id", F.col("issued_at").alias("at"))
    return T.active_signing_key(requests, i.signing_keys).select("issuance_id", "signing_key_id", "error_code")


def _retained(i):
    # The statement compares attempts: a receipt's id is a function of job and attempt.
    receipts = i.receipts.withColumn("message_id", receipt_id(F.col("job_id"), F.col("attempt")))
    return T.retained_evidence(i.issuances, i.issuance_results, i.issuance_jobs, i.source_documents, receipts,
                               T.manifest_trust(i.manifests, i.signing_keys))


@query("retained_evidence", "WITH" + TRUST + "," + RETAINED + "SELECT * FROM retained")
def _(i):
    return _retained(i)


def _verdicts(i):
    # Two joins use the retained evidence, so it is computed once.
    return T.resolve_verdict(i.suspects, i.registry, materialize(_retained(i), "retained"), i.suspect_decodes)


@query("resolve_verdict", "WITH" + EXACT + "," + TRUST + "," + RETAINED + "," + VERDICT + "SELECT * FROM verdicts")
def _(i):
    return _verdicts(i).withColumn("limitations", F.array_join("limitations", ","))


@query("verdict_counts", "WITH" + EXACT + "," + TRUST + "," + RETAINED + "," + VERDICT
       + "SELECT organization_id, verdict, count(*) AS suspects FROM verdicts GROUP BY 1, 2")
def _(i):
    return _verdicts(i).groupBy("organization_id", "verdict").agg(F.count("*").alias("suspects"))


@query("attestation", "WITH" + EXACT + """
    SELECT e.suspect_id, f.* FROM exact e LEFT JOIN (
      SELECT m.organization_id AS o, m.issuance_id AS i, json_extract_string(public_payload, '$.output_sha256') AS expected_sha256,
             sha256(public_payload) AS manifest_sha256, json_extract_string(public_payload, '$.issued_at') AS issued_at,
             k.key_id AS signing_key_id, m.algorithm AS signing_algorithm,
             json_extract_string(public_payload, '$.integrity_algorithm') AS integrity_algorithm
      FROM manifests m LEFT JOIN signing_keys k ON m.organization_id = k.organization_id AND m.key_id = k.key_id
      WHERE regexp_full_match(json_extract_string(public_payload, '$.output_sha256'), '[0-9a-f]{64}')) f
    ON f.o = e.organization_id AND f.i = e.exact_issuance_id""".replace("f.*", """f.expected_sha256, f.manifest_sha256,
      f.issued_at, f.signing_key_id, f.signing_algorithm, f.integrity_algorithm"""))
def _(i):
    refs = T.exact_trace(i.suspects, i.registry).select(
        "suspect_id", "organization_id", F.col("exact_issuance_id").alias("issuance_id"))
    return T.attestation(refs, i.manifests, i.signing_keys).drop("organization_id", "issuance_id")


@query("issuance_available", """
    SELECT i.issuance_id, j.status,
           coalesce(r.output_state = 'committed' AND r.algorithm_label = 'experimental_unreleased_fingerprint_v2'
             AND r.organization_id = i.organization_id AND r.job_id = j.job_id AND j.organization_id = i.organization_id
             AND j.status = 'succeeded' AND r.attempt = j.attempt AND i.output_object_key <> '' AND i.output_sha256 <> ''
             AND i.output_deleted_at IS NULL AND r.output_object_key = i.output_object_key
             AND r.output_sha256 = i.output_sha256, false) AS result_available
    FROM issuances i LEFT JOIN issuance_jobs j ON j.issuance_id = i.issuance_id
    LEFT JOIN issuance_results r ON r.issuance_id = i.issuance_id""")
def _(i):
    return T.issuance_available(i.issuances, i.issuance_results, i.issuance_jobs, "experimental_unreleased_fingerprint_v2")


PAGES = """
    WITH facts AS (SELECT document_id, max(confidence) AS confidence, CAST(sum(valid_votes) AS BIGINT) AS valid_votes,
        count(DISTINCT CASE WHEN status = 'decoded' THEN issuance_id END) AS ids,
        min(CASE WHEN status = 'decoded' THEN issuance_id END) AS id, count(*) FILTER (status = 'decoded') AS support,
        bool_or(status = 'partial_payload_evidence') AS p, bool_or(status = 'geometry_rejected') AS g,
        bool_or(status = 'payload_not_detected') AS n FROM page_decisions GROUP BY 1),
    st AS (SELECT *, CASE WHEN p OR ids > 1 THEN 'partial_payload_evidence' WHEN ids = 1 AND support < {k}
        THEN 'partial_payload_evidence' WHEN ids = 1 THEN 'decoded'
        WHEN g THEN 'geometry_rejected' WHEN n THEN 'payload_not_detected' ELSE 'insufficient_sync_evidence' END AS status FROM facts)
    SELECT document_id, status, CASE WHEN status = 'decoded' THEN id END AS issuance_id, round(confidence, 6) AS confidence,
           valid_votes FROM st"""


@query("page_decisions", PAGES.replace("{k}", "0"))
def _(i):
    return r6(T.page_decisions(i.page_decisions), "confidence")


@query("unknown_page_decision", PAGES.replace("{k}", "1"))
def _(i):
    return r6(T.page_decisions(i.page_decisions, minimum_support=1), "confidence")


@query("first_conclusive", """
    SELECT document_id, page_index, round(confidence, 6) AS confidence, issuance_id, status, valid_votes FROM (
      SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY
        CASE WHEN status IN ('decoded', 'partial_payload_evidence') THEN 0 ELSE 1 END, page_index, confidence,
        issuance_id NULLS FIRST, status, valid_votes) AS rn FROM page_decisions) WHERE rn = 1""")
def _(i):
    return r6(T.first_conclusive(i.page_decisions, "document_id", "page_index"), "confidence")


LINES = """
    lines AS (SELECT doc_id, lang, text AS body, unnest(string_split(text, chr(10))) AS line,
                     generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
    altered AS (SELECT doc_id, lang, unnest(string_split(replace(text, 'ou', 'uo'), chr(10))) AS line,
                     generate_subscripts(string_split(replace(text, 'ou', 'uo'), chr(10)), 1) - 1 AS pos FROM documents)"""


@query("trace_modified_copy", "WITH" + LINES + """,
    holders AS (SELECT lang, line, count(DISTINCT doc_id) AS n, min(concat('iss-', CAST(doc_id AS STRING))) AS id FROM lines GROUP BY 1, 2),
    line_votes AS (SELECT a.doc_id, CASE WHEN h.n = 1 THEN h.id END AS id, coalesce(h.n > 1, false) AS shared
              FROM altered a LEFT JOIN holders h ON a.lang = h.lang AND a.line = h.line),
    tally AS (SELECT doc_id, id, count(*) AS v, count(*) FILTER (shared) AS s FROM line_votes GROUP BY 1, 2),
    counted AS (SELECT doc_id, CAST(sum(v) AS BIGINT) AS chunks, CAST(sum(s) AS BIGINT) AS shared_votes, count(id) AS unique_ids,
        max(v) FILTER (id IS NOT NULL) AS best, max(id) AS id FROM tally GROUP BY 1),
    shared AS (SELECT DISTINCT a.doc_id, a.lang, a.line FROM altered a JOIN counted c ON c.doc_id = a.doc_id AND c.unique_ids = 0
        JOIN holders h ON a.lang = h.lang AND a.line = h.line AND h.n > 1),
    wanted AS (SELECT doc_id, count(*) AS k FROM shared GROUP BY 1),
    owned AS (SELECT DISTINCT lang, line, concat('iss-', CAST(doc_id AS STRING)) AS holder FROM lines),
    whole AS (SELECT s.doc_id, o.holder FROM shared s JOIN owned o ON s.lang = o.lang AND s.line = o.line JOIN wanted w ON w.doc_id = s.doc_id
        GROUP BY s.doc_id, o.holder, w.k HAVING count(*) = w.k),
    met AS (SELECT doc_id, min(holder) AS holder FROM whole GROUP BY 1 HAVING count(*) = 1),
    decided AS (SELECT c.doc_id, chunks, shared_votes, CASE WHEN m.holder IS NOT NULL THEN 1 ELSE unique_ids END AS identities,
        coalesce(best, CASE WHEN m.holder IS NOT NULL THEN shared_votes END, 0) AS valid_votes, coalesce(c.id, m.holder) AS id
        FROM counted c LEFT JOIN met m ON m.doc_id = c.doc_id),
    st AS (SELECT *, CASE WHEN identities > 1 THEN 'conflicting_payload_evidence'
        WHEN identities = 1 AND valid_votes >= 2 AND valid_votes / chunks >= 0.60 THEN 'decoded'
        WHEN identities = 1 OR shared_votes >= 2 THEN 'partial_payload_evidence' ELSE 'payload_not_detected' END AS status FROM decided)
    SELECT concat('doc-', CAST(doc_id AS STRING)) AS suspect_id, chunks, shared_votes, identities, valid_votes,
           round(valid_votes / chunks, 6) AS support, status, CASE WHEN status = 'decoded' THEN id END AS issuance_id FROM st""")
def _(i):
    docs = i.table("documents").select("doc_id", F.col("lang").alias("organization_id"), "text")
    issued = T.text_chunks(docs.withColumn("issuance_id", F.concat(F.lit("iss-"), "doc_id")), "organization_id", "issuance_id")
    altered = docs.select(F.concat(F.lit("doc-"), "doc_id").alias("suspect_id"), "organization_id",
                          F.replace("text", F.lit("ou"), F.lit("uo")).alias("text"))
    return r6(T.trace_modified_copy(T.text_chunks(altered, "suspect_id", "organization_id"), issued), "support")


@query("localize_changes", "WITH" + LINES + """,
    side AS (SELECT coalesce(l.doc_id, a.doc_id) AS doc_id, coalesce(l.pos, a.pos) AS pos, coalesce(l.line = a.line, false) AS same
             FROM lines l FULL JOIN altered a ON l.doc_id = a.doc_id AND l.pos = a.pos),
    c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (same) AS m, min(CASE WHEN NOT same THEN pos END) AS f FROM side GROUP BY 1),
    l AS (SELECT *, CASE WHEN n < 4 THEN 'integrity.insufficient_complete_regions'
                         WHEN (n - m) / n >= 0.25 THEN 'integrity.geometry_failure' END AS limitation FROM c)
    SELECT concat('iss-', CAST(doc_id AS STRING)) AS issuance_id, CASE WHEN n < 4 THEN 0 ELSE n END AS evaluated_regions,
           round(CASE WHEN n < 4 THEN 0 ELSE m / n END, 6) AS score, limitation,
           CASE WHEN limitation IS NULL THEN n - m ELSE 0 END AS suspicious_regions,
           CAST(CASE WHEN limitation IS NULL THEN f END AS INT) AS first_suspicious FROM l""")
def _(i):
    docs = i.table("documents").select(F.concat(F.lit("iss-"), "doc_id").alias("issuance_id"), "text")
    altered = docs.withColumn("text", F.replace("text", F.lit("ou"), F.lit("uo")))
    changes = T.chunk_changes(T.text_chunks(docs, "issuance_id"), T.text_chunks(altered, "issuance_id"))
    return r6(T.localize_changes(changes), "score")
