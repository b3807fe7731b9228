"""Queries that apply scalar rules and projections."""

from pyspark.sql import functions as F

from copytrail.catalog import query
from copytrail.functions import evidence as E
from copytrail.functions import ids as I
from copytrail.functions import text as X
from copytrail.operators import messages as M

UUID_RE = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def joined(name):
    return F.array_join(name, ",").alias(name)


@query("upload_intent_code", """
    SELECT intent_id, line, part, CASE
      WHEN NOT (role = 'administrator' OR (role = 'issuer' AND kind = 'issuance_input') OR (role = 'verifier' AND kind = 'verification_input'))
        THEN 'UPLOAD_FORBIDDEN'
      WHEN kind NOT IN ('issuance_input', 'verification_input') THEN 'UPLOAD_KIND'
      WHEN content_type NOT IN ('application/pdf', 'image/png', 'image/jpeg') THEN 'UPLOAD_CONTENT_TYPE'
      WHEN size_bytes NOT BETWEEN 1 AND 100000000 THEN 'UPLOAD_SIZE'
      WHEN NOT regexp_full_match(sha256, '[0-9a-f]{64}') THEN 'UPLOAD_SHA256' END AS error_code FROM upload_intents""")
def _(i):
    code = X.upload_intent_code(*[F.col(c) for c in ("role", "kind", "content_type", "size_bytes", "sha256")])
    return i.upload_intents.select("intent_id", "line", "part", code.alias("error_code"))


@query("safe_filename", r"""
    WITH a AS (SELECT doc_id, regexp_replace(regexp_extract(replace(name, '\', '/'), '([^/]*)$', 1), '^\s+|\s+$', '', 'g') AS n FROM file_names),
    b AS (SELECT doc_id, regexp_replace(regexp_replace(n, '[\x00-\x1f\x7f"\\/:*?<>|]', '', 'g'), '^\s+|\s+$', '', 'g') AS n FROM a),
    c AS (SELECT doc_id, regexp_replace(n, '^(\.\s*)+', '') AS n FROM b),
    d AS (SELECT doc_id, CASE WHEN length(n) <= 120 THEN n WHEN contains(n, '.') THEN
            concat(substr(array_to_string(string_split(n, '.')[:-2], '.'), 1, 120), '.', string_split(n, '.')[-1]) ELSE substr(n, 1, 120) END AS n FROM c)
    SELECT doc_id, CASE WHEN length(n) BETWEEN 1 AND 180 AND NOT regexp_matches(n, '^\.|^\s|\s$')
      AND regexp_full_match(n, '(?s).+\.[A-Za-z0-9]{1,8}') THEN n ELSE '' END AS safe_name FROM d""")
def _(i):
    return i.file_names.select("doc_id", X.safe_filename(F.col("name")).alias("safe_name"))


SLUG = r"""regexp_replace(substr(regexp_replace(regexp_replace(lower(regexp_replace(replace(replace(strip_accents({0}), 'đ', 'd'), 'Đ', 'D'),
    '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), '^-+|-+$', '', 'g')"""


@query("document_slug", f"SELECT doc_id, {SLUG.format('name')} AS slug FROM file_names")
def _(i):
    return i.file_names.select("doc_id", X.document_slug(F.col("name")).alias("slug"))


@query("download_name", rf"""
    WITH a AS (SELECT doc_id, issuance_id, regexp_replace(name, '^\s+|\s+$', '', 'g') AS n,
                 CASE WHEN object_key LIKE '%.png' THEN 'png' ELSE 'pdf' END AS ext FROM file_names),
    b AS (SELECT *, {SLUG.format("CASE WHEN contains(n, '.') THEN array_to_string(string_split(n, '.')[:-2], '.') ELSE n END")} AS slug FROM a)
    SELECT doc_id, concat(CASE WHEN slug = '' THEN '' ELSE concat(slug, '-') END, 'copy-', substr(issuance_id, 1, 8), '.', ext) AS file_name FROM b""")
def _(i):
    return i.file_names.select("doc_id", X.download_name(F.col("issuance_id"), F.col("name"), F.col("object_key")).alias("file_name"))


KEYS = f"""
    parsed AS (SELECT *, CASE WHEN regexp_full_match(key, 'uploads/orphan/(issuance|verification)_input/{UUID_RE}/[0-9a-f]{{32}}\\.bin') THEN 'orphan'
        WHEN regexp_full_match(key, 'inputs/(issuance|verification)/{UUID_RE}/{UUID_RE}\\.bin') THEN 'promoted'
        WHEN regexp_full_match(key, 'outputs/issuance/{UUID_RE}/{UUID_RE}\\.(pdf|png)') THEN 'output' END AS shape FROM storage_keys),
    parts AS (SELECT *, CASE shape WHEN 'orphan' THEN replace(string_split(key, '/')[3], '_input', '') ELSE string_split(key, '/')[2] END AS kind,
        string_split(key, '/')[-2] AS org, string_split(string_split(key, '/')[-1], '.')[1] AS obj,
        string_split(string_split(key, '/')[-1], '.')[2] AS ext FROM parsed)"""


@query("parse_storage_key", "WITH" + KEYS + """
    SELECT object_key_id, shape, CASE WHEN shape IS NOT NULL THEN kind END AS kind, CASE WHEN shape IS NOT NULL THEN org END AS organization_id,
      CASE WHEN shape IS NOT NULL THEN obj END AS object_id, CASE WHEN shape IS NOT NULL THEN ext END AS extension FROM parts""")
def _(i):
    return i.storage_keys.select("object_key_id", X.parse_storage_key(F.col("key")).alias("p")).select("object_key_id", "p.*")


@query("key_is_owned", "WITH" + KEYS + """
    SELECT object_key_id, coalesce(org = organization_id AND CASE category
      WHEN 'orphan' THEN shape = 'orphan' AND kind = purpose AND obj = replace(object_id, '-', '')
      WHEN 'issuance_output' THEN shape = 'output' AND obj = object_id
      ELSE shape = 'promoted' AND kind = purpose AND obj = object_id END, false) AS owned FROM parts""")
def _(i):
    owned = X.key_is_owned(*[F.col(c) for c in ("key", "category", "organization_id", "object_id", "purpose")])
    return i.storage_keys.select("object_key_id", owned.alias("owned"))


@query("copy_boundary_ok", "WITH" + KEYS + """
    SELECT object_key_id, coalesce(shape = 'orphan' AND kind = string_split(target_key, '/')[2] AND org = string_split(target_key, '/')[3], false)
      AS ok FROM parts""")
def _(i):
    return i.storage_keys.select("object_key_id", X.copy_boundary_ok(F.col("key"), F.col("target_key")).alias("ok"))


@query("redact_metadata", """
    SELECT event_id, CASE WHEN json_type(metadata_json, '$.kind') = 'VARCHAR' AND metadata_json ->> '$.kind' NOT LIKE '%//%' THEN metadata_json ->> '$.kind' END AS kind,
      metadata_json ->> '$.role' AS role, substr(metadata_json ->> '$.status', 1, 256) AS status, metadata_json ->> '$.object_size' AS object_size,
      CASE metadata_json ->> '$.attempt' WHEN 'true' THEN 'True' ELSE metadata_json ->> '$.attempt' END AS attempt,
      CASE WHEN json_type(metadata_json, '$.kind') = 'VARCHAR' AND metadata_json ->> '$.kind' NOT LIKE '%//%' THEN 5 ELSE 4 END AS kept FROM audit_metadata""")
def _(i):
    return i.audit_metadata.select("event_id", E.redact_metadata(F.col("metadata_json")).alias("m")).select(
        "event_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("kind", "role", "status", "object_size", "attempt")],
        F.size("m").alias("kept"))


AUDIT_COLUMNS = """SELECT event_id, CASE WHEN user_id % 9 = 0 THEN NULL ELSE user_id END AS actor_id, user_id % 7 = 0 AS is_system,
    concat('org', CAST(user_id % 4 AS STRING)) AS actor_org, concat('org', CAST((user_id + CASE WHEN value > 150 THEN 1 ELSE 0 END) % 4 AS STRING)) AS target_org,
    CASE WHEN user_id % 11 = 0 THEN '' ELSE event_type END AS action,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'denied' WHEN 'view' THEN 'seen' ELSE 'succeeded' END AS outcome,
    repeat('t', CAST(user_id AS INT)) AS target_type, CAST(event_id AS STRING) AS target_id,
    CASE WHEN user_id % 5 = 0 THEN 'nope' WHEN user_id % 5 = 1 THEN concat('urn:uuid:', md5(CAST(event_id AS STRING))) ELSE md5(CAST(event_id AS STRING)) END
      AS correlation_id"""


@query("audit_event_errors", f"""
    WITH r AS ({AUDIT_COLUMNS} FROM events)
    SELECT event_id, concat_ws(',', CASE WHEN NOT is_system AND actor_id IS NULL THEN 'actor_missing' END,
      CASE WHEN is_system AND actor_id IS NOT NULL THEN 'actor_unexpected' END, CASE WHEN actor_org <> target_org THEN 'tenant_mismatch' END,
      CASE WHEN length(action) NOT BETWEEN 1 AND 120 THEN 'action_invalid' END,
      CASE WHEN outcome NOT IN ('succeeded', 'denied', 'failed') THEN 'outcome_invalid' END,
      CASE WHEN length(target_type) > 80 OR length(target_id) > 120 THEN 'target_too_long' END,
      CASE WHEN correlation_id = 'nope' THEN 'correlation_invalid' END) AS errors FROM r""")
def _(i):
    i.table("events").createOrReplaceTempView("src_events")
    rows = i.spark.sql(f"{AUDIT_COLUMNS} FROM src_events")
    errors = E.audit_event_errors(*[F.col(c) for c in ("actor_id", "actor_org", "target_org", "is_system", "action", "outcome",
                                                       "target_type", "target_id", "correlation_id")])
    return rows.select("event_id", errors.alias("errors")).withColumn("errors", joined("errors"))


@query("project_evidence", """
    SELECT evidence_id, line, part, CASE WHEN body ->> '$.algorithm_label' <> 'secret_label' THEN body ->> '$.algorithm_label' END AS algorithm_label,
      CASE WHEN body ->> '$.decode_status' <> 'unknown' THEN body ->> '$.decode_status' END AS decode_status,
      CASE WHEN json_type(body, '$.fingerprint_confidence') <> 'VARCHAR' AND CAST(body ->> '$.fingerprint_confidence' AS DOUBLE) <= 1
        THEN CAST(body ->> '$.fingerprint_confidence' AS DOUBLE) END AS fingerprint_confidence,
      CAST(body ->> '$.integrity_score' AS DOUBLE) AS integrity_score,
      CASE WHEN CAST(body ->> '$.valid_vote_count' AS BIGINT) >= 0 THEN CAST(body ->> '$.valid_vote_count' AS BIGINT) END AS valid_vote_count,
      CAST(body ->> '$.exact_file_hash_match' AS BOOLEAN) AS exact_file_hash_match,
      concat_ws(';', CASE WHEN body ->> '$.suspicious_regions[0].width' <> '0' THEN '0.1/0.2/0.25/0.5' END,
        CASE WHEN body ->> '$.suspicious_regions[1].z' IS NULL THEN '0.5/0.5/0.1/0.1' END) AS regions,
      concat('a.b,', body ->> '$.limitations[2]') AS limitations FROM evidence""")
def _(i):
    p = i.evidence.select("evidence_id", "line", "part", E.project_evidence(F.col("body")).alias("p")).select(
        "evidence_id", "line", "part", "p.*")
    regions = F.array_join(F.transform("suspicious_regions", lambda r: F.concat_ws("/", r["x"], r["y"], r["width"], r["height"])), ";")
    return p.select("evidence_id", "line", "part", "algorithm_label", "decode_status", "fingerprint_confidence", "integrity_score",
                    "valid_vote_count", "exact_file_hash_match", regions.alias("regions"), joined("limitations"))


@query("project_evidence_release", """
    SELECT evidence_id, line, part, CASE WHEN body ->> '$.algorithm_label' <> 'secret_label' THEN 'integrity_release_v1' END AS algorithm_label,
      concat('evidence.not_proof_of_leak_edit_or_distribution', CASE WHEN coalesce(body ->> '$.exact_file_hash_match', 'false') = 'true' THEN ''
        ELSE ',fingerprint.transformed_attribution_unavailable' END) AS limitations FROM evidence""")
def _(i):
    return i.evidence.select("evidence_id", "line", "part", E.project_evidence(F.col("body"), True).alias("p")).select(
        "evidence_id", "line", "part", "p.algorithm_label", F.array_join("p.limitations", ",").alias("limitations"))


@query("project_metrics", """
    SELECT evidence_id, line, part, CAST(metrics ->> '$.processing_ms' AS BIGINT) AS processing_ms,
      CASE WHEN CAST(metrics ->> '$.pages_processed' AS BIGINT) >= 0 THEN CAST(metrics ->> '$.pages_processed' AS BIGINT) END AS pages_processed,
      CASE WHEN CAST(metrics ->> '$.pages_processed' AS BIGINT) >= 0 THEN 2 ELSE 1 END AS kept FROM evidence""")
def _(i):
    return i.evidence.select("evidence_id", "line", "part", E.project_metrics(F.col("metrics")).alias("m")).select(
        "evidence_id", "line", "part", F.try_element_at("m", F.lit("processing_ms")).alias("processing_ms"),
        F.try_element_at("m", F.lit("pages_processed")).alias("pages_processed"), F.size("m").alias("kept"))


def canonical_sql(fields):
    parts = []
    for f in sorted(fields):
        parts.append(f"""'"{f}":', {"CAST(schema_version AS STRING)" if f == "schema_version" else "'" + chr(34) + "', " + f + ", '" + chr(34) + "'"}""")
    return "concat('{', " + ", ',', ".join(parts) + ", '}')"


def _manifest(i):
    rows = i.manifest_rows
    return rows.select("manifest_id", F.struct(*E.INTERNAL_FIELDS).alias("m"))


@query("public_manifest", f"SELECT manifest_id, {canonical_sql(E.PUBLIC_FIELDS)} AS public_payload FROM manifest_rows")
def _(i):
    public = _manifest(i).select("manifest_id", E.public_manifest(F.col("m")).alias("p"))
    return public.select("manifest_id", E.canonical_manifest(F.col("p"), E.PUBLIC_FIELDS).alias("public_payload"))


@query("manifest_digest", f"""
    SELECT manifest_id, {canonical_sql(E.INTERNAL_FIELDS)} AS canonical, sha256({canonical_sql(E.INTERNAL_FIELDS)}) AS digest FROM manifest_rows""")
def _(i):
    m = F.col("m")
    return _manifest(i).select("manifest_id", E.canonical_manifest(m).alias("canonical"), E.manifest_digest(m).alias("digest"))


@query("manifest_errors", f"""
    SELECT manifest_id, concat_ws(',', CASE WHEN schema_version <> 1 THEN 'schema_version' END,
      CASE WHEN NOT regexp_full_match(lower(recipient_id), '{UUID_RE}') THEN 'recipient_id' END,
      CASE WHEN right(issued_at, 1) <> 'Z' THEN 'issued_at' END,
      CASE WHEN NOT regexp_full_match(output_sha256, '[0-9a-f]{{64}}') THEN 'output_sha256' END,
      CASE WHEN NOT regexp_full_match(fingerprint_algorithm, '[a-z0-9][a-z0-9._-]{{0,127}}') THEN 'fingerprint_algorithm' END,
      CASE WHEN signing_key_id = '' THEN 'signing_key_id' END) AS errors FROM manifest_rows""")
def _(i):
    return _manifest(i).select("manifest_id", E.manifest_errors(F.col("m")).alias("errors")).withColumn("errors", joined("errors"))


MESSAGE_ERRORS = f"""
    checked AS (SELECT job_key, body, json_valid(body) AS ok, body ->> '$.message_type' AS mt, body ->> '$.issuance_id' AS iid, body ->> '$.verification_id' AS vid,
        body ->> '$.input_object_key' AS k FROM (SELECT job_key, CASE WHEN json_valid(body) THEN body ELSE '{{}}' END AS body FROM messages)),
    bad AS (SELECT job_key FROM messages WHERE NOT json_valid(body)),
    errs AS (SELECT job_key, CASE WHEN job_key IN (SELECT job_key FROM bad) THEN 'malformed'
      WHEN contains(body, '","attempt":1}}') THEN 'repeated_member' ELSE concat_ws(',',
      CASE WHEN body ->> '$.schema_version' <> '1' THEN 'schema_version' END,
      CASE WHEN NOT regexp_full_match(body ->> '$.message_id', '{UUID_RE}') THEN 'message_id' END,
      CASE WHEN CAST(body ->> '$.attempt' AS INT) > 2 THEN 'attempt' END,
      CASE WHEN NOT ((mt = 'issuance.requested' AND iid IS NOT NULL AND vid IS NULL) OR (mt = 'verification.requested' AND iid IS NULL AND vid IS NOT NULL)) THEN 'target' END,
      CASE WHEN regexp_matches(k, '^[a-zA-Z][a-zA-Z0-9+.-]*://|^/|\\.\\.|[?&]') THEN 'input_object_key' END,
      CASE WHEN NOT regexp_full_match(body ->> '$.input_sha256', '[0-9a-f]{{64}}') THEN 'input_sha256' END,
      CASE WHEN right(body ->> '$.deadline_at', 1) <> 'Z' THEN 'deadline_at' END,
      CASE WHEN contains(body, '"extra"') THEN 'fields' END) END AS errors FROM checked)"""


@query("job_message_errors", "WITH" + MESSAGE_ERRORS + "SELECT job_key, errors FROM errs")
def _(i):
    return M.parse_messages(i.messages).select("job_key", joined("errors"))


@query("read_job_messages", "WITH" + MESSAGE_ERRORS + """
    SELECT CASE WHEN errors = '' THEN 'accepted' ELSE 'rejected' END AS branch, coalesce(mt, 'none') AS message_type, count(*) AS messages
    FROM errs JOIN checked USING (job_key) GROUP BY 1, 2""")
def _(i):
    parsed = M.parse_messages(i.messages)
    both = M.accepted_messages(parsed).withColumn("branch", F.lit("accepted")).unionByName(
        M.rejected_messages(parsed).withColumn("branch", F.lit("rejected")))
    return both.groupBy("branch", F.coalesce("m.message_type", F.lit("none")).alias("message_type")).agg(F.count("*").alias("messages"))


@query("outbox_match", "WITH" + MESSAGE_ERRORS + """,
    n AS (SELECT job_id, count(*) AS n FROM outbox_events GROUP BY 1),
    one AS (SELECT e.* FROM outbox_events e JOIN n USING (job_id) WHERE n = 1)
    SELECT o.job_key, coalesce(n.n, 0) AS event_count, coalesce(n.n = 1 AND e.organization_id = o.organization_id AND e.attempt = o.attempt
      AND e.published_at IS NULL AND o.input_sha256 IS NOT NULL AND x.errors = '', false) AS matches
    FROM outbox o LEFT JOIN n ON n.job_id = o.job_id LEFT JOIN one e ON e.job_id = o.job_id LEFT JOIN errs x ON x.job_key = o.job_key""")
def _(i):
    return M.outbox_match(i.outbox, i.outbox_events).select("job_key", "event_count", "matches")


@query("scan_objects", """
    SELECT doc_id, sha256(text) AS sha256, strlen(text) AS size_bytes, CASE WHEN strlen(text) > 20000 THEN 'size_limit'
      WHEN sha256(text) <> sha256(CASE WHEN doc_id % 5 = 0 THEN concat(text, ' ') ELSE text END) THEN 'sha256_mismatch' END AS error_code FROM documents""")
def _(i):
    docs = i.table("documents")
    declared = F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256)
    return M.scan_objects(docs, F.col("text").cast("binary"), declared, 20000).select("doc_id", "sha256", "size_bytes", "error_code")


@query("reconcile_objects", """
    SELECT u.upload_id, CASE WHEN u.finalized_at IS NOT NULL AND u.requested_by % 2 = 0 THEN 'final' WHEN """ + """
      (u.created_at + INTERVAL '1' MINUTE * (u.requested_by % 4 * 6)) >= u.expires_at THEN 'expired' WHEN o.upload_id IS NULL THEN 'missing'
      WHEN o.size_bytes IS DISTINCT FROM u.size_bytes OR o.sha256 <> u.expected_sha256 THEN 'mismatched' ELSE 'ok' END AS state
    FROM uploads u LEFT JOIN (SELECT upload_id, min(size_bytes) AS size_bytes, min(sha256) AS sha256 FROM observed_objects GROUP BY 1) o
      ON o.upload_id = u.upload_id""")
def _(i):
    declared = i.uploads.withColumn("finalized_at", F.expr("CASE WHEN requested_by % 2 = 0 THEN finalized_at END"))
    observed = i.observed_objects.groupBy("upload_id").agg(F.min("size_bytes").alias("size_bytes"), F.min("sha256").alias("sha256"))
    return M.reconcile_objects(declared, observed, F.expr("created_at + INTERVAL '1' MINUTE * (requested_by % 4 * 6)")).select("upload_id", "state")


VIEW_COLUMNS = """SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part,
    CASE l_suppkey % 6 WHEN 0 THEN 'PROCESSING_FAILED' WHEN 1 THEN 'INVALID_MANIFEST' WHEN 2 THEN 'VERIFIED_INTACT'
      WHEN 3 THEN 'SOURCE_IDENTIFIED_MODIFIED' WHEN 4 THEN 'NO_WATERMARK' ELSE 'PARTIAL_EVIDENCE' END AS status,
    CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false ELSE NULL END AS exact,
    CASE l_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS sig"""


@query("verdict_view", f"""
    WITH r AS ({VIEW_COLUMNS} FROM lineitem)
    SELECT id, line, part, CASE WHEN status = 'PROCESSING_FAILED' THEN 'processing_failed' WHEN status = 'INVALID_MANIFEST' OR sig = false THEN 'invalid_manifest'
      WHEN status = 'VERIFIED_INTACT' AND exact AND sig THEN 'intact' WHEN status = 'SOURCE_IDENTIFIED_MODIFIED' THEN 'identified_modified'
      WHEN status = 'NO_WATERMARK' AND exact = false AND sig IS NULL THEN 'no_match' ELSE 'unresolved' END AS code,
      CASE WHEN status IN ('PROCESSING_FAILED', 'INVALID_MANIFEST') OR sig = false THEN 'error'
      WHEN status = 'VERIFIED_INTACT' AND exact AND sig THEN 'success' ELSE 'warning' END AS tone FROM r""")
def _(i):
    i.table("lineitem").createOrReplaceTempView("src_lineitem")
    rows = i.spark.sql(f"{VIEW_COLUMNS} FROM src_lineitem")
    return rows.select("id", "line", "part", E.verdict_view(F.col("status"), F.col("exact"), F.col("sig")).alias("v")).select(
        "id", "line", "part", "v.*")


@query("describe_error", """
    SELECT job_id, CASE safe_error_code WHEN 'DEMO_JOB_DEADLINE_EXCEEDED' THEN 'too slow' WHEN 'DEMO_PDF_INVALID' THEN 'unreadable'
      WHEN 'SOMETHING_ELSE' THEN 'failed' END AS message FROM jobs""")
def _(i):
    texts = i.spark.createDataFrame([("DEMO_JOB_DEADLINE_EXCEEDED", "too slow"), ("DEMO_PDF_INVALID", "unreadable")], "code string, text string")
    return M.describe_error(i.jobs.select("job_id", "safe_error_code"), texts, "failed", "safe_error_code").select("job_id", "message")


RUNNING = """
    r AS (SELECT document_id, page_index, line, width, height, document_bytes, document_pages, width * height AS pixels,
            CAST(sum(width * height) OVER (PARTITION BY document_id ORDER BY page_index, line, width, height
              ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_pixels FROM page_sizes)"""
PAGE_ORDER = ["page_index", "line", "width", "height"]


@query("limit_screen", "WITH" + RUNNING + """
    SELECT document_id, page_index, line, cumulative_pixels, CASE WHEN document_bytes > 100000000 THEN 'bytes' WHEN document_pages > 50 THEN 'pages'
      WHEN pixels > 40000000 THEN 'page_pixels' WHEN cumulative_pixels > 140000000 THEN 'document_pixels' END AS error_code FROM r""")
def _(i):
    return M.limit_screen(i.page_sizes, PAGE_ORDER).select("document_id", "page_index", "line", "cumulative_pixels", "error_code")


@query("running_budget", "WITH" + RUNNING + """
    SELECT document_id, min(page_index) AS first_page_over FROM r WHERE cumulative_pixels > 140000000 GROUP BY 1""")
def _(i):
    return M.running_budget(i.page_sizes, PAGE_ORDER)


@query("sniff_kind", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' ELSE 'pdf' END AS kind FROM pages")
def _(i):
    head = F.unhex(F.expr("CASE page_id % 3 WHEN 0 THEN '89504E470D0A1A0A' WHEN 1 THEN 'FFD8FFE0' ELSE '25504446' END"))
    return i.table("pages").select("page_id", X.sniff_kind(F.concat(head, F.col("html").cast("binary"))).alias("kind"))


CRC_STEP = "if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1)"  # the CRC-32 polynomial, reversed (fixed value)


@query("payload_check", f"""
    WITH ids AS (SELECT job_key, coalesce(issuance_id, verification_id) AS id FROM outbox),
    body AS (SELECT job_key, id, '534201' || upper(replace(id, '-', '')) AS h FROM ids),
    crc AS (SELECT job_key, id, h, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 19),
        lambda k: CAST('0x' || substr(h, CAST(2 * k + 1 AS INT), 2) AS BIGINT))),
        lambda r, b: list_reduce(list_prepend(xor(r, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, _: {CRC_STEP})), 4294967295) AS c FROM body),
    framed AS (SELECT job_key, id, h || printf('%08X', c) AS frame FROM crc)
    SELECT job_key, frame, CASE job_key % 5 WHEN 0 THEN if(substr(frame, 39, 2) = '00', NULL, 'crc') WHEN 1 THEN 'length' WHEN 2 THEN 'version' END AS reason,
      CASE WHEN job_key % 5 IN (3, 4) OR (job_key % 5 = 0 AND substr(frame, 39, 2) = '00') THEN id END AS issuance_id FROM framed""")
def _(i):
    frame = I.payload_frame(F.col("issuance_id"))
    broken = F.expr("CASE job_key % 5 WHEN 0 THEN overlay(f PLACING unhex('00') FROM 20) WHEN 1 THEN substring(f, 1, 22) "
                    "WHEN 2 THEN overlay(f PLACING unhex('02') FROM 3) ELSE f END")
    rows = i.outbox.select("job_key", F.coalesce("issuance_id", "verification_id").alias("issuance_id"))
    checked = rows.withColumn("f", frame).withColumn("c", I.payload_check(broken))
    return checked.select("job_key", F.hex("f").alias("frame"), "c.reason", "c.issuance_id")


@query("classify_outcome", """
    SELECT row_id, CASE WHEN limitation = 'embedding failed' THEN 'execution_error' WHEN decoded_id = expected_id THEN 'true_attribution'
      WHEN decoded_id IS NOT NULL THEN 'false_attribution' WHEN expected_id IS NULL THEN 'true_negative' ELSE reason END AS outcome FROM result_rows""")
def _(i):
    error = F.when(F.col("limitation") == "embedding failed", F.col("limitation"))
    return i.result_rows.select("row_id", E.classify_outcome(F.col("expected_id"), F.col("decoded_id"), F.col("reason"), error).alias("outcome"))


@query("metric_reason", """
    SELECT status, CASE status WHEN 'decoded' THEN 'decoded' WHEN 'partial_payload_evidence' THEN 'partial' ELSE 'not_detected' END AS reason,
      count(*) AS pages FROM page_decisions GROUP BY 1, 2""")
def _(i):
    return i.page_decisions.groupBy("status", E.metric_reason(F.col("status")).alias("reason")).agg(F.count("*").alias("pages"))


@query("row_ids", """
    WITH r AS (SELECT l_orderkey, l_linenumber AS page_index, l_partkey, concat('fx', CAST(l_suppkey AS STRING)) AS fixture_id,
                 sha256(CAST(l_partkey AS STRING)) AS profile, concat('atk', CAST(l_orderkey % 31 AS STRING)) AS attack_id FROM lineitem),
    b AS (SELECT *, unhex('000000000135284B') || CAST(fixture_id AS BLOB) || unhex('00') || unhex(printf('%08x', page_index)) || unhex(profile) AS binding FROM r),
    h AS (SELECT *, sha256(CAST('copytrail-case-v1' AS BLOB) || unhex('00') || binding || CAST(attack_id AS BLOB)) AS case_hash,
            sha256(CAST('copytrail-identity-v1' AS BLOB) || unhex('00') || binding) AS id_hash,
            sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || CAST(concat('copytrail-result:', CAST(l_orderkey AS STRING), ':', CAST(page_index AS STRING)) AS BLOB)) AS rec FROM b)
    SELECT l_orderkey, l_partkey, sha256(concat(fixture_id, chr(0), CAST(page_index AS STRING), chr(0), profile, chr(0), attack_id)) AS row_id,
      CAST(CAST(concat('0x', substr(case_hash, 1, 16)) AS UBIGINT) AS VARCHAR) AS case_seed,
      concat(substr(id_hash, 1, 8), '-', substr(id_hash, 9, 4), '-4', substr(id_hash, 14, 3), '-',
        substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(id_hash, 17, 1)), 1), substr(id_hash, 18, 3), '-', substr(id_hash, 21, 12)) AS issuance_id,
      concat(substr(rec, 1, 8), '-', substr(rec, 9, 4), '-5', substr(rec, 14, 3), '-',
        substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(rec, 17, 1)), 1), substr(rec, 18, 3), '-', substr(rec, 21, 12)) AS receipt_id FROM h""")
def _(i):
    r = i.table("lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("page_index"),
                                   F.concat(F.lit("fx"), "l_suppkey").alias("fixture_id"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("profile"),
                                   F.concat(F.lit("atk"), (F.col("l_orderkey") % 31).cast("string")).alias("attack_id"))
    fx, page, profile, attack = (F.col(c) for c in ("fixture_id", "page_index", "profile", "attack_id"))
    seed = 20260939
    return r.select("l_orderkey", "l_partkey", I.row_id(fx, page, profile, attack).alias("row_id"),
                    I.case_seed(seed, fx, page, profile, attack).cast("string").alias("case_seed"),
                    I.expected_issuance_id(seed, fx, page, profile).alias("issuance_id"),
                    I.receipt_id(F.col("l_orderkey"), page).alias("receipt_id"))


@query("measurement_errors", """
    SELECT measure_id, line, part, concat_ws(',', CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence' END,
      CASE WHEN bit_error_rate NOT BETWEEN 0 AND 1 THEN 'bit_error_rate' END, CASE WHEN psnr_db = 'high' THEN 'psnr_db' END,
      CASE WHEN quality_data_range <> 255 THEN 'quality_data_range' END,
      CASE WHEN quality_scope <> CASE WHEN fixture_kind = 'negative_external' THEN 'negative_control_original_vs_unmodified'
        ELSE 'original_vs_watermarked_before_attack' END THEN 'quality_scope' END,
      CASE WHEN elapsed_ms < 0 THEN 'elapsed_ms' END, CASE WHEN temp_peak_bytes <> 0 THEN 'temp_peak_bytes' END,
      CASE WHEN eligibility_reason = 'maybe' THEN 'eligibility_reason' END) AS errors FROM measurements""")
def _(i):
    return i.measurements.select("measure_id", "line", "part", E.measurement_errors(F.col).alias("errors")).withColumn("errors", joined("errors"))


@query("signing_key_errors", """
    SELECT key_id, concat_ws(',', CASE WHEN valid_until <= valid_from THEN 'window' END,
      CASE WHEN status = 'revoked' AND (revoked_at IS NULL OR revoked_at < valid_from) THEN 'revocation_time' END,
      CASE WHEN status <> 'revoked' AND revoked_at IS NOT NULL THEN 'revocation_state' END,
      CASE WHEN contains(metadata_json, 'owner') THEN 'metadata' END) AS errors FROM signing_keys""")
def _(i):
    errors = E.signing_key_errors(*[F.col(c) for c in ("key_id", "algorithm", "status", "valid_from", "valid_until", "revoked_at", "metadata_json")])
    return i.signing_keys.select("key_id", errors.alias("errors")).withColumn("errors", joined("errors"))


@query("issue_request_errors", """
    SELECT request_id, CASE request_id % 4 WHEN 2 THEN 'both' WHEN 3 THEN 'neither' END AS error_code, trim(recipient_email) AS recipient_email,
      trim(recipient_name) AS recipient_name FROM issue_requests""")
def _(i):
    return i.issue_requests.select("request_id", E.issue_request_error(F.col("recipient_id"), F.col("recipient_email")).alias("error_code"),
                                   F.trim("recipient_email").alias("recipient_email"), F.trim("recipient_name").alias("recipient_name"))
