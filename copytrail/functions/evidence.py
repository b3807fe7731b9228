"""Projections and rule codes for evidence, manifests, messages, audit and measurements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from copytrail import constants as C
from copytrail.functions.text import codes, let, longer, matches

_UUID_ANY_CASE = "(?i)" + C.UUID_PATTERN

# Audit metadata keys that may be kept (fixed values).
AUDIT_KEYS = ("kind", "role", "status", "safe_error_code", "object_size", "attempt")
AUDIT_VALUE_LIMIT = 256
_URL = r"^([\x00-\x20]*[A-Za-z][A-Za-z0-9+.-]*:|)//[^/?#]+"


def redact_map(metadata: Column) -> Column:
    """Allow-listed entries of a map, without links, cut to the value limit."""
    kept = F.map_filter(metadata, lambda k, v: k.isin(*AUDIT_KEYS) & v.isNotNull() & ~v.rlike(_URL))
    return F.transform_values(kept, lambda k, v: F.substring(v, 1, AUDIT_VALUE_LIMIT))


def redact_metadata(metadata_json: Column) -> Column:
    """``redact_map`` of a JSON object, keeping scalar members only."""
    def kept(p: Column) -> Column:
        entries = []
        for key in AUDIT_KEYS:
            kind = F.schema_of_variant(F.variant_get(p["typed"], f"$.{key}", "variant"))
            text = F.try_element_at(p["texts"], F.lit(key))
            scalar = ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY") & (kind != "VOID")
            value = F.when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)
            entries.append(F.when(scalar, F.struct(F.lit(key).alias("key"), value.alias("value"))))
        return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))

    parsed = F.struct(F.try_parse_json(metadata_json).alias("typed"), F.from_json(metadata_json, "map<string,string>").alias("texts"))
    return redact_map(let(parsed, kept))


def audit_event_errors(actor_id: Column, actor_org: Column, target_org: Column, system: Column, action: Column, outcome: Column,
                       target_type: Column, target_id: Column, correlation_id: Column) -> Column:
    """Broken rules of an audit event. System events carry no actor but a tenant."""
    bare = F.regexp_replace(F.regexp_replace(correlation_id, r"urn:|uuid:|-", ""), r"^[{}]+|[{}]+$", "")
    return codes(
        ("actor_missing", ~system & actor_id.isNull()), ("actor_unexpected", system & actor_id.isNotNull()),
        ("tenant_mismatch", ~F.coalesce(actor_org == target_org, F.lit(False))),
        ("action_invalid", ~F.coalesce(F.length(action).between(1, 120), F.lit(False))),
        ("outcome_invalid", ~F.coalesce(outcome.isin("succeeded", "denied", "failed"), F.lit(False))),
        ("target_too_long", longer(target_type, 80) | longer(target_id, 120)),
        ("correlation_invalid", ~matches(bare, "^[0-9a-fA-F]{32}$")))


# Decode statuses and algorithm labels (fixed values).
DECODE_STATUSES = ("decoded", "partial_payload_evidence", "payload_not_detected", "insufficient_sync_evidence",
                   "geometry_rejected", "execution_error", "cancelled")
ALGORITHM_LABELS = ("experimental_unreleased_fingerprint_v2", "integrity_release_v1")
EVIDENCE_SCHEMA = (
    "algorithm_label string, decode_status string, fingerprint_confidence double, integrity_score double, "
    "valid_vote_count bigint, analyzed_page_count bigint, manifest_signature_valid boolean, exact_file_hash_match boolean, "
    "suspicious_regions array<map<string,double>>, limitations array<string>")
REGION_LIMIT = 500
_SIDES = ("x", "y", "width", "height")


def project_evidence(evidence_json: Column, integrity_mode: bool = False, fingerprint_enabled: bool = False) -> Column:
    """Closed projection of stored evidence: unknown members vanish and values out of range become null."""
    return let(F.from_json(evidence_json, EVIDENCE_SCHEMA), lambda e: _project(e, integrity_mode, fingerprint_enabled))


def _project(e: Column, integrity_mode: bool, fingerprint_enabled: bool) -> Column:
    label = e["algorithm_label"]
    if integrity_mode:
        label = F.when(label == ALGORITHM_LABELS[0], ALGORITHM_LABELS[1]).otherwise(label)

    def ratio(name: str) -> Column:
        return F.when(e[name].between(0.0, 1.0), e[name]).alias(name)

    def count(name: str) -> Column:
        return F.when(e[name] >= 0, e[name]).alias(name)

    def region_ok(r: Column) -> Column:
        inside = F.size(r) == 4
        for side in _SIDES:
            inside = inside & F.coalesce(F.element_at(r, side).between(0.0, 1.0), F.lit(False))
        return inside & (F.element_at(r, "width") > 0) & (F.element_at(r, "height") > 0)

    regions = F.transform(F.filter(F.slice(e["suspicious_regions"], 1, REGION_LIMIT), region_ok),
                          lambda r: F.struct(*[F.element_at(r, s).alias(s) for s in _SIDES]))
    if integrity_mode:
        base = F.array(F.lit("evidence.not_proof_of_leak_edit_or_distribution"))
        if fingerprint_enabled:
            limits = F.concat(base, F.array(F.lit("fingerprint.recall_below_release_gate")))
        else:
            unmatched = ~F.coalesce(e["exact_file_hash_match"], F.lit(False))
            limits = F.when(unmatched, F.concat(base, F.array(F.lit("fingerprint.transformed_attribution_unavailable")))).otherwise(base)
    else:
        limits = F.filter(F.slice(e["limitations"], 1, 100), lambda t: matches(t, "^[a-z][a-z0-9_.-]{0,127}$"))
    return F.struct(
        F.when(label.isin(*ALGORITHM_LABELS), label).alias("algorithm_label"),
        F.when(e["decode_status"].isin(*DECODE_STATUSES), e["decode_status"]).alias("decode_status"),
        ratio("fingerprint_confidence"), ratio("integrity_score"), count("valid_vote_count"), count("analyzed_page_count"),
        e["manifest_signature_valid"].alias("manifest_signature_valid"), e["exact_file_hash_match"].alias("exact_file_hash_match"),
        regions.alias("suspicious_regions"), limits.alias("limitations"))


# Names of the metrics that may be shown (fixed values).
METRIC_KEYS = ("processing_ms", "pages_processed", "peak_rss_bytes", "temp_peak_bytes", "cleanup_failures")


def project_metrics(metrics_json: Column) -> Column:
    """Known metrics that hold a non-negative 64-bit integer."""
    parsed = F.from_json(metrics_json, ", ".join(f"{k} bigint" for k in METRIC_KEYS))
    return let(parsed, lambda p: F.map_filter(
        F.create_map(*[x for k in METRIC_KEYS for x in (F.lit(k), p[k])]), lambda k, v: v >= 0))


# Fields of a manifest (fixed values).
PUBLIC_FIELDS = ("schema_version", "issuance_id", "issued_at", "output_sha256", "fingerprint_algorithm", "integrity_algorithm",
                 "signing_key_id")
INTERNAL_FIELDS = PUBLIC_FIELDS + ("document_id", "recipient_id", "source_sha256", "retention_policy_id")


def public_manifest(manifest: Column) -> Column:
    """The seven fields of a manifest that may leave the tenant."""
    return F.struct(*[manifest[f].alias(f) for f in PUBLIC_FIELDS])


def canonical_manifest(manifest: Column, fields: tuple[str, ...] = INTERNAL_FIELDS) -> Column:
    """Compact JSON with sorted keys. Right for this flat shape of text and integers only."""
    return F.to_json(F.struct(*[manifest[f].alias(f) for f in sorted(fields)]))


def manifest_digest(manifest: Column, fields: tuple[str, ...] = INTERNAL_FIELDS) -> Column:
    return F.sha2(canonical_manifest(manifest, fields), 256)


def manifest_errors(m: Column) -> Column:
    """Broken rules of an internal manifest."""
    stamp = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"
    algorithm = "^[a-z0-9][a-z0-9._-]{0,127}$"
    real_time = F.try_to_timestamp(F.substring(m["issued_at"], 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull()
    rules = [("schema_version", ~F.coalesce(m["schema_version"] == 1, F.lit(False)))]
    rules += [(f, ~matches(m[f], _UUID_ANY_CASE)) for f in ("issuance_id", "document_id", "recipient_id")]
    rules += [("issued_at", ~(matches(m["issued_at"], stamp) & real_time))]
    rules += [(f, ~matches(m[f], C.SHA256_PATTERN)) for f in ("source_sha256", "output_sha256")]
    rules += [(f, ~matches(m[f], algorithm)) for f in ("fingerprint_algorithm", "integrity_algorithm")]
    rules += [(f, ~F.coalesce(F.length(m[f]).between(1, 128), F.lit(False))) for f in ("signing_key_id", "retention_policy_id")]
    return codes(*rules)


MESSAGE_SCHEMA = (
    "schema_version int, message_type string, message_id string, job_id string, attempt int, issuance_id string, "
    "verification_id string, input_object_key string, input_sha256 string, deadline_at string, correlation_id string")
MESSAGE_FIELDS = tuple(part.split()[0] for part in MESSAGE_SCHEMA.split(", "))
# No scheme, no leading slash, no dot-dot, no query (fixed value).
OBJECT_KEY_PATTERN = r"^(?![a-zA-Z][a-zA-Z0-9+.-]*://)(?!/)(?!.*\.\.)(?!.*[?&]).+$"


def job_message_errors(body: Column, m: Column) -> Column:
    """Broken rules of a request message; ``m`` is ``body`` parsed with ``MESSAGE_SCHEMA``."""
    return let(F.json_object_keys(body), lambda keys: _message_rules(keys, m))


def _message_rules(keys: Column, m: Column) -> Column:
    whole = keys.isNotNull() & m.isNotNull()
    issuing, verifying = m["message_type"] == "issuance.requested", m["message_type"] == "verification.requested"
    has_i, has_v = matches(m["issuance_id"], _UUID_ANY_CASE), matches(m["verification_id"], _UUID_ANY_CASE)
    no_i, no_v = m["issuance_id"].isNull(), m["verification_id"].isNull()
    fits = (issuing & has_i & no_v) | (verifying & no_i & has_v)
    rules = [
        ("schema_version", ~F.coalesce(m["schema_version"] == 1, F.lit(False))),
        ("message_type", ~F.coalesce(issuing | verifying, F.lit(False))),
        ("message_id", ~matches(m["message_id"], _UUID_ANY_CASE)), ("job_id", ~matches(m["job_id"], _UUID_ANY_CASE)),
        ("attempt", ~F.coalesce(m["attempt"].between(0, C.MAX_ATTEMPT), F.lit(False))),
        ("target", ~F.coalesce(fits, F.lit(False))),
        ("input_object_key", ~(matches(m["input_object_key"], OBJECT_KEY_PATTERN) & (F.length(m["input_object_key"]) <= 1024))),
        ("input_sha256", ~matches(m["input_sha256"], C.SHA256_PATTERN)),
        ("deadline_at", ~matches(m["deadline_at"], r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$")),
        ("correlation_id", ~matches(m["correlation_id"], _UUID_ANY_CASE)),
        ("fields", F.size(F.array_except(keys, F.array(*[F.lit(f) for f in MESSAGE_FIELDS]))) > 0),
        ("missing", F.size(F.array_except(F.array(*[F.lit(f) for f in MESSAGE_FIELDS]), keys)) > 0),
    ]
    # Which of two values of a member counts is the reader's whim, so such a message is refused whole.
    repeated = whole & (F.size(F.array_distinct(keys)) < F.size(keys))
    return F.when(repeated, F.array(F.lit("repeated_member"))).when(whole, codes(*rules)).otherwise(F.array(F.lit("malformed")))


def verdict_view(status: Column, exact: Column, signature: Column) -> Column:
    """Code and tone a reader sees. A null flag means not checked, never false."""
    def view(code: str, tone: str) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(tone).alias("tone"))

    yes, no = F.lit(True), F.lit(False)
    return (
        F.when(status.eqNullSafe(C.PROCESSING_FAILED), view("processing_failed", "error"))
        .when(status.eqNullSafe(C.INVALID_MANIFEST) | signature.eqNullSafe(no), view("invalid_manifest", "error"))
        .when(status.eqNullSafe(C.VERIFIED_INTACT) & exact.eqNullSafe(yes) & signature.eqNullSafe(yes), view("intact", "success"))
        .when(status.eqNullSafe(C.SOURCE_IDENTIFIED_MODIFIED), view("identified_modified", "warning"))
        .when(status.eqNullSafe(C.NO_WATERMARK) & exact.eqNullSafe(no) & signature.isNull(), view("no_match", "warning"))
        .otherwise(view("unresolved", "warning"))
    )


def classify_outcome(expected: Column, decoded: Column, reason: Column, error: Column) -> Column:
    return (
        F.when(error.isNotNull(), "execution_error").when(decoded.isNotNull() & decoded.eqNullSafe(expected), "true_attribution")
        .when(decoded.isNotNull(), "false_attribution").when(expected.isNull(), "true_negative").otherwise(reason)
    )


def metric_reason(status: Column) -> Column:
    """Three reasons from six decode states; null for a state that is none of them."""
    blank = ("payload_not_detected", "insufficient_sync_evidence", "geometry_rejected", "conflicting_payload_evidence")
    return (F.when(status == "decoded", "decoded").when(status == "partial_payload_evidence", "partial")
            .when(status.isin(*blank), "not_detected"))


# Reasons of a crop eligibility (fixed values).
ELIGIBILITY_REASONS = ("eligible", "at_least_two_complete_embedded_tiles_remain", "fewer_than_two_complete_embedded_tiles_remain")


def measurement_errors(r) -> Column:
    """Broken rules of a measured row; ``r`` maps a field name to its column."""
    def outside(name: str, low: float, high: float, optional: bool = False) -> Column:
        ok = r(name).between(low, high) & ~F.isnan(r(name))
        return ~F.coalesce(ok, F.lit(optional))

    negative = r("fixture_kind") == "negative_external"
    scope = F.when(negative, "negative_control_original_vs_unmodified").otherwise("original_vs_watermarked_before_attack")
    psnr = F.try_cast(r("psnr_db"), "double") if hasattr(F, "try_cast") else r("psnr_db").try_cast("double")
    finite = psnr.isNotNull() & ~F.isnan(psnr) & (F.abs(psnr) != float("inf"))
    return codes(
        ("confidence", outside("confidence", 0.0, 1.0)), ("bit_error_rate", outside("bit_error_rate", 0.0, 1.0, True)),
        ("psnr_db", ~(finite | F.coalesce(r("psnr_db") == "Infinity", F.lit(False)))), ("ssim", outside("ssim", -1.0, 1.0)),
        ("quality_data_range", ~F.coalesce(r("quality_data_range") == 255.0, F.lit(False))),
        ("quality_scope", ~r("quality_scope").eqNullSafe(scope)),
        ("elapsed_ms", ~F.coalesce(r("elapsed_ms") >= 0, F.lit(False))),
        ("temp_peak_bytes", ~F.coalesce(r("temp_peak_bytes") == 0, F.lit(False))),
        ("eligibility_reason", ~F.coalesce(r("eligibility_reason").isin(*ELIGIBILITY_REASONS), F.lit(False))))


def signing_key_errors(key_id: Column, algorithm: Column, status: Column, valid_from: Column, valid_until: Column,
                       revoked_at: Column, metadata_json: Column) -> Column:
    """Broken rules of a signing-key record; the key material itself is not inspected."""
    revoked = status == "revoked"
    meta = F.from_json(metadata_json, "map<string,string>")
    unsafe = F.size(F.map_filter(meta, lambda k, v: ~k.isin("label", "purpose") | v.isNull() | ~F.length(v).between(1, 120))) > 0
    return codes(
        ("algorithm", ~algorithm.eqNullSafe("Ed25519")), ("key_id", ~matches(key_id, "^[A-Za-z0-9][A-Za-z0-9._:-]{0,119}$")),
        ("window", valid_until <= valid_from), ("revocation_time", revoked & (revoked_at.isNull() | (revoked_at < valid_from))),
        ("revocation_state", ~revoked & revoked_at.isNotNull()), ("metadata", meta.isNull() | unsafe))


def issue_request_error(recipient_id: Column, recipient_email: Column) -> Column:
    """Exactly one of recipient id and recipient e-mail must be given."""
    has_id = F.coalesce(F.length(recipient_id) > 0, F.lit(False))
    has_email = F.coalesce(F.length(recipient_email) > 0, F.lit(False))
    return F.when(has_id & has_email, "both").when(~has_id & ~has_email, "neither")
