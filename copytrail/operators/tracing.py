"""From a suspect file to a verdict: hash look-ups, retained evidence, page decisions and text traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copytrail import constants as C
from copytrail.functions.ids import receipt_id
from copytrail.session import materialize
from copytrail.skew import lookup_join, running_max, running_sum, slice_hot, sparse_join

CONCLUSIVE = ("decoded", "partial_payload_evidence")


def _keyed(registry: DataFrame) -> DataFrame:
    """One row per (tenant, hash): how many copies carry it, and the id when it is the only one."""
    counted = registry.groupBy("organization_id", F.col("output_sha256").alias("input_sha256")).agg(
        F.count("*").alias("_n"), F.min("issuance_id").alias("_id"))
    return counted.select("organization_id", "input_sha256", "_n", F.when(F.col("_n") == 1, F.col("_id")).alias("_id"))


def exact_trace(suspects: DataFrame, registry: DataFrame) -> DataFrame:
    """Count issued copies with a suspect's tenant and hash; the id is exposed only when exactly one matches.

    The registry is reduced to one row per (tenant, hash) first, so the join never multiplies suspects.
    """
    joined = lookup_join(suspects, _keyed(registry), ["organization_id", "input_sha256"], spread=["suspect_id"])
    return joined.withColumn("exact_matches", F.coalesce("_n", F.lit(0))).withColumnRenamed("_id", "exact_issuance_id").drop("_n")


def manifest_trust(manifests: DataFrame, keys: DataFrame) -> DataFrame:
    """One code per manifest; the first failing check in order names it. ``signature_ok`` comes in as a column."""
    known = keys.select("organization_id", "key_id", F.col("status").alias("_status"), F.col("valid_from").alias("_from"),
                        F.col("valid_until").alias("_until"), F.lit(True).alias("_known"))
    at = F.col("checked_at")
    outside = (at < F.col("_from")) | F.coalesce(at >= F.col("_until"), F.lit(False))
    code = (
        F.when(~F.col("algorithm").eqNullSafe("Ed25519"), "INVALID_ENVELOPE")
        .when(~F.col("envelope_key_id").eqNullSafe(F.col("key_id")) | F.col("_known").isNull(), "KEY_ID_MISMATCH")
        .when(~F.coalesce("signature_ok", F.lit(False)), "INVALID_SIGNATURE")
        .when(F.col("_status") == "revoked", "VALID_REVOKED")
        .when(~F.col("_status").isin("active", "verify_only"), "VALID_UNTRUSTED_STATUS")
        .when(outside, "VALID_UNTRUSTED_WINDOW")
        .otherwise("VALID_TRUSTED")
    )
    joined = lookup_join(manifests, known, ["organization_id", "key_id"], spread=["issuance_id"])
    return joined.withColumn("trust_code", code).withColumn("trusted", F.col("trust_code") == "VALID_TRUSTED").withColumn(
        "key_known", F.coalesce("_known", F.lit(False))).drop("_status", "_from", "_until", "_known")


def active_signing_key(requests: DataFrame, keys: DataFrame, at: str = "at") -> DataFrame:
    """The single active key of the tenant whose half-open window holds the request time, or an error code.

    No request is paired with its tenant's keys. Window starts and ends are turned into segments of time with
    the number of open keys and the sum of their numbers; where one key is open the sum is its number. Each
    distinct request time then finds the segment it falls into by a running maximum.
    """
    usable = keys.filter((F.col("status") == "active") & (F.col("algorithm") == "Ed25519")).filter(
        F.col("valid_until").isNull() | (F.col("valid_until") > F.col("valid_from"))).select(
        "organization_id", F.col("key_id").alias("_key"), F.xxhash64("key_id").cast("decimal(38,0)").alias("_number"),
        F.col("valid_from").cast("timestamp").alias("_from"), F.col("valid_until").cast("timestamp").alias("_until"))
    edges = usable.select("organization_id", "_number", F.explode(F.array(
        F.struct(F.col("_from").alias("t"), F.lit(1).alias("d")), F.struct(F.col("_until").alias("t"), F.lit(-1).alias("d")))).alias("e"))
    steps = edges.filter(F.col("e.t").isNotNull()).groupBy("organization_id", F.col("e.t").alias("_t")).agg(
        F.sum("e.d").alias("_d"), F.sum(F.col("_number") * F.col("e.d")).alias("_dn"))
    tenant, part = ["organization_id"], F.col("_slice")
    sliced = slice_hot(steps.withColumn("_us", F.unix_micros("_t")), tenant, "_us")
    segments = running_sum(running_sum(sliced, tenant, [F.col("_t")], "_d", part, "_open"), tenant, [F.col("_t")], "_dn", part, "_sum")
    single = segments.filter(F.col("_open") == 1).select("organization_id", "_t", F.col("_sum").cast("decimal(38,0)").alias("_number")).join(
        usable.select("organization_id", "_number", "_key"), ["organization_id", "_number"]).select(
        "organization_id", F.col("_t").alias("_since"), F.col("_key").alias("signing_key_id"))
    moments = requests.select("organization_id", F.col(at).cast("timestamp").alias("_t"), F.lit(None).cast("timestamp").alias("_edge")).distinct()
    marks = steps.select("organization_id", "_t", F.col("_t").alias("_edge")).unionByName(moments)
    cut = slice_hot(marks.withColumn("_us", F.unix_micros("_t")), tenant, "_us")
    placed = running_max(cut, tenant, [F.col("_t"), F.col("_edge").asc_nulls_last()], "_edge", part, "_since").filter(
        F.col("_edge").isNull()).select("organization_id", F.col("_t"), "_since")
    found = placed.join(single, ["organization_id", "_since"]).select("organization_id", F.col("_t").alias("_at"), "signing_key_id")
    joined = lookup_join(requests.withColumn("_at", F.col(at).cast("timestamp")), found, ["organization_id", "_at"])
    return joined.withColumn("error_code", F.when(
        F.col("signing_key_id").isNull(), F.lit("MANIFEST_SIGNING_KEY_UNREGISTERED"))).drop("_at")


def retained_evidence(issuances: DataFrame, results: DataFrame, jobs: DataFrame, documents: DataFrame,
                      receipts: DataFrame, trusted_manifests: DataFrame) -> DataFrame:
    """Whether an issuance's stored evidence still agrees, and what its manifest says (null = not checked).

    A receipt counts only under the id that belongs to the job's present attempt.
    """
    res = results.select("issuance_id", "organization_id", F.col("job_id").alias("_job"),
                         F.col("output_state").alias("_state"), F.col("attempt").alias("_attempt"),
                         F.col("output_object_key").alias("_key"), F.col("output_sha256").alias("_sha"),
                         F.col("page_count").alias("_pages"))
    job = jobs.select(F.col("job_id").alias("_job"), F.col("status").alias("_jstatus"), F.col("attempt").alias("_jattempt"))
    doc = documents.select("document_id", F.col("page_count").alias("_dpages"))
    rec = receipts.select(F.col("job_id").alias("_job"), "organization_id", F.col("message_id").alias("_message")).distinct().withColumn("_receipt", F.lit(True))
    man = trusted_manifests.select("issuance_id", "organization_id", "trusted", "key_known", "public_payload")
    agreed = (
        (F.col("_jstatus") == "succeeded") & (F.col("_state") == "committed") & (F.col("_attempt") == F.col("_jattempt"))
        & F.col("_key").eqNullSafe(F.col("output_object_key")) & F.col("_sha").eqNullSafe(F.col("output_sha256"))
        & F.col("_pages").eqNullSafe(F.col("_dpages")) & F.col("_receipt").isNotNull()
    )
    payload_agrees = (
        F.get_json_object("public_payload", "$.issuance_id").eqNullSafe(F.col("issuance_id"))
        & F.get_json_object("public_payload", "$.output_sha256").eqNullSafe(F.col("output_sha256"))
    )
    joined = (
        lookup_join(issuances, doc, ["document_id"], spread=["issuance_id"]).join(res, ["issuance_id", "organization_id"], "left")
        .join(man, ["issuance_id", "organization_id"], "left")
    )
    placed = sparse_join(joined, job, ["_job"], ["issuance_id"]).withColumn("_message", receipt_id(F.col("_job"), F.col("_jattempt")))
    joined = sparse_join(placed, rec, ["_job", "organization_id", "_message"], ["issuance_id"])
    valid = joined.withColumn("evidence_valid", F.coalesce(agreed, F.lit(False)))
    manifest = (
        F.when(~F.col("evidence_valid") | F.col("trusted").isNull(), F.lit(None).cast("boolean"))
        .when(~F.col("key_known") | ~F.col("trusted"), F.lit(False)).otherwise(payload_agrees)
    )
    return valid.withColumn("manifest_valid", manifest).select("issuance_id", "organization_id", "evidence_valid", "manifest_valid")


def resolve_verdict(suspects: DataFrame, registry: DataFrame, retained: DataFrame, decodes: DataFrame,
                    exact_only: bool = False, base_limitations: tuple[str, ...] = ()) -> DataFrame:
    """The verdict cascade. A decoded mark never overrides a known hash fact.

    Evidence is attached to the registry's and the decodes' rows first, so that suspects are joined once by
    hash and once by their own id, and hot keys are counted on plain scans.
    """
    known = retained.select(F.col("issuance_id").alias("_id"), F.col("organization_id").alias("_org"),
                            F.col("evidence_valid").alias("_e"), F.col("manifest_valid").alias("_m"))
    exact = sparse_join(_keyed(registry), known, ["_id"], ["input_sha256"]).select(
        "organization_id", "input_sha256", "_n", F.col("_id").alias("exact_issuance_id"),
        F.when(F.col("_org") == F.col("organization_id"), F.struct("_e", "_m")).alias("_x"))
    seen = lookup_join(decodes.select("suspect_id", F.col("status").alias("_dstatus"), F.col("issuance_id").alias("_id")),
                       known, ["_id"], spread=["suspect_id"]).select("suspect_id", "_dstatus", F.col("_id").alias("_did"), "_org",
                                              F.struct("_e", "_m").alias("_y"))
    rows = lookup_join(suspects, exact, ["organization_id", "input_sha256"], spread=["suspect_id"]).join(seen, "suspect_id", "left")
    rows = rows.withColumn("_known", F.when(F.col("_org") == F.col("organization_id"), F.lit(True)))
    none_id, none_flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")

    def out(verdict: str, issuance: Column, exact_hash: bool, manifest: Column, *limits: str) -> Column:
        limitations = F.array_distinct(F.array(*[F.lit(x) for x in (*base_limitations, *limits)])) if (
            base_limitations or limits) else F.array().cast("array<string>")
        return F.struct(F.lit(verdict).alias("verdict"), issuance.alias("matched_issuance_id"),
                        F.lit(exact_hash).alias("exact_file_hash_match"), manifest.alias("manifest_signature_valid"),
                        limitations.alias("limitations"))

    one, many = F.coalesce(F.col("_n") == 1, F.lit(False)), F.coalesce(F.col("_n") > 1, F.lit(False))
    xe, xm = F.coalesce("_x._e", F.lit(False)), F.col("_x._m")
    de, dm = F.coalesce("_y._e", F.lit(False)), F.col("_y._m")
    decoded = (F.col("_dstatus") == "decoded") & F.col("_did").isNotNull()
    unsigned = "manifest.signed_evidence_unavailable"
    chain = F.when(one & xe & xm.eqNullSafe(F.lit(True)), out(C.VERIFIED_INTACT, F.col("exact_issuance_id"), True, xm))
    if not exact_only:
        chain = chain.when(one & xe & xm.isNull(), out(C.VERIFIED_INTACT, F.col("exact_issuance_id"), True, none_flag, unsigned))
    chain = (
        chain.when(one, out(C.INVALID_MANIFEST, none_id, True, xm, "evidence.retained_issuance_invalid"))
        .when(many, out(C.PARTIAL_EVIDENCE, none_id, True, none_flag, "evidence.exact_hash_ambiguous", unsigned))
    )
    if exact_only:
        chain = chain.otherwise(out(C.NO_WATERMARK, none_id, False, none_flag, "fingerprint.transformed_attribution_unavailable"))
    else:
        chain = (
            chain.when(decoded & F.col("_known").isNull(),
                       out(C.PARTIAL_EVIDENCE, none_id, False, none_flag, "fingerprint.decoded_source_not_available", unsigned))
            .when(decoded & (~de | dm.eqNullSafe(F.lit(False))),
                  out(C.INVALID_MANIFEST, none_id, False, dm, "evidence.retained_issuance_invalid"))
            .when(decoded & dm.isNull(), out(C.SOURCE_IDENTIFIED_MODIFIED, F.col("_did"), False, none_flag, unsigned))
            .when(decoded, out(C.SOURCE_IDENTIFIED_MODIFIED, F.col("_did"), False, dm))
            .when(F.col("_dstatus") == "partial_payload_evidence",
                  out(C.PARTIAL_EVIDENCE, none_id, False, none_flag, "fingerprint.partial_payload_evidence", unsigned))
            .otherwise(out(C.NO_WATERMARK, none_id, False, none_flag, "fingerprint.no_watermark_not_exclusion", unsigned))
        )
    return rows.withColumn("_v", chain).select("suspect_id", "organization_id", "_v.*")


def _string_field(payload: str, field: str) -> Column:
    """A JSON member's text, null unless the member is a string."""
    path = F.expr(f"variant_get(try_parse_json({payload}), '$.{field}')")
    return F.when(F.schema_of_variant(path) == "STRING", F.get_json_object(payload, f"$.{field}"))


def attestation(references: DataFrame, manifests: DataFrame, keys: DataFrame) -> DataFrame:
    """Six public facts about a matched issuance; all null when the recorded hash is missing or malformed."""
    man = manifests.select("organization_id", "issuance_id", "public_payload", "key_id",
                           F.col("algorithm").alias("signing_algorithm"))
    known = keys.select("organization_id", "key_id", F.col("key_id").alias("signing_key_id"))
    facts = lookup_join(man, known, ["organization_id", "key_id"], spread=["issuance_id"]).drop("key_id").withColumn(
        "expected_sha256", _string_field("public_payload", "output_sha256")).filter(
        F.col("expected_sha256").rlike(C.SHA256_PATTERN)).select(
        "organization_id", "issuance_id", "expected_sha256", F.sha2("public_payload", 256).alias("manifest_sha256"),
        _string_field("public_payload", "issued_at").alias("issued_at"), "signing_key_id", "signing_algorithm",
        _string_field("public_payload", "integrity_algorithm").alias("integrity_algorithm"))
    return lookup_join(references, facts, ["organization_id", "issuance_id"])


def issuance_available(issuances: DataFrame, results: DataFrame, jobs: DataFrame, label: str) -> DataFrame:
    """Whether every stored fact about an issuance, its result and its first job agrees."""
    first = jobs.groupBy("issuance_id").agg(
        F.min_by(F.struct("job_id", "organization_id", "status", "attempt"), F.struct("created_at", "job_id")).alias("j")
    ) if "created_at" in jobs.columns else jobs.select(
        "issuance_id", F.struct("job_id", "organization_id", "status", "attempt").alias("j"))
    res = results.select(
        "issuance_id", F.struct("organization_id", "job_id", "output_state", "attempt", "output_object_key",
                                "output_sha256", "algorithm_label").alias("r"))
    agreed = (
        (F.col("r.output_state") == "committed") & (F.col("r.algorithm_label") == label)
        & (F.col("r.organization_id") == F.col("organization_id")) & (F.col("r.job_id") == F.col("j.job_id"))
        & (F.col("j.organization_id") == F.col("organization_id")) & (F.col("j.status") == "succeeded")
        & (F.col("r.attempt") == F.col("j.attempt")) & (F.coalesce(F.length("output_object_key"), F.lit(0)) > 0)
        & (F.coalesce(F.length("output_sha256"), F.lit(0)) > 0) & F.col("output_deleted_at").isNull()
        & (F.col("r.output_object_key") == F.col("output_object_key")) & (F.col("r.output_sha256") == F.col("output_sha256"))
    )
    return issuances.join(first, "issuance_id", "left").join(res, "issuance_id", "left").select(
        "issuance_id", F.col("j.status").alias("status"), F.coalesce(agreed, F.lit(False)).alias("result_available"))


def page_decisions(decisions: DataFrame, key: str = "document_id", minimum_support: int = 0) -> DataFrame:
    """Combine the page decisions of a document; two identities or any partial page give no identity.

    With ``minimum_support`` the pages are hypotheses about one unknown page, and an identity also needs
    that many agreeing pages.
    """
    decoded = F.col("status") == "decoded"
    facts = decisions.groupBy(key).agg(
        F.max("confidence").alias("confidence"), F.sum("valid_votes").alias("valid_votes"),
        F.min(F.when(decoded, F.col("issuance_id"))).alias("_low"), F.max(F.when(decoded, F.col("issuance_id"))).alias("_high"),
        F.count_if(decoded).alias("_decoded"), F.count_if(decoded & F.col("issuance_id").isNull()).alias("_blank"),
        *[F.bool_or(F.col("status") == s).alias(f"_{s}") for s in (
            "partial_payload_evidence", "geometry_rejected", "payload_not_detected", "insufficient_sync_evidence")])
    split = (F.col("_low") != F.col("_high")) | ((F.col("_blank") > 0) & F.col("_low").isNotNull())
    weak = F.lit(False) if not minimum_support else (F.col("_decoded") < minimum_support) | F.col("_low").isNull()
    status = (
        F.when(F.col("_partial_payload_evidence") | F.coalesce(split, F.lit(False)), "partial_payload_evidence")
        .when((F.col("_decoded") > 0) & F.coalesce(weak, F.lit(True)), "partial_payload_evidence")
        .when(F.col("_decoded") > 0, "decoded").when(F.col("_geometry_rejected"), "geometry_rejected")
        .when(F.col("_payload_not_detected"), "payload_not_detected")
        .when(F.col("_insufficient_sync_evidence"), "insufficient_sync_evidence")
    )
    return facts.withColumn("status", status).select(
        key, "status", F.when(F.col("status") == "decoded", F.col("_low")).alias("issuance_id"), "confidence", "valid_votes")


def first_conclusive(attempts: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The first attempt that reached the payload, else the first attempt."""
    rest = sorted(c for c in attempts.columns if c not in (key, ordinal))
    order = F.struct((~F.col("status").isin(*CONCLUSIVE)).alias("_open"), F.col(ordinal), *rest)
    return attempts.groupBy(key).agg(F.min_by(F.struct(ordinal, *rest), order).alias("_a")).select(key, "_a.*")


def text_chunks(texts: DataFrame, *ids: str, text: str = "text") -> DataFrame:
    """One row per line of a text: its position and digest."""
    return texts.select(*ids, F.posexplode(F.split(text, "\n")).alias("chunk_index", "_line")).select(
        *ids, "chunk_index", F.sha2("_line", 256).alias("chunk_sha256"))


def line_holders(issued_chunks: DataFrame) -> DataFrame:
    """One row per (organization_id, chunk_sha256): ``holders`` counts the copies with that line, ``only_id`` names a single
    one, and ``holder_set`` stands for the set of several.

    Sets are told apart by their size and two folded hashes of their members, so no list of holders is ever built: a line
    that every copy holds is reduced in each task like any other, and lines with the same holders share one set.
    """
    copies = issued_chunks.select("organization_id", "chunk_sha256", "issuance_id").distinct()
    counted = copies.groupBy("organization_id", "chunk_sha256").agg(
        F.count("*").alias("holders"), F.min("issuance_id").alias("_low"), F.bit_xor(F.xxhash64("issuance_id")).alias("_x"),
        F.bit_xor(F.xxhash64(F.lit(1), "issuance_id")).alias("_y"))
    several = F.md5(F.concat_ws("/", "organization_id", "holders", "_x", "_y"))
    return counted.select("organization_id", "chunk_sha256", "holders", F.when(F.col("holders") == 1, F.col("_low")).alias("only_id"),
                          F.when(F.col("holders") > 1, several).alias("holder_set"))


def intersect_holders(families: DataFrame, holders: DataFrame, issued_chunks: DataFrame) -> DataFrame:
    """(family, issuance_id): the copy that is in all sets of a family, where it is the only one.

    ``families`` holds (family, sets), sets being an ascending array of (holders, holder_set). Members of a set are read once,
    from one of its lines. The candidates of a family are those of its smallest set; the next one eliminates most of them,
    and what is left must be in all others. A family of one set of several copies names nobody and costs nothing.
    """
    many = families.filter(F.size("sets") > 1)
    needed = many.select(F.explode("sets.holder_set").alias("holder_set")).distinct()
    lines = holders.filter("holders > 1").join(needed, "holder_set").groupBy("holder_set").agg(
        F.min(F.struct("organization_id", "chunk_sha256")).alias("l")).select("holder_set", "l.*")
    members = materialize(issued_chunks.join(lines, ["organization_id", "chunk_sha256"]).select("holder_set", "issuance_id").distinct(), "holder_sets")
    named = many.select("family", *[F.col("sets")[k]["holder_set"].alias(f"_{k}") for k in (0, 1)],
                        F.expr("transform(slice(sets, 3, greatest(0, size(sets) - 2)), x -> x.holder_set)").alias("_rest"))
    first = named.join(members.withColumnRenamed("holder_set", "_0"), "_0")
    second = first.join(members.withColumnRenamed("holder_set", "_1"), ["_1", "issuance_id"], "left_semi")
    asked = second.select("family", "issuance_id", F.size("_rest").alias("_asked"), F.explode_outer("_rest").alias("holder_set"))
    met = asked.join(members.withColumn("_in", F.lit(1)), ["holder_set", "issuance_id"], "left")
    whole = met.groupBy("family", "issuance_id").agg(F.count("_in").alias("_met"), F.max("_asked").alias("_asked")).filter("_met = _asked")
    return whole.groupBy("family").agg(F.count("*").alias("_n"), F.min("issuance_id").alias("issuance_id")).filter("_n = 1").select("family", "issuance_id")


def trace_modified_copy(suspect_chunks: DataFrame, issued_chunks: DataFrame) -> DataFrame:
    """Attribute an altered text to the issued copy that holds its lines.

    Each suspect line votes for the copy holding it, if only one does. Lines that several copies hold count for the set of
    their holders, one row per (suspect, set) and none per holder. A suspect without a line of a single copy is attributed by
    these sets: where exactly one copy holds all its shared lines, they vote for that copy. Suspects with the same sets are
    resolved once.
    """
    holders = materialize(line_holders(issued_chunks), "line_holders")
    lines = suspect_chunks.groupBy("suspect_id", "organization_id", "chunk_sha256").agg(F.count("*").alias("_n"))
    shared = F.col("holder_set").isNotNull()
    votes = lookup_join(lines, holders, ["organization_id", "chunk_sha256"], spread=["suspect_id"])
    tally = votes.groupBy("suspect_id", F.col("only_id").alias("issuance_id")).agg(
        F.sum("_n").alias("_votes"), F.sum(F.when(shared, F.col("_n")).otherwise(0)).alias("_common"),
        F.collect_set(F.when(shared, F.struct("holders", "holder_set"))).alias("_sets"))
    named = F.col("issuance_id").isNotNull()
    counted = tally.groupBy("suspect_id").agg(
        F.sum("_votes").alias("chunks"), F.sum("_common").alias("shared_votes"), F.count_if(named).alias("unique_identities"),
        F.max(F.when(named, F.struct("_votes", "issuance_id"))).alias("_best"), F.first(F.when(~named, F.col("_sets")), True).alias("sets"))
    sets = F.when((F.col("unique_identities") == 0) & (F.size("sets") > 1), F.array_sort("sets"))
    counted = counted.withColumn("sets", sets).withColumn("family", F.md5(F.array_join("sets.holder_set", "/")))
    counted = materialize(counted, "suspect_votes")
    families = counted.filter("family is not null").groupBy("family").agg(F.first("sets").alias("sets"))
    found = intersect_holders(families, holders, issued_chunks).withColumnRenamed("issuance_id", "_met")
    decided = sparse_join(counted.drop("sets"), found, ["family"], ["suspect_id"])
    votes_n = F.coalesce(F.col("_best._votes"), F.when(F.col("_met").isNotNull(), F.col("shared_votes")), F.lit(0))
    decided = decided.withColumn("identities", F.when(F.col("_met").isNotNull(), F.lit(1)).otherwise(F.col("unique_identities")).cast("long"))
    status = (
        F.when(F.col("identities") > 1, "conflicting_payload_evidence")
        .when((F.col("identities") == 1) & (votes_n >= C.VOTE_QUORUM) & (votes_n / F.col("chunks") >= C.VOTE_SUPPORT), "decoded")
        .when((F.col("identities") == 1) | (F.col("shared_votes") >= C.VOTE_QUORUM), "partial_payload_evidence")
        .otherwise("payload_not_detected")
    )
    return decided.withColumn("status", status).select(
        "suspect_id", "chunks", "shared_votes", "identities", votes_n.alias("valid_votes"),
        (votes_n / F.col("chunks")).alias("support"), "status",
        F.when(F.col("status") == "decoded", F.coalesce(F.col("_best.issuance_id"), F.col("_met"))).alias("issuance_id"))


def chunk_changes(issued: DataFrame, suspect: DataFrame, key: str = "issuance_id") -> DataFrame:
    """Line positions of two versions side by side, with a flag for the equal ones."""
    left = issued.select(key, "chunk_index", F.col("chunk_sha256").alias("_a"))
    right = suspect.select(key, "chunk_index", F.col("chunk_sha256").alias("_b"))
    return left.join(right, [key, "chunk_index"], "full_outer").select(
        key, "chunk_index", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("is_match"))


def localize_changes(changes: DataFrame, key: str = "issuance_id") -> DataFrame:
    """Match score per copy, and whether its change positions may be named at all."""
    counted = changes.groupBy(key).agg(
        F.count("*").alias("regions"), F.count_if("is_match").alias("matches"),
        F.min(F.when(~F.col("is_match"), F.col("chunk_index"))).alias("_first"))
    mismatched = F.col("regions") - F.col("matches")
    limitation = (
        F.when(F.col("regions") < C.MIN_REGIONS, "integrity.insufficient_complete_regions")
        .when(mismatched / F.col("regions") >= C.GEOMETRY_MISMATCH, "integrity.geometry_failure")
    )
    few = F.col("regions") < C.MIN_REGIONS
    return counted.withColumn("limitation", limitation).select(
        key, F.when(few, 0).otherwise(F.col("regions")).alias("evaluated_regions"),
        F.when(few, 0.0).otherwise(F.col("matches") / F.col("regions")).alias("score"), "limitation",
        F.when(F.col("limitation").isNull(), mismatched).otherwise(0).alias("suspicious_regions"),
        F.when(F.col("limitation").isNull(), F.col("_first")).alias("first_suspicious"))
