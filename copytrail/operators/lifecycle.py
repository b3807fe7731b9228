"""Job, key, upload and retention rules over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copytrail import constants as C
from copytrail.skew import lookup_join, previous_in_key, slice_hot


def _allowed(edges: dict[str, tuple[str, ...]], source: Column, target: Column) -> Column:
    """Whether source -> target is a declared edge; the few edges are constants inside the expression."""
    known = F.lit(False)
    for state, targets in edges.items():
        if targets:
            known = known | ((source == state) & target.isin(*targets))
    return F.coalesce(known, F.lit(False))


def transition_code(status: Column, target: Column, attempt: Column) -> Column:
    """Null when the change is accepted, else the rejection code."""
    return (
        F.when(attempt.isNull() | ~attempt.between(0, C.MAX_ATTEMPT), "JOB_ATTEMPT")
        .when(~_allowed(C.JOB_EDGES, status, target), "JOB_TRANSITION")
        .when((status == "retryable_failed") & (target == "queued") & (attempt >= C.MAX_ATTEMPT), "JOB_ATTEMPT")
    )


def apply_transitions(requests: DataFrame) -> DataFrame:
    """Each requested change with its rejection code and the status that results."""
    code = transition_code(F.col("status"), F.col("target"), F.col("attempt"))
    return requests.withColumn("error_code", code).withColumn(
        "new_status", F.when(F.col("error_code").isNull(), F.col("target")).otherwise(F.col("status")))


def transition_audit(history: DataFrame) -> DataFrame:
    """Status changes that no declared edge allows. A busy job is followed slice by slice."""
    order = ["changed_at", "change_id", "status", "attempt"]
    sliced = slice_hot(history.withColumn("_at", F.unix_micros(F.col("changed_at").cast("timestamp"))), ["job_id"], "_at")
    stepped = previous_in_key(sliced, ["job_id"], order, ["status", "attempt"], F.col("_slice")).drop("_at", "_slice")
    moved = stepped.filter(F.col("previous_status").isNotNull())
    code = transition_code(F.col("previous_status"), F.col("status"), F.col("previous_attempt"))
    return moved.withColumn("error_code", code).filter(F.col("error_code").isNotNull())


def claim_triage(jobs: DataFrame, now: Column, timeout_seconds: int | None = None) -> DataFrame:
    """What a claim does with each queued job: cancel first, then deadline, then age, else process it."""
    aged = F.lit(False) if timeout_seconds is None else (
        now >= F.col("created_at") + F.expr(f"INTERVAL '{timeout_seconds}' SECOND"))
    late = now >= F.col("deadline_at")
    status = F.when(F.col("cancel_requested_at").isNotNull(), "cancelled").when(late | aged, "failed").otherwise("processing")
    code = F.when(F.col("cancel_requested_at").isNotNull(), None).when(late, "DEMO_JOB_DEADLINE_EXCEEDED").when(
        aged, "INTEGRITY_JOB_TIMEOUT")
    return jobs.filter(F.col("status") == "queued").withColumn("new_status", status).withColumn("error_code", code)


def retry_triage(jobs: DataFrame, owners: DataFrame, now: Column) -> DataFrame:
    """What happens to each retryable job; one that owns a result or is out of attempts is dead-lettered."""
    owned = owners.select("job_id").distinct().withColumn("_owned", F.lit(True))
    rows = jobs.filter(F.col("status") == "retryable_failed").join(owned, "job_id", "left")
    rule = (
        F.when(F.col("cancel_requested_at").isNotNull(), F.struct(F.lit("cancelled").alias("s"), F.lit(None).cast("string").alias("c")))
        .when(now >= F.col("deadline_at"), F.struct(F.lit("failed").alias("s"), F.lit("INTEGRITY_DEADLINE_EXCEEDED").alias("c")))
        .when(F.col("_owned"), F.struct(F.lit("dead_lettered").alias("s"), F.lit("INTEGRITY_RESULT_ALREADY_OWNED").alias("c")))
        .when(F.col("attempt") >= C.MAX_ATTEMPT, F.struct(F.lit("dead_lettered").alias("s"), F.lit("INTEGRITY_ATTEMPTS_EXHAUSTED").alias("c")))
        .otherwise(F.struct(F.lit("queued").alias("s"), F.lit(None).cast("string").alias("c")))
    )
    return rows.withColumn("_r", rule).withColumn("new_status", F.col("_r.s")).withColumn("error_code", F.col("_r.c")).withColumn(
        "new_attempt", F.when(F.col("new_status") == "queued", F.col("attempt") + 1).otherwise(F.col("attempt"))).drop("_r", "_owned")


FENCE_CODE = "DEMO_STALE_RECOVERY_FENCED"


def stale_action(jobs: DataFrame, owners: DataFrame, stale_before: Column, fence_code: str = FENCE_CODE) -> DataFrame:
    """Recovery of jobs left in processing, from the state of the one result each of them owns."""
    own = owners.select("job_id", F.col("state").alias("_state"), F.col("safe_error_code").alias("_code"), F.col("replay_ok").alias("_ok"))
    rows = jobs.join(own, "job_id", "left")
    issuing = F.col("kind") == "issuance"
    action = (
        F.when(issuing & (F.col("status") == "failed") & (F.col("_state") == "cleanup_required") & (F.col("_code") == fence_code), "tombstone")
        .when((F.col("status") != "processing") | (F.col("updated_at") >= stale_before) | F.col("_state").isNull(), "none")
        .when((F.col("_state") == "committed") & F.col("_ok"), "succeed")
        .when(F.col("_state") == "committed", "fail_result")
        .when(issuing & F.col("_state").isin("uploading", "cleanup_required"), "cleanup")
        .when(F.col("_state") == "reserved", "fail_stale")
        .when(issuing & (F.col("_state") == "cleaned"), "fail_stale")
        .otherwise("none")
    )
    return rows.withColumn("action", action).drop("_state", "_code", "_ok")


def retention_deadline(rows: DataFrame, kind: str = "kind", at: str = "completed_at") -> DataFrame:
    """When an object may be removed; null for kinds kept for ever, a code for unknown kinds."""
    deadline = F.lit(None).cast("timestamp")
    for name, hours in C.RETENTION_HOURS.items():
        deadline = F.when(F.col(kind) == name, F.col(at) + F.expr(f"INTERVAL '{hours}' HOUR")).otherwise(deadline)
    known = F.col(kind).isin(*C.RETENTION_HOURS, *C.KEPT_KINDS)
    return rows.withColumn("deadline", deadline).withColumn(
        "error_code", F.when(~F.coalesce(known, F.lit(False)), "unknown_retention_kind"))


def _window(kind: str) -> Column:
    return F.expr(f"INTERVAL '{C.RETENTION_HOURS[kind]}' HOUR")


def _job_facts(jobs: DataFrame, key: str) -> DataFrame:
    """The three existence questions about an object's jobs, answered by one aggregation."""
    done = F.col("status").isin(*C.TERMINAL_STATES)
    return jobs.groupBy(key).agg(F.bool_and(done).alias("_done"), F.bool_or(F.col("status") == "succeeded").alias("_success"),
                                 F.max("updated_at").alias("_latest"))


def retention_eligible(uploads: DataFrame, upload_jobs: DataFrame, issuances: DataFrame, issuance_jobs: DataFrame,
                       now: Column) -> DataFrame:
    """Every object that may be removed now: (priority, category, id, at), one row per object and category.

    A stale promotion without a ``target_key`` names nothing to remove and is not listed.
    """
    facts = _job_facts(upload_jobs, "upload_id")
    rows = uploads.join(facts, "upload_id", "left")
    stale = (F.col("status_changed_at") <= now - F.expr("INTERVAL '1' HOUR")) & F.col("deleted_at").isNull()
    stale &= F.col("target_key").isNotNull()
    settled = (F.col("promotion_status") == "attached") & F.col("deleted_at").isNull() & F.coalesce("_done", F.lit(False))

    def entry(test: Column, priority: int, category: str, at: str = "created_at") -> Column:
        return F.when(test, F.struct(F.lit(priority).alias("priority"), F.lit(category).alias("category"), F.col(at).alias("at")))

    found = F.filter(F.array(
        entry(stale & (F.col("promotion_status") == "failed"), 0, "stale_promotion"),
        entry(stale & (F.col("promotion_status") == "copying"), 1, "stale_promotion"),
        entry(settled & (F.col("purpose") == "issuance") & (F.col("_latest") <= now - _window("issuance_input")), 2, "issuance_input"),
        entry(settled & (F.col("purpose") == "verification") & (F.col("_latest") <= now - _window("verification_input")), 3, "verification_input"),
        entry(F.col("orphan_deleted_at").isNull() & (F.col("created_at") <= now - _window("orphan_upload")), 5, "orphan"),
    ), lambda e: e.isNotNull())
    objects = rows.select(F.col("upload_id").cast("string").alias("id"), F.explode(found).alias("e")).select("e.*", "id")
    outputs = issuances.filter(F.col("output_deleted_at").isNull() & F.col("output_object_key").isNotNull()).join(
        _job_facts(issuance_jobs, "issuance_id"), "issuance_id").filter(
        F.col("_done") & F.col("_success") & (F.col("_latest") <= now - _window("issuance_output"))).select(
        F.lit(4).alias("priority"), F.lit("issuance_output").alias("category"), F.col("issued_at").alias("at"), F.col("issuance_id").alias("id"))
    return objects.unionByName(outputs)


def reconcile_outcomes(log: DataFrame) -> DataFrame:
    """Per target the state its latest attempt leaves, with an observed time that never goes back."""
    code = (
        F.when(~F.col("owner_exists"), "MISSING_CLEANUP_OWNER").when(~F.col("eligible"), "INELIGIBLE_CLEANUP_OWNER")
        .when(~F.col("key_ok"), "INVALID_CONTROLLED_KEY").when(~F.col("storage_ok"), "STORAGE_DELETE_RETRY")
    )
    last = log.withColumn("_code", code).groupBy("target_id").agg(
        F.max("at").alias("observed_at"), F.max_by(F.struct("_code"), F.struct("at", "attempt_key", F.coalesce("_code", F.lit("")))).alias("_l"))
    state = (F.when(F.col("_l._code").isNull(), "closed").when(F.col("_l._code") == "STORAGE_DELETE_RETRY", "open")
             .otherwise("handled_failure"))
    return last.select("target_id", "observed_at", state.alias("state"), F.col("_l._code").alias("safe_error_code"))


def key_transitions(requests: DataFrame) -> DataFrame:
    """Requested signing-key changes: accepted, unchanged, or the rule they break."""
    same = F.col("target") == F.col("status")
    code = (
        F.when(~F.col("target").isin(*C.KEY_EDGES), "invalid_target").when(same, None)
        .when(F.col("status") == "revoked", "terminal").when(~_allowed(C.KEY_EDGES, F.col("status"), F.col("target")), "invalid_transition")
        .when(F.col("at") < F.col("valid_from"), "invalid_time")
    )
    moved = F.col("error_code").isNull() & ~same
    return requests.withColumn("error_code", code).withColumn(
        "new_status", F.when(moved, F.col("target")).otherwise(F.col("status"))).withColumn(
        "new_revoked_at", F.when(moved & (F.col("target") == "revoked"), F.col("at")).when(moved, None).otherwise(F.col("revoked_at")))


def promotion_triage(uploads: DataFrame, kind: Column, now: Column) -> DataFrame:
    """Whether an upload may be promoted for a job kind; the first failing rule names the rejection."""
    code = (
        F.when(F.col("purpose") != kind, "UPLOAD_WRONG_PURPOSE").when(F.col("finalized_at").isNull(), "UPLOAD_NOT_FINALIZED")
        .when(now >= F.col("expires_at"), "UPLOAD_EXPIRED")
        .when(F.col("expected_sha256").isNull() | F.col("size_bytes").isNull(), "UPLOAD_LEGACY_METADATA")
        .when(F.col("promotion_status") != "none", "PROMOTION_ALREADY_RESERVED")
    )
    target = F.concat(F.lit("inputs/"), kind, F.lit("/"), F.col("organization_id"), F.lit("/"), F.col("upload_id").cast("string"), F.lit(".bin"))
    return uploads.withColumn("error_code", code).withColumn(
        "target_key", F.when(F.col("error_code").isNull(), target)).withColumn(
        "new_status", F.when(F.col("error_code").isNull(), "copying").otherwise(F.col("promotion_status")))


AUDIT_KEY = ("organization_id", "action", "target_id", "outcome")


def audit_once(events: DataFrame, history: DataFrame, order: Sequence[str]) -> DataFrame:
    """New events, at most one per (tenant, action, target, outcome), the first by ``order``."""
    rest = [c for c in events.columns if c not in AUDIT_KEY]
    firsts = events.groupBy(*AUDIT_KEY).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f")).select(*AUDIT_KEY, "_f.*")
    return firsts.join(history.select(*AUDIT_KEY).distinct(), list(AUDIT_KEY), "left_anti")


def deletion_evidence(outcomes: DataFrame, stamped: DataFrame) -> DataFrame:
    """The first deletion time of each target not stamped before, with its audit row's fields."""
    first = outcomes.groupBy("organization_id", "target_id", "action").agg(F.min("at").alias("deleted_at"))
    fresh = first.join(stamped.select("target_id", "action").distinct(), ["target_id", "action"], "left_anti")
    return fresh.withColumn("outcome", F.lit("succeeded")).withColumn("metadata_status", F.lit("deleted"))


def cancel_triage(requests: DataFrame, jobs: DataFrame, audit: DataFrame) -> DataFrame:
    """Answer to each cancel request, and the status it leaves. An exact replay is accepted."""
    job = jobs.select("job_id", F.col("organization_id").alias("_org"), F.col("kind").alias("_kind"), F.col("owner_id").alias("_owner"),
                      F.col("status").alias("_status"), F.col("cancel_requested_at").alias("_cancel"))
    replays = audit.filter((F.col("action") == "job.cancel_requested") & (F.col("outcome") == "succeeded")).select(
        "organization_id", "actor_id", F.col("target_id").alias("job_id"), "correlation_id").distinct().withColumn("_replay", F.lit(True))
    asked = ["organization_id", "actor_id", "job_id", "correlation_id"]
    rows = lookup_join(lookup_join(requests, job, ["job_id"]), replays, asked, counted=requests)
    visible = (F.col("_org") == F.col("organization_id")) & (
        (F.col("role") == "administrator")
        | ((F.col("role") == "issuer") & (F.col("_kind") == "issuance") & (F.col("_owner") == F.col("as_owner")))
        | ((F.col("role") == "verifier") & (F.col("_kind") == "verification") & (F.col("_owner") == F.col("as_owner"))))
    requested = F.col("_cancel").isNotNull() | (F.col("_status") == "cancelled")
    answer = (
        F.when(F.col("role") == "auditor", "WORKFLOW_FORBIDDEN").when(~F.coalesce(visible, F.lit(False)), "WORKFLOW_NOT_FOUND")
        .when(requested & F.col("_replay"), "replayed").when(requested, "JOB_CANCEL_ALREADY_REQUESTED")
        .when(F.col("_status").isin("succeeded", "failed", "dead_lettered"), "JOB_TERMINAL")
        .when(F.col("_status") == "processing", "flagged").otherwise("cancelled")
    )
    return rows.withColumn("answer", answer).withColumn(
        "new_status", F.when(F.col("answer") == "cancelled", "cancelled").when(
            F.col("answer").isin("WORKFLOW_FORBIDDEN", "WORKFLOW_NOT_FOUND"), None).otherwise(F.col("_status"))).drop(
        "_org", "_kind", "_owner", "_status", "_cancel", "_replay")
