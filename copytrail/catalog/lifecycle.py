"""Queries over job, key, upload and retention rules."""

from pyspark.sql import functions as F

from copytrail.catalog import query
from copytrail.operators import lifecycle as L
from copytrail.operators import queues as Q

NOW_SQL = "TIMESTAMP '1999-01-01 00:00:00'"
CUT_SQL = "TIMESTAMP '2024-01-05 00:00:00'"


def ts(name):
    """A timestamp column as text, so that no session time zone enters the comparison."""
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def ts_sql(expr, name):
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS {name}"


EDGES = """(status, target) IN (('created','queued'), ('created','cancelled'), ('created','failed'), ('queued','processing'),
    ('queued','cancelled'), ('queued','failed'), ('queued','dead_lettered'), ('processing','succeeded'), ('processing','failed'),
    ('processing','retryable_failed'), ('processing','cancelled'), ('retryable_failed','queued'), ('retryable_failed','failed'),
    ('retryable_failed','dead_lettered'), ('retryable_failed','cancelled'))"""
CODE = f"""CASE WHEN attempt NOT BETWEEN 0 AND 2 THEN 'JOB_ATTEMPT' WHEN NOT {EDGES} THEN 'JOB_TRANSITION'
    WHEN status = 'retryable_failed' AND target = 'queued' AND attempt >= 2 THEN 'JOB_ATTEMPT' END"""
TARGETS = ("queued", "processing", "succeeded", "failed", "cancelled", "dead_lettered", "retryable_failed")
TARGET_SQL = "CASE owner_id % 7 " + " ".join(f"WHEN {n} THEN '{t}'" for n, t in enumerate(TARGETS)) + " END"


@query("apply_transitions", f"""
    WITH r AS (SELECT job_id, status, attempt, {TARGET_SQL} AS target FROM jobs), c AS (SELECT *, {CODE} AS error_code FROM r)
    SELECT job_id, status, target, error_code, CASE WHEN error_code IS NULL THEN target ELSE status END AS new_status FROM c""")
def _(i):
    requests = i.jobs.withColumn("target", F.element_at(F.array(*[F.lit(t) for t in TARGETS]), (F.col("owner_id") % 7 + 1).cast("int")))
    return L.apply_transitions(requests).select("job_id", "status", "target", "error_code", "new_status")


@query("transition_audit", f"""
    WITH h AS (SELECT job_id, changed_at, change_id, status AS target, lag(status) OVER w AS status, lag(attempt) OVER w AS attempt
               FROM job_history WINDOW w AS (PARTITION BY job_id ORDER BY changed_at, change_id, status, attempt)),
    c AS (SELECT *, {CODE} AS error_code FROM h WHERE status IS NOT NULL)
    SELECT job_id, change_id, {ts_sql('changed_at', 'changed_at')}, status AS previous_status, target AS status, error_code
    FROM c WHERE error_code IS NOT NULL""")
def _(i):
    return L.transition_audit(i.job_history).select("job_id", "change_id", ts("changed_at"), "previous_status", "status", "error_code")


MIX_NOW = "(created_at + INTERVAL '9' MINUTE + INTERVAL '1' MINUTE * (owner_id % 4 * 100))"


@query("claim_triage", f"""
    SELECT job_id, CASE WHEN cancel_requested_at IS NOT NULL THEN 'cancelled' WHEN {MIX_NOW} >= deadline_at
        OR {MIX_NOW} >= created_at + INTERVAL '540' SECOND THEN 'failed' ELSE 'processing' END AS new_status,
      CASE WHEN cancel_requested_at IS NOT NULL THEN NULL WHEN {MIX_NOW} >= deadline_at THEN 'DEMO_JOB_DEADLINE_EXCEEDED'
        WHEN {MIX_NOW} >= created_at + INTERVAL '540' SECOND THEN 'INTEGRITY_JOB_TIMEOUT' END AS error_code
    FROM jobs WHERE status = 'queued'""")
def _(i):
    return L.claim_triage(i.jobs, F.expr(MIX_NOW), 540).select("job_id", "new_status", "error_code")


@query("retry_triage", f"""
    WITH r AS (SELECT j.*, o.job_id IS NOT NULL AS owned FROM jobs j LEFT JOIN (SELECT DISTINCT job_id FROM job_owners
                 WHERE state = 'committed') o ON o.job_id = j.job_id WHERE j.status = 'retryable_failed'),
    c AS (SELECT *, CASE WHEN cancel_requested_at IS NOT NULL THEN 'cancelled' WHEN {MIX_NOW} >= deadline_at THEN 'failed'
            WHEN owned OR attempt >= 2 THEN 'dead_lettered' ELSE 'queued' END AS new_status FROM r)
    SELECT job_id, new_status, CASE WHEN new_status = 'failed' THEN 'INTEGRITY_DEADLINE_EXCEEDED' WHEN new_status <> 'dead_lettered' THEN NULL
        WHEN owned THEN 'INTEGRITY_RESULT_ALREADY_OWNED' ELSE 'INTEGRITY_ATTEMPTS_EXHAUSTED' END AS error_code,
        attempt + CASE WHEN new_status = 'queued' THEN 1 ELSE 0 END AS new_attempt FROM c""")
def _(i):
    owners = i.job_owners.filter(F.col("state") == "committed")
    return L.retry_triage(i.jobs, owners, F.expr(MIX_NOW)).select("job_id", "new_status", "error_code", "new_attempt")


ONE_OWNER = """one AS (SELECT job_id, arg_min(row(state, coalesce(safe_error_code, ''), replay_ok), row(sequence, part, state)) AS o
               FROM job_owners GROUP BY 1)"""


def _owners(i):
    first = F.min_by(F.struct("state", "safe_error_code", "replay_ok"), F.struct("sequence", "part", "state"))
    return i.job_owners.groupBy("job_id").agg(first.alias("o")).select("job_id", "o.*")


@query("stale_action", f"""
    WITH {ONE_OWNER}
    SELECT j.job_id, CASE
      WHEN kind = 'issuance' AND status = 'failed' AND o[1] = 'cleanup_required' AND o[2] = 'DEMO_STALE_RECOVERY_FENCED' THEN 'tombstone'
      WHEN status <> 'processing' OR updated_at >= {NOW_SQL} OR o IS NULL THEN 'none'
      WHEN o[1] = 'committed' AND o[3] THEN 'succeed' WHEN o[1] = 'committed' THEN 'fail_result'
      WHEN kind = 'issuance' AND o[1] IN ('uploading', 'cleanup_required') THEN 'cleanup'
      WHEN o[1] = 'reserved' THEN 'fail_stale' ELSE 'none' END AS action
    FROM jobs j LEFT JOIN one ON one.job_id = j.job_id""")
def _(i):
    return L.stale_action(i.jobs, _owners(i), F.expr(NOW_SQL)).select("job_id", "action")


KINDS = ("orphan_upload", "issuance_input", "issuance_output", "verification_input", "manifest_metadata", "audit_event", "other")
KIND_SQL = "CASE user_id % 7 " + " ".join(f"WHEN {n} THEN '{k}'" for n, k in enumerate(KINDS)) + " END"


@query("retention_deadline", f"""
    WITH k AS (SELECT event_id, {KIND_SQL} AS kind, ts FROM events)
    SELECT event_id, kind, strftime(CASE kind WHEN 'orphan_upload' THEN ts + INTERVAL '24' HOUR WHEN 'issuance_input' THEN ts + INTERVAL '7' DAY
        WHEN 'issuance_output' THEN ts + INTERVAL '30' DAY WHEN 'verification_input' THEN ts + INTERVAL '1' DAY END, '%Y-%m-%d %H:%M:%S') AS deadline,
      CASE WHEN kind = 'other' THEN 'unknown_retention_kind' END AS error_code FROM k""")
def _(i):
    rows = i.table("events").selectExpr("event_id", f"{KIND_SQL} AS kind", "CAST(ts AS TIMESTAMP) AS completed_at")
    return L.retention_deadline(rows).select("event_id", "kind", ts("deadline"), "error_code")


ELIGIBLE = f"""
    f AS (SELECT upload_id, bool_and(status IN ('succeeded', 'failed', 'dead_lettered', 'cancelled')) AS done,
            bool_or(status = 'succeeded') AS ok, max(updated_at) AS latest FROM related_jobs GROUP BY 1),
    u AS (SELECT u.*, done, ok, latest FROM uploads u LEFT JOIN f ON f.upload_id = u.upload_id),
    outs AS (SELECT o_orderkey AS k, CAST(o_orderdate AS TIMESTAMP) AS issued_at FROM orders),
    candidates AS (
      SELECT CASE promotion_status WHEN 'failed' THEN 0 ELSE 1 END AS priority, 'stale_promotion' AS category, created_at AS at,
             CAST(upload_id AS STRING) AS id FROM u
        WHERE promotion_status IN ('failed', 'copying') AND target_key IS NOT NULL AND deleted_at IS NULL AND status_changed_at <= {NOW_SQL} - INTERVAL '1' HOUR
      UNION ALL SELECT 2, 'issuance_input', created_at, CAST(upload_id AS STRING) FROM u WHERE promotion_status = 'attached'
        AND deleted_at IS NULL AND done AND purpose = 'issuance' AND latest <= {NOW_SQL} - INTERVAL '168' HOUR
      UNION ALL SELECT 3, 'verification_input', created_at, CAST(upload_id AS STRING) FROM u WHERE promotion_status = 'attached'
        AND deleted_at IS NULL AND done AND purpose = 'verification' AND latest <= {NOW_SQL} - INTERVAL '24' HOUR
      UNION ALL SELECT 4, 'issuance_output', issued_at, concat('iss-', CAST(k AS STRING)) FROM outs JOIN f ON f.upload_id = k
        WHERE done AND ok AND latest <= {NOW_SQL} - INTERVAL '720' HOUR
      UNION ALL SELECT 5, 'orphan', created_at, CAST(upload_id AS STRING) FROM u
        WHERE orphan_deleted_at IS NULL AND created_at <= {NOW_SQL} - INTERVAL '24' HOUR)"""


def _candidates(i):
    issued = i.table("orders").select(
        F.concat(F.lit("iss-"), "o_orderkey").alias("issuance_id"), F.col("o_orderdate").cast("timestamp").alias("issued_at"),
        F.lit("key").alias("output_object_key"), F.lit(None).cast("timestamp").alias("output_deleted_at"))
    issuance_jobs = i.related_jobs.withColumn("issuance_id", F.concat(F.lit("iss-"), "upload_id"))
    return L.retention_eligible(i.uploads, i.related_jobs, issued, issuance_jobs, F.expr(NOW_SQL))


@query("retention_eligible", "WITH" + ELIGIBLE + f"SELECT priority, category, id, strftime(at, '%Y-%m-%d %H:%M:%S') AS at FROM candidates")
def _(i):
    return _candidates(i).select("priority", "category", "id", ts("at"))


@query("cleanup_batch", "WITH" + ELIGIBLE + f"""
    SELECT priority, category, id, strftime(at, '%Y-%m-%d %H:%M:%S') AS at FROM candidates c WHERE NOT EXISTS (
      SELECT 1 FROM related_jobs r WHERE r.status = 'failed' AND CAST(r.upload_id AS STRING) = c.id AND c.category = 'stale_promotion')
    ORDER BY priority, c.at, id LIMIT 500""")
def _(i):
    tried = i.related_jobs.filter(F.col("status") == "failed").select(
        F.lit("stale_promotion").alias("category"), F.col("upload_id").cast("string").alias("id"))
    return Q.cleanup_batch(_candidates(i), tried, 500).select("priority", "category", "id", ts("at"))


@query("reconcile_outcomes", f"""
    WITH c AS (SELECT *, CASE WHEN NOT owner_exists THEN 'MISSING_CLEANUP_OWNER' WHEN NOT eligible THEN 'INELIGIBLE_CLEANUP_OWNER'
                 WHEN NOT key_ok THEN 'INVALID_CONTROLLED_KEY' WHEN NOT storage_ok THEN 'STORAGE_DELETE_RETRY' END AS code FROM attempt_log),
    l AS (SELECT target_id, max(at) AS observed_at, arg_max(row(code), row(at, attempt_key, coalesce(code, ''))) AS last FROM c GROUP BY 1)
    SELECT target_id, {ts_sql('observed_at', 'observed_at')}, CASE WHEN last[1] IS NULL THEN 'closed'
      WHEN last[1] = 'STORAGE_DELETE_RETRY' THEN 'open' ELSE 'handled_failure' END AS state, last[1] AS safe_error_code FROM l""")
def _(i):
    return L.reconcile_outcomes(i.attempt_log).select("target_id", ts("observed_at"), "state", "safe_error_code")


@query("key_transitions", f"""
    WITH r AS (SELECT k.*, t.target, TIMESTAMP '2024-02-01 00:00:00' AS at
               FROM signing_keys k, (VALUES ('active'), ('verify_only'), ('revoked'), ('lost')) t(target)),
    c AS (SELECT *, CASE WHEN target NOT IN ('active', 'verify_only', 'revoked') THEN 'invalid_target' WHEN target = status THEN NULL
        WHEN status = 'revoked' THEN 'terminal' WHEN NOT ((status = 'active' AND target IN ('verify_only', 'revoked')) OR
        (status = 'verify_only' AND target = 'revoked')) THEN 'invalid_transition' WHEN at < valid_from THEN 'invalid_time' END AS error_code FROM r)
    SELECT key_id, target, error_code, CASE WHEN error_code IS NULL THEN target ELSE status END AS new_status,
      strftime(CASE WHEN error_code IS NULL AND target <> status THEN CASE WHEN target = 'revoked' THEN at END ELSE revoked_at END,
        '%Y-%m-%d %H:%M:%S') AS new_revoked_at FROM c""")
def _(i):
    targets = F.array(*[F.lit(t) for t in ("active", "verify_only", "revoked", "lost")])
    requests = i.signing_keys.withColumn("target", F.explode(targets)).withColumn("at", F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return L.key_transitions(requests).select("key_id", "target", "error_code", "new_status", ts("new_revoked_at"))


MIX_KIND = "CASE WHEN requested_by % 5 = 0 THEN 'issuance' ELSE purpose END"
MIX_AT = "(created_at + INTERVAL '1' MINUTE * (requested_by % 4 * 6))"


@query("promotion_triage", f"""
    WITH c AS (SELECT *, {MIX_KIND} AS kind, CASE WHEN purpose <> {MIX_KIND} THEN 'UPLOAD_WRONG_PURPOSE'
        WHEN finalized_at IS NULL THEN 'UPLOAD_NOT_FINALIZED' WHEN {MIX_AT} >= expires_at THEN 'UPLOAD_EXPIRED'
        WHEN size_bytes IS NULL THEN 'UPLOAD_LEGACY_METADATA' WHEN promotion_status <> 'none' THEN 'PROMOTION_ALREADY_RESERVED' END AS error_code
      FROM uploads)
    SELECT upload_id, error_code, CASE WHEN error_code IS NULL THEN concat('inputs/', kind, '/', organization_id, '/',
        CAST(upload_id AS STRING), '.bin') END AS target_key, CASE WHEN error_code IS NULL THEN 'copying' ELSE promotion_status END AS new_status FROM c""")
def _(i):
    return L.promotion_triage(i.uploads, F.expr(MIX_KIND), F.expr(MIX_AT)).select("upload_id", "error_code", "target_key", "new_status")


EVENTS_SQL = """
    ev AS (SELECT organization_id, concat('object.', action, '.', outcome) AS action, target_id, outcome, event_id, created_at FROM audit),
    hist AS (SELECT organization_id, action, target_id, outcome FROM ev WHERE created_at < TIMESTAMP '2024-01-05 00:00:00')"""


def _events(i):
    return i.audit.select("organization_id", F.concat(F.lit("object."), "action", F.lit("."), "outcome").alias("action"),
                          "target_id", "outcome", "event_id", "created_at")


@query("audit_once", "WITH" + EVENTS_SQL + """
    SELECT organization_id, action, target_id, outcome, event_id FROM (SELECT *, row_number() OVER (
        PARTITION BY organization_id, action, target_id, outcome ORDER BY created_at, event_id) AS rn FROM ev
      WHERE created_at >= TIMESTAMP '2024-01-05 00:00:00') e
    WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM hist h WHERE h.organization_id = e.organization_id AND h.action = e.action
      AND h.target_id = e.target_id AND h.outcome = e.outcome)""")
def _(i):
    events = _events(i)
    fresh, history = events.filter(F.col("created_at") >= F.expr(CUT_SQL)), events.filter(F.col("created_at") < F.expr(CUT_SQL))
    return L.audit_once(fresh, history, ["created_at", "event_id"]).select("organization_id", "action", "target_id", "outcome", "event_id")


@query("deletion_evidence", f"""
    WITH f AS (SELECT organization_id, target_id, action, min(created_at) AS at FROM audit
                 WHERE outcome = 'succeeded' AND created_at >= TIMESTAMP '2024-01-05 00:00:00' GROUP BY 1, 2, 3)
    SELECT organization_id, target_id, action, {ts_sql('at', 'deleted_at')}, 'succeeded' AS outcome, 'deleted' AS metadata_status
    FROM f WHERE NOT EXISTS (SELECT 1 FROM audit a WHERE a.created_at < TIMESTAMP '2024-01-05 00:00:00' AND a.outcome = 'succeeded'
      AND a.target_id = f.target_id AND a.action = f.action)""")
def _(i):
    done = i.audit.filter(F.col("outcome") == "succeeded")
    fresh = done.filter(F.col("created_at") >= F.expr(CUT_SQL)).withColumnRenamed("created_at", "at")
    return L.deletion_evidence(fresh, done.filter(F.col("created_at") < F.expr(CUT_SQL))).select(
        "organization_id", "target_id", "action", ts("deleted_at"), "outcome", "metadata_status")


@query("cancel_triage", """
    WITH rp AS (SELECT DISTINCT organization_id, actor_id, target_id, correlation_id FROM cancel_audit),
    j AS (SELECT r.*, b.status, b.cancel_requested_at, rp.target_id IS NOT NULL AS replay,
            coalesce(b.organization_id = r.organization_id AND (r.role = 'administrator'
              OR (r.role = 'issuer' AND b.kind = 'issuance' AND b.owner_id = r.as_owner)
              OR (r.role = 'verifier' AND b.kind = 'verification' AND b.owner_id = r.as_owner)), false) AS visible
          FROM cancel_requests r LEFT JOIN jobs b ON b.job_id = r.job_id
          LEFT JOIN rp ON rp.organization_id = r.organization_id AND rp.actor_id = r.actor_id AND rp.target_id = r.job_id
            AND rp.correlation_id = r.correlation_id),
    a AS (SELECT *, CASE WHEN role = 'auditor' THEN 'WORKFLOW_FORBIDDEN' WHEN NOT visible THEN 'WORKFLOW_NOT_FOUND'
        WHEN (cancel_requested_at IS NOT NULL OR status = 'cancelled') AND replay THEN 'replayed'
        WHEN cancel_requested_at IS NOT NULL OR status = 'cancelled' THEN 'JOB_CANCEL_ALREADY_REQUESTED'
        WHEN status IN ('succeeded', 'failed', 'dead_lettered') THEN 'JOB_TERMINAL' WHEN status = 'processing' THEN 'flagged'
        ELSE 'cancelled' END AS answer FROM j)
    SELECT request_id, line, job_id, actor_id, answer, CASE WHEN answer = 'cancelled' THEN 'cancelled'
      WHEN answer IN ('WORKFLOW_FORBIDDEN', 'WORKFLOW_NOT_FOUND') THEN NULL ELSE status END AS new_status FROM a""")
def _(i):
    return L.cancel_triage(i.cancel_requests, i.jobs, i.cancel_audit).select(
        "request_id", "line", "job_id", "actor_id", "answer", "new_status")


@query("queue_head", f"""
    SELECT job_id, {ts_sql('created_at', 'created_at')} FROM (SELECT * FROM jobs WHERE status = 'queued' ORDER BY created_at, job_id LIMIT 20)""")
def _(i):
    return Q.queue_head(i.jobs, "queued", 20).select("job_id", ts("created_at"))


@query("retry_head", f"""
    SELECT job_id, {ts_sql('updated_at', 'updated_at')} FROM (SELECT * FROM jobs WHERE status = 'retryable_failed'
      ORDER BY updated_at, job_id LIMIT 20)""")
def _(i):
    return Q.queue_head(i.jobs, "retryable_failed", 20, "updated_at").select("job_id", ts("updated_at"))


@query("stale_jobs", f"""
    WITH o AS (SELECT job_id, coalesce(bool_or(state = 'cleanup_required' AND safe_error_code = 'DEMO_STALE_RECOVERY_FENCED'), false) AS fenced
               FROM job_owners GROUP BY 1)
    SELECT j.job_id, j.status, {ts_sql('updated_at', 'updated_at')} FROM jobs j JOIN o ON o.job_id = j.job_id
    WHERE (status = 'processing' AND j.updated_at < {NOW_SQL} - INTERVAL '15' MINUTE) OR (status = 'failed' AND fenced AND kind = 'issuance')
    ORDER BY j.updated_at, j.job_id LIMIT 100""")
def _(i):
    return Q.stale_jobs(i.jobs, i.job_owners, F.expr(NOW_SQL), 100).select("job_id", "status", ts("updated_at"))


@query("keyset_next", f"""
    SELECT upload_id, {ts_sql('deleted_at', 'deleted_at')} FROM (SELECT * FROM uploads WHERE deleted_at IS NOT NULL
      ORDER BY CASE WHEN deleted_at > TIMESTAMP '1998-07-01 00:00:00' OR (deleted_at = TIMESTAMP '1998-07-01 00:00:00' AND upload_id > 700)
               THEN 0 ELSE 1 END, deleted_at, upload_id LIMIT 50)""")
def _(i):
    rows = i.uploads.filter(F.col("deleted_at").isNotNull())
    return Q.keyset_next(rows, "deleted_at", "upload_id", F.lit("1998-07-01 00:00:00").cast("timestamp"), F.lit(700), 50).select(
        "upload_id", ts("deleted_at"))


@query("lane_interleave", """
    WITH o AS (SELECT 'ordinary' AS lane, upload_id AS id, created_at AS at, 0 AS turn, row_number() OVER (ORDER BY created_at, upload_id) AS rn
               FROM uploads WHERE orphan_deleted_at IS NULL),
    r AS (SELECT 'reconciliation' AS lane, upload_id AS id, deleted_at AS at, 1 AS turn, row_number() OVER (ORDER BY deleted_at, upload_id) AS rn
          FROM uploads WHERE deleted_at IS NOT NULL)
    SELECT lane, id, CAST(row_number() OVER (ORDER BY rn, turn) AS INT) AS position FROM (SELECT * FROM o UNION ALL SELECT * FROM r)
    ORDER BY rn, turn LIMIT 500""")
def _(i):
    ordinary = i.uploads.filter(F.col("orphan_deleted_at").isNull()).select(F.col("created_at").alias("at"), F.col("upload_id").alias("id"))
    again = i.uploads.filter(F.col("deleted_at").isNotNull()).select(F.col("deleted_at").alias("at"), F.col("upload_id").alias("id"))
    return Q.lane_interleave(ordinary, again, 500).select("lane", "id", "position")
