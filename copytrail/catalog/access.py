"""Queries over tenants, actors and recipients."""

from pyspark.sql import functions as F

from copytrail.catalog import query
from copytrail.catalog.lifecycle import ts, ts_sql
from copytrail.operators import access as A


def totals_sql(rows, owner, wide, own):
    """Visible rows per actor, counted row by row against the rule."""
    return f"""
    WITH v AS (SELECT a.actor_id, a.organization_id, a.role, r.created_at FROM actors a LEFT JOIN {rows} r
               ON r.organization_id = a.organization_id AND ({wide} OR ({own} AND r.{owner} = a.actor_id)))
    SELECT actor_id, organization_id, role, count(created_at) AS visible_rows, {ts_sql('max(created_at)', 'newest')} FROM v GROUP BY 1, 2, 3"""


WIDE = "a.role IN ('administrator', 'auditor')"


def _totals(rows, actors, kind):
    return A.visible_totals(actors, rows, kind).select("actor_id", "organization_id", "role", "visible_rows", ts("newest"))


@query("scope_issuances", totals_sql("(SELECT * FROM jobs WHERE kind = 'issuance')", "owner_id", WIDE, "a.role = 'issuer'"))
def _(i):
    return _totals(i.jobs.filter(F.col("kind") == "issuance"), i.actors, "issuances")


@query("scope_verifications", totals_sql("(SELECT * FROM jobs WHERE kind = 'verification')", "owner_id", WIDE, "a.role = 'verifier'"))
def _(i):
    return _totals(i.jobs.filter(F.col("kind") == "verification"), i.actors, "verifications")


@query("scope_jobs", totals_sql("jobs", "owner_id", WIDE, "((a.role = 'issuer' AND r.kind = 'issuance') OR (a.role = 'verifier' AND r.kind = 'verification'))"))
def _(i):
    return _totals(i.jobs, i.actors, "jobs")


@query("scope_uploads", totals_sql("uploads", "requested_by", "a.role = 'administrator'", "true"))
def _(i):
    return _totals(i.uploads.withColumn("owner_id", F.col("requested_by")), i.actors, "uploads")


@query("check_access", """
    SELECT q.l_orderkey AS job_id, q.l_partkey AS actor_id, q.l_linenumber AS line, coalesce(a.organization_id = j.organization_id AND (
      a.role IN ('administrator', 'auditor') OR (a.role = 'issuer' AND j.kind = 'issuance' AND j.owner_id = a.actor_id)
      OR (a.role = 'verifier' AND j.kind = 'verification' AND j.owner_id = a.actor_id)), false) AS visible
    FROM lineitem q LEFT JOIN actors a ON a.actor_id = q.l_partkey LEFT JOIN jobs j ON j.job_id = q.l_orderkey""")
def _(i):
    requests = i.table("lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("actor_id"),
                                          F.col("l_linenumber").alias("line"))
    return A.check_access(requests, i.actors, i.jobs, "jobs", "job_id")


@query("job_list", """
    WITH v AS (SELECT a.actor_id, j.*, row_number() OVER (PARTITION BY a.actor_id ORDER BY j.created_at DESC, j.job_id DESC) AS rn
               FROM actors a JOIN jobs j ON j.organization_id = a.organization_id AND (a.role IN ('administrator', 'auditor')
                 OR (j.owner_id = a.actor_id AND ((a.role = 'issuer' AND j.kind = 'issuance') OR (a.role = 'verifier' AND j.kind = 'verification')))))
    SELECT v.actor_id, v.job_id, v.kind, v.status, r.recipient_email, r.recipient_name, s.verification_status
    FROM v LEFT JOIN issuance_recipients r ON r.issuance_id = v.issuance_id
    LEFT JOIN verification_states s ON s.verification_id = v.verification_id WHERE rn <= 50""")
def _(i):
    listed = A.job_lists(i.actors, i.jobs, i.issuance_recipients, i.verification_states)
    return listed.select("actor_id", "job_id", "kind", "status", "recipient_email", "recipient_name", "verification_status")


@query("recipient_upsert", """
    WITH o AS (SELECT organization_id, lower(trim(email)) AS ref, arg_min(trim(display_name), ordinal) FILTER (trim(display_name) <> '') AS offered
               FROM recipients GROUP BY 1, 2),
    s AS (SELECT organization_id, lower(external_reference) AS ref, display_name FROM known_recipients)
    SELECT coalesce(s.organization_id, o.organization_id) AS organization_id, coalesce(s.ref, o.ref) AS external_reference,
      CASE WHEN trim(coalesce(s.display_name, '')) = '' AND offered IS NOT NULL THEN offered ELSE coalesce(s.display_name, '') END AS display_name,
      CASE WHEN s.ref IS NULL THEN 'created' WHEN trim(coalesce(s.display_name, '')) = '' AND offered IS NOT NULL THEN 'filled' ELSE 'kept' END AS action
    FROM s FULL JOIN o ON s.organization_id = o.organization_id AND s.ref = o.ref""")
def _(i):
    return A.recipient_upsert(i.known_recipients, i.recipients)


@query("tenant_violations", """
    SELECT j.job_id, j.organization_id, i.organization_id AS parent_organization_id FROM issuance_jobs j
    JOIN issuances i ON i.issuance_id = j.issuance_id WHERE i.organization_id <> j.organization_id""")
def _(i):
    return A.tenant_violations(i.issuance_jobs, i.issuances, "issuance_id").select("job_id", "organization_id", "parent_organization_id")
