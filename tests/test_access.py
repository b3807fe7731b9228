"""Single-actor scopes against the rules, row by row."""

import datetime as dt

import pytest

from copytrail.operators import access as A
from copytrail.operators import lifecycle as L
from copytrail.operators import queues as Q

NOW = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def jobs(spark):
    rows = []
    for n in range(120):
        kind = "issuance" if n % 2 else "verification"
        rows.append((n, f"o{n % 3}", n % 5, kind, "queued", NOW + dt.timedelta(minutes=n), f"i{n}" if n % 2 else None, None if n % 2 else f"v{n}"))
    return spark.createDataFrame(rows, "job_id bigint, organization_id string, owner_id bigint, kind string, status string, created_at timestamp, issuance_id string, verification_id string")


@pytest.mark.parametrize("role", ["administrator", "auditor", "issuer", "verifier", "stranger"])
def test_scope_jobs(jobs, role):
    seen = {r.job_id for r in A.scope_rows(jobs, "jobs", 2, "o1", role).collect()}
    wanted = set()
    for r in jobs.collect():
        if r.organization_id != "o1":
            continue
        own = r.owner_id == 2
        if role in ("administrator", "auditor") or (role == "issuer" and own and r.kind == "issuance") or (role == "verifier" and own and r.kind == "verification"):
            wanted.add(r.job_id)
    assert seen == wanted


def test_scope_filters_reach_the_scan(spark, jobs, tmp_path):
    jobs.write.partitionBy("organization_id").parquet(str(tmp_path / "j"))
    plan = A.scope_rows(spark.read.parquet(str(tmp_path / "j")), "jobs", 2, "o1", "issuer")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(organization_id" in plan and "EqualTo(owner_id,2)" in plan


def test_scope_uploads_and_single_job_list(spark, jobs):
    uploads = spark.createDataFrame([(1, "o1", 2), (2, "o1", 3), (3, "o2", 2)], "upload_id bigint, organization_id string, requested_by bigint")
    assert {r.upload_id for r in A.scope_uploads(uploads, 2, "o1", "auditor").collect()} == {1}
    assert {r.upload_id for r in A.scope_uploads(uploads, 2, "o1", "administrator").collect()} == {1, 2}
    recipients = spark.createDataFrame([("i1", "a@x", "A")], "issuance_id string, recipient_email string, recipient_name string")
    states = spark.createDataFrame([("v118", "NO_WATERMARK")], "verification_id string, verification_status string")
    rows = A.job_list(jobs, recipients, states, 0, "o1", "administrator", limit=3).collect()
    assert [r.job_id for r in rows] == [118, 115, 112] and rows[0].verification_status == "NO_WATERMARK"
    assert [r.job_id for r in A.job_list(jobs, recipients, states, 0, "o1", "administrator", "issuance", 2).collect()] == [115, 109]
    assert A.job_list(jobs, recipients, states, 0, "o1", "administrator", "unknown", 50).count() == 40


def test_limits_are_checked(spark, jobs):
    empty = spark.createDataFrame([], "job_id bigint, state string, safe_error_code string")
    with pytest.raises(ValueError):
        Q.stale_jobs(jobs, empty, L.F.lit(NOW), 101)
    with pytest.raises(ValueError):
        Q.lane_interleave(jobs, jobs, 0)


def test_lanes_alternate_and_yield(spark):
    lane = lambda ids: spark.createDataFrame([(NOW + dt.timedelta(minutes=n), n) for n in ids], "at timestamp, id bigint")
    rows = sorted(Q.lane_interleave(lane([1, 2, 3, 4]), lane([10]), 4, first="reconciliation").collect(), key=lambda r: r.position)
    assert [(r.lane, r.id) for r in rows] == [("reconciliation", 10), ("ordinary", 1), ("ordinary", 2), ("ordinary", 3)]


def test_keyset_wraps(spark):
    rows = spark.createDataFrame([(NOW + dt.timedelta(minutes=n // 2), n) for n in range(6)], "at timestamp, id bigint")
    F = L.F
    take = lambda cursor, k: [r.id for r in Q.keyset_next(rows, "at", "id", F.lit(NOW + dt.timedelta(minutes=cursor[0])), F.lit(cursor[1]), k).collect()]
    assert take((1, 2), 2) == [3, 4] and take((2, 5), 2) == [0, 1] and take((2, 4), 3) == [5, 0, 1]
    assert [r.id for r in Q.keyset_next(rows, "at", "id", None, None, 1).collect()] == [0]
