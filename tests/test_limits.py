"""Request limits against a walk over all requests, for sparse, dense and overfull keys, whole and in slices."""

import datetime as dt
import hashlib
import random

import pytest

from copytrail.streaming import limits

START = dt.datetime(2024, 1, 1)
SCHEMA = "key string, ts timestamp, event_id long"


def plain(rows, limit, seconds):
    out, allowed = {}, {}
    for key, ts, event in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        recent = [t for t in allowed.get(key, []) if t > ts - dt.timedelta(seconds=seconds)]
        out[event] = key is None or len(recent) < limit
        if out[event]:
            allowed[key] = [*recent, ts]
    return out


def requests_of(rng, keys, n, gap):
    rows, event = [], 0
    for key in keys:
        at = START
        for _ in range(n):
            at += dt.timedelta(seconds=rng.choice(gap))
            rows.append((key, at, event := event + 1))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("limit,gap", [(1, [0, 1, 5, 40]), (3, [0, 5, 9, 30, 70]), (5, [11, 12, 13]), (5, [3, 4]), (4, [0])])
def test_limits_equal_a_walk_over_all_requests(spark, request, hot, limit, gap):
    if hot:
        request.getfixturevalue("tiny_hot_keys")
    rows = [*requests_of(random.Random(limit), ["a", "b", "c"], 150, gap), ("d", START, 9001), (None, START, 9002), (None, START, 9003)]
    got = {r.event_id: r.allowed for r in limits.rate_limit(spark.createDataFrame(rows, SCHEMA).repartition(3), limit, 60).collect()}
    assert got == plain(rows, limit, 60)


def test_a_dense_key_below_its_limit_needs_no_walk(spark, monkeypatch):
    monkeypatch.setattr(limits, "walk", None)
    rows = [("k", START + dt.timedelta(seconds=k), k) for k in range(3000)]
    found = limits.rate_limit(spark.createDataFrame(rows, SCHEMA), 60, 60)
    assert found.filter("allowed").count() == 3000
    assert limits.rate_limit(spark.createDataFrame([], SCHEMA), 60, 60).collect() == []
    assert [r.allowed for r in limits.rate_limit(spark.createDataFrame(rows[:1], SCHEMA), 0, 60).collect()] == [False]


RATES = {"account": (2, 60), "source_ip": (3, 45), "issuance_job": (1, 90), "verification_job": (0, 60)}
ASKED = "event_id long, ts timestamp, account_id string, source_ip string, job_kind string"


def asked(rng, n):
    kinds = ["issuance_job", "verification_job", None]
    rows, at = [], START
    for event in range(n):
        at += dt.timedelta(seconds=rng.choice([0, 1, 2, 9, 40]))
        rows.append((event, at, rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None]), rng.choice(kinds)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("batch", [3, 10000])
def test_scopes_decided_together_equal_a_walk_of_each(spark, request, hot, batch):
    if hot:
        request.getfixturevalue("tiny_hot_keys")
    rows = asked(random.Random(batch), 400)
    truth = {}
    for scope, (limit, seconds) in RATES.items():
        def key(account, ip, kind):
            return {"account": account, "source_ip": ip or "None"}.get(scope, account if kind == scope else None)
        hits = [(key(*r[2:]), r[1], r[0]) for r in rows if key(*r[2:]) is not None]
        truth |= {(scope, event): allowed for event, allowed in plain(hits, limit, seconds).items()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        timeless = (9000, None, "a", "x", "issuance_job")
        found = limits.scoped_limits(spark.createDataFrame([*rows, timeless], ASKED).repartition(3), RATES).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r.scope, r.event_id): r.allowed for r in found if r.event_id < 9000} == truth
    assert {r.scope: r.allowed for r in found if r.event_id == 9000} == {"account": True, "source_ip": True, "issuance_job": True}
    keys = {(r.scope, r.event_id): r.key for r in limits.scoped_requests(spark.createDataFrame([*rows, timeless], ASKED)).collect()}
    assert {(r.scope, r.event_id): r.key for r in found} == keys and len(found) == len(keys)
    assert keys["account", 9000] == hashlib.sha256(b"a").hexdigest() and keys["issuance_job", 9000] == f"{keys['account', 9000]}:issuance_job"


def test_all_scopes_share_one_shuffle(spark):
    rows = spark.createDataFrame(asked(random.Random(1), 50), ASKED)
    found = limits.scoped_limits(rows, RATES)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("limit", [1, 3])
def test_equal_requests_are_allowed_up_to_the_limit(spark, request, hot, limit):
    if hot:
        request.getfixturevalue("tiny_hot_keys")
    rows = [("k", START + dt.timedelta(seconds=at), 1) for at in (0, 30, 60, 61) for _ in range(8)]
    found = limits.rate_limit(spark.createDataFrame(rows, SCHEMA).repartition(5), limit, 60).collect()
    assert len(found) == 32 and sum(r.allowed for r in found) == 2 * limit
