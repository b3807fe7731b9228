"""Queries that run streams over the tables until everything available is processed."""

from pyspark.sql import functions as F

from copytrail.catalog import query
from copytrail.catalog.lifecycle import ts, ts_sql
from copytrail.catalog.rules import MESSAGE_ERRORS
from copytrail.streaming import limits, monitors
from copytrail.streaming import requests as R
from copytrail.streaming.runner import drain, drain_closed


@query("ingest_requests", "WITH" + MESSAGE_ERRORS + """
    SELECT DISTINCT body ->> '$.message_id' AS message_id, body ->> '$.job_id' AS job_id FROM errs JOIN checked USING (job_key) WHERE errors = ''""")
def _(i):
    raw = i.stream("messages").select("body", "received_at")
    accepted, _rejected = R.ingest_requests(raw.unionByName(raw))
    return drain(accepted.select("message_id", F.col("m.job_id").alias("job_id")), "ingest")


@query("ingest_rejects", "WITH" + MESSAGE_ERRORS + "SELECT job_key, errors FROM errs WHERE errors <> ''")
def _(i):
    _accepted, rejected = R.ingest_requests(i.stream("messages"))
    return drain(rejected.select("job_key", F.array_join("errors", ",").alias("errors")), "rejects")


EDGE_LIST = """VALUES ('created','queued'), ('created','cancelled'), ('created','failed'), ('queued','processing'), ('queued','cancelled'),
    ('queued','failed'), ('queued','dead_lettered'), ('processing','succeeded'), ('processing','failed'), ('processing','retryable_failed'),
    ('processing','cancelled'), ('retryable_failed','queued'), ('retryable_failed','failed'), ('retryable_failed','dead_lettered'),
    ('retryable_failed','cancelled')"""


@query("job_states", f"""
    WITH RECURSIVE edges(s, t) AS ({EDGE_LIST}),
    h AS MATERIALIZED (SELECT job_id, change_id, status AS target, attempt, row_number() OVER (PARTITION BY job_id ORDER BY changed_at, change_id, status) AS rn FROM job_history),
    walk AS (SELECT job_id, rn, change_id, CAST(NULL AS VARCHAR) AS status, target, CASE WHEN target <> 'created' THEN 'JOB_TRANSITION' END AS error_code FROM h WHERE rn = 1
      UNION ALL SELECT h.job_id, h.rn, h.change_id, CASE WHEN w.error_code IS NULL THEN w.target ELSE w.status END, h.target,
        CASE WHEN CASE WHEN w.error_code IS NULL THEN w.target ELSE w.status END IS NULL THEN CASE WHEN h.target <> 'created' THEN 'JOB_TRANSITION' END
             WHEN NOT EXISTS (SELECT 1 FROM edges e WHERE e.s = CASE WHEN w.error_code IS NULL THEN w.target ELSE w.status END AND e.t = h.target) THEN 'JOB_TRANSITION'
             WHEN CASE WHEN w.error_code IS NULL THEN w.target ELSE w.status END = 'retryable_failed' AND h.target = 'queued' AND h.attempt >= 2 THEN 'JOB_ATTEMPT' END
      FROM walk w JOIN h ON h.job_id = w.job_id AND h.rn = w.rn + 1)
    SELECT job_id, change_id, status, target, error_code FROM walk""")
def _(i):
    changes = i.stream("job_history").select("job_id", "changed_at", "change_id", F.col("status").alias("target"), "attempt")
    changes = changes.withColumn("changed_at", F.col("changed_at").cast("timestamp"))
    schema = "job_id bigint, changed_at timestamp, change_id bigint, target string, attempt int"
    return drain_closed(lambda ticks: monitors.job_states(changes.withColumn("attempt", F.col("attempt").cast("int")).unionByName(ticks)), schema, "states", i.spark)


DAYS = 30


@query("deadline_monitor", f"""
    WITH mark AS (SELECT least((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) - INTERVAL '10' MINUTE AS w)
    SELECT o_orderkey AS job_id, {ts_sql(f"o_orderdate + INTERVAL '{DAYS}' DAY", 'due_at')}, 'failed' AS new_status,
      'DEMO_JOB_DEADLINE_EXCEEDED' AS error_code FROM orders
    WHERE o_orderdate + INTERVAL '{DAYS}' DAY <= (SELECT w FROM mark) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey
      AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL '{DAYS}' DAY)""")
def _(i):
    created = i.stream("orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").cast("timestamp").alias("at"))
    results = i.stream("lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_shipdate").cast("timestamp").alias("at"))
    out = drain(monitors.deadline_monitor(created, results, DAYS * 86400), "deadline")
    return out.select("job_id", ts("due_at"), "new_status", "error_code")


@query("orphan_uploads", f"""
    WITH mark AS (SELECT least(max(o_orderdate), max(o_orderdate + INTERVAL '1' HOUR * (o_custkey % 48))) - INTERVAL '10' MINUTE AS w FROM orders)
    SELECT o_orderkey AS upload_id, {ts_sql("o_orderdate + INTERVAL '24' HOUR", 'eligible_at')} FROM orders
    WHERE o_custkey % 48 >= 24 AND o_orderdate + INTERVAL '24' HOUR <= (SELECT w FROM mark)""")
def _(i):
    orders = i.stream("orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").cast("timestamp").alias("at"), "o_custkey")
    deleted = orders.select("key", F.expr("at + INTERVAL '1' HOUR * (o_custkey % 48)").alias("at"))
    return drain(monitors.orphan_uploads(orders, deleted), "orphans").select("upload_id", ts("eligible_at"))


@query("stale_monitor", f"""
    WITH e AS (SELECT user_id AS k, ts AS at FROM events),
    n AS (SELECT k, at, lead(at) OVER (PARTITION BY k ORDER BY at) AS nxt FROM e), mark AS (SELECT max(ts) - INTERVAL '10' MINUTE AS w FROM events)
    SELECT k AS key, {ts_sql('at', 'last_seen')}, {ts_sql("at + INTERVAL '720' MINUTE", 'stale_at')} FROM n
    WHERE nxt - at > INTERVAL '720' MINUTE OR (nxt IS NULL AND at + INTERVAL '720' MINUTE <= (SELECT w FROM mark))""")
def _(i):
    events = i.stream("events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"))
    return drain(monitors.stale_monitor(events, 720), "stale").select("key", ts("last_seen"), ts("stale_at"))


LIMITED = """
    WITH RECURSIVE h AS MATERIALIZED (SELECT key, event_id, ts, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS rn FROM hits),
    walk AS (SELECT key, event_id, rn, [ts] AS recent, true AS allowed FROM h WHERE rn = 1
      UNION ALL SELECT h.key, h.event_id, h.rn,
        CASE WHEN len(list_filter(w.recent, lambda t: t > h.ts - INTERVAL '1' HOUR)) < 3
             THEN list_append(list_filter(w.recent, lambda t: t > h.ts - INTERVAL '1' HOUR), h.ts)
             ELSE list_filter(w.recent, lambda t: t > h.ts - INTERVAL '1' HOUR) END,
        len(list_filter(w.recent, lambda t: t > h.ts - INTERVAL '1' HOUR)) < 3
      FROM walk w JOIN h ON h.key = w.key AND h.rn = w.rn + 1)
    SELECT key, event_id, allowed FROM walk"""


@query("rate_limit", LIMITED)
def _(i):
    return limits.rate_limit(i.hits, 3, 3600)


SMALL_RATES = {"account": (2, 86400), "source_ip": (3, 86400), "issuance_job": (1, 604800), "verification_job": (1, 604800)}


@query("rate_limit_scopes", f"""
    WITH RECURSIVE rates(scope, most, secs) AS (VALUES {", ".join(f"('{s}', {n}, {t})" for s, (n, t) in SMALL_RATES.items())}),
    keyed AS (SELECT 'account' AS scope, SHA256(account_id) AS key, ts, event_id FROM api_requests WHERE account_id IS NOT NULL
      UNION ALL SELECT 'source_ip', SHA256(source_ip), ts, event_id FROM api_requests
      UNION ALL SELECT job_kind, concat(SHA256(account_id), ':', job_kind), ts, event_id FROM api_requests WHERE account_id IS NOT NULL AND job_kind IS NOT NULL),
    h AS MATERIALIZED (SELECT keyed.*, most, secs, row_number() OVER (PARTITION BY key, scope ORDER BY ts, event_id) AS rn FROM keyed JOIN rates USING (scope)),
    walk AS (SELECT scope, key, event_id, rn, [ts] AS recent, true AS allowed FROM h WHERE rn = 1
      UNION ALL SELECT h.scope, h.key, h.event_id, h.rn,
        CASE WHEN len(list_filter(w.recent, lambda t: t > h.ts - INTERVAL '1' SECOND * h.secs)) < h.most
             THEN list_append(list_filter(w.recent, lambda t: t > h.ts - INTERVAL '1' SECOND * h.secs), h.ts)
             ELSE list_filter(w.recent, lambda t: t > h.ts - INTERVAL '1' SECOND * h.secs) END,
        len(list_filter(w.recent, lambda t: t > h.ts - INTERVAL '1' SECOND * h.secs)) < h.most
      FROM walk w JOIN h ON h.scope = w.scope AND h.key = w.key AND h.rn = w.rn + 1)
    SELECT scope, key, event_id, allowed FROM walk""")
def _(i):
    # Rates tight enough for the test tables' sparse events; the default ones are in constants.RATES.
    return limits.scoped_limits(i.api_requests, SMALL_RATES)


@query("rate_limit_stream", LIMITED)
def _(i):
    hits = i.stream("hits").select("key", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return drain_closed(lambda ticks: monitors.rate_limit_stream(hits.unionByName(ticks), 3, 3600), "key string, ts timestamp, event_id bigint", "limits", i.spark)


@query("request_result_join", f"""
    WITH cut AS (SELECT least((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) - INTERVAL '65' DAY AS c)
    SELECT o_orderkey AS job_id, {ts_sql('o_orderdate', 'requested_at')}, {ts_sql('l_shipdate', 'finished_at')}, l_returnflag AS outcome,
      CASE WHEN l_shipdate IS NULL THEN 'missing' WHEN l_shipdate <= o_orderdate + INTERVAL '45' DAY THEN 'matched' ELSE 'late' END AS state
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber - 1 = o_orderkey % 4 AND l_shipdate >= o_orderdate
      AND l_shipdate <= o_orderdate + INTERVAL '60' DAY WHERE l_shipdate IS NOT NULL OR o_orderdate <= (SELECT c FROM cut)""")
def _(i):
    requests = i.stream("orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") % 4).cast("int").alias("attempt"),
                                         F.col("o_orderdate").cast("timestamp").alias("requested_at"))
    results = i.stream("lineitem").select(F.col("l_orderkey").alias("job_id"), (F.col("l_linenumber") - 1).cast("int").alias("attempt"),
                                          F.col("l_shipdate").cast("timestamp").alias("finished_at"), F.col("l_returnflag").alias("outcome"))
    joined = drain(R.request_result_join(requests, results, "45 DAYS", grace="15 DAYS"), "results")
    # Requests without a result near the end of both streams are still waiting for it when the streams end.
    last = i.table("orders").agg(F.max("o_orderdate").cast("timestamp").alias("t")).unionAll(
        i.table("lineitem").agg(F.max("l_shipdate").cast("timestamp"))).agg(F.min("t"))
    settled = F.col("requested_at") <= last.scalar() - F.expr("INTERVAL '65' DAY")
    return joined.filter(settled | F.col("finished_at").isNotNull()).select(
        "job_id", ts("requested_at"), ts("finished_at"), "outcome", "state")


@query("audit_stream", """
    SELECT event_id, CAST(user_id AS STRING) AS object_size, CASE WHEN user_id % 11 = 0 THEN 'action_invalid' ELSE '' END AS errors FROM events""")
def _(i):
    rows = i.stream("events").select(
        "event_id", F.col("user_id").alias("actor_id"), F.lit("org").alias("organization_id"), F.lit("org").alias("target_organization_id"),
        F.lit(False).alias("is_system"), F.when(F.col("user_id") % 11 == 0, "").otherwise(F.col("event_type")).alias("action"),
        F.lit("succeeded").alias("outcome"), F.lit("job").alias("target_type"), F.col("event_id").cast("string").alias("target_id"),
        F.md5(F.col("event_id").cast("string")).alias("correlation_id"),
        F.concat(F.lit('{"object_size":'), "user_id", F.lit(',"secret":"s","kind":"https://host/x"}')).alias("metadata_json"))
    out = drain(R.audit_stream(rows), "audit")
    return out.select("event_id", F.try_element_at("metadata", F.lit("object_size")).alias("object_size"), F.array_join("errors", ",").alias("errors"))
