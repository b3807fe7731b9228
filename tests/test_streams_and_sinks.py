"""Streams over several micro-batches and sinks that are written again."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from copytrail.session import materialize, shared_root
from copytrail.sources import readers, sinks
from copytrail.streaming import monitors
from copytrail.streaming import requests as R
from copytrail.streaming.runner import drain, drain_closed, start_batches


def batches(spark, tmp_path, parts, schema):
    """A stream that delivers each list of rows in its own micro-batch."""
    folder = str(tmp_path / "in")
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


REQUESTS = "key string, ts timestamp, event_id bigint"
CHANGES = "job_id bigint, changed_at timestamp, change_id bigint, target string, attempt int"


def limited(spark, stream, limit=2, delay="0 seconds"):
    out = drain_closed(lambda ticks: monitors.rate_limit_stream(stream.unionByName(ticks), limit, 3600, delay), REQUESTS, "t", spark)
    return {r.event_id: r.allowed for r in out.collect()}


def followed(spark, stream, delay="0 seconds"):
    out = drain_closed(lambda ticks: monitors.job_states(stream.unionByName(ticks), delay), CHANGES, "t", spark)
    return {r.change_id: r.error_code for r in out.collect()}


def test_rate_limit_keeps_state_between_batches(spark, tmp_path):
    stream = batches(spark, tmp_path, [[("k", at(0), 1), ("k", at(1), 2)], [("k", at(2), 3), ("k", at(70), 4)]], REQUESTS)
    assert limited(spark, stream) == {1: True, 2: True, 3: False, 4: True}


def test_job_states_keep_the_state_on_rejects(spark, tmp_path):
    stream = batches(spark, tmp_path, [[(1, at(0), 1, "created", 0), (1, at(1), 2, "succeeded", 0)], [(1, at(2), 3, "queued", 0), (1, at(3), 4, "processing", 3)]], CHANGES)
    assert followed(spark, stream) == {1: None, 2: "JOB_TRANSITION", 3: None, 4: "JOB_ATTEMPT"}


def test_no_split_into_batches_changes_a_decision(spark, tmp_path):
    """Rows in one batch, and in reversed and mixed files, one a batch."""
    requests = [(k, at(5 * m), 100 * (k == "b") + m) for k in "ab" for m in range(12)]
    states = ["created", "queued", "succeeded", "processing", "retryable_failed", "queued", "processing", "succeeded"]
    changes = [(j, at(3 * m), 100 * j + m, target, 0) for j in (1, 2) for m, target in enumerate(states)]
    one = limited(spark, batches(spark, tmp_path / "a", [requests], REQUESTS))
    assert sum(one.values()) < len(one) == 24
    assert limited(spark, batches(spark, tmp_path / "b", [requests[12:], requests[:12]][::-1], REQUESTS), delay="2 hours") == one
    assert limited(spark, batches(spark, tmp_path / "c", [requests[::-1][k::3] for k in range(3)], REQUESTS), delay="2 hours") == one
    whole = followed(spark, batches(spark, tmp_path / "d", [changes], CHANGES))
    assert [whole[100 + m] for m in range(8)] == [None, None, "JOB_TRANSITION", None, None, None, None, None]
    assert followed(spark, batches(spark, tmp_path / "e", [changes[::-1][k::2] for k in range(2)], CHANGES), delay="1 hour") == whole


def test_state_is_removed_behind_the_windows(spark, tmp_path):
    rows = [(k, at(m), 10 * i + m) for i, k in enumerate("abc") for m in range(3)]
    stream = batches(spark, tmp_path, [rows, [("z", at(1000), 99)], [("z", at(3000), 98)]], REQUESTS)
    query = monitors.rate_limit_stream(stream, 2, 3600).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert held[0] > 0 and held[-1] <= 2  # the last request waits for the watermark, with its timer


def test_deadline_boundary(spark, tmp_path):
    created = batches(spark, tmp_path / "a", [[(k, at(0)) for k in (1, 2, 3)] + [(9, at(500))]], "key bigint, at timestamp")
    results = batches(spark, tmp_path / "b", [[(1, at(9)), (2, at(10)), (8, at(500))]], "key bigint, at timestamp")
    found = {r.job_id for r in drain(monitors.deadline_monitor(created, results, 600), "t").collect()}
    assert found == {2, 3}


def test_silence_boundary(spark, tmp_path):
    stream = batches(spark, tmp_path, [[(1, at(0)), (1, at(15)), (2, at(0)), (2, at(16)), (3, at(900))]], "key bigint, at timestamp")
    found = sorted((r.key, r.last_seen) for r in drain(monitors.stale_monitor(stream), "t").collect())
    assert found == [(1, at(15)), (2, at(0)), (2, at(16))]


def test_request_without_result_is_missing(spark, tmp_path):
    requests = batches(spark, tmp_path / "a", [[(1, 0, at(0)), (2, 0, at(0)), (9, 0, at(900))]], "job_id bigint, attempt int, requested_at timestamp")
    results = batches(spark, tmp_path / "b", [[(1, 0, at(5), "ok"), (9, 1, at(900), "ok")]], "job_id bigint, attempt int, finished_at timestamp, outcome string")
    found = {r.job_id: r.state for r in drain(R.request_result_join(requests, results, "30 MINUTES"), "t").collect()}
    assert found[1] == "matched" and found[2] == "missing"


def test_result_within_the_grace_is_late(spark, tmp_path):
    asked = batches(spark, tmp_path / "a", [[(k, 0, at(0)) for k in range(4)] + [(9, 0, at(900))]], "job_id bigint, attempt int, requested_at timestamp")
    given = batches(spark, tmp_path / "b", [[(0, 0, at(30), "ok"), (1, 0, at(31), "ok"), (2, 0, at(40), "ok"), (3, 0, at(41), "ok"), (9, 1, at(900), "ok")]],
                    "job_id bigint, attempt int, finished_at timestamp, outcome string")
    found = {r.job_id: r.state for r in drain(R.request_result_join(asked, given, "30 MINUTES", grace="10 MINUTES"), "t").collect()}
    assert {k: found[k] for k in range(4)} == {0: "matched", 1: "late", 2: "late", 3: "missing"}


def test_append_indexed_reads_only_touched_slots(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(200).selectExpr("int(id) AS k", "concat('v', id) AS v")
    sinks.append_indexed(rows, path, ["k"], ["v"], slots=64)
    before = {p for p in (tmp_path / "t").rglob("*.parquet")}
    sinks.append_indexed(rows, path, ["k"], ["v"], slots=64)
    assert {p for p in (tmp_path / "t").rglob("*.parquet")} == before  # a replay writes nothing
    extra = spark.createDataFrame([(7, "other"), (1000, "b"), (1000, "a"), (None, "n"), (None, "m")], "k int, v string")
    one = extra.filter("k = 1000").withColumn("s", F.expr("pmod(xxhash64(k), 64)")).first().s
    for folder in (tmp_path / "t").iterdir():  # slots that the next rows do not touch are not even opened
        if folder.is_dir() and folder.name != f"_slot={one}":
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"broken")
    sinks.append_indexed(extra.filter("k = 1000"), path, ["k"], ["v"], slots=64)
    stored = spark.read.schema("k int, v string, _slot int").parquet(path).filter(F.col("_slot") == one).select("k", "v").collect()
    assert ("a",) in {(r.v,) for r in stored if r.k == 1000} and len([r for r in stored if r.k == 1000]) == 1


def test_append_indexed_keeps_the_first_row_of_a_key(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b", "x"), (1, "a", "y"), (2, "c", None)], "k int, v string, w string")
    for _ in range(2):
        sinks.append_indexed(rows, str(tmp_path / "t"), ["k"], ["v"], slots=4)
    assert sorted(map(tuple, sinks.read_indexed(spark, str(tmp_path / "t")).select("k", "v", "w").collect())) == [(1, "a", "y"), (2, "c", None)]


def test_append_once_ignores_replays(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    for _ in range(2):
        sinks.append_once(rows, path, ["k"], ["v"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c")]


def test_append_once_as_stream_writer(spark, tmp_path):
    stream = batches(spark, tmp_path, [[(1, "a")], [(1, "b"), (2, "c")]], "k int, v string")
    query = start_batches(stream, sinks.append_once_batches(str(tmp_path / "out"), ["k"], ["v"]), str(tmp_path / "c"))
    query.processAllAvailable()
    query.stop()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_malformed_result_line_is_fatal(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"row_id":"a","page_index":0}\n{"row_id":"b","page_index":"x"}\n')
    with pytest.raises(Exception):
        readers.read_results(spark, str(path)).collect()
    path.write_text('{"row_id":"a","odd":1}\n')
    assert [r.member for r in readers.unknown_members(spark, str(path)).collect()] == ["odd"]


def test_read_objects(spark, tmp_path):
    (tmp_path / "o.bin").write_bytes(b"abc")
    row = readers.read_objects(spark, str(tmp_path)).select("length", F.sha2("content", 256).alias("h")).first()
    assert row.length == 3 and row.h.startswith("ba7816bf")


def test_append_only_audit(spark, tmp_path):
    rows = spark.createDataFrame([(1, "o", at(0), '{"role":"issuer","secret":"s"}')], "event_id bigint, organization_id string, created_at timestamp, metadata_json string")
    for _ in range(2):
        sinks.append_audit(rows, str(tmp_path / "a"))
    back = spark.read.parquet(str(tmp_path / "a")).collect()
    assert len(back) == 2 and back[0].metadata == {"role": "issuer"}
    assert not [n for n in dir(sinks) if "update" in n or "delete" in n]


def test_materialize_writes_below_the_shared_folder(spark):
    frame = materialize(spark.range(3).toDF("n"), "t")
    assert all(shared_root(spark) in f for f in frame.inputFiles()) and frame.count() == 3
