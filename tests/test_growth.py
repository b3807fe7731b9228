"""What grew faster than the input: broadcasts guessed small, sorts of whole input splits, calls to a state for every key."""

import os
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from copytrail.functions.evidence import audit_event_errors
from copytrail.operators import access, regions, scoring
from copytrail.plans import benchmark
from copytrail.sources import sinks
from copytrail.streaming import runner
from copytrail.streaming.monitors import JobStates
from tests.conftest import FOLDER

TABLES = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def under_deepest(text, operator):
    lines = text.split("\n")
    at = max(n for n, line in enumerate(lines) if operator in line)
    return lines[at + 1:at + 3]


@TABLES
@pytest.mark.parametrize("name", ["crop_eligibility", "outbox_match"])
def test_nothing_of_guessed_size_is_broadcast(spark, name):
    assert "BroadcastExchange" not in plan(entry.queries()[name](spark, FOLDER))


def test_sample_sorts_after_its_shuffle(spark):
    tiles = spark.range(40).select((F.col("id") % 2).alias("page_id"), F.col("id").cast("int").alias("tile_index"))
    sampled = regions.keyed_sample(tiles, "k", 3)
    sort, below = under_deepest(plan(sampled), "WindowGroupLimit")
    assert "Sort" in sort and "Exchange" in below
    order = {p: sorted((r for r in range(40) if r % 2 == p), key=lambda t: sha256(f"k\0{p}\0{t}".encode()).hexdigest())[:3] for p in (0, 1)}
    assert {(r.page_id, r.ordinal): r.tile_index for r in sampled.collect()} == {(p, n): t for p, ts in order.items() for n, t in enumerate(ts)}


def test_job_lists_sort_after_their_shuffle(spark):
    jobs = spark.range(300).select(
        F.col("id").alias("job_id"), F.lit("o").alias("organization_id"), F.lit(1).alias("owner_id"), F.lit("issuance").alias("kind"), F.lit("queued").alias("status"),
        F.timestamp_seconds("id").alias("created_at"), F.col("id").cast("string").alias("issuance_id"), F.lit(None).cast("string").alias("verification_id"))
    actors = spark.createDataFrame([(1, "o", "issuer"), (2, "o", "auditor")], "actor_id int, organization_id string, role string")
    recipients = spark.createDataFrame([], "issuance_id string, recipient_email string, recipient_name string")
    states = spark.createDataFrame([], "verification_id string, verification_status string")
    listed = access.job_lists(actors, jobs, recipients, states)
    sort, below = under_deepest(plan(listed), "WindowGroupLimit")
    assert "Sort" in sort and "Exchange" in below
    found = [(r.actor_id, r.job_id) for r in listed.collect()]
    assert sorted(found) == [(a, j) for a in (1, 2) for j in range(250, 300)]


def test_results_are_written_compressed(spark, tmp_path):
    rows = spark.range(5).select(F.col("id").cast("string").alias("row_id"), F.lit(None).cast("string").alias("reason"))
    sinks.write_results(rows, str(tmp_path))
    for kind in ("results.jsonl", "results.csv"):
        parts = [f for f in os.listdir(tmp_path / kind) if f.startswith("part-")]
        assert parts and all(f.endswith(".gz") for f in parts)
    assert spark.read.schema(rows.schema).json(str(tmp_path / "results.jsonl")).count() == 5


def test_long_targets_are_not_counted(spark):
    rows = spark.createDataFrame([("é" * 80,), ("é" * 81,), ("t" * 321,), ("𝄞" * 80,), (None,)], "t string")
    one = F.lit("x")
    errors = audit_event_errors(one, one, one, F.lit(False), one, F.lit("failed"), F.col("t"), one, F.lit("a" * 32))
    assert [r[0] for r in rows.select(F.size(errors)).collect()] == [0, 1, 1, 0, 0]
    assert "octet_length" in plan(rows.select(errors))


class Listed:
    """A list state and a timer service that count the calls made to them."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls += 1
        self.rows = list(rows)

    def appendList(self, rows):
        self.calls += 1
        self.rows += rows

    def clear(self):
        self.calls += 1
        self.rows = []


def test_keys_of_a_slot_share_their_calls():
    import pandas as pd

    states, timers = {}, []

    class Handle:
        def getListState(self, name, schema):
            return states.setdefault(name, Listed())

        def registerTimer(self, at):
            timers.append(at)

    class Now:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

    states_of = JobStates(30)
    states_of.init(Handle())
    keys = [str(k) for k in range(500)] + [None]
    for target, micros in (("created", 1_000_000), ("queued", 5_000_000)):
        rows = pd.DataFrame({"micros": micros, "change_id": 1, "target": target, "attempt": 0, "state_key": keys})
        list(states_of.handleInputRows((0,), iter([rows]), Now(0)))
    early = pd.concat(states_of.handleExpiredTimer((0,), Now(2000), None))
    assert len(early) == 501 and early["error_code"].isna().all() and timers[-1] == 5001
    late = pd.concat(states_of.handleExpiredTimer((0,), Now(6000), None))
    assert set(late["status"]) == {"created"} and late["error_code"].isna().all() and timers[-1] == 35001
    assert list(states_of.handleExpiredTimer((0,), Now(36000), None)) == [] and states["kept"].rows == []
    assert sum(s.calls for s in states.values()) < 20


def test_least_row_id_of_a_plan(spark):
    ids = ["f" * 64, "a" * 15 + "2" + "0" * 48, "a" * 15 + "1" + "0" * 48, "b" * 64]
    rows = spark.createDataFrame([(g, r) for g in ("p", "q", None) for r in (ids if g != "q" else ids[:1])], "g string, row_id string")
    found = benchmark.first_rows(rows, ["g"], F.count("*").alias("n"))
    assert {r.g: (r.n, r.first_row) for r in found.collect()} == {"p": (4, ids[2]), "q": (1, ids[0]), None: (4, ids[2])}


@TABLES
@pytest.mark.parametrize("name", ["pregate_plan_v2", "shard_assign"])
def test_plan_rows_are_not_sorted_for_a_least_text(spark, name):
    under = plan(entry.queries()[name](spark, FOLDER)).split("Generate", 1)[0]
    # Only rows that hold their group's least number are compared as texts, behind the join with those numbers.
    assert "SortAggregate" not in under or "Join" in under.rsplit("SortAggregate", 1)[1]


def test_tiles_are_dealt_by_their_number(spark, monkeypatch):
    corners = [(0.1 * k, 0.05 * k) for k in range(6)]
    rects = spark.createDataFrame([(c, s, x, y, 0.2, 0.3) for c in range(5) for s, at in (("expected", corners), ("predicted", corners[2:])) for x, y in at * 2],
                                  "case_id int, side string, x double, y double, width double, height double")
    whole = {r.case_id: r.iou for r in regions.union_iou(rects, rects).collect()}
    monkeypatch.setattr(regions, "TASK_PIECES", 10)
    dealt = regions.union_iou(rects, rects)
    assert "REPARTITION_BY_NUM" in plan(dealt)
    found = {r.case_id: r.iou for r in dealt.collect()}
    assert found == pytest.approx(whole) and len(found) == 5 and 0 < found[0] < 1
    assert regions._dealt(rects, 95, ["case_id"]).rdd.getNumPartitions() == 10


def test_drained_streams_do_not_count_their_state(spark, tmp_path, monkeypatch):
    queries, dropped = [], runner.dropped_rows
    monkeypatch.setattr(runner, "dropped_rows", lambda query: queries.append(query) or dropped(query))
    spark.range(3).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in")).dropDuplicates()
    assert runner.drain(rows, "distinct").count() == 3
    assert {op["numRowsTotal"] for p in queries[0].recentProgress for op in p["stateOperators"]} == {0}
    assert spark.conf.get(runner.COUNTED) == "true"


def test_schedule_diff_carries_no_text_of_row_ids(spark):
    schema = "fixture_id string, page_index int, profile_id string, attack_id string, row_id string, candidate_id string, expected_id string"
    planned = spark.createDataFrame([(f, 0, "p", "a", f"row-{f}", "c", None) for f in "uvwxy"], schema)
    seen = [("u", "row-u"), ("v", "row-w"), ("w", "row-w"), ("x", "row-x"), ("x", None), ("z", None)]
    observed = spark.createDataFrame([(f, 0, "p", "a", r, "c", None) for f, r in seen], schema)
    diff = scoring.schedule_diff(planned, observed)
    deal = [line for line in plan(diff).split("\n") if "functions=[partial_count(1), partial_min(_id0" in line]
    assert deal and "row_id" not in deal[0]
    assert {(r.fixture_id, r.row_id, r.code) for r in diff.collect()} == {
        ("v", None, "id_mismatch"), ("x", None, "duplicate_key"), ("y", None, "missing"), ("z", None, "unexpected"),
        (None, "row-w", "duplicate_id"), (None, None, "duplicate_id")}
