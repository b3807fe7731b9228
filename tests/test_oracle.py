"""Every registered query against its SQL statement on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from copytrail.adapters import TABLES
from tests.conftest import FOLDER

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    text = [tuple(f"{r[n]:.6f}" if isinstance(r[n], float) else str(r[n]) for n in order) for r in rows]
    return sorted(columns), sorted(text)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_statement(spark, database, name):
    frame = entry.queries()[name](spark, FOLDER)
    got = normal(frame.columns, frame.collect())
    if name not in ORACLES:
        assert got[1]
        return
    cursor = database.execute(ORACLES[name])
    assert got == normal([d[0] for d in cursor.description], cursor.fetchall())


SALTED = ("exact_trace", "resolve_verdict", "manifest_trust", "active_signing_key", "retained_evidence", "trace_modified_copy", "soft_vote",
          "timing_distribution", "union_iou", "partner_ring", "crop_eligibility", "transition_audit", "cancel_triage", "check_access", "job_list", "rate_limit")


@pytest.mark.parametrize("name", SALTED)
def test_salted_paths_give_the_same_rows(spark, database, tiny_hot_keys, name):
    """With nearly every key treated as hot, the statements still hold."""
    test_query_equals_statement(spark, database, name)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
