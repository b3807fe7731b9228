"""A stream query gives the same rows whatever files a table is cut into."""

import os

import pytest

import __spark_entry__ as entry
from copytrail.adapters import TABLES
from copytrail.streaming.runner import LateRowsError, drain
from tests.conftest import FOLDER

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
STREAMS = ("ingest_requests", "ingest_rejects", "job_states", "deadline_monitor", "orphan_uploads", "stale_monitor", "rate_limit_stream", "request_result_join", "audit_stream")


@pytest.fixture(scope="module")
def in_four_files(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    for name in TABLES:
        if os.path.exists(f"{FOLDER}/{name}.parquet"):
            rows = spark.read.parquet(f"{FOLDER}/{name}.parquet")
            rows.repartition(4).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", STREAMS)
def test_folder_of_files_gives_the_rows_of_one_file(spark, in_four_files, name):
    one, four = (sorted(map(repr, entry.queries()[name](spark, folder).collect())) for folder in (FOLDER, in_four_files))
    assert one == four and one


def test_draining_fails_when_rows_came_too_late(spark, tmp_path):
    from pyspark.sql import functions as F

    for n, day in enumerate(("2024-03-01", "2024-03-02", "2024-01-01")):
        spark.createDataFrame([(n, day)], "key int, day string").select("key", F.to_timestamp("day").alias("at")).coalesce(1).write.parquet(f"{tmp_path}/{n}")
        os.utime(next(os.path.join(d, f) for d, _, fs in os.walk(f"{tmp_path}/{n}") for f in fs if f.endswith(".parquet")), (n + 1, n + 1))
    stream = spark.readStream.schema("key int, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path))
    counts = stream.withWatermark("at", "1 hour").groupBy("key", F.window("at", "1 day")).count()
    with pytest.raises(LateRowsError):
        drain(counts.select("key", "count"), "late")
