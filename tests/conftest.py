import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from copytrail.session import build_session

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tiny_hot_keys(spark):
    """Treat a key as hot from five rows on, so that small tables take the salted path."""
    spark.conf.set("spark.copytrail.hotRows", "5")
    spark.conf.set("spark.copytrail.salts", "4")
    yield
    spark.conf.unset("spark.copytrail.hotRows")
    spark.conf.unset("spark.copytrail.salts")
