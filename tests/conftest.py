"""One small session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def spark():
    from quillon.session import build_session

    session = build_session("local[4]", 4, "tests", **{"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
