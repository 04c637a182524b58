import os

import pytest

import __spark_entry__ as entry


def test_registry():
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries) and all(callable(f) for f in queries.values())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the tables aren't there")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "score"] and df.count() > 0
