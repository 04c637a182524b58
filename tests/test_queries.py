"""Every registered query against its SQL oracle, on the smallest tables."""

import os

import pytest

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="the tables aren't there")

from quillon.plans import registry  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return c


def plain(row):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, ROOT)
    cols = sorted(df.columns)
    rows = sorted((plain(r) for r in df.select(*cols).collect()), key=repr)
    if name in registry.ORACLES:
        got = con.execute(registry.ORACLES[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert rows == sorted((plain(r[i] for i in at) for r in got.fetchall()), key=repr)
