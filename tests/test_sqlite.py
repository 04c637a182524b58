"""SQLite databases against the rows that were put into them."""

import os
import sqlite3

import pytest
from pyspark.errors import PySparkException

from quillon.sources import sqlite as Q

N = 30_500


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = str(tmp_path_factory.mktemp("db") / "a book #1.db")
    con = sqlite3.connect(p)
    con.execute("PRAGMA journal_mode = WAL")
    con.execute('CREATE TABLE scenes (id INTEGER PRIMARY KEY, title TEXT, share REAL, body BLOB, flag BOOLEAN, "odd ""name" NUMERIC, seen DATETIME)')
    con.executemany("INSERT INTO scenes VALUES (?, ?, ?, ?, ?, ?, ?)", [row(k) for k in range(N)])
    con.execute("CREATE TABLE codes (code TEXT PRIMARY KEY, n INTEGER) WITHOUT ROWID")
    con.executemany("INSERT INTO codes VALUES (?, ?)", [(f"c{k}", k) for k in range(9)])
    con.execute("CREATE VIEW titled AS SELECT id, title FROM scenes WHERE title IS NOT NULL")
    con.execute("CREATE TABLE empty (a INTEGER)")
    con.execute("CREATE TABLE loose (a INTEGER, b TEXT)")
    con.executemany("INSERT INTO loose VALUES (?, ?)", [(1, "x"), ("two", "y"), (None, None), (3, 4.5)])
    con.commit()
    yield p  # the writer stays connected: its rows are still in the write-ahead log
    con.close()


def row(k):
    return (k - 100, None if k % 5 == 0 else f"título {k % 7}", k / 3, bytes([k % 256]), k % 2, k, f"2024-01-{k % 28 + 1:02d}")


def test_reads_what_is_there(spark, path):
    df = Q.sqlite_table(spark, path, "scenes")
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "double", "binary", "bigint", "double", "string"]
    assert df.columns[5] == 'odd "name' and df.rdd.getNumPartitions() == 4
    got = {r[0]: r for r in df.collect()}
    assert len(got) == N and all(tuple(got[k - 100])[:3] == row(k)[:3] and bytes(got[k - 100].body) == row(k)[3] and got[k - 100][5] == k for k in range(0, N, 997))
    assert Q.sqlite_table(spark, path, "codes").count() == 9 and Q.sqlite_table(spark, path, "titled").count() == N - N // 5
    assert Q.sqlite_table(spark, path, "empty").collect() == []


@pytest.mark.parametrize(
    "where",
    ["id > 100 AND id <= 300", "title = 'título 3'", "title <> 'título 3'", "title IS NULL", "title IN ('título 1', 'título 2', 'nada')", "NOT title IN ('título 1')", "share >= 10.5 AND flag = 1",
     "title LIKE 'título%' AND id < 0", "title <=> NULL", "id = 5 OR title = 'título 4'", "length(title) > 3 AND id % 2 = 0", "title > 'título 4'", "flag < 1 AND NOT id = 7"],
)
def test_filters_agree_with_spark(spark, path, where):
    df = Q.sqlite_table(spark, path, "scenes", ["id", "title", "share", "flag"])
    plain = spark.createDataFrame([(r[0], r[1], r[2], r[4]) for r in map(row, range(N))], df.schema).where(where)
    assert sorted(map(tuple, df.where(where).collect())) == sorted(map(tuple, plain.collect()))


def test_columns_and_filters_reach_the_database(path):
    from pyspark.sql import datasource as D
    from pyspark.sql import types as T

    seen, schema = [], T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType())])
    reader = Q.Reader(path, "scenes", schema, 2, "error", None)
    left = list(reader.pushFilters([D.GreaterThan(("id",), 7), D.EqualTo(("title",), "x'; --"), D.StringContains(("title",), "í"), D.EqualTo(("id",), "7"), D.In(("id",), (1, 2))]))
    assert [type(f) for f in left] == [D.StringContains, D.EqualTo] and reader.where[1] == ('"title" = ? COLLATE BINARY', ["x'; --"])
    real, opened = Q.open_read_only, []

    def watched(p):
        con = real(p)
        con.set_trace_callback(seen.append)
        opened.append(con)
        return con

    Q.open_read_only = watched
    try:
        assert [r for part in reader.partitions() for r in reader.read(part)] == []
    finally:
        Q.open_read_only = real
    asked = [s for s in seen if s.startswith('SELECT "id", "title" FROM')]
    assert len(asked) == 2 and all('"id" > 7' in s and "rowid >=" in s for s in asked)


def test_read_only_and_errors(spark, path, tmp_path):
    con = Q.open_read_only(path)
    with pytest.raises(sqlite3.OperationalError):
        con.execute("DELETE FROM scenes")
    con.close()
    with pytest.raises(PySparkException, match="no integer|no bigint"):
        Q.sqlite_table(spark, path, "loose").collect()
    got = sorted(map(tuple, Q.sqlite_table(spark, path, "loose", misfit="null").collect()), key=repr)
    assert got == sorted([(1, "x"), (None, "y"), (None, None), (3, "4.5")], key=repr)
    assert Q.sqlite_table(spark, path, "loose", misfit="null").where("a IS NULL").count() == 2
    with pytest.raises(ValueError, match="no table"):
        Q.sqlite_table(spark, path, "nowhere", ["a"])
    with pytest.raises(Exception, match="nowhere.db"):
        Q.sqlite_table(spark, str(tmp_path / "nowhere.db"), "x").collect()
    assert not os.path.exists(tmp_path / "nowhere.db")


def test_shipped_copy(spark, path):
    """Executors read a copy that holds what the write-ahead log held, and no later rows."""
    at = Q.ship(spark, path)
    con = sqlite3.connect(path)
    con.execute("INSERT INTO empty VALUES (1)")
    con.commit()
    assert Q.sqlite_table(spark, at, "scenes", ["id"]).agg({"id": "sum"}).first()[0] == sum(k - 100 for k in range(N))
    assert Q.sqlite_table(spark, at, "empty").count() == 0 and Q.sqlite_table(spark, path, "empty").count() == 1
    con.execute("DELETE FROM empty")
    con.commit()
    con.close()


def test_many_databases(spark, tmp_path):
    Q.register(spark)
    out = str(tmp_path / "works")
    rows = spark.range(100).selectExpr("id", "CAST(id AS STRING) AS s", "id / 4D AS f", "CAST(CAST(id AS STRING) AS BINARY) AS b", "CAST(NULL AS INT) AS n")
    rows.repartition(3).write.format("sqlite").option("table", "u").mode("append").save(out)
    back = Q.sqlite_table(spark, out, "u", origin="work")
    assert sorted(map(tuple, back.drop("work", "n").collect())) == sorted(map(tuple, rows.drop("n").collect())) and back.select("work").distinct().count() == 3
    rows.limit(5).write.format("sqlite").option("table", "u").mode("overwrite").save(out)
    assert Q.sqlite_table(spark, out, "u").count() == 5 and all(f.endswith(".db") for f in os.listdir(out))
    with pytest.raises(Exception, match="no such types"):
        spark.sql("SELECT array(1) AS a").write.format("sqlite").option("table", "u").mode("append").save(out)
