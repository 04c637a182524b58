"""SQLite databases as a Spark data source: ``spark.read.format("sqlite")``, after ``register``.

A path names one database, or a folder or pattern of many (works of one universe);
each is read in ranges of rowid, a task a range, by connections that can't write.
The columns of a schema that the caller gives are the only ones selected, and
filters that SQLite decides alike are handed down. Rows come in Arrow batches.

Executors must see the file: on a shared mount, or shipped with ``ship``, which
takes a consistent copy on the driver (write-ahead log included) and hands it to
every executor. A database that is being written is read range by range, each
range at its own moment; ship it, or hold the writer's lease, for one moment.

Types follow the declared ones by SQLite's rules: integer, real, text, blob;
others that hold numbers are doubles, and those that name a date or time texts.
Values that don't fit their column (SQLite lets them be stored) raise an error
with the table and column; with option ``misfit`` = "null" they become null.

Writing (``df.write.format("sqlite").option("table", ...)``) makes one database a
task in a folder: complete ones only, under names that a second attempt of a task
doesn't share; failed jobs delete theirs.
"""

from __future__ import annotations

import glob
import os
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

#: Rows of a range at least, and of an Arrow batch; ranges of a database by default.
LEAST_ROWS, BATCH, RANGES = 10_000, 4096, 8


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def open_read_only(path: str) -> sqlite3.Connection:
    con = sqlite3.connect(f"file:{path.replace('%', '%25').replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True, timeout=5)
    con.execute("PRAGMA query_only = ON")
    return con


def type_of(declared: str) -> T.DataType:
    """The Spark type of a declared column type."""
    d = (declared or "").upper()
    if "INT" in d or "BOOL" in d:
        return T.LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT", "DATE", "TIME", "JSON")):
        return T.StringType()
    if "BLOB" in d:
        return T.BinaryType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return T.DoubleType()
    return T.StringType()


def local(path: str) -> str:
    """A path of the file system, given as such or as a file URI."""
    return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")


def databases(path: str) -> list[str]:
    """The files that a path names; ``SparkFiles`` is asked for shipped ones."""
    path = local(path)
    if path.startswith("shipped:"):
        from pyspark import SparkFiles

        return [SparkFiles.get(path.removeprefix("shipped:"))]
    found = sorted(glob.glob(f"{glob.escape(path)}/*.db")) if os.path.isdir(path) else [path] if os.path.exists(path) else sorted(glob.glob(path))
    if not found:
        raise FileNotFoundError(path)
    return found


def columns(con: sqlite3.Connection, table: str) -> list[tuple[str, str]]:
    got = [(r[1], r[2]) for r in con.execute(f"PRAGMA table_xinfo({quoted(table)})") if r[6] != 1]
    if not got:
        raise ValueError(f"there is no table {table}")
    return got


@dataclass
class Range(D.InputPartition):
    """Rows of a database with low <= rowid < high; all, if low is None."""

    path: str
    low: int | None
    high: int | None


def ranges(path: str, table: str, most: int) -> list[Range]:
    """Even ranges of rowid; views, and tables without rowids, are one."""
    con = open_read_only(databases(path)[0])
    try:
        try:
            low, high, n = con.execute(f"SELECT min(rowid), max(rowid), count(*) FROM {quoted(table)}").fetchone()
        except sqlite3.OperationalError:
            return [Range(path, None, None)]
        kind = con.execute("SELECT type FROM sqlite_schema WHERE name = ?", (table,)).fetchone()
        if kind is None or kind[0] == "view" or low is None:
            return [Range(path, None, None)]
        parts = max(1, min(most, -(-n // LEAST_ROWS)))
        cuts = [low + (high + 1 - low) * k // parts for k in range(parts + 1)]
        # The ends are open: rows that were added since belong to them.
        return [Range(path, None if parts == 1 else (-(2**63) if k == 0 else cuts[k]), 2**63 - 1 if k == parts - 1 else cuts[k + 1]) for k in range(parts)]
    finally:
        con.close()


class Source(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _table(self) -> str:
        if "table" not in self.options:
            raise ValueError("option 'table' is missing")
        return self.options["table"]

    def schema(self) -> T.StructType:
        con = open_read_only(databases(self.options["path"])[0])
        try:
            return T.StructType([T.StructField(n, type_of(d)) for n, d in columns(con, self._table())])
        finally:
            con.close()

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"], self._table(), schema, int(self.options.get("ranges", RANGES)), self.options.get("misfit", "error"), self.options.get("origin"))

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self._table(), schema, overwrite)


_SIMPLE = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}


def condition(f: D.Filter, kinds: dict[str, T.DataType]) -> tuple[str, list] | None:
    """A filter as SQL with parameters, if SQLite decides it as Spark does."""
    if isinstance(f, D.Not):
        inner = condition(f.child, kinds) if isinstance(f.child, (D.EqualTo, D.In, D.IsNull)) else None
        return inner and (f"NOT ({inner[0]})", inner[1])
    at = getattr(f, "attribute", None)
    if at is None or len(at) != 1 or at[0] not in kinds:
        return None
    name, kind = quoted(at[0]), kinds[at[0]]
    if isinstance(f, D.IsNull):
        return f"{name} IS NULL", []
    if isinstance(f, D.IsNotNull):
        return f"{name} IS NOT NULL", []
    # Numbers and texts of the column's own type only; both compare texts by their UTF-8 bytes.
    good = lambda v: isinstance(v, str) and isinstance(kind, T.StringType) or isinstance(v, int) and not isinstance(v, bool) and isinstance(kind, T.LongType) or isinstance(v, float) and v == v and isinstance(kind, T.DoubleType)
    if type(f) in _SIMPLE and good(f.value):
        return f"{name} {_SIMPLE[type(f)]} ? COLLATE BINARY", [f.value]
    if isinstance(f, D.In) and f.value and len(f.value) <= 500 and all(good(v) for v in f.value):
        return f"{name} COLLATE BINARY IN ({', '.join('?' * len(f.value))})", list(f.value)
    return None


class Reader(D.DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType, most: int, misfit: str, origin: str | None):
        self.path, self.table, self.fields, self.most, self.misfit, self.origin = path, table, schema, most, misfit, origin
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        # Where values may become null on reading, SQLite would still see them.
        kinds = {f.name: f.dataType for f in self.fields if f.name != self.origin} if self.misfit == "error" else {}
        for f in filters:
            own = condition(f, kinds)
            if own:
                self.where.append(own)
            else:
                yield f

    def partitions(self) -> list[Range]:
        if self.path.startswith("shipped:"):
            return ranges(self.path, self.table, self.most)
        return [r for p in databases(self.path) for r in ranges(p, self.table, self.most)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        file = databases(part.path)[0]
        con = open_read_only(file)
        try:
            there = {n for n, _ in columns(con, self.table)}
            names = [f.name for f in self.fields]
            picked = ["NULL" if n == self.origin else quoted(n) if n in there else _missing(n, self.table) for n in names]
            where, values = [w for w, _ in self.where], [v for _, vs in self.where for v in vs]
            if part.low is not None:
                where.append("rowid >= ? AND rowid < ?" if part.high < 2**63 - 1 else "rowid >= ? AND rowid <= ?")
                values += [part.low, part.high]
            sql = f"SELECT {', '.join(picked) or '1'} FROM {quoted(self.table)}" + (f" WHERE {' AND '.join(f'({w})' for w in where)}" if where else "")
            cursor = con.execute(sql, values)
            while rows := cursor.fetchmany(BATCH):
                cells = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([self._column(f, c, file) for f, c in zip(self.fields, cells, strict=False)], names)
        finally:
            con.close()

    def _column(self, f: T.StructField, cells: tuple, file: str) -> pa.Array:
        if f.name == self.origin:
            return pa.array([os.path.basename(file)] * len(cells), pa.string())
        kind, takes = next((a, t) for s, a, t in _ARROW if isinstance(f.dataType, s))
        out = []
        for v in cells:
            if v is not None and not isinstance(v, takes):
                if isinstance(f.dataType, T.DoubleType) and isinstance(v, int):
                    v = float(v)
                elif self.misfit != "null":
                    raise ValueError(f"{self.table}.{f.name} holds {v!r}, which is no {f.dataType.simpleString()}")
                else:
                    v = None
            out.append(v)
        return pa.array(out, kind)


_ARROW = ((T.LongType, pa.int64(), int), (T.IntegerType, pa.int32(), int), (T.DoubleType, pa.float64(), float), (T.StringType, pa.string(), str), (T.BinaryType, pa.binary(), bytes))


def _missing(name: str, table: str) -> str:
    raise ValueError(f"{table} has no column {name}")


@dataclass
class Written(D.WriterCommitMessage):
    draft: str
    final: str


class Writer(D.DataSourceArrowWriter):
    """One database a task; names appear when the job commits."""

    def __init__(self, path: str, table: str, schema: T.StructType, overwrite: bool):
        self.path, self.table, self.fields, self.overwrite = local(path), table, schema, overwrite
        bad = [f.name for f in schema if not isinstance(f.dataType, tuple(s for s, *_ in _ARROW))]
        if bad:
            raise ValueError(f"SQLite has no such types: {bad}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.path, exist_ok=True)
        name = uuid.uuid4().hex
        draft, final = f"{self.path}/.{name}.part", f"{self.path}/{name}.db"
        kinds = {T.LongType: "INTEGER", T.IntegerType: "INTEGER", T.DoubleType: "REAL", T.StringType: "TEXT", T.BinaryType: "BLOB"}
        con = sqlite3.connect(draft)
        try:
            con.execute(f"CREATE TABLE {quoted(self.table)} ({', '.join(f'{quoted(f.name)} {kinds[type(f.dataType)]}' for f in self.fields)})")
            put = f"INSERT INTO {quoted(self.table)} VALUES ({', '.join('?' * len(self.fields))})"
            for batch in batches:
                con.executemany(put, zip(*(c.to_pylist() for c in batch.columns), strict=True))
            con.commit()
        finally:
            con.close()
        return Written(draft, final)

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite:
            for old in glob.glob(f"{glob.escape(self.path)}/*.db"):
                os.remove(old)
        for m in messages:
            if m:
                os.replace(m.draft, m.final)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and os.path.exists(m.draft):
                os.remove(m.draft)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters handed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Source)


def sqlite_table(spark: SparkSession, path: str, table: str, picked: list[str] | None = None, origin: str | None = None, **options: str) -> DataFrame:
    """A table of the databases that ``path`` names.

    ``picked``: the columns that are read at all; ``origin``: a column for the file
    that each row is from. Databases must agree in the columns that are read.
    """
    register(spark)
    read = spark.read.format("sqlite").option("table", table).options(**options)
    if picked is None and origin is None:
        return read.load(path)
    known = Source({"path": path, "table": table}).schema()
    fields = [known[c] for c in (picked if picked is not None else known.names)]
    if origin:
        fields.append(T.StructField(origin, T.StringType()))
        read = read.option("origin", origin)
    return read.schema(T.StructType(fields)).load(path)


def ship(spark: SparkSession, path: str) -> str:
    """A consistent copy of one database on every executor; the result is a path for ``sqlite_table``."""
    import tempfile

    name = f"{uuid.uuid4().hex}.db"
    copy = os.path.join(tempfile.mkdtemp(prefix="quillon-ship-"), name)
    source, target = open_read_only(databases(path)[0]), sqlite3.connect(copy)
    try:
        source.backup(target)
    finally:
        source.close()
        target.close()
    spark.sparkContext.addFile(copy)
    return f"shipped:{name}"
