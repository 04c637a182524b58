"""A vector index that outlives a query: vectors written by cell, searched by nearest cells until a bound proves the result.

Cells are those of k-means over unit vectors (fitted by Spark's own, on a bounded
sample chosen by hash); every vector is written to the folder of its nearest
centre, and a centre keeps the largest distance of its vectors. By the triangle
inequality no vector of a cell is nearer to a query than the centre's distance
less that radius. A search reads the nearest cells first; in exact mode it goes
on to every cell that the k-th distance found so far doesn't rule out.

Tables (of a ``Store``): ``centres`` (cell, centre, radius, n), ``vectors``
(cell, id, embedding, seq; in folders by cell), ``removed`` (id, upto).

Adding, replacing and deleting are commits, as in the inverted index; radii grow
as needed, so bounds hold, but cells drift: ``rebuild`` fits them anew.

Defined results: null and zero vectors, and those with null or non-finite entries
or of another length than the first fit, aren't indexed (a query of another
length raises an error); of rows that share an id in a batch the one with the
largest vector counts; ties by id; an empty index gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.numeric import cosine_distance
from quillon.sources.lease import Lease
from quillon.sources.versions import Store

#: Cells at most (their centres are handed to tasks), rows that they are fitted on at most, rounds of the fit.
MOST_CELLS, SAMPLE, ROUNDS = 4096, 100_000, 10
#: Tasks that a cell's vectors are dealt to at most, and vectors of a batch for each of them.
SPREAD, CROWD = 8, 50_000
#: Queries that probes are calibrated on, neighbours of each, and the part of those that must be found.
QUERIES, NEIGHBOURS, RECALL = 64, 10, 0.95
#: Distances are compared after rounding to six digits.
ROUNDING = 2e-6


def _usable(vec: Column, dim: int | None = None) -> Column:
    v = vec.cast("array<double>")
    fine = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))) & F.exists(v, lambda c: c != 0)
    return F.coalesce(fine & (F.lit(True) if dim is None else F.size(v) == dim), F.lit(False))


def _unit(vec: Column) -> Column:
    # A lambda computes anew, for each entry, what it takes from outside: an array of one gives such a value a name.
    named = lambda c, then: F.get(F.transform(F.array(c), then), F.lit(0))
    by = lambda v, size: F.transform(v, lambda c: c / size)
    whole = lambda v: named(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, c: a + c * c)), lambda size: by(v, size))
    return named(vec.cast("array<double>"), lambda v: named(F.array_max(F.transform(v, F.abs)), lambda top: named(by(v, top), whole)))


class VectorIndex:
    """The index below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    @classmethod
    def create(cls, spark: SparkSession, root: str, rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cells: int | None = None, recall: float = RECALL) -> VectorIndex:
        """A new index; ``cells``: how many (the root of the number of vectors by default); ``recall``: what the default number of probes must reach."""
        own = cls(spark, root)
        if own.store.version():
            raise FileExistsError(root)
        own._build(own._given(rows, id_col, vec_col), cells, recall, expected=0)
        return own

    def rebuild(self, cells: int | None = None, lease: Lease | None = None) -> int:
        """Fit the cells anew on what is there, and write it again."""
        rows = self._alive(self.store.read("vectors")).select("id", "embedding")
        return self._build(rows, cells, self.store.meta()["recall"], self.store.version(), lease)

    def _given(self, rows: DataFrame, id_col: str, vec_col: str, dim: int | None = None) -> DataFrame:
        given = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("embedding")).where(F.col("id").isNotNull() & _usable(F.col("embedding"), dim))
        return given.groupBy("id").agg(F.max("embedding").alias("embedding"))

    def _build(self, rows: DataFrame, cells: int | None, recall: float, expected: int, lease: Lease | None = None) -> int:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        seq = self.store.meta()["seq"] + 1 if expected else 1
        n = rows.count()
        place = F.xxhash64("id")
        first = rows.select(F.size("embedding"), place, "id").orderBy(place, "id").first() if n else None
        # About SAMPLE rows by hash, without a sort: they stay in as many tasks as they were.
        sample = rows if n <= SAMPLE else rows.where(F.pmod(place, F.lit(1 << 30)) < F.lit(int(SAMPLE / n * (1 << 30))))
        dim = first[0] if first else 0
        rows = rows.where(F.size("embedding") == dim)
        wanted = max(1, min(MOST_CELLS, cells or round(n**0.5)))
        centres = np.zeros((0, dim))
        if n:
            train = sample.where(F.size("embedding") == dim).select(array_to_vector(_unit(F.col("embedding"))).alias("features")).cache()
            centres = np.array(KMeans(k=wanted, maxIter=ROUNDS, seed=7, initSteps=2).fit(train).clusterCenters()) if wanted > 1 else np.array([np.mean([r[0].toArray() for r in train.limit(1000).collect()], axis=0)])
            train.unpersist()
        meta = {"seq": seq, "dim": dim, "n": 0, "dead": False, "recall": recall, "probes": 1}
        kind = rows.schema["id"].dataType.simpleString()
        replace = {"removed": self.spark.createDataFrame([], f"id {kind}, upto int")}
        segment, assigned = self._write(rows, n, centres, seq, expected)
        found = assigned.groupBy("cell").agg(F.max("far"), F.count(F.lit(1))).collect()
        replace["centres"] = self._centres(centres, {c: (far, m) for c, far, m in found})
        meta["n"] = sum(m for _, _, m in found)
        known = {"vectors": [segment]}
        if not expected:
            # The first commit states the schema; the rows are there already.
            self.store.commit(replace={"vectors": assigned.drop("far").limit(0)}, meta=meta, partition_by={"vectors": ["cell"]})
            expected = 1
        version = self.store.commit(replace=replace, meta=meta, expected=expected, lease=lease, segment=segment, written=known, renew=("vectors",))
        if meta["n"]:
            version = self.store.commit(meta={"probes": self._calibrated(recall)}, expected=version, lease=lease)
        return version

    def _write(self, rows: DataFrame, n: int, centres: np.ndarray, seq: int, expected: int) -> tuple[str, DataFrame]:
        """``n`` rows with the cell of each, written by cell, and read again with their distance from its centre."""
        squares = (centres**2).sum(1)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                u = batch.column("unit").flatten().to_numpy().reshape(len(batch), -1)
                d = squares - 2 * u @ centres.T
                cell = d.argmin(1)
                far = np.sqrt(((u - centres[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("embedding"), pa.array(np.full(len(u), seq, np.int32)), pa.array(far), pa.array(cell.astype(np.int32))], ["id", "embedding", "seq", "far", "cell"])

        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        schema = f"id {kinds['id']}, embedding {kinds['embedding']}, seq int, far double, cell int"
        placed = rows.withColumn("unit", _unit(F.col("embedding"))).mapInArrow(assign, schema)
        segment = f"{seq:08d}-{expected}-{uuid.uuid4().hex[:8]}"
        path = f"{self.store.root}/data/vectors/segment={segment}"
        # A crowded cell is dealt to several tasks, by hash of the id; few vectors can't crowd one, and a file for each of its tasks would only cost time.
        tasks, spread = int(self.spark.conf.get("spark.sql.shuffle.partitions")), max(1, min(SPREAD, n // CROWD))
        placed.repartition(tasks, "cell", F.pmod(F.xxhash64("id"), F.lit(spread))).write.partitionBy("cell").parquet(path)
        return segment, self.spark.read.schema(placed.schema).parquet(path)

    def _centres(self, centres: np.ndarray, found: dict[int, tuple[float, int]]) -> DataFrame:
        rows = [(k, c.tolist(), float(found.get(k, (0.0, 0))[0]), int(found.get(k, (0.0, 0))[1])) for k, c in enumerate(centres)]
        return self.spark.createDataFrame(rows, "cell int, centre array<double>, radius double, n long")

    def _cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centres, radii and sizes by cell: at most ``MOST_CELLS`` rows."""
        got = sorted(self.store.read("centres").collect())
        return np.array([r.centre for r in got]).reshape(len(got), self.store.meta()["dim"]), np.array([r.radius for r in got]), np.array([r.n for r in got])

    # --- changes ---------------------------------------------------------------------

    def add(self, rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", lease: Lease | None = None) -> int:
        """Add vectors, or replace those that are known; the new version is the result."""
        meta, expected = self.store.meta(), self.store.version()
        if not meta["n"] and not meta["dim"]:
            return self._build(self._given(rows, id_col, vec_col), None, meta["recall"], expected, lease)
        new = self._given(rows, id_col, vec_col, meta["dim"])
        centres, radius, sizes = self._cells()
        seq = meta["seq"] + 1
        segment, placed = self._write(new, new.count(), centres, seq, expected)
        found = {c: (far, m) for c, far, m in placed.groupBy("cell").agg(F.max("far"), F.count(F.lit(1))).collect()}
        gone = self._known(placed.select("id"))
        lost = gone.count()
        grown = {k: (max(radius[k], found.get(k, (0.0, 0))[0]), sizes[k] + found.get(k, (0.0, 0))[1]) for k in range(len(centres))}
        return self.store.commit(
            replace={"centres": self._centres(centres, grown)}, append={"removed": gone.select("id", F.lit(seq - 1).alias("upto"))} if lost else {},
            meta={"seq": seq, "n": meta["n"] - lost + sum(m for _, m in found.values()), "dead": meta["dead"] or lost > 0}, expected=expected, lease=lease, segment=segment, written={"vectors": [segment]},
        )

    def delete(self, ids: DataFrame, id_col: str = "vec_id", lease: Lease | None = None) -> int:
        """Delete vectors by id; the new version is the result."""
        meta, expected = self.store.meta(), self.store.version()
        gone = self._known(ids.select(F.col(id_col).alias("id")))
        lost = gone.count()
        if not lost:
            return expected
        return self.store.commit(append={"removed": gone.select("id", F.lit(meta["seq"]).alias("upto"))}, meta={"seq": meta["seq"] + 1, "n": meta["n"] - lost, "dead": True}, expected=expected, lease=lease)

    def _known(self, ids: DataFrame) -> DataFrame:
        return self._alive(self.store.read("vectors").select("id", "seq")).select("id").join(ids.distinct(), "id", "left_semi")

    def _alive(self, rows: DataFrame) -> DataFrame:
        if not self.store.meta()["dead"]:
            return rows
        gone = self.store.read("removed").groupBy("id").agg(F.max("upto").alias("upto"))
        return rows.join(gone, "id", "left").where("upto is null or seq > upto").drop("upto")

    # --- search ----------------------------------------------------------------------

    def search(self, query: list[float], k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
        """(id, distance): the ``k`` vectors at the smallest cosine distance among the ``probes`` nearest cells; among all, if ``exact``."""
        meta = self.store.meta()
        if not meta["n"]:
            return self.store.read("vectors").limit(0).select("id", F.lit(0.0).alias("distance"))
        q = np.array(query, float)
        if len(q) != meta["dim"]:
            raise ValueError(f"the query has {len(q)} entries, the index {meta['dim']}")
        if not np.isfinite(q).all() or not q.any():
            raise ValueError("the query has no direction")
        centres, radius, sizes = self._cells()
        far = np.sqrt(((q / np.linalg.norm(q) - centres) ** 2).sum(1))
        order = [int(c) for c in np.argsort(far, kind="stable") if sizes[c]]
        near = order[: probes or meta["probes"]]
        first = self._nearest(near, q, k)
        if not exact:
            return first
        got = first.collect()
        # Unit vectors at cosine distance d are sqrt(2 d) apart.
        reach = np.sqrt(2 * max(0.0, got[-1].distance + ROUNDING)) if len(got) == k else np.inf
        more = [c for c in order[len(near) :] if far[c] - radius[c] <= reach + 1e-9]
        if not more:
            return first
        known = self.spark.createDataFrame(got, first.schema)
        return known.unionByName(self._nearest(more, q, k)).orderBy("distance", "id").limit(k)

    def _nearest(self, cells: list[int], q: np.ndarray, k: int) -> DataFrame:
        rows = self._alive(self.store.read("vectors").where(F.col("cell").isin(cells)))
        at = F.array(*[F.lit(float(x)) for x in q])
        return rows.select("id", F.round(cosine_distance(F.col("embedding"), at), 6).alias("distance")).orderBy("distance", "id").limit(k)

    def search_many(self, queries: DataFrame, k: int, probes: int | None = None, id_col: str = "query_id", vec_col: str = "embedding") -> DataFrame:
        """(query_id, id, distance, rank) for many queries at once: each meets the vectors of its nearest cells, joined by cell."""
        centres, _, sizes = self._cells()
        probes = probes or self.store.meta()["probes"]
        full = np.flatnonzero(sizes)

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                u = batch.column("unit").flatten().to_numpy().reshape(len(batch), -1)
                d = (centres[full] ** 2).sum(1) - 2 * u @ centres[full].T
                m = min(probes, len(full))
                near = full[np.argsort(d, axis=1, kind="stable")[:, :m]].astype(np.int32)
                each = pa.array(np.repeat(np.arange(len(u)), m))
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(each), batch.column("unit").take(each), pa.array(near.ravel())], ["query_id", "unit", "cell"])

        usable = queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("v")).where(_usable(F.col("v"), self.store.meta()["dim"]))
        asked = usable.select("query_id", _unit(F.col("v")).alias("unit"))
        asked = asked.mapInArrow(choose, f"query_id {asked.schema['query_id'].dataType.simpleString()}, unit array<double>, cell int")
        rows = self._alive(self.store.read("vectors")).join(asked, "cell")
        hits = rows.select("query_id", "id", F.round(cosine_distance(F.col("embedding"), F.col("unit")), 6).alias("distance"))
        w = Window.partitionBy("query_id").orderBy("distance", "id")
        return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def _calibrated(self, recall: float) -> int:
        """The least number of probes with which the sample's queries find so large a part of their true neighbours."""
        rows = self._alive(self.store.read("vectors"))
        sample = rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(QUERIES).select("id", _unit(F.col("embedding")).alias("unit")).collect()
        q = np.array([r.unit for r in sample])
        centres, _, sizes = self._cells()
        full = np.flatnonzero(sizes)
        k = NEIGHBOURS

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                u = batch.column("unit").flatten().to_numpy().reshape(len(batch), -1)
                if not len(u):
                    continue
                d = 1 - q @ u.T
                top = np.argsort(d, axis=1, kind="stable")[:, :k]
                at = np.repeat(np.arange(len(q)), top.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(d[at, top.ravel()]), batch.column("cell").take(pa.array(top.ravel()))], ["q", "d", "cell"])

        near = rows.select(_unit(F.col("embedding")).alias("unit"), "cell").mapInArrow(best, "q long, d double, cell int")
        w = Window.partitionBy("q").orderBy("d")
        got = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("q", "cell").collect()
        order = np.argsort(((q[:, None] - centres[None, full]) ** 2).sum(2), axis=1, kind="stable") if len(q) else np.zeros((0, 0))
        place = {(i, int(full[c])): r for i, own in enumerate(order) for r, c in enumerate(own)}
        needed = np.sort([place[r.q, r.cell] + 1 for r in got])
        return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else 1
