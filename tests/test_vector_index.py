"""The vector index against scanning all vectors."""

import numpy as np
import pytest

from quillon.operators import search as S
from quillon.operators.vector_index import VectorIndex
from quillon.session import scratch

SCHEMA = "vec_id long, embedding array<float>"


def vectors(n, dim, groups, seed=3, spread=0.25):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((groups, dim))[rng.integers(0, groups, n)] + spread * rng.standard_normal((n, dim))
    return {k: v.astype(np.float32).tolist() for k, v in enumerate(x)}


def frame(spark, rows):
    return spark.createDataFrame(list(rows.items()), SCHEMA)


def scan(spark, rows, q, k):
    return [tuple(r) for r in S.nearest(frame(spark, rows), q, k).collect()]


def got(index, q, k, **how):
    return [tuple(r) for r in index.search(q, k, **how).collect()]


def test_exact_search_and_changes(spark):
    rows = vectors(600, 8, 12)
    odd = {9001: None, 9002: [], 9003: [0.0] * 8, 9004: [float("nan")] + [1.0] * 7, 9005: [None] + [1.0] * 7, 9006: [1.0] * 7, 9007: [float("inf")] * 8}
    index = VectorIndex.create(spark, scratch(spark, "vectors"), frame(spark, rows | odd))
    assert index.store.meta()["n"] == 600
    rng = np.random.default_rng(9)
    queries = [rows[5], [float(x) for x in rng.standard_normal(8)]]
    for q in queries:
        assert got(index, q, 15, exact=True) == got(index, q, 15, probes=1, exact=True) == scan(spark, rows, q, 15)
    new = {k: [-x for x in rows[k]] for k in range(40)} | {k + 5000: v for k, v in vectors(30, 8, 3, 7, 3.0).items()}
    index.add(frame(spark, new))
    index.delete(spark.createDataFrame([(50,), (51,), (88888,)], "vec_id long"))
    rows = {k: v for k, v in (rows | new).items() if k not in (50, 51)}
    assert index.store.meta()["n"] == len(rows)
    for q in queries:
        assert got(index, q, 15, exact=True) == scan(spark, rows, q, 15)
    index.rebuild()
    assert got(index, queries[0], 700, exact=True) == scan(spark, rows, queries[0], 700)
    with pytest.raises(ValueError, match="entries"):
        index.search([1.0], 3)
    with pytest.raises(ValueError, match="direction"):
        index.search([0.0] * 8, 3)


def test_bounds_leave_cells_unread(spark):
    rows = vectors(800, 6, 16, spread=0.03)
    index = VectorIndex.create(spark, scratch(spark, "vectors"), frame(spark, rows), cells=16)
    read = []
    nearest = index._nearest
    index._nearest = lambda cells, q, k: read.append(len(cells)) or nearest(cells, q, k)
    assert got(index, rows[3], 5, probes=1, exact=True) == scan(spark, rows, rows[3], 5)
    assert sum(read) <= 4


def test_recall_of_the_calibrated_probes(spark):
    """Vectors without any groups are the worst case: probes must rise until recall at 10 is reached."""
    rows = vectors(1500, 16, 1500)
    index = VectorIndex.create(spark, scratch(spark, "vectors"), frame(spark, rows), cells=30)
    ask = {k: rows[k] for k in range(0, 1500, 20)}
    found = {}
    for r in index.search_many(frame(spark, ask).withColumnRenamed("vec_id", "query_id"), 10).collect():
        found.setdefault(r.query_id, set()).add(r.id)
    x = np.array([rows[k] for k in range(1500)], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    true = {k: set(np.argsort(-(x @ x[k]), kind="stable")[:10].tolist()) for k in ask}
    recall = np.mean([len(true[k] & found[k]) / 10 for k in ask])
    probes = index.store.meta()["probes"]
    assert recall >= 0.9 and 1 < probes < 30
    many = sorted((r.id, r.distance) for r in index.search_many(frame(spark, {0: rows[0]}).withColumnRenamed("vec_id", "query_id"), 10, probes=30).collect())
    assert many == sorted(got(index, rows[0], 10, exact=True))


def test_small_and_empty(spark):
    index = VectorIndex.create(spark, scratch(spark, "vectors"), frame(spark, {1: [1.0]}).limit(0))
    assert got(index, [1.0], 3) == []
    index.add(frame(spark, {1: [1.0, 0.0], 2: [0.0, 1.0]}))
    assert got(index, [1.0, 0.1], 5, exact=True) == scan(spark, {1: [1.0, 0.0], 2: [0.0, 1.0]}, [1.0, 0.1], 5)
    same = VectorIndex.create(spark, scratch(spark, "vectors"), frame(spark, {k: [1.0, 1.0] for k in range(30)}))
    assert [i for i, _ in got(same, [1.0, 0.0], 4, exact=True)] == [0, 1, 2, 3]


def test_unit_vectors_cost_as_much_as_they_are_long(spark):
    """An entry must not cost a pass over the vector: of 2,000 entries that took hours."""
    import time

    from pyspark.sql import functions as F

    from quillon.operators.vector_index import _unit

    x = np.random.default_rng(1).standard_normal(2000).tolist()
    began = time.monotonic()
    got = spark.createDataFrame([(x,)], "v array<double>").select(_unit(F.col("v"))).first()[0]
    assert time.monotonic() - began < 30
    assert np.allclose(got, np.array(x) / np.linalg.norm(x), rtol=1e-12, atol=0)


def test_the_fit_takes_a_sample_by_hash(spark, monkeypatch):
    """More vectors than the sample holds: all are indexed, and search is exact."""
    monkeypatch.setattr("quillon.operators.vector_index.SAMPLE", 100)
    rows = vectors(700, 8, 12)
    index = VectorIndex.create(spark, scratch(spark, "vectors"), frame(spark, rows))
    assert index.store.meta()["n"] == 700
    assert got(index, rows[5], 15, exact=True) == scan(spark, rows, rows[5], 15)
