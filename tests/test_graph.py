"""Cycles against reachability by hand."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import graph as G


def by_hand(edges):
    edges = {(a, b) for a, b in edges if a is not None and b is not None}
    next_of = {}
    for a, b in edges:
        next_of.setdefault(a, set()).add(b)

    def reached(v):
        seen, work = set(), [v]
        while work:
            for w in next_of.get(work.pop(), ()):
                if w not in seen:
                    seen.add(w)
                    work.append(w)
        return seen

    reach = {v: reached(v) for v in {x for e in edges for x in e}}
    return sorted((v, min(w for w in reach[v] if v in reach[w])) for v in reach if v in reach[v])


@pytest.mark.parametrize("core", [0, 100])
@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, core, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 59), rng.randint(0, 59)) for _ in range(75)]
    ring = list(range(100, 109))
    edges += [*zip(ring, ring[1:] + ring[:1]), (5, 100), (104, 6), (200, 201), (201, 202), (202, 200), (202, 203), (300, 300), (301, 302), (302, 303)]
    # Two chains between the same ends, and a chain that comes back to where it starts.
    edges += [(400, 401), (401, 402), (402, 403), (400, 404), (404, 403), (403, 400), (400, 400), (500, 501), (501, 502), (502, 500), (500, 503), (503, 504), (504, 505)]
    edges += [(None, 3), (3, None), (200, 201)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted(map(tuple, G.strong_components(df, "a", "b", core=core).collect())) == by_hand(edges)
    assert G.strong_components(df.limit(0), "a", "b", core=core).count() == 0


def test_texts_as_nodes(spark):
    edges = [("b", "a"), ("a", "c"), ("c", "b"), ("c", "d"), ("x", "x")]
    df = spark.createDataFrame(edges, "a string, b string")
    assert sorted(map(tuple, G.strong_components(df, "a", "b").collect())) == by_hand(edges)
    got = {r.component: (r.nodes, r.cycle) for r in G.cycles(df, "a", "b").collect()}
    assert got == {"a": (3, ["a", "c", "b", "a"]), "x": (1, ["x", "x"])}


def test_long_rings_and_paths(spark):
    """A ring of 1,000 events and a path of 100,000, in some dozens of rounds."""
    ring = spark.range(1000).select(F.col("id").alias("a"), ((F.col("id") + 1) % 1000).alias("b"))
    path = spark.range(100_000).select((F.col("id") + 5000).alias("a"), (F.col("id") + 5001).alias("b"))
    off = spark.createDataFrame([(17, 5000)], "a long, b long")
    e = ring.unionByName(path).unionByName(off).repartition(4)
    got = G.strong_components(e, "a", "b", core=0)
    assert got.count() == 1000 and got.agg(F.min("component"), F.max("component"), F.max("node")).first() == (0, 0, 999)
    one = G.cycles(e, "a", "b").collect()
    assert len(one) == 1 and one[0].nodes == 1000 and one[0].cycle == [*range(1000), 0]
    assert G.cycles(e, "a", "b", most=10).first().cycle is None
