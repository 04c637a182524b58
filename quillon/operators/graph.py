"""Cycles of any length in directed graphs: strongly connected components in written rounds.

A round peels nodes without a predecessor or successor, then contracts chains
(nodes with one of each) to single edges by pointer doubling, so that a ring or a
path of a million events takes some twenty joins. Of what stays, forward colours
(the least node that reaches each) and, within a colour, the nodes that reach its
root are one component; edges between colours go. A graph that has shrunk to
``CORE`` edges is finished by depth-first search in one task.

Contracted nodes belong to the component of both ends of their chain, if that is
one. Nodes may be numbers or texts; null ends are no edges, repeated edges one.

Joins are merges by hint: a round's file of sorted numbers is so small that Spark
would broadcast millions of rows through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import Rounds

#: Edges of a rest that one task may hold.
CORE = 200_000
#: Peeling steps before chains are contracted.
PEEL = 2


def _search(next_of: dict) -> dict:
    """Component (by its least node) of each node on a cycle; depth-first, without recursion."""
    order, low, on, stack, out, count = {}, {}, set(), [], {}, 0
    for root in next_of:
        if root in order:
            continue
        work = [(root, iter(next_of[root]))]
        order[root] = low[root] = count
        count += 1
        stack.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in order:
                    order[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(next_of.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], order[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == order[v]:
                    members = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        members.append(w)
                        if w == v:
                            break
                    if len(members) > 1 or v in next_of.get(v, ()):
                        least = min(members)
                        out.update((m, least) for m in members)
    return out


def _finish(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_of: dict = {}
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                next_of.setdefault(a, []).append(b)
        found = _search(next_of)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), kind), pa.array(list(found.values()), kind)], ["node", "component"])

    return run


def _peeled(e: DataFrame, rounds: Rounds, peel: int) -> tuple[DataFrame, int]:
    n = e.count()
    for _ in range(peel):
        kept = e.join(e.select(F.col("b").alias("a")).distinct().hint("merge"), "a", "left_semi")
        e = rounds.put(kept.join(kept.select(F.col("a").alias("b")).distinct().hint("merge"), "b", "left_semi").select("a", "b"))
        left = e.count()
        if left == n or not left:
            return e, left
        n = left
    return e, n


def _contracted(e: DataFrame, rounds: Rounds) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Edges with chains made single edges; (node, u, v) of the nodes inside, with the ends of their chain; (node, component) of rings that have no other node."""
    out = e.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("ahead")).where("n = 1")
    into = e.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("m"), F.min("a").alias("behind")).where("m = 1")
    inner = rounds.put(out.join(into.hint("merge"), "node").where("ahead <> node").select("node", "ahead", "behind", F.col("node").alias("least")))
    n = inner.count()
    if not n:
        return e, None, None
    p = inner
    for _ in range(max(1, n.bit_length()) + 1):
        f = p.select(F.col("node").alias("ahead"), F.col("ahead").alias("ahead2"), F.col("least").alias("least2"))
        b = p.select(F.col("node").alias("behind"), F.col("behind").alias("behind2"))
        step = p.join(f.hint("merge"), "ahead", "left").join(b.hint("merge"), "behind", "left")
        open_ = F.coalesce("ahead2", "behind2").isNotNull()
        p = rounds.put(step.select("node", F.coalesce("ahead2", "ahead").alias("ahead"), F.coalesce("behind2", "behind").alias("behind"), F.least("least", "least2").alias("least"), open_.alias("open")))
        if p.where("open").isEmpty():
            break
    names = inner.select("node")
    rings = p.join(names.withColumnRenamed("node", "ahead").hint("merge"), "ahead", "left_semi").select("node", F.col("least").alias("component"))
    chains = rounds.put(p.join(names.withColumnRenamed("node", "ahead").hint("merge"), "ahead", "left_anti").select("node", F.col("behind").alias("u"), F.col("ahead").alias("v")))
    rest = e.join(names.withColumnRenamed("node", "a").hint("merge"), "a", "left_anti").join(names.withColumnRenamed("node", "b").hint("merge"), "b", "left_anti").select("a", "b")
    return rounds.put(rest.unionByName(chains.select(F.col("u").alias("a"), F.col("v").alias("b"))).distinct()), chains, rounds.put(rings)


def _coloured(e: DataFrame, rounds: Rounds) -> tuple[DataFrame, DataFrame]:
    """(node, component) of the components that hold their colour's root, and the edges among other nodes of one colour."""
    nodes = e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct()
    colour = rounds.put(nodes.withColumn("colour", F.col("node")))
    while True:
        push = e.join(colour.withColumnRenamed("node", "a").hint("merge"), "a").groupBy(F.col("b").alias("node")).agg(F.min("colour").alias("other"))
        new = rounds.put(colour.join(push.hint("merge"), "node", "left").select("node", F.least("colour", "other").alias("colour"), (F.coalesce(F.col("other") < F.col("colour"), F.lit(False))).alias("changed")))
        colour = new.drop("changed")
        if new.where("changed").isEmpty():
            break
    own = colour.withColumnRenamed("node", "a").withColumnRenamed("colour", "ca")
    other = colour.withColumnRenamed("node", "b").withColumnRenamed("colour", "cb")
    within = rounds.put(e.join(own.hint("merge"), "a").join(other.hint("merge"), "b").where("ca = cb").select("a", "b", F.col("ca").alias("colour")))
    # Backward from the roots, within their colours.
    reach = rounds.put(within.where("a = colour").select(F.col("a").alias("node")).distinct())
    front = reach
    while True:
        more = within.join(front.withColumnRenamed("node", "b").hint("merge"), "b", "left_semi").select(F.col("a").alias("node")).distinct().join(reach.hint("merge"), "node", "left_anti")
        front = rounds.put(more)
        if front.isEmpty():
            break
        reach = rounds.put(reach.unionByName(front))
    found = within.select(F.col("a").alias("node"), "colour").unionByName(within.select(F.col("b").alias("node"), "colour")).distinct().join(reach.hint("merge"), "node", "left_semi")
    # A root alone is a component only with an edge to itself.
    real = within.join(reach.withColumnRenamed("node", "a").hint("merge"), "a", "left_semi").join(reach.withColumnRenamed("node", "b").hint("merge"), "b", "left_semi").select("colour").distinct()
    found = rounds.put(found.join(real.hint("merge"), "colour", "left_semi").select("node", F.col("colour").alias("component")))
    left = within.join(reach.withColumnRenamed("node", "a").hint("merge"), "a", "left_anti").join(reach.withColumnRenamed("node", "b").hint("merge"), "b", "left_anti").select("a", "b")
    return found, rounds.put(left)


def strong_components(edges: DataFrame, source: str, target: str, core: int | None = None, peel: int = PEEL) -> DataFrame:
    """(node, component) of every node on a cycle; a component is named by its least node."""
    spark = edges.sparkSession
    core = CORE if core is None else core
    rounds = Rounds(spark, "graph")
    e = rounds.put(edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct())
    kind = e.schema["a"].dataType.simpleString()
    found, chains = [], []
    while True:
        e, n = _peeled(e, rounds, peel)
        if not n:
            break
        if n <= core:
            arrow = {"string": pa.string(), "int": pa.int32()}.get(kind, pa.int64())
            found.append(rounds.put(e.repartition(1).mapInArrow(_finish(arrow), f"node {kind}, component {kind}")))
            break
        e, inner, rings = _contracted(e, rounds)
        if inner is not None:
            chains.append(inner)
            found.append(rings)
        else:
            own, e = _coloured(e, rounds)
            found.append(own)
    none = spark.createDataFrame([], f"node {kind}, component {kind}")
    known = none
    for f in found:
        known = known.unionByName(f)
    for inner in reversed(chains):
        # Ends may lie inside chains that were contracted later: those are resolved by now.
        u, v = known.select(F.col("node").alias("u"), F.col("component").alias("cu")), known.select(F.col("node").alias("v"), F.col("component").alias("cv"))
        known = rounds.put(known.unionByName(inner.join(u.hint("merge"), "u").join(v.hint("merge"), "v").where("cu = cv").select("node", F.col("cu").alias("component"))))
    least = known.groupBy("component").agg(F.min("node").alias("least"))
    return rounds.last(known.join(least.hint("merge"), "component").select("node", F.col("least").alias("component")))


def _shortest(kind: str, most: int):
    """The shortest cycle through a component's least node, neighbours in order."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        root, next_of = key[0].as_py(), {}
        for a, b in sorted(zip(t.column("a").to_pylist(), t.column("b").to_pylist(), strict=True)):
            next_of.setdefault(a, []).append(b)
        path = None
        if len(t) <= most:
            before, level = {}, [root]
            while level and root not in before:
                following = []
                for v in level:
                    for w in next_of.get(v, ()):
                        if w not in before:
                            before[w] = v
                            following.append(w)
                level = following
            path, at = [root], before[root]
            while at != root:
                path.append(at)
                at = before[at]
            path = [root, *path[:0:-1], root]
        arrow = t.schema.field("a").type
        return pa.table({"component": pa.array([root], arrow), "nodes": pa.array([len(next_of)], pa.int64()), "cycle": pa.array([path], pa.list_(arrow))})

    return run


def cycles(edges: DataFrame, source: str, target: str, most: int = 1_000_000) -> DataFrame:
    """(component, nodes, cycle): of each component its size and the shortest cycle through its least node, which begins and ends it.

    A component's edges meet in one task for that; of one with more than ``most`` edges the cycle is null.
    """
    e = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    c = strong_components(edges, source, target)
    kind = c.schema["node"].dataType.simpleString()
    own = e.join(c.select(F.col("node").alias("a"), "component"), "a").join(c.select(F.col("node").alias("b"), F.col("component").alias("other")), "b").where("component = other").select("component", "a", "b")
    sizes = own.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("a").alias("nodes"))
    own = own.join(sizes, "component")
    small = own.where(F.col("n") <= most).groupBy("component").applyInArrow(_shortest(kind, most), f"component {kind}, nodes long, cycle array<{kind}>")
    large = sizes.where(F.col("n") > most).select("component", "nodes", F.lit(None).cast(f"array<{kind}>").alias("cycle"))
    return small.unionByName(large)
