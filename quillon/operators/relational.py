"""Relational building blocks shared by the queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.session import settled


def in_list(col: Column, values: list) -> Column:
    """``col IN values``; an empty list is false for every row."""
    return col.isin(values) if values else F.lit(False)


def row_greater(left: list[Column], right: list[Column]) -> Column:
    """Row-value comparison ``(l1, l2, ..) > (r1, r2, ..)``."""
    return F.struct(*left) > F.struct(*right)


def exactly_one(a: Column, b: Column) -> Column:
    return a.isNotNull() != b.isNotNull()


def touching(edges: DataFrame, nodes: DataFrame, a: str, b: str, node: str) -> DataFrame:
    """(node, edge) pairs of edges with the node at either end: two equi-joins, since
    an OR condition would plan as a nested loop."""
    left = nodes.join(edges, nodes[node] == edges[a])
    right = nodes.join(edges, (nodes[node] == edges[b]) & ~edges[a].eqNullSafe(edges[b]))
    return left.unionByName(right)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in an order."""
    out = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def at_maximum(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Rows that hold the largest value, of all rows or of their group.

    The global form joins a one-row aggregate, so that no task gets all rows.
    """
    if keys:
        top = df.groupBy(*keys).agg(F.max(value).alias("_top"))
        cond = reduce(lambda x, y: x & y, [df[k].eqNullSafe(top[k]) for k in keys])
        return df.join(top, cond & (df[value] == top["_top"]), "left_semi")
    top = df.agg(F.max(value).alias("_top"))
    return df.join(F.broadcast(top), F.col(value) == F.col("_top"), "left_semi")  # one row


def unique_only(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs once. Counts before the shuffle; no window over a hot key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.any_value(c).alias(c) for c in df.columns if c != key]).where("_n = 1").drop("_n").select(*df.columns)


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def overlapping_pairs(df: DataFrame, keys: list[str], ident: str, start: str, end: str, value: str) -> DataFrame:
    """Pairs (left, right) of rows of one key whose intervals overlap and whose values differ, ``left < right``.

    The equality keys carry the join; the interval test is a residual.
    """
    x, y = df.alias("x"), df.alias("y")
    cond = reduce(lambda p, q: p & q, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys])
    cond &= (F.col(f"x.{ident}") < F.col(f"y.{ident}")) & (F.col(f"x.{value}") != F.col(f"y.{value}"))
    cond &= F.greatest(f"x.{start}", f"y.{start}") <= F.least(f"x.{end}", f"y.{end}")
    return x.join(y, cond).select(*[F.col(f"x.{k}").alias(k) for k in keys], F.col(f"x.{ident}").alias("left"), F.col(f"y.{ident}").alias("right"))


def runs(df: DataFrame, keys: list[str], order: str, value: str, least: int) -> DataFrame:
    """Gaps and islands: (keys, value, first, last, n) of at least ``least`` neighbours with one value; null ends a run."""
    by = W.partitionBy(*keys).orderBy(order)
    within = W.partitionBy(*keys, value).orderBy(order)
    island = F.row_number().over(by) - F.row_number().over(within)
    out = df.withColumn("_island", island).where(F.col(value).isNotNull())
    return out.groupBy(*keys, value, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("_island")


def conflicts_with_first(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """Rows whose value differs from the first one of their scope; ``reference`` is that."""
    first = F.first(value).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return df.withColumn("reference", first).where(F.col(value) != F.col("reference"))


def carry_forward(df: DataFrame, keys: list[str], order: list[Column], when: Column, value: Column, name: str) -> DataFrame:
    """``name``: the value of the last earlier row on which ``when`` holds."""
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(when, value), ignorenulls=True).over(before))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with rows of equal keys replaced by those of ``changes``, and its new rows added."""
    return base.join(changes, keys, "left_anti").unionByName(changes)


def insert_ignore(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` plus rows whose keys are new."""
    return base.unionByName(rows.dropDuplicates(keys).join(base, keys, "left_anti").select(*base.columns))


def replace_source(base: DataFrame, rows: DataFrame, source: str) -> DataFrame:
    """``base`` without the rows of the sources that ``rows`` comes from, plus ``rows``."""
    return base.join(rows.select(source).distinct(), source, "left_anti").unionByName(rows)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status) with status inserted, updated, unchanged or deleted."""
    o, n = old.select(key, F.col(digest).alias("_old")), new.select(key, F.col(digest).alias("_new"))
    status = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "deleted").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("updated")
    return o.join(n, key, "full_outer").select(key, status.alias("status"))


def fallback_match(new: DataFrame, old: DataFrame, keys: list[str], new_id: str, old_id: str) -> DataFrame:
    """(new_id, old_id, rule): match by the first key, what is left by the second, and so on.

    Within a rule the smallest ids pair off first: the k-th new row of a key value takes
    its k-th old row. Both sides of a match leave the pool.
    """
    out = None
    for rule, key in enumerate(keys):
        left = top_per_key(new.where(F.col(key).isNotNull()), [key], [F.col(new_id)], 2**31 - 1, "_k").select(new_id, key, "_k")
        right = top_per_key(old.where(F.col(key).isNotNull()), [key], [F.col(old_id)], 2**31 - 1, "_k").select(old_id, key, "_k")
        hit = left.join(right, [key, "_k"]).select(new_id, old_id, F.lit(rule).alias("rule"))
        out = hit if out is None else out.unionByName(hit)
        new, old = new.join(hit, new_id, "left_anti"), old.join(hit, old_id, "left_anti")
    return out


def resolve_redirects(edges: DataFrame, source: str, target: str, rounds: int = 40) -> DataFrame:
    """Every redirect pointed at its final target, by pointer doubling; each round is written. Raises if some still move after
    ``rounds`` doublings, which only a cycle can cause."""
    up = edges.select(F.col(source).alias("s"), F.col(target).alias("t"))
    for _ in range(rounds):
        nxt = up.alias("a").join(up.alias("b"), F.col("a.t") == F.col("b.s"), "left").select(F.col("a.s").alias("s"), F.coalesce("b.t", "a.t").alias("t"), F.col("b.t").isNotNull().alias("moved"))
        nxt = settled(nxt)
        if not nxt.where("moved").head(1):
            return up.select(F.col("s").alias(source), F.col("t").alias(target))
        up = nxt.select("s", "t")
    raise ValueError("the redirects contain a cycle")
