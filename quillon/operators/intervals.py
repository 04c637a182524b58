"""Overlaps of intervals by sweeping their ends, without pairs.

Two intervals of one key overlap unless one ends before the other starts. So an
interval has as many partners as have started by its end, less those that had
ended before its start, less itself; and the same count among those of its own
value, subtracted, leaves the partners of other values. Both are running sums
over the starts and ends in order.

Keys with up to ``HOT`` rows are summed key by key after a single shuffle. The ends
of a larger one are ranged over partitions by time; running sums are taken within
a partition, and the totals of its earlier partitions are added, so a key with a
third of all rows is summed by as many tasks as it has partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.session import Rounds, tasks_for


#: Rows of a key from which on it is summed by several tasks.
HOT = 200_000
#: Rows of a task on average.
ROWS = 200_000


def _ends(own: DataFrame, keys: list[str], start: str, end: str, value: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Two rows a row: where it starts and where it ends."""
    # An open start comes first as a null; an open end comes last by its flag. At one time starts come before ends.
    edge = lambda late, at, kind: F.struct(late.alias("late"), at.alias("at"), F.lit(kind).alias("kind"))
    both = F.explode(F.array(edge(F.lit(False), F.col(start), 0), edge(F.col(end).isNull(), F.col(end), 1)))
    out = own.select(*keys, F.col(value).alias("_value"), "_row", *more, both.alias("e"))
    return out.withColumns({"starts": (F.col("e.kind") == 0).cast("long"), "stops": (F.col("e.kind") == 1).cast("long")})


_ORDER = ["e.late", "e.at", "e.kind", "_row"]


def _whole(rows: DataFrame, keys: list[str], start: str, end: str, value: str, tasks: int) -> DataFrame:
    """Partners within keys that a task can hold: all steps follow one shuffle by key."""
    # Dealt by a hash of the keys, which all steps name too: a key that is the same everywhere would be left out of some, and they would shuffle again.
    by = ["_key", *keys]
    own = rows.withColumn("_key", F.xxhash64(*keys)).repartition(tasks, "_key").distinct().withColumn("_row", F.monotonically_increasing_id())
    kept = F.struct(*[own[c] for c in rows.columns])
    ends = _ends(own.withColumn("_kept", kept), by, start, end, value, ("_kept",))
    over = lambda own: W.partitionBy(*own).orderBy(*_ORDER).rowsBetween(W.unboundedPreceding, W.currentRow)
    every, same = over(by), over([*by, "_value"])
    counted = ends.withColumns({"a": F.sum("starts").over(every), "o": F.sum("stops").over(every)}).withColumns({"a1": F.sum("starts").over(same), "o1": F.sum("stops").over(same)})
    started = F.max(F.when(F.col("e.kind") == 1, F.col("a") - F.col("a1")))
    ended = F.max(F.when(F.col("e.kind") == 0, F.col("o") - F.col("o1")))
    found = counted.groupBy(*by, "_row").agg(F.first("_kept").alias("_kept"), (started - ended).alias("partners"))
    return found.where("partners > 0").select("_kept.*", "partners")


def partners(rows: DataFrame, keys: list[str], ident: str, start: str, end: str, value: str) -> DataFrame:
    """Rows with ``partners``: how many rows of the key overlap (both ends included) and have another value; those without any are left out.

    A null start or end is open. Rows with a null key or value, and those that end
    before they start, have no partners and are nobody's; equal rows count once.
    """
    good = F.coalesce(F.col(start) <= F.col(end), F.lit(True))
    for c in (*keys, value):
        good &= F.col(c).isNotNull()
    rows = rows.where(good)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    n, most = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    tasks = tasks_for(rows.sparkSession, n, ROWS)
    if most <= HOT:
        return _whole(rows, keys, start, end, value, tasks)
    few = Rounds(rows.sparkSession, "hot").last(sizes.where(F.col("_n") > HOT).drop("_n"))
    return _whole(rows.join(few, keys, "left_anti").select(rows.columns), keys, start, end, value, tasks).unionByName(_ranged(rows.join(few, keys, "left_semi").select(rows.columns), keys, start, end, value, tasks))


def _ranged(rows: DataFrame, keys: list[str], start: str, end: str, value: str, tasks: int) -> DataFrame:
    """Partners within keys of any size: ends ranged by key and time, running sums by partition."""
    spark = rows.sparkSession
    rounds = Rounds(spark, "sweep")
    own = rounds.put(rows.distinct().withColumn("_row", F.monotonically_increasing_id()))
    ends = _ends(own, keys, start, end, value).repartitionByRange(tasks, *keys, *_ORDER)
    ends = rounds.put(ends.withColumn("part", F.spark_partition_id()))
    counted = ends
    for name, by in (("all", keys), ("same", [*keys, "_value"])):
        before = W.partitionBy(*by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        sums = ends.groupBy(*by, "part").agg(F.sum("starts").alias("a"), F.sum("stops").alias("o"))
        sums = sums.select(*by, "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_{name}") for c in ("a", "o")])
        running = W.partitionBy(*by, "part").orderBy(*_ORDER).rowsBetween(W.unboundedPreceding, W.currentRow)
        counted = counted.withColumns({f"starts_{name}": F.sum("starts").over(running), f"stops_{name}": F.sum("stops").over(running)}).join(sums, [*by, "part"])
    n = lambda c, name: F.col(f"{c}_{name}") + F.col(f"{'a' if c == 'starts' else 'o'}_{name}")
    started = F.max(F.when(F.col("e.kind") == 1, n("starts", "all") - n("starts", "same")))
    ended = F.max(F.when(F.col("e.kind") == 0, n("stops", "all") - n("stops", "same")))
    found = counted.groupBy("_row").agg((started - ended).alias("partners")).where("partners > 0")
    return rounds.last(own.join(found, "_row").drop("_row"))
