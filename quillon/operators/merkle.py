"""A Merkle tree that is kept: written levels, of which only paths from changed leaves are hashed again.

A level holds its nodes' digests below the keys of their parents, in folders by a
hash of those. An update appends the leaves that really differ, reads the folders
of their parents only, folds the digests of those parents' children, and goes up
level by level; all of it is one commit. Of several rows of a node the newest
counts, a null digest says that it is gone; ``compact`` leaves the newest only.

Nodes with null keys are nodes like others. Parents without children left are gone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.hashing import merkle_level
from quillon.session import Rounds
from quillon.sources.lease import Lease
from quillon.sources.versions import Store

BUCKETS = 64


@dataclass
class Level:
    """A kind of node: what it is called, its keys, and the column that orders its children."""

    kind: str
    keys: list[str]
    order: str


class MerkleTree:
    """The tree below ``root``; leaves have the keys of the first level, its order, and a digest."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        meta = self.store.meta()
        self.levels = [Level(*x) for x in meta.get("levels", [])]
        self.buckets = meta.get("buckets", BUCKETS)

    @classmethod
    def create(cls, spark: SparkSession, root: str, leaves: DataFrame, levels: list[Level], buckets: int = BUCKETS) -> MerkleTree:
        own = cls(spark, root)
        own.levels, own.buckets = levels, buckets
        rounds = Rounds(spark, "merkle")
        rows = rounds.put(own._leaves(leaves))
        first, hashed = {}, []
        for k, level in enumerate(levels):
            first[f"level{k}"] = own._placed(rows, level, 0)
            rows = rounds.put(own._folded(rows, level))
            hashed.append(rows.count())
        first["top"] = rows.withColumn("seq", F.lit(0))
        own.store.commit(replace=first, expected=0, partition_by={f"level{k}": ["bucket"] for k in range(len(levels))}, meta={"levels": [[x.kind, x.keys, x.order] for x in levels], "buckets": buckets, "seq": 0, "hashed": hashed})
        rounds.last(rows)
        return own

    def _leaves(self, leaves: DataFrame) -> DataFrame:
        level = self.levels[0]
        return leaves.select(*level.keys, level.order, "digest")

    def _bucket(self, level: Level) -> Column:
        return F.pmod(F.xxhash64(*level.keys), F.lit(self.buckets)).cast("int")

    def _placed(self, rows: DataFrame, level: Level, seq: int) -> DataFrame:
        return rows.select(*level.keys, level.order, "digest", F.lit(seq).alias("seq"), self._bucket(level).alias("bucket"))

    def _folded(self, rows: DataFrame, level: Level) -> DataFrame:
        """Digests of the parents, below the keys of theirs."""
        return merkle_level(rows, level.keys, level.order, "digest", level.kind, "digest")

    @staticmethod
    def _newest(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*by).agg(F.max_by("digest", "seq").alias("digest"))

    def current(self, k: int, buckets: list[int] | None = None) -> DataFrame:
        """Nodes of a level as they are, in some folders only if ``buckets`` says which."""
        level = self.levels[k]
        rows = self.store.read(f"level{k}")
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        return self._newest(rows, [*level.keys, level.order]).where("digest IS NOT NULL")

    def roots(self) -> DataFrame:
        """Digests of the topmost nodes."""
        by = self.levels[-1].keys
        return self._newest(self.store.read("top"), by).where("digest IS NOT NULL")

    def update(self, changed: DataFrame | None = None, deleted: DataFrame | None = None, lease: Lease | None = None) -> int:
        """New or other leaves, and leaves (keys, order) that go; the new version is the result. ``store.meta()["hashed"]`` then says how many nodes of each level were hashed."""
        base, meta = self.store.version(), self.store.meta()
        seq, level = meta["seq"] + 1, self.levels[0]
        rounds = Rounds(self.spark, "merkle")
        parts = [] if changed is None else [self._leaves(changed)]
        if deleted is not None:
            gone = deleted.select(*level.keys, level.order)
            parts.append((gone if changed is None else gone.join(changed, [*level.keys, level.order], "left_anti")).withColumn("digest", F.lit(None).cast("string")))
        if not parts:
            return base
        rows = rounds.put(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
        append, hashed = {}, []
        for k, level in enumerate(self.levels):
            node = [*level.keys, level.order]
            buckets = [r[0] for r in rows.select(self._bucket(level).alias("b")).distinct().collect()]  # as many as there are folders
            now = self.current(k, buckets)
            x, y = rows.alias("x"), now.alias("y")
            same = F.lit(True)
            for c in node:
                same &= F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
            differ = x.join(y, same, "left").where(~F.col("x.digest").eqNullSafe(F.col("y.digest"))).select(*[F.col(f"x.{c}").alias(c) for c in (*node, "digest")])
            rows = rounds.put(differ)
            append[f"level{k}"] = self._placed(rows, level, seq)
            parents = rows.select(*level.keys).distinct()
            near = F.lit(True)
            for c in level.keys:
                near &= F.col(f"s.{c}").eqNullSafe(F.col(f"p.{c}"))
            siblings = now.withColumn("seq", F.lit(0)).unionByName(rows.withColumn("seq", F.lit(1))).alias("s").join(parents.alias("p"), near, "left_semi")
            alive = self._newest(siblings, node).where("digest IS NOT NULL")
            folded = rounds.put(self._folded(alive, level))
            hashed.append(folded.count())
            # Parents that have lost all their children.
            empty = parents.alias("s").join(folded.alias("p"), near, "left_anti").withColumn("digest", F.lit(None).cast("string"))
            rows = rounds.put(folded.unionByName(empty))
        append["top"] = rows.withColumn("seq", F.lit(seq))
        version = self.store.commit(append=append, expected=base, lease=lease, partition_by={f"level{k}": ["bucket"] for k in range(len(self.levels))}, meta={"seq": seq, "hashed": hashed})
        rounds.last(rows)
        return version

    def compact(self, lease: Lease | None = None) -> int:
        """Leave the newest row of each node only."""
        base = self.store.version()
        replace = {f"level{k}": self._placed(self.current(k), level, 0) for k, level in enumerate(self.levels)}
        replace["top"] = self.roots().withColumn("seq", F.lit(0))
        return self.store.commit(replace=replace, expected=base, lease=lease, partition_by={f"level{k}": ["bucket"] for k in range(len(self.levels))}, meta={"seq": 0})
