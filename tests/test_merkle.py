"""A kept Merkle tree against one made anew."""

import random

from pyspark.sql import functions as F

from quillon.functions import hashing as H
from quillon.operators.merkle import Level, MerkleTree
from quillon.session import scratch

LEVELS = [Level("chapter", ["book", "chapter"], "scene"), Level("book", ["book"], "chapter")]
SCHEMA = "book string, chapter int, scene int, text string"


def leaves(spark, rows):
    return spark.createDataFrame([(*k, t) for k, t in rows.items()], SCHEMA).select("book", "chapter", "scene", H.node_hash("scene", F.col("text")).alias("digest"))


def anew(spark, rows):
    rows = leaves(spark, rows)
    for level in LEVELS:
        rows = H.merkle_level(rows, level.keys, level.order, "digest", level.kind, "digest")
    return sorted(map(tuple, rows.collect()), key=repr)


def kept(tree):
    return sorted(map(tuple, tree.roots().collect()), key=repr)


def test_updates_hash_paths_only(spark):
    rng = random.Random(2)
    rows = {(rng.choice(["a", "b", "c", None]), rng.randint(0, 19), s): f"text {s}" for s in range(1000)}
    tree = MerkleTree.create(spark, scratch(spark, "merkle"), leaves(spark, rows), LEVELS, buckets=8)
    assert kept(tree) == anew(spark, rows)
    # One percent changed: at most as many chapters are hashed, and the books.
    some = {k: rows[k] + "!" for k in rng.sample(sorted(rows, key=repr), 10)}
    tree.update(leaves(spark, some))
    rows |= some
    chapters = len({k[:2] for k in some})
    assert kept(tree) == anew(spark, rows) and tree.store.meta()["hashed"] == [chapters, len({k[0] for k in some})] and chapters <= 10
    # What doesn't differ isn't hashed.
    before = kept(tree)
    tree.update(leaves(spark, dict(list(rows.items())[:20])))
    assert tree.store.meta()["hashed"] == [0, 0] and kept(tree) == before
    # New, moved and deleted leaves; a chapter and a book that lose all.
    gone = [k for k in rows if k[0] == "c" or k[:2] == ("a", 3)]
    new = {("d", 1, 5000): "new", ("a", 4, 5001): "new", (None, None, 5002): "no chapter"}
    rows = {k: t for k, t in rows.items() if k not in gone} | new
    tree.update(leaves(spark, new), spark.createDataFrame(gone, "book string, chapter int, scene int"))
    assert kept(tree) == anew(spark, rows)
    again = MerkleTree(spark, tree.store.root)
    again.compact()
    again.store.vacuum()
    assert kept(again) == anew(spark, rows) and again.store.read("level0").count() == len(rows)
    again.update(leaves(spark, {("d", 1, 5000): "newer"}))
    assert kept(again) == anew(spark, rows | {("d", 1, 5000): "newer"})
    assert again.update() == again.store.version()
