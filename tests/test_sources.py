import hashlib

import pytest
from pyspark.sql import functions as F

from quillon.functions.python import float_leaf, fold_any, unified_diff
from quillon.operators import assets as X
from quillon.operators import knowledge as K
from quillon.operators import search as S
from quillon.sources import files


def test_texts_and_probe(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("﻿# Á\nx\n".encode())
    (tmp_path / "b.md").write_bytes(b"\xff\xfe bad")
    (tmp_path / "c.md").write_bytes(b"")
    (tmp_path / "d.md").write_bytes(b"one\ntwo")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.texts(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "# Á\nx\n", "d.md": "one\ntwo"}
    probe = {r.path.rsplit("/", 1)[1]: r for r in files.probe(spark, str(tmp_path)).collect()}
    assert probe["d.md"].n_lines == 2 and probe["a.md"].n_lines == 2 and "c.md" not in probe
    assert probe["d.md"].sha256 == hashlib.sha256(b"one\ntwo").hexdigest()


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "set")
    files.write_atomic(spark.range(3), path)
    files.write_atomic(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and len(list(tmp_path.iterdir())) == 1
    files.write_report(spark.range(2), str(tmp_path / "report"))
    log = tmp_path / "log.jsonl"
    log.write_text('{"seq": 1, "kind": "a"}\n{"seq": 2, "kind": "b"}\n')
    assert files.events(spark, str(log), "seq long, kind string").count() == 2


def test_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("a: [1, 2]\n")
    assert files.yaml_config(spark, str(tmp_path / "c.yaml")) == {"a": [1, 2]}


def test_python_functions(spark):
    df = spark.createDataFrame([("a\nb", "a\nc", 0.1), (None, None, None)], "x string, y string, v double")
    got = df.select(unified_diff("x", "y"), fold_any(F.lit("ÀÉß")), float_leaf("v")).collect()
    assert "-b" in got[0][0] and "+c" in got[0][0] and got[1][0] == "" and got[0][1] == "aess" and got[0][2] == (0.1).hex() and got[1][2] is None


def test_embedding_cache(spark):
    p = spark.createDataFrame([("s1", "a"), ("s1", "a"), ("s2", "b")], "sha string, content string")
    cache = spark.createDataFrame([("s2",)], "sha string")
    got = S.embed_pending(p, cache, lambda ts: [[float(len(t))] * 4 for t in ts], 4).collect()
    assert [r.sha for r in got] == ["s1"]


def test_typed_claims_and_reconcile(spark):
    c = spark.createDataFrame([(1, "age", "3", None), (2, "age", '"x"', None), (3, "age", "true", None), (4, "age", None, None), (5, "kin", None, "e"), (6, "age", None, "e"), (7, "new", "{", None)], "id long, predicate string, value string, object_entity string")
    p = spark.createDataFrame([("age", "number"), ("kin", "entity")], "predicate string, value_kind string")
    assert sorted(map(tuple, K.typed_claims(c, p).collect())) == [(2, "wrong_type"), (3, "wrong_type"), (4, "not_exactly_one"), (6, "wrong_type"), (7, "not_json")]
    d = spark.createDataFrame([("w", 1, "r", True, 5), ("w", 2, "r", False, 7), ("w", 3, "r", False, 6)], "work string, doc long, role string, active boolean, updated long")
    here = spark.createDataFrame([(2,), (3,)], "doc long")
    assert sorted((r.doc, r.available, r.active) for r in K.reconcile(d, here).collect()) == [(1, False, False), (2, True, True), (3, True, False)]


def test_balanced_groups(spark):
    df = spark.createDataFrame([([5, 5, 5, 5, 5, 5],), ([100, 1, 1],), ([],)], "s array<int>")
    assert [r[0] for r in df.select(X.balanced_groups(F.col("s"), 3)).collect()] == [[0, 0, 1, 1, 2, 2], [1, 2, 2], []]
