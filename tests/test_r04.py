"""Knowledge files that no task holds whole."""

import hashlib
import io
import json

import pytest

from quillon.operators import sync


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_large_file_is_read_a_window_at_a_time(monkeypatch):
    item = '{"name": "é\\u00e9😀", "x": {"y": [1, -12345.5e+10, null]}}'
    numbers = '{"claims" : [ 1.5e-3 , NaN, -Infinity, 1234567 ] , "entities" : null, "schema_version" : 2 }\n'
    texts = [f'{{"schema_version":1,"entities":[{item},{item}],"claims":[]}}', numbers, "{}", "", '{"entities": [1 2]}', '{"entities": [', '{"entities": []} x', '{"entities": [{"name": "a"}], "entities": [{"name": "b"}]}', "entities:\n- name: a\n", "﻿{}", "{" + " " * 40 + "}"]
    for window in (1, 3, 16):
        monkeypatch.setattr(sync, "WINDOW", window)
        for text in texts:
            assert list(sync._rows(sync._Text(file=io.BytesIO(b"..." + text.encode()), start=3))) == list(sync._rows(text)), (window, text)
    monkeypatch.setattr(sync, "WINDOW", 256)
    text = sync._Text(file=io.BytesIO(('{"claims":[],"entities":[' + ",\n".join([item] * 5000) + "]}").encode()))
    held = [len(text.held) for _ in sync._rows(text)]
    assert len(held) == 5000 and max(held) < 2000


def test_files_come_in_pieces(spark, tmp_path):
    large = json.dumps({"schema_version": 1, "entities": [{"name": f"n{k}", "description": "é" * 90} for k in range(30_000)]}, ensure_ascii=False)
    assert len(large.encode()) > sync.WHOLE
    files = {
        "a b.json": large.encode(), "end.json": b'{"entities":[{"name":"a"}]}\n', "mark.json": b'\xef\xbb\xbf{"entities":[{"name":"a"}]}', "mark end.json": b'\xef\xbb\xbf{"entities":[]} ', "mark only.json": b"\xef\xbb\xbf",
        "é.yaml": "entities:\r\n- {name: é}\r\n- {name: b}\r\n".encode(), "bad.json": b'{"entities":[{"name":"\xff"}]}', "cut.json": b'{"entities":[{"name":"\xc3', "brace.json": b"}",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = sync.items(spark, str(tmp_path))
    assert "content" not in plan_of(got)
    rows = got.collect()
    assert {r.source: r.sha256 for r in rows if r.kind == "file"} == {n: hashlib.sha256(d).hexdigest() for n, d in files.items()}
    assert {r.source: r.item for r in rows if r.kind == "issue" and "UTF-8" in r.item}.keys() == {"bad.json", "cut.json"}
    count = {n: sum(r.kind == "entities" for r in rows if r.source == n) for n in files}
    assert count == {n: 0 for n in files} | {"a b.json": 30_000, "end.json": 1, "mark.json": 1, "é.yaml": 2}
    assert sorted((r.at, json.loads(r.item)["name"]) for r in rows if r.source == "a b.json" and r.kind == "entities") == [(k, f"n{k}") for k in range(30_000)]


def test_a_nation_is_written_line_by_line(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    from pyspark.sql.readwriter import DataFrameWriter

    from quillon.plans import indexes

    class Done(Exception):
        pass

    written, write = {}, DataFrameWriter.text

    def text(self, path, *a, **k):
        written[path] = plan_of(DataFrame(self._df._jdf, spark))
        write(self, path, *a, **k)

    def stop(*a):
        raise Done

    monkeypatch.setattr(DataFrameWriter, "text", text)
    monkeypatch.setattr(indexes.knowledge_sync, "create", stop)
    with pytest.raises(Done):
        indexes.i11_sync(spark, "/root/testdata/sf0.001")
    assert len(written) == 2 and not any("collect_list" in p for p in written.values())
    for path in written:
        for r in spark.read.text(path, wholetext=True).collect():
            assert {len(x) for x in (json.loads(r.value),)} == {4}, r.name


def test_rows_without_a_name_are_spread(spark, tmp_path):
    """A claim without an object has none, whatever the names are."""
    (tmp_path / "a.json").write_text(json.dumps({"schema_version": 1, "entities": [{"name": "\0a.json\x000"}, {"name": "B"}], "claims": [{"subject": "B", "predicate": "p", "scene_uid": "s1", "value": 1}, {"subject": "B", "predicate": "p", "scene_uid": "s1", "object_entity": "b"}]}))
    from quillon.session import scratch

    store = sync.create(spark, scratch(spark, "knowledge"))
    sync.sync(store, sync.items(spark, str(tmp_path)), spark.createDataFrame([("s1", "", True)], "scene string, content string, active boolean"), "w", extract_mentions=False)
    got = {r.at: (r.object, r.value) for r in store.read("claims").collect()}
    assert got[0] == (None, "1") and got[1][0] and got[1][1] is None
