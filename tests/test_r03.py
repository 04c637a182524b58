"""Queries against their SQL on small tables of odd rows."""

import pytest
from pyspark.sql import functions as F

from quillon.plans import registry

duckdb = pytest.importorskip("duckdb")


def agrees(spark, path, name, **tables):
    """Rows of a query, which must be those of its SQL, over ``tables`` (rows and schema of each)."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, str(path))
    got = con.execute(registry.ORACLES[name])
    at = [[d[0] for d in got.description].index(c) for c in df.columns]
    rows = sorted((tuple(r) for r in df.collect()), key=repr)
    assert rows == sorted((tuple(r[i] for i in at) for r in got.fetchall()), key=repr)
    return rows


def test_titles_with_entities(spark, tmp_path):
    pages = [(1, "<title>a &quot;b&quot; &amp; c</title>"), (2, "<title> *x &lt;y&gt;* </title>"), (3, "<p>none</p>"), (4, "<title>&amp;quot; &#39;</title>")]
    agrees(spark, tmp_path, "c1_clean_title", pages=(pages, "page_id long, html string"))


DOCS = "doc_id long, text string, lang string, source string, n_chars int"
TEXTS = ["of the of the", "out of the of the of the end", "of  the", "Of the.", "of the of  the", "of\tthe\nof the of the x of the", "of the", "", None]
PAIRS = ["The of the of the of x. the of", "the of, the of", "the  of2 the of", "lathe of", "the of the offer the of", "the of _the of_ the of", "", None]


def documents(texts):
    return [(k, t, "de", "web", len(t or "")) for k, t in enumerate(texts)], DOCS


def test_aliases_that_share_a_space(spark, tmp_path):
    rows = agrees(spark, tmp_path, "j13_alias_join", documents=documents([t and f"x {t} y" for t in TEXTS]))
    assert (0, 1) in rows and (1, 2) in rows


def test_connector_pairs_that_share_a_space(spark, tmp_path):
    rows = agrees(spark, tmp_path, "r5_connector_pairs", documents=documents(PAIRS))
    assert (0, 3) in rows


def test_variants_with_large_keys(spark, tmp_path):
    part = [(7, "a", 1000.02), (2_000_001, "a", 1000.03), (9, "b", 5.0), (3, "b", 5.0), (4, "c", None)]
    rows = agrees(spark, tmp_path, "x12_variant_ranking", part=(part, "p_partkey long, p_brand string, p_retailprice double"))
    assert rows == [("a", 7), ("b", 3), ("c", None)]


def test_digests_are_shuffled_not_texts(spark, tmp_path):
    agrees(spark, tmp_path, "v6_aggregate", documents=documents(["a", "b", "a", ""]))
    plan = registry.QUERIES["v6_aggregate"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("bag_hash") < plan.index("Exchange") < plan.index("sha2(")
    assert plan.count("Exchange") == 1


def test_rounds_of_a_graph_broadcast_nothing(spark, monkeypatch):
    from quillon.operators import graph

    plans, put = [], graph.Rounds.put
    monkeypatch.setattr(graph.Rounds, "put", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or put(self, df))
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (4, 6), (6, 7)], "a long, b long")
    got = graph.strong_components(edges, "a", "b", core=0).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


PART = "p_partkey long, p_name string, p_size int"


def test_bars_digit_by_digit(spark, tmp_path):
    agrees(spark, tmp_path, "h7_bars", part=([(k, "x", 1) for k in (0, 1, 7, 123_456, 2_000_001)] + [(None, "x", 1)], PART))
    assert "lambdafunction(" not in plan_of(registry.QUERIES["h7_bars"](spark, str(tmp_path)))


def test_isbns_as_before(spark):
    from quillon.functions.hashing import isbn13

    given = ["0-306-40615-2", "0-306-40615-3", "080442957X", "9780306406157", "9780306406158", "978030640615X", "X123456789", "12", "", None]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(given)], "k int, x string").select("k", isbn13("x").alias("y"))
    assert [r.y for r in rows.orderBy("k").collect()] == ["9780306406157", None, "9780804429573", "9780306406157", None, None, None, None, None, None]


def test_prepress_is_dealt_out(spark, tmp_path):
    agrees(spark, tmp_path, "x10_prepress", part=([(k, "x", k % 51) for k in range(120)], PART))
    df = registry.QUERIES["x10_prepress"](spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "filter(" not in plan_of(df)


def test_log_is_written_by_all_tasks(spark, tmp_path, monkeypatch):
    from quillon.plans import indexes

    paths, scratch = {}, indexes.scratch
    monkeypatch.setattr(indexes, "scratch", lambda s, name: paths.setdefault(name, scratch(s, name)))
    monkeypatch.setattr(indexes, "log_stream", lambda s, path, *a, log_stream=indexes.log_stream: paths.setdefault("n", len(s.read.text(path).inputFiles())) and log_stream(s, path, *a))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        import datetime

        day = lambda k: datetime.datetime(1995, 1, 1) + datetime.timedelta(days=37 * k % 400)
        agrees(spark, tmp_path, "g1_timed", orders=([(k, k % 23, day(k)) for k in range(60)], "o_orderkey long, o_custkey long, o_orderdate timestamp"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert paths["n"] > 2


def test_proposals_with_more_events_than_a_value_holds(spark, tmp_path):
    import json

    from quillon.streaming import proposals as P

    n = P.KEPT + 20
    line = lambda k, day, state="approved": json.dumps({"event_uid": f"u{k}", "proposal_uid": 1, "to_status": state, "created_at": f"2020-01-01T{day // 60:02d}:{day % 60:02d}:00Z"})
    path = tmp_path / "log"
    path.mkdir()
    files = [[line(0, 0, "suggested"), *(line(k, k) for k in range(1, n))], [line(k, k) for k in (0, 1, 2, n - 1)], [json.dumps({"event_uid": "end", "proposal_uid": 2, "to_status": "suggested", "created_at": "2030-01-01T00:00:00Z"})]]
    for k, lines in enumerate(files):
        (path / f"{k}.json").write_text("\n".join(lines))
        import os

        os.utime(path / f"{k}.json", (1_000_000 + k, 1_000_000 + k))
    stream = P.replay_timed(P.log_stream(spark, str(path), 1), 10**9, "1000 days")
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = [(r.uid, r.outcome) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(u for u, o in got if o == "repeated") == sorted(["u0", "u1", "u2", f"u{n - 1}"])
    assert sorted(u for u, o in got if o == "applied")[:2] == ["u0", "u1"]
    assert len([1 for _, o in got if o in ("applied", "illegal")]) == n


def test_files_are_parsed_item_by_item(monkeypatch):
    import json

    from quillon.operators import sync

    def whole(text):
        with monkeypatch.context() as m:
            m.setattr(sync, "_places", lambda text: None)
            return list(sync._rows(text))

    item = '{"name": "é\\u00e9", "aliases": ["a", null], "x": {"y": [1, {}]}}'
    texts = [
        f'{{"schema_version":1,"entities":[{item},{item}],"claims":[]}}', f' {{ "claims" : [ {item} , 3 , "x" ] , "entities" : null, "schema_version" : 2 }}\n', "{}", "[]", "null", "", '{"entities": [1,]}', '{"entities": [1 2]}', '{"entities": [', '{"entities": []',
        '{"entities": [] "claims": []}', '{"entities": []} x', '{"entities": {"a": 1}}', '{"entities": [{"name": "a"}], "entities": [{"name": "b"}]}', '{"entities": [{"name": "b"}], "entities": 7}', '{"personagens": [{"nome": "A", "papel": "p"}, {}]}', '{"entities": [NaN]}', "entities:\n- name: a\n", '{entities: [{name: a}]}', "\ufeff{}", '{"a": 1, }',
    ]
    for text in texts:
        assert list(sync._rows(text)) == whole(text), text
    loaded = []
    monkeypatch.setattr(json, "loads", lambda *a: loaded.append(a))
    assert len(list(sync._rows(texts[0]))) == 2 and not loaded


def test_hunks_without_a_shuffle(spark, monkeypatch):
    from quillon.operators import diff

    plans, last = [], diff.Rounds.last
    monkeypatch.setattr(diff.Rounds, "last", lambda self, df: plans.append(plan_of(df)) or last(self, df))
    rows = [(1, "a\nb\nc\nd", "x\na\nc\nd\ny"), (2, None, "a"), (3, "b\nb\na\nb", "b\na\nb\nb"), (4, "same", "same"), (5, "a\nb\nc", "")]
    got = diff.hunks(spark.createDataFrame(rows, "k long, x string, y string"), "k", "x", "y").orderBy("k", "hunk").collect()
    assert [tuple(r) for r in got] == [
        (1, 1, 1, [], 1, ["x"]), (1, 2, 2, ["b"], 3, []), (1, 3, 5, [], 5, ["y"]), (2, 1, 1, [""], 1, ["a"]), (3, 1, 2, ["b"], 2, []), (3, 2, 4, [], 3, ["b"]), (5, 1, 1, ["a", "b", "c"], 1, [""]),
    ]
    assert plans and "Exchange" not in plans[0]


def test_passages_of_many_texts(spark):
    from quillon.sources import manuscript

    text = "# One\n" + "\n\n".join(f"word {k}" for k in range(2500)) + "\n# Two\nend"
    df = manuscript.passages(spark.createDataFrame([(1, text), (2, None), (3, "# A\nx"), (4, text)], "doc_id long, text string"), target=2)
    assert "MapInArrow" in plan_of(df)
    want = [(d, r["chapter"], r["passage"], r["content"], r["token_count"]) for d, t in ((1, text), (2, ""), (3, "# A\nx"), (4, text)) for r in manuscript.parse(t, target=2)]
    assert len(want) > 2 * manuscript.TOGETHER
    assert sorted(tuple(r) for r in df.select("doc_id", "chapter", "passage", "content", "token_count").collect()) == sorted(want)


def test_tasks_follow_the_rows(spark, tmp_path, monkeypatch):
    from quillon.operators import intervals
    from quillon.plans import production
    from quillon.session import tasks_for

    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [tasks_for(spark, n, 10) for n in (0, 10 * least, 10 * least + 1)] == [least, least, least + 1]
    monkeypatch.setattr(intervals, "ROWS", 10)
    rows = spark.createDataFrame([(k % 7, "main", k, k, k + 9, k % 2) for k in range(200)], "s long, c string, id long, a long, e long, v long").withColumn("c", F.lit("main"))
    out = intervals.partners(rows, ["s", "c"], "id", "a", "e", "v")
    # One shuffle, though a key is the same everywhere.
    assert plan_of(out).count("Exchange") == 1 and ", 20), REPARTITION_BY_NUM" in plan_of(out)
    lines = [(k % 5, k % 3, "ANR"[k % 3]) for k in range(40)]
    asked = []
    monkeypatch.setattr(production, "tasks_for", lambda s, n, each: asked.append(n) or 7)
    agrees(spark, tmp_path, "i13_lineage", lineitem=(lines, "l_partkey long, l_suppkey long, l_returnflag string"))
    assert asked == [40] * len(asked) and asked


def test_probed_files_lie_in_folders_of_tasks(spark, tmp_path, monkeypatch):
    from quillon.plans import files as plans
    from quillon.sources import files

    monkeypatch.setattr(plans, "scratch", lambda _, name: f"file://{tmp_path}/{name}")
    orders = [(n, 10 * (n % 200) + 3) for n in range(700)] + [(700, 4), (701, None)]
    assert len(agrees(spark, tmp_path, "s6_probe", orders=(orders, "o_orderkey long, o_custkey long"))) == 200
    folders = [p for p in (tmp_path / "probe").iterdir() if p.is_dir()]
    written = [p for f in folders for p in f.rglob("*") if p.is_file()]
    assert len(folders) <= 4 and len(written) == 200 and not any(p.suffix == ".crc" for p in written)
    few = spark.conf.get(files._FEW)
    spark.sparkContext.setJobGroup("listed", "")
    try:
        assert files.probe(spark, f"file://{tmp_path}/probe/task=*", deep=True).count() == 200
        listed = spark.sparkContext.statusTracker().getJobIdsForGroup("listed")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # One job lists the folders, however few they are; the rest counts.
    assert len(listed) <= 3 and spark.conf.get(files._FEW) == few


@pytest.mark.parametrize("tokens", ["letters", "folded"])
def test_postings_are_a_row_for_each_term_of_a_slot(spark, monkeypatch, tokens):
    """Whole and right also where a slot's texts are cut in pieces, where texts meet without a space, and after a merge."""
    import re

    from quillon.operators import index as I
    from quillon.session import scratch

    rows = [(f"k{n}", "ab" * (n % 4) + " céu-Azul, x" + "y z y"[: n % 6] + ("" if n % 3 else "\U0001f600b")) for n in range(120)]
    rows += [("none", None), ("empty", ""), ("marks", " ?!, "), ("k3", "a"), ("k5", "zz zz b"), ("long", "long words " * 40), (None, "lost")]
    texts = {}
    for k, t in rows:
        if k and t:
            texts[k] = max(texts.get(k, t), t)
    cut = lambda t: re.findall("[a-z]+", t.lower()) if tokens == "letters" else re.findall(r"[^\W_]+", t.lower().replace("é", "e"))
    want = sorted((w, k, len(cut(t)), [i for i, x in enumerate(cut(t)) if x == w]) for k, t in texts.items() for w in set(cut(t)))
    monkeypatch.setattr(I, "SLOT", 30)
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    for size in (1 << 24, 100):
        monkeypatch.setattr(I, "BYTES", size)
        index = I.TextIndex.create(spark, scratch(spark, "index"), docs, tokens=tokens, buckets=4)
        each = lambda: sorted((r.term, r.doc, r.len, list(r.positions)) for r in index.postings(sorted({w for w, *_ in want})).collect())  # noqa: B023, E731
        assert each() == want and index.store.meta()["words"] == sum(len(p) for *_, p in want)
        stored = index.store.read("postings")
        pairs = stored.select("term", "slot").distinct().count()
        assert pairs < len(want) / 2 and (stored.count() == pairs if size > 100 else pairs < stored.count() < len(want))
        found = [tuple(r) for r in index.search(["b", "zz", "azul"], 5).collect()]
        assert found == [tuple(r) for r in index.search(["b", "zz", "azul"], 5, skip=False).collect()] and len(found) == 5
    index.merge()
    assert each() == want and found == [tuple(r) for r in index.search(["b", "zz", "azul"], 5).collect()]


def test_few_vectors_make_a_file_a_cell(spark, tmp_path):
    from quillon.operators.vector_index import VectorIndex

    rows = [(n, [float(n % 7 + 1), float(n % 11), 1.0 + n % 3]) for n in range(400)]
    index = VectorIndex.create(spark, f"file://{tmp_path}/vectors", spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cells=5)
    files = list(tmp_path.glob("vectors/data/vectors/*/cell=*/*.parquet"))
    assert len(files) == len({f.parent for f in files}) and index.store.meta()["n"] == 400
