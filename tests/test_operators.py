"""Operators on literal rows."""

import uuid
import zlib

import pytest
from pyspark.sql import functions as F

from quillon.functions import hashing as H
from quillon.functions import text as T
from quillon.operators import assets as X
from quillon.operators import governance as G
from quillon.operators import knowledge as K
from quillon.operators import relational as R
from quillon.operators import search as S
from quillon.sources import manuscript as M


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_hashes(spark):
    one = spark.range(1)
    ns = uuid.NAMESPACE_URL
    got = one.select(H.uuid5(ns.hex, F.lit("abc")), H.ean13_check(F.lit("978030640615")), H.isbn13(F.lit("0-306-40615-2")), H.isbn13(F.lit("0-306-40615-3")), F.length(H.ean13_bars(F.lit("9780306406157")))).first()
    assert tuple(got) == (str(uuid.uuid5(ns, "abc")), "7", "9780306406157", None, 95)
    a, b, c = one.select(H.node_hash("x", F.lit(None), F.lit("a")), H.node_hash("x", F.lit(""), F.lit("a")), H.node_hash("x", F.lit("a"), F.lit(""))).first()
    assert len({a, b, c}) == 3


def test_text(spark):
    df = spark.createDataFrame([("  Ação & Reação! ",)], "t string")
    got = df.select(T.slug(F.col("t")), T.fold(F.col("t")), T.squeeze(F.col("t")), T.clean_title(F.lit("<b>**A &amp; B\\.**</b>"))).first()
    assert tuple(got) == ("acao-reacao", "  acao & reacao! ", "Ação & Reação!", "A & B.")


def test_matching(spark):
    new = spark.createDataFrame([(1, "u1", "h1"), (2, None, "h1"), (3, None, "h1"), (4, None, "h9")], "n long, uid string, h string")
    old = spark.createDataFrame([(10, "u1", "hx"), (11, "u2", "h1"), (12, "u3", "h2")], "o long, uid string, h string")
    assert rows(R.fallback_match(new, old, ["uid", "h"], "n", "o")) == [(1, 10, 0), (2, 11, 1)]


def test_redirects(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 4)], "s long, t long")
    assert rows(R.resolve_redirects(edges, "s", "t")) == [(1, 4), (2, 4), (3, 4), (9, 4)]
    with pytest.raises(ValueError):
        R.resolve_redirects(spark.createDataFrame([(1, 2), (2, 1)], "s long, t long"), "s", "t", 5)


def test_merge_and_sinks(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert rows(R.upsert(base, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(R.insert_ignore(base, new, ["k"])) == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(R.snapshot_diff(base, new, "k", "v")) == [(1, "deleted"), (2, "updated"), (3, "inserted")]
    assert rows(R.unique_only(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k long, v string"), "v")) == [(3, "b")]


def test_mentions(spark):
    texts = spark.createDataFrame([(1, "Ana Maria viu Ana. Anabela não."), (2, None)], "doc_id long, text string")
    aliases = spark.createDataFrame([("a", "Ana"), ("b", "ana maria"), ("c", "não")], "entity string, alias string")
    assert rows(K.mentions(texts, aliases)) == [(1, "a", 0, 3), (1, "a", 14, 17), (1, "b", 0, 9), (1, "c", 27, 30)]


def test_continuity_and_cycles(spark):
    c = spark.createDataFrame([(1, "s", "p", None, "x", 2, 0, 5), (2, "s", "p", "main", "y", 2, 5, 9), (3, "s", "q", None, "x", 1, 0, 1), (4, "s", "q", None, "y", 2, 1, 2), (5, "t", "p", None, "x", 1, 0, 1), (6, "t", "p", None, "y", 1, 2, 3)],
                              "id long, subject string, predicate string, continuity string, value string, rank int, starts int, ends int")
    assert rows(K.continuity(c).select("subject", "predicate", "ids", "severity")) == [("s", "p", [1, 2], "error"), ("s", "q", [3, 4], "warning")]
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "a long, b long")
    assert rows(K.reachable(e, "a", "b").where("a = b")) == [(1, 1), (2, 2), (3, 3)]
    moved = K.split_entity(spark.createDataFrame([(1, "Ana"), (1, "Bia")], "entity long, alias string"), ["bia"], 1, 2)
    assert rows(moved) == [(1, "Ana"), (2, "Bia")]
    o = spark.createDataFrame([("k", 1, "a"), ("k", 1, "b"), ("k", 2, "c")], "k string, ord long, id string")
    assert rows(K.next_free_ordinals(o, ["k"], "ord", "id")) == [("k", 1, "a"), ("k", 2, "c"), ("k", 3, "b")]


def test_governance(spark):
    e = spark.createDataFrame([(1, 1, "approved"), (1, 2, "suggested"), (1, 3, "approved"), (1, 4, "rejected"), (1, 5, "superseded")], "p long, o long, s string")
    assert [r.legal for r in G.replay(e, "p", "o", "s").orderBy("o").collect()] == [False, True, True, False, True]
    assert rows(G.current_state(e, "p", "o", "s")) == [(1, "superseded")]
    chain, prev = [], None
    for k in range(4):
        h = spark.range(1).select(G.chain_hash(F.lit(prev).cast("string"), F.lit(f"e{k}"))).first()[0]
        chain.append((1, k, f"e{k}", prev, h))
        prev = h
    schema = "c long, o long, payload string, previous_hash string, event_hash string"
    assert not G.verify_chain(spark.createDataFrame(chain, schema), "c", "o", "payload").collect()
    chain[2] = (*chain[2][:2], "forged", *chain[2][3:])
    assert [r.o for r in G.verify_chain(spark.createDataFrame(chain, schema), "c", "o", "payload").collect()] == [2]


def test_chunks_agree(spark):
    """The fold over arrays and the parser's loop cut alike."""
    cases = [[zlib.crc32(f"{n}-{i}".encode()) % 90 for i in range(n % 23)] for n in range(60)] + [[500], [10] * 30, [60, 60, 60]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "k long, sizes array<int>")
    for overlap in (0, 1, 2):
        got = {r.k: [tuple(x) for x in r.c] for r in df.select("k", X.greedy_chunks(F.col("sizes"), 100, overlap).alias("c")).collect()}
        assert got == {i: M.chunks(c, 100, overlap) for i, c in enumerate(cases)}, overlap


def test_manuscript(spark):
    text = "---\na: b\n---\nbefore\n\n# One\n\nfirst para\n\nsecond\n<!-- scene:UID-1 title=\"S\" -->\nthird\n# One\nend\n```\n# not a heading\n```\n"
    got = M.parse(text)
    assert [(r["chapter_key"], r["scene"], r["scene_uid"]) for r in got] == [("preambulo", 0, None), ("one", 0, None), ("one", 1, "UID-1"), ("one-2", 0, None)]
    for r in got:
        assert text.splitlines()[r["start_line"] - 1].strip() == r["content"].splitlines()[0].strip()
    assert M.parse("") == [] and M.parse("plain")[0]["chapter_title"] == "Documento"
    numbered = "# Parte\n## 1. a\nx\n## 2. b\ny\n## 3. c\nz"
    assert [r["chapter_title"] for r in M.parse(numbered) if r["chapter_title"] != "Preâmbulo"] == ["1. a", "2. b", "3. c"]
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    assert M.passages(df).count() == len(got)


def test_search(spark):
    docs = spark.createDataFrame([(1, "rare word here", "a"), (2, "word word", "a"), (3, "word rare", "a"), (4, None, "b")], "doc_id long, text string, source string")
    assert [r.doc_id for r in S.bm25_top_k(docs, ["rare"], 5).collect()] == [3, 1]
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "doc_id long, embedding array<float>")
    assert [r.doc_id for r in S.nearest(vec, [1.0, 0.1], 5, "doc_id").collect()] == [1, 2]
    hits = S.hybrid(docs, vec, ["rare"], [1.0, 0.0], "source", 8, 2).collect()
    assert len([h for h in hits if h.source == "a"]) == 2
    live = spark.createDataFrame([(1, False, 3), (2, True, 1), (3, True, 2)], "doc_id long, active boolean, priority int")
    assert [r.doc_id for r in S.active_documents(live).collect()] == [3]
    assert S.active_documents(live.where("NOT active")).count() == 1


def test_preflight(spark):
    a = spark.createDataFrame([("ok", 1200, 1200, "RGB", True, 100.0, 100.0), ("low", 100, 100, "RGB", True, 100.0, 100.0), ("icc", 1200, 1200, "RGB", False, 100.0, 100.0)], "asset string, w int, h int, mode string, has_icc boolean, mm_w double, mm_h double")
    assert {r.asset: r.status for r in X.preflight(a).collect()} == {"ok": "passed", "low": "failed", "icc": "warnings"}
    assert spark.range(1).select(X.title_lines(F.lit("the long way home"), 9)).first()[0] == ["the long", "way home"]


def test_q5_embeds_whole_texts(spark, monkeypatch, tmp_path):
    """Texts that differ beyond their first hundred characters get different vectors."""
    from quillon.plans import knowledge

    spark.createDataFrame([(1, "x" * 100 + "a"), (3, "x" * 100 + "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    whole, found = S.embed_pending, []
    monkeypatch.setattr(S, "embed_pending", lambda *args: found.append(whole(*args)) or found[0])
    assert knowledge.q5(spark, str(tmp_path)).count() == 2
    vectors = [tuple(r.embedding) for r in found[0].collect()]
    assert len(set(vectors)) == 2 and {v[1] for v in vectors} == {101.0}
