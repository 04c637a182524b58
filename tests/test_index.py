"""The inverted index against scoring every document; leases and versions."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from quillon.operators import index as I
from quillon.operators import search as S
from quillon.session import scratch
from quillon.sources import lease as L
from quillon.sources.versions import Conflict, Store

WORDS = [f"w{'abcdefghijklmnopqrst'[k]}" for k in range(20)]


def texts(n, seed=1):
    rng = random.Random(seed)
    return {k: " ".join(rng.choices(WORDS, weights=range(20, 0, -1), k=rng.randint(1, 60))) for k in range(n)}


def frame(spark, rows):
    return spark.createDataFrame(list(rows.items()), "doc_id long, text string")


def best(spark, rows, terms, k):
    return [tuple(r) for r in S.bm25_top_k(frame(spark, rows), terms, k).collect()]


def found(index, terms, k, **how):
    return [tuple(r) for r in index.search(terms, k, **how).collect()]


def test_search_and_changes(spark, monkeypatch):
    monkeypatch.setattr(I, "SLOT", 3)
    rows = texts(300)
    index = I.TextIndex.create(spark, scratch(spark, "index"), frame(spark, rows), tokens="letters", buckets=8)
    for terms, k in ((["wa", "wt"], 5), (["ws", "wt", "wr"], 7), (["wa"], 400), (["nowhere"], 3), ([], 3), (["wt", "nowhere", "wt"], 4)):
        assert found(index, terms, k) == found(index, terms, k, skip=False) == (best(spark, rows, terms, k) if terms else [])
    new = {k: t + " wt wt" for k, t in texts(80, 2).items()} | {1000: "wt", 1001: None, 1002: "", 1003: "??"}
    index.add(frame(spark, new))
    rows |= {k: t for k, t in new.items() if t and t != "??"}
    index.delete(spark.createDataFrame([(5,), (299,), (77777,), (None,)], "doc_id long"))
    for gone in (5, 299):
        rows.pop(gone)
    for terms, k in ((["wa", "wt"], 5), (["wt"], 9), (["wa", "wb", "wc"], 500)):
        assert found(index, terms, k) == best(spark, rows, terms, k)
    assert index.frequencies(["wt"]) == {"wt": sum("wt" in t.split() for t in rows.values())}
    before = index.store.version()
    assert index.delete(spark.createDataFrame([(77777,)], "doc_id long")) == before
    index.merge()
    assert index.store.read("postings").select("seq").distinct().count() == 1
    assert found(index, ["wa", "wt"], 5) == best(spark, rows, ["wa", "wt"], 5)
    index.store.vacuum()
    assert found(index, ["wa", "wt"], 5) == best(spark, rows, ["wa", "wt"], 5)
    # An old version can't be read any more, and a deleted document comes back when added.
    index.add(frame(spark, {5: "wt wt wt"}))
    rows[5] = "wt wt wt"
    assert found(index, ["wt"], 3) == best(spark, rows, ["wt"], 3)


def test_search_skips_slots_and_folders(spark, monkeypatch):
    """Only the folders of the terms' buckets are read, and hardly any slot when one document stands out."""
    monkeypatch.setattr(I, "SLOT", 4)
    rows = texts(400, 3) | {9999: "wt wt wt wt"}
    index = I.TextIndex.create(spark, scratch(spark, "index"), frame(spark, rows), tokens="letters", buckets=16)
    named = []
    within = I._within
    monkeypatch.setattr(I, "_within", lambda slots: named.append(len(slots)) or within(slots))
    assert found(index, ["wt"], 1) == best(spark, rows, ["wt"], 1)
    slots = index.store.read("blocks").select("slot").distinct().count()
    assert named[-1] < slots / 4
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = index.postings(["wt"])
        df.collect()
        leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
        read = leaf.metrics().apply("numPartitions").value()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert read == 1 and "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,wt)" in plan


def test_phrases(spark):
    rows = {1: "O céu AZUL é azul azul", 2: "azul é o céu", 3: "céu azul. Céu-azul!", 4: "nada"}
    index = I.TextIndex.create(spark, scratch(spark, "index"), frame(spark, rows))
    got = lambda q, phrase: sorted(map(tuple, index.matching(q, phrase).collect()))
    assert got("ceu azul", True) == [(1, 1), (3, 2)] and got("azul azul", True) == [(1, 1)] and got("Azul céu", False) == [(1, 1), (2, 1), (3, 2)]
    assert got("azul", True) == [(1, 3), (2, 1), (3, 2)] and got("", True) == [] and got("céu vermelho", False) == []
    assert index.terms("Céu, céu AZUL") == ["ceu", "azul"]
    assert [r.doc for r in index.search("Céu", 5).collect()][0] in (1, 2, 3)


def test_empty_index(spark):
    index = I.TextIndex.create(spark, scratch(spark, "index"), frame(spark, {1: "a"}).limit(0))
    assert found(index, ["a"], 3) == [] and index.matching("a").count() == 0
    index.add(frame(spark, {1: "a b"}))
    assert [r[0] for r in found(index, ["b"], 3)] == [1]
    with pytest.raises(FileExistsError):
        I.TextIndex.create(spark, index.store.root, frame(spark, {1: "a"}))


def test_commits_change_all_tables_or_none(spark):
    store = Store(spark, scratch(spark, "store"))
    one, two = spark.createDataFrame([(1, "a")], "k long, v string"), spark.createDataFrame([(2, "b")], "k long, v string")
    assert store.version() == 0 and store.commit(replace={"a": one, "b": one}, meta={"x": 1}) == 1

    def fail(name):
        if name == "a":
            raise OSError("no space left")

    with pytest.raises(OSError, match="no space"):
        store.commit(replace={"a": two, "b": two}, between=fail)
    assert [store.read(n).first().k for n in ("a", "b")] == [1, 1] and store.version() == 1
    assert store.commit(replace={"a": two}, append={"b": two}) == 2
    assert store.read("a").collect() == two.collect() and store.read("b").count() == 2 and store.read("b", version=1).count() == 1
    assert store.meta() == {"x": 1} and store.tables() == ["a", "b"]
    with pytest.raises(Conflict):
        store.commit(replace={"a": one}, expected=1)
    with pytest.raises(ValueError, match="columns"):
        store.commit(append={"a": one.withColumnRenamed("v", "w")})
    gone = store.vacuum()
    assert store.versions() == [2] and gone and store.read("b").count() == 2


def test_of_two_commits_one_wins(spark):
    """Both start from one version and write; only one manifest gets the number."""
    store = Store(spark, scratch(spark, "store"))
    base = store.commit(replace={"a": spark.range(1)})
    meet, out = threading.Barrier(2), []

    def writer(n):
        try:
            out.append(store.commit(replace={"a": spark.range(n)}, expected=base, between=lambda _: meet.wait(60)))
        except Conflict:
            out.append("conflict")

    both = [threading.Thread(target=writer, args=(n,)) for n in (5, 7)]
    [t.start() for t in both]
    [t.join() for t in both]
    assert sorted(map(str, out)) == ["2", "conflict"] and store.read("a").count() in (5, 7)


def test_leases_fence_stale_writers(spark):
    root, clock = scratch(spark, "lease"), [1000.0]
    now = lambda: clock[0]
    a = L.acquire(spark, root, 60, "a", now)
    with pytest.raises(L.LeaseHeld, match="a holds"):
        L.acquire(spark, root, 60, "b", now)
    clock[0] += 50
    a.heartbeat()
    clock[0] += 50
    a.check()
    with pytest.raises(L.LeaseHeld):
        L.acquire(spark, root, 60, "b", now)
    clock[0] += 20
    with pytest.raises(L.LeaseLost):
        a.heartbeat()
    b = L.acquire(spark, root, 60, "b", now)
    assert b.token == a.token + 1
    with pytest.raises(L.LeaseLost, match="stale"):
        a.check()
    store = Store(spark, scratch(spark, "store"))
    store.commit(replace={"a": spark.range(3)}, lease=b)
    with pytest.raises(L.LeaseLost):
        store.commit(replace={"a": spark.range(9)}, lease=a)
    assert store.read("a").count() == 3
    from quillon.sources import files

    path = scratch(spark, "swap")
    files.write_atomic(spark.range(4), path, lease=b)
    with pytest.raises(L.LeaseLost):
        files.write_atomic(spark.range(9), path, lease=a)
    assert spark.read.parquet(path).count() == 4
    b.release()
    assert L.holder(spark, root, now()) is None
    c = L.acquire(spark, root, 60, "c", now)
    assert L.holder(spark, root, now())["owner"] == "c" and c.token == 3
    with pytest.raises(ValueError):
        L.acquire(spark, root, 1)


def test_lease_as_a_block(spark):
    root = scratch(spark, "lease")
    with L.held(spark, root, 6) as own:
        own.check()
        with pytest.raises(L.LeaseHeld), L.held(spark, root, 6):
            pass
        threading.Event().wait(3)  # a renewal
        assert L.holder(spark, root)["ends"] > 0
    assert L.holder(spark, root) is None


def test_publishing_is_exclusive(spark):
    from quillon.sources.versions import publish, read_text

    path, got, meet = f"{scratch(spark, 'once')}/x.json", [], threading.Barrier(4)

    def put(k):
        meet.wait(60)
        got.append((publish(spark, str(k), path), k))

    all_ = [threading.Thread(target=put, args=(k,)) for k in range(4)]
    [t.start() for t in all_]
    [t.join() for t in all_]
    won = [k for ok, k in got if ok]
    assert len(won) == 1 and read_text(spark, path) == str(won[0])


def test_tools_search_the_index(spark):
    from quillon.plans import tools

    rows = {1: "o céu azul", 2: "azul azul", 3: "nada"}
    docs = frame(spark, rows)
    plain = tools.Book(spark, {"documents": docs})
    made = lambda tokens: tools.Book(spark, {}, I.TextIndex.create(spark, scratch(spark, "index"), docs, tokens=tokens))
    assert tools.call(made("letters"), "search_book_context", query="azul") == tools.call(plain, "search_book_context", query="azul") != []
    # The index folds accents, and needs no text at all.
    assert [r["doc_id"] for r in tools.call(made("folded"), "search_book_context", query="CEU")] == [1]
