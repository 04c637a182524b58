import random
import re

import numpy as np

from quillon.llm import ngram_join

LOW = {i: i + 32 for i in range(65, 91)}


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOW))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                up[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return sorted(((d, len(sets[k]), least.get(find(k)) if sets[k] else d) for k, (d, _) in enumerate(rows)), key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6)))
    shared = [word() for _ in range(30)]
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([4, 20, 60, 150]))] + (shared if g % 2 else [])
        for _ in range(rng.choice([1, 2, 12])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE"), (905, "a b c d"), (906, "a b c d e"), (906, "a b c d e"), (None, "a b c d e"), (None, "zz"), (907, "w " * 3000), (908, "W " * 9)]
    return rows


def test_components(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, sig string")
    got = ngram_join.sets_and_components(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert not ngram_join.sets_and_components(df.limit(0)).collect()


def test_components_in_small_chunks(spark, monkeypatch):
    """With chunks of two sets every level of seeding and the completing step have work."""
    monkeypatch.setattr(ngram_join, "CHUNK", 2)
    rows = corpus(2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.sets_and_components(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_keep_rows(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in ngram_join.keep_rows(df).collect()]
    want = [d for d, _, c in brute(rows) if d is None or d == c]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_traversal_finds_all_links():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    toks = [np.unique(np.concatenate((rng.choice(base, rng.integers(40, 60), replace=False), rng.integers(0, 2**63, rng.integers(0, 6)).astype(np.uint64)))) for _ in range(90)]
    n = np.array([len(t) for t in toks])
    tree = ngram_join.Tree(np.arange(90), n, toks)
    group = np.arange(90)
    ngram_join.traverse(tree, tree, group, group)
    sets = [set(t.tolist()) for t in tree.toks]
    up = np.arange(90)
    for a in range(90):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[up == up[a]] = up[b]
    assert len({(x, y) for x, y in zip(group.tolist(), up.tolist())}) == len(set(up.tolist())) == len(set(group.tolist()))


def test_slots_are_spark_partitions(spark):
    from pyspark.sql import functions as F

    for n in (64, 128):
        df = spark.createDataFrame([(int(x),) for x in ngram_join.slots(n)], "slot int")
        got = df.repartition(n, "slot").select("slot", F.spark_partition_id().alias("p")).collect()
        assert {r.slot: r.p for r in got} == {int(x): k for k, x in enumerate(ngram_join.slots(n))}


def test_all_links_are_listed(spark, monkeypatch):
    """Each link between distinct sets comes once, also within a group of near copies, whatever the chunks."""
    rows = corpus(5)
    base = [f"w{k}" for k in range(120)]
    rows += [(1000 + k, " ".join(base[:k] + ["x"] + base[k + 1 :])) for k in range(0, 60, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOW))
        s = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        if s:
            sets.setdefault(s, []).append(d)
    least = [(s, min((d for d in ids if d is not None), default=None)) for s, ids in sets.items()]
    want = [tuple(sorted(((d, len(s)), (e, len(t))), key=str)) + (len(s & t),) for k, (s, d) in enumerate(least) for t, e in least[:k] if 100 * len(s & t) >= 80 * len(s | t)]
    assert len(want) > len(sets)
    for chunk in (512, 2):
        monkeypatch.setattr(ngram_join, "CHUNK", chunk)
        got = [tuple(sorted(((r.doc_a, r.n_a), (r.doc_b, r.n_b)), key=str)) + (r.shared,) for r in ngram_join.links(df).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert not ngram_join.links(df.limit(0)).collect()


def test_kept_rows_of_one_id(spark):
    """Rows with one id and different texts are told apart: the copy goes, the unique text stays."""
    a, b = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    df = spark.createDataFrame([(1, a, {"k": 1}), (5, a + " x", None), (5, b, None), (9, b + " y", None), (None, b, None)], "doc_id long, text string, key map<string,int>")
    assert sorted((r.doc_id, r.text) for r in ngram_join.keep_rows(df).where("doc_id is not null").collect()) == [(1, a), (5, b)]


def test_many_parts_in_a_partition(spark, monkeypatch):
    """Parts of a partition are taken one after the other."""
    monkeypatch.setattr(ngram_join, "LEAST_LOG2", 1)
    monkeypatch.setattr(ngram_join, "EACH_LOG2", -1)
    rows = corpus(6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.sets_and_components(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_hot_shingles(spark, monkeypatch):
    """Shingles that pass for the most frequent without being counted change nothing, whether many do or all."""
    rows = corpus(7)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for share, least in ((1 / 200, 2), (0.0, 1)):
        monkeypatch.setattr(ngram_join, "HOT_SHARE", share)
        monkeypatch.setattr(ngram_join, "LEAST_HOT", least)
        got = ngram_join.sets_and_components(df).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)
