import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quillon.llm import exact_dedup, line_dedup


def test_keep_table(spark):
    rows = [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (5, "b" * 50000), (None, "c"), (None, "c"), (9, "c"), (7, "A"), (8, "a ")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, sha string, rid int")
    got = exact_dedup.keep_table(df).collect()
    by = defaultdict(list)
    for d, t in rows:
        by[t or ""].append(d)
    want = Counter()
    for t, ids in by.items():
        top = max((d for d in ids if d is not None), default=None)
        for d in ids:
            want[(d, top, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(by)
    assert not exact_dedup.keep_table(df.limit(0)).collect()


def test_keep_rows(spark):
    df = spark.createDataFrame([(1, "a", "p"), (2, "a", "q"), (2, "a", "q"), (3, "b", None), (None, None, "r"), (4, "", "s")], "doc_id long, text string, body string")
    got = sorted(map(tuple, exact_dedup.keep_rows(df).collect()), key=str)
    assert got == sorted([(2, "a", "q"), (3, "b", None), (4, "", "s")], key=str)


def test_filter_has_no_false_negatives(spark):
    df = spark.range(2000).select((F.col("id") % 1500).alias("k")).select(F.xxhash64("k").alias("h"))
    bits = exact_dedup.twice_bits(df, 64)
    flagged = exact_dedup._flagged(df, bits, 64)
    twice = df.groupBy("h").count().where("count > 1")
    assert flagged.where("not maybe").join(twice, "h").count() == 0


def test_lines(spark):
    rows = []
    for d in range(40):
        site = f"s{d % 10}"
        lines = [f"own {d}", " shared ", "" if d % 2 else "  ", "few" if d % 10 < 7 else "just" if d % 10 < 8 else "other"]
        rows.append((d, "\n".join(lines), site))
    rows += [(100, None, "s1"), (101, "shared\nshared\nx", None), (102, "", "s2"), (102, "", "s2"), (None, "shared", "s3")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, h int")
    got = Counter(map(tuple, line_dedup.remove_lines(df).collect()))
    spread = defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if line.strip(" ") and s:
                spread[line.strip(" ")].add(s)
    want = Counter()
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(spread[x.strip(" ")]) < line_dedup.SITES]
        want[(d, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    assert got == want
    assert not line_dedup.remove_lines(df.limit(0)).collect()


def test_lines_near_the_threshold_are_exact(spark):
    rows = [(k, f"line {n}", f"site {k}") for n in (7, 8, 9, 30) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.h for r in line_dedup.boilerplate(df, sites=8).collect()}
    want = {r.h for r in spark.createDataFrame([(f"line {n}",) for n in (8, 9, 30)], "t string").select(line_dedup.line_hash(F.col("t")).alias("h")).collect()}
    assert found == want


def test_kept_rows_may_hold_maps(spark):
    df = spark.createDataFrame([(1, "a", {"k": 1}), (2, "a", {"k": 2}), (2, "a", None), (3, "b", {})], "doc_id long, text string, tie map<string,int>")
    out = exact_dedup.keep_rows(df).collect()
    assert sorted(r.doc_id for r in out) == [2, 3]


def test_hot_and_long_lines(spark, monkeypatch):
    """With every line hot the joins are broadcast; a very long line is a line like any other."""
    from quillon.llm import groups

    long = "x y " * 100000
    rows = [(k, f"own {k}\n{long}\nshared", f"s{k}") for k in range(9)] + [(50, "shared\n" + long, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted((k, 3, 2, f"own {k}") for k in range(9)) + [(50, 2, 2, "")]
    assert sorted(map(tuple, line_dedup.remove_lines(df).collect())) == want
    monkeypatch.setattr(groups, "HOT_SHARE", 0.0)
    assert sorted(map(tuple, line_dedup.remove_lines(df).collect())) == want
