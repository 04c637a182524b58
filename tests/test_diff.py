"""Hunks of random pairs of texts, carried out again."""

import random

from pyspark.sql import functions as F

from quillon.operators import diff as D


def test_longest_series():
    rng = random.Random(1)
    for n in range(40):
        own = rng.sample(range(100), n)
        got = [own[k] for k in D.increasing(own)]
        best = [1] * n
        for k in range(n):
            best[k] = 1 + max((best[j] for j in range(k) if own[j] < own[k]), default=0)
        assert got == sorted(got) and len(got) == max(best, default=0)


def test_hunks_apply(spark):
    rng = random.Random(3)
    rows = [(0, None, "a\nb"), (1, "a\nb", None), (2, "", ""), (3, "x", "x"), (4, "a\n", "a"), (5, "a\nb\nc\nd", "a\nX\nc\nd"), (6, "a\na\na", "a\na"), (7, "1\n2\n3\n4\n5", "4\n5\n1\n2\n3")]
    for k in range(8, 60):
        a = [rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(0, 30))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 3)] = [rng.choice("abcxyz") for _ in range(rng.randint(0, 3))]
        rows.append((k, "\n".join(a), "\n".join(b)))
    df = spark.createDataFrame(rows, "k long, x string, y string")
    found = D.hunks(df, "k", "x", "y")
    back = {r.k: r.t for r in D.apply(df, found, "k", "x", "t").collect()}
    assert back == {k: y or "" for k, _, y in rows}
    got = {}
    for r in found.orderBy("k", "hunk").collect():
        got.setdefault(r.k, []).append((r.start, r.removed, r["at"], r.added))
    assert set(got) == {k for k, x, y in rows if (x or "") != (y or "")}
    assert got[5] == [(2, ["b"], 2, ["X"])] and got[4] == [(2, [""], 2, [])]
    # The longer block stays, the shorter one moves.
    assert got[7] == [(1, [], 1, ["4", "5"]), (4, ["4", "5"], 6, [])]
    for k, own in got.items():
        assert all(set(removed) or set(added) for _, removed, _, added in own), k
    text = {r.k: r["diff"] for r in D.unified(found, "k").collect()}
    assert text[5] == "@@ -2 +2 @@\n-b\n+X" and text[7] == "@@ -0,0 +1,2 @@\n+4\n+5\n@@ -4,2 +5,0 @@\n-4\n-5"
    wrong = df.where("k = 5").withColumn("x", F.lit("a\nZ\nc\nd"))
    assert D.apply(wrong, found, "k", "x", "t").first().t is None
