"""Overlaps by sweeping against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import intervals as I
from quillon.operators import knowledge as K

CLAIMS = "id long, subject string, predicate string, continuity string, value string, rank int, starts int, ends int"


def by_hand(rows):
    rows, out = list(dict.fromkeys(rows)), []
    low, high = float("-inf"), float("inf")
    fine = [r for r in rows if None not in (r[1], r[2], r[4]) and not (r[6] is not None and r[7] is not None and r[6] > r[7])]
    for r in fine:
        s, e = low if r[6] is None else r[6], high if r[7] is None else r[7]
        n = 0
        for q in fine:
            if q is not r and q[1:3] == r[1:3] and (q[3] or "main") == (r[3] or "main") and q[4] != r[4]:
                n += max(s, low if q[6] is None else q[6]) <= min(e, high if q[7] is None else q[7])
        if n:
            out.append((r[0], r[1], r[2], r[3] or "main", r[4], r[5], r[6], r[7], n))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "hot"), [(1, 200_000), (2, 0), (3, 60)])
def test_partners(spark, monkeypatch, seed, hot):
    """Keys summed whole, in ranges, and some this way and some that."""
    monkeypatch.setattr(I, "HOT", hot)
    rng = random.Random(seed)
    maybe = lambda x: None if rng.random() < 0.08 else x
    rows = []
    for k in range(260):
        s = rng.randint(0, 60)
        rows.append((k, maybe(rng.choice("abb")), "p", rng.choice([None, "main", "alt"]), maybe(rng.choice("xyz")), rng.randint(1, 3), maybe(s), maybe(s + rng.randint(-2, 9))))
    rows += rows[:9]
    got = K.conflicts(spark.createDataFrame(rows, CLAIMS))
    assert sorted(map(tuple, got.select(*[c.split()[0] for c in CLAIMS.split(", ")], "partners").collect()), key=repr) == by_hand(rows)
    assert K.conflicts(spark.createDataFrame([], CLAIMS)).count() == 0


def test_severity_and_classes(spark):
    rows = [(1, "s", "p", None, "x", 2, 0, 5), (2, "s", "p", "main", "y", 2, 5, 9), (3, "s", "q", None, "x", 1, 0, 1), (4, "s", "q", None, "y", 2, 1, 2), (5, "s", "q", None, "y", 2, 0, 0), (6, "t", "p", None, "x", 1, 0, 1), (7, "t", "p", None, "y", 1, 2, 3)]
    df = spark.createDataFrame(rows, CLAIMS)
    assert sorted(map(tuple, K.continuity(df).collect())) == [("s", "p", "main", [1, 2], "error"), ("s", "q", "main", [3, 4, 5], "warning")]
    assert sorted(map(tuple, K.continuity(df, ids=False).collect())) == [("s", "p", "main", 2, "error"), ("s", "q", "main", 3, "warning")]
    assert sorted(map(tuple, K.conflict_classes(df).collect())) == [("s", "p", "main", "x", 1, 1, 0, 5), ("s", "p", "main", "y", 1, 1, 5, 9), ("s", "q", "main", "x", 1, 2, 0, 1), ("s", "q", "main", "y", 2, 2, 0, 2)]


def test_one_subject_with_a_million_claims(spark):
    """Half of them say a and last for ever after; the others say b, and each overlaps all that have begun by its end."""
    n = 1_000_000
    a = spark.range(n // 2).select(F.lit("a").alias("value"), (F.col("id") * 2).alias("starts"), F.lit(None).cast("long").alias("ends"))
    b = spark.range(n // 2).select(F.lit("b").alias("value"), (F.col("id") * 2 + 1).alias("starts"), (F.col("id") * 2 + 2).alias("ends"))
    c = a.unionByName(b).withColumns({"id": F.xxhash64("value", "starts"), "subject": F.lit("s"), "predicate": F.lit("p"), "continuity": F.lit(None).cast("string"), "rank": F.lit(1)})
    got = {r.value: r for r in K.conflict_classes(c).collect()}
    links = sum(min(k + 2, n // 2) for k in range(n // 2))
    assert got["a"].claims == got["b"].claims == n // 2 and got["a"].links == got["b"].links == links
