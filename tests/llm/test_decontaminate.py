import hashlib
import random
import re

from quillon.llm import decontaminate as D

LOW = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall((t or "").translate(LOW))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = split(t)
        for s in range(max(1, len(w) - 9)) if w else ():
            wins.setdefault(tuple(w[s : s + 10]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, ids = split(t), set(), set()
        for s in range(len(w)):
            for n in {len(x) for x in wins}:
                k = tuple(w[s : s + n])
                if len(k) == n and k in wins:
                    hit |= set(range(s, s + n))
                    ids |= wins[k]
        ids = sorted({str(i) for i in ids if i is not None})
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def data():
    rng = random.Random(6)
    word = lambda: rng.choice(["a", "b", "c", "dé", "x1", "The"])
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 3, 9, 10, 11, 25])))) for i in range(14)] + [(50, None), (51, " -- "), (52, "zeta"), (53, "ZETA"), (None, "null id item words"), (52, "zeta")]
    docs = []
    for d in range(60):
        body = [word() for _ in range(rng.randint(0, 40))]
        if d % 2:
            w = split(items[rng.randrange(14)][1])
            s = rng.randrange(len(w))
            body[rng.randint(0, len(body)) : 0] = w[s : s + rng.randint(5, 14)]
        docs.append((d, ", ".join(body)))
    docs += [(100, None), (101, ""), (102, "zeta-zeta"), (103, "x " * 40000 + "zeta"), (104, "null id item words"), (104, "null id item words"), (None, "zeta")]
    return docs, items


def test_contamination(spark):
    docs, items = data()
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, D.digest(D.contamination(df, bench)).collect()), key=str)
    assert got == brute(docs, items)
    none = D.digest(D.contamination(df, bench.limit(0))).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)
    assert not D.contamination(df.limit(0), bench).collect()
    kept = [r.doc_id for r in D.keep_clean(df, bench).collect()]
    assert sorted(map(str, kept)) == sorted(str(r[0]) for r in brute(docs, items) if not r[5])
    assert D.keep_clean(df, bench.limit(0)).count() == len(docs)


def test_benchmark_in_parts(spark, monkeypatch):
    """A benchmark beyond the size that is broadcast at once gives the same result, part by part."""
    docs, items = data()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "PART_BYTES", 120)
    got = sorted(map(tuple, D.digest(D.contamination(df, bench)).collect()), key=str)
    assert got == brute(docs, items)
    kept = [r.doc_id for r in D.keep_clean(df, bench).collect()]
    assert sorted(map(str, kept)) == sorted(str(r[0]) for r in brute(docs, items) if not r[5])
