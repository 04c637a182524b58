"""Repeated 200-byte strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quillon.llm import suffix_dedup as S


def brute(rows):
    count = Counter()
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        for s in range(len(b) - S.MIN + 1):
            count[b[s : s + S.MIN]] += 1
    out = Counter()
    for d, b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - S.MIN + 1):
            if count[b[s : s + S.MIN]] > 1:
                gone[s : s + S.MIN] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[(d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def corpus():
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh éß\n") for _ in range(n))
    base = [text(900) for _ in range(4)]
    rows = []
    for k in range(30):
        b = rng.choice(base)
        a, z = sorted(rng.sample(range(900), 2))
        body = list(text(rng.randint(0, 300)) + b[a:z] + text(rng.randint(0, 300)))
        if body and k % 3 == 0:
            body[rng.randrange(len(body))] = "#"
        rows.append((k, "".join(body)))
    rows += [(100, "a" * 700), (101, "ab" * 350), (102, "the cat sat. " * 60), (103, None), (104, ""), (105, base[0]), (105, base[0]), (None, base[1][:250]), (106, "z" * 199), (107, "q" * 200), (108, "\0" * 201)]
    return rows


def test_spans(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, d string")
    got = Counter(map(tuple, S.digest(S.remove_repeats(df)).collect()))
    assert got == brute(rows)
    assert not S.remove_repeats(df.limit(0)).collect()


@pytest.mark.parametrize("seed", range(4))
def test_transform_finds_repeats(seed):
    rng = random.Random(seed)
    unit = bytes(rng.choice(b"ab\0\xff") for _ in range(40))
    bodies = [unit[rng.randrange(20) :] + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(12)] + [b"a" * 30, b"ab" * 20, b"", b"x"]
    depth = 9
    count = Counter(b[s : s + depth] for b in bodies for s in range(len(b) - depth + 1))
    want = [[s for s in range(len(b) - depth + 1) if count[b[s : s + depth]] > 1] for b in bodies]
    assert [x.tolist() for x in S.repeated(bodies, depth)] == want


def test_pieces_partition_the_windows():
    rng = np.random.default_rng(2)
    texts = [rng.integers(97, 101, n).astype(np.uint8) for n in (0, 5, 199, 200, 201, 1000, 5000)] + [np.full(900, 97, np.uint8)]
    raw, offs = np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    text, lo, hi, anchor, _ = S.pieces(raw, offs)
    for k, t in enumerate(texts):
        own = sorted(zip(lo[text == k].tolist(), hi[text == k].tolist()))
        assert [x for a, b in own for x in range(a, b)] == list(range(max(0, len(t) - S.MIN + 1)))
        alone = S.pieces(t, np.array([0, len(t)]))
        assert sorted(zip(alone[1].tolist(), alone[3].tolist())) == sorted(zip(lo[text == k].tolist(), anchor[text == k].tolist()))


def test_crowded_anchors_are_cut_again(spark, monkeypatch):
    """With few pieces enough to crowd an anchor every level is reached; the result is the same."""
    rows = corpus()
    monkeypatch.setattr(S, "CROWD", 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, S.digest(S.remove_repeats(df)).collect())) == brute(rows)


@pytest.mark.parametrize("step", [1, 3, 1000])
def test_comparing_is_the_same_over_any_batches(step):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = sorted((int(rng.integers(0, 12)), int(rng.integers(0, 3)), k, bool(rng.random() < 0.1)) for k in range(60))
    names = ["a", "c", "d", "src", "lo", "hi", "many"]
    table = pa.table([[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], pa.array([0] * 60, pa.int32()), pa.array([0] * 60, pa.int32()), pa.array([1] * 60, pa.int32()), [r[3] for r in rows]], names)
    out = [r for b in S._compare(iter(table.to_batches(max_chunksize=step))) for r in b.to_pylist()]
    classes = Counter()
    for a, c, _, many in rows:
        classes[a, c] += 1 + many
    covered = {d for a, c, d, _ in rows if classes[a, c] > 1}
    assert {r["d"] for r in out if r["kind"] == 1} == covered
    several = {a for a, _ in classes if sum(x == a for x, _ in classes) > 1}
    assert sorted((r["a"], r["c"], r["many"]) for r in out if r["kind"] == 2) == sorted((a, c, n > 1) for (a, c), n in classes.items() if a in several)


def test_long_texts_in_segments(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(S, "SEGMENT", 700)
    rng = np.random.default_rng(3)
    body = rng.integers(97, 123, 3000).astype(np.uint8).tobytes()
    got = []
    for rows, begin, raw, offs in S._segments(pa.array([body.decode()])):
        text, lo, hi, a, _ = S.pieces(raw, offs)
        got += [x for s, e in zip((lo + begin[text]).tolist(), (hi + begin[text]).tolist()) for x in range(s, e)]
    assert sorted(got) == list(range(3000 - S.MIN + 1))


def test_hot_anchors_are_dealt_by_content(spark, monkeypatch):
    """With every anchor hot, all pieces are dealt by anchor and content; the result is the same."""
    rows = corpus()
    monkeypatch.setattr(S, "HOT_SHARE", 0.0)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert Counter(map(tuple, S.digest(S.remove_repeats(df)).collect())) == brute(rows)


def test_repeated_rows_bring_their_pieces_once(spark):
    """One row many times, and one that differs in a letter: the anchor's task searches two pieces."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    text = "".join(map(chr, rng.integers(97, 123, 900)))
    other = text[:450] + "#" + text[451:]
    rows = [(1, text)] * 40 + [(2, other), (3, "".join(map(chr, rng.integers(97, 123, 400))))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(map(tuple, S.digest(S.remove_repeats(df)).collect())) == brute(rows)
    bodies = pa.RecordBatch.from_pydict({"a": [7] * 6, "d": [1, 1, 2, 1, 2, 3], "lo": pa.array([0, 0, 0, 5, 0, 0], pa.int32()), "many": [True] * 6, "body": [b"x"] * 6})
    out = [r for b in S._once(iter([bodies.slice(0, 2), bodies.slice(2)])) for r in b.to_pylist()]
    assert [(r["d"], r["lo"]) for r in out] == [(1, 0), (2, 0), (1, 5), (3, 0)]
