"""Near copies of embeddings, whitening and hard negatives against brute force, and odd rows."""

import math

import numpy as np
import pytest

from quillon.llm import collisions, hard_negatives, whitening

NAN, INF = float("nan"), float("inf")


def near_by_hand(rows, least=0.93):
    """n_links and class of every row; rows as (vec_id, vector, label)."""
    def fine(r):
        return r[2] is not None and r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1]) and any(r[1])

    dim = max([len(r[1]) for r in rows if fine(r)], default=0)
    full = [np.pad(np.array(r[1], float), (0, dim - len(r[1]))) if fine(r) else None for r in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if full[i] is not None and full[j] is not None and rows[i][2] == rows[j][2]:
                a, b = full[i] / np.abs(full[i]).max(), full[j] / np.abs(full[j]).max()
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= least:
                    links[i] += 1
                    links[j] += 1
                    up[find(i)] = find(j)
    ids = {}
    for i in range(len(rows)):
        ids.setdefault(find(i), []).append(rows[i][0])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    out = []
    for i, r in enumerate(rows):
        c = low[find(i)]
        out.append((r[0], links[i], c, r[0] == c))
    return out


def key(rows):
    return sorted(map(tuple, rows), key=repr)


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_near_copies_odd_rows(spark):
    v = [0.6, 0.8, 0.0]
    rows = [
        (1, v, 0), (2, v, 0), (2, v, 0), (3, [1.2, 1.6, 0.0], 0), (4, v, 1), (5, v, None), (6, None, 0), (7, [], 0), (8, [0.0, 0.0, 0.0], 0),
        (9, [0.6, None, 0.0], 0), (10, [0.6, NAN, 0.0], 0), (11, [INF, 0.0, 0.0], 0), (12, [-0.6, -0.8, 0.0], 0), (None, v, 0), (None, [0.0, 0.0, 1.0], 2),
        (None, [0.0, 0.0, 1.0], 2), (13, [0.6, 0.8], 0), (14, [1e-30, 1.4e-30, 0.0], 0), (15, [3e38, 3.2e38, 0.0], 0), (16, [-0.0, 0.6, 0.8], 3), (17, [0.0, 0.6, 0.8], 3),
    ]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], f"{SCHEMA}, n_links string, component_id int")
    out = collisions.near_copies(df)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert key(out.collect()) == key(near_by_hand(rows))
    assert not collisions.near_copies(df.limit(0)).collect()
    only = spark.createDataFrame([(1, None, None)], SCHEMA)
    assert [tuple(r) for r in collisions.near_copies(only).collect()] == [(1, 0, 1, True)]
    flat = [(k, [float(x)], 0) for k, x in enumerate([1, 2, -1, 0, 5])]
    assert key(collisions.near_copies(spark.createDataFrame(flat, SCHEMA)).collect()) == key(near_by_hand(flat))


def clustered(rng, n, dim, copies, spread, shift=0.0):
    """Random directions, a third of the rows near copies of one vector, and exact copies."""
    x = rng.standard_normal((n, dim)) + shift
    x[: n // 3] = x[0] + spread * rng.standard_normal((n // 3, dim)) * np.linalg.norm(x[0]) / dim**0.5
    for _ in range(copies):
        a, b = rng.integers(0, n, 2)
        x[a] = x[b] + rng.choice([0, 0.1, 0.25, 0.36]) * rng.standard_normal(dim) * np.linalg.norm(x[b]) / dim**0.5
    return x


@pytest.mark.parametrize(("shift", "spread"), [(0.0, 0.2), (1.0, 0.3)])
def test_near_copies_cut_lists_and_crowded_stretches(spark, monkeypatch, shift, spread):
    """Small stretches and chunks: lists are cut by signs, chunks of one stretch meet in tasks of their own, and no link is counted twice."""
    monkeypatch.setattr(collisions, "STRETCH", 40)
    monkeypatch.setattr(collisions, "CHUNK", 64)
    rng = np.random.default_rng(5)
    x = clustered(rng, 900, 16, 200, spread, shift).astype(np.float32)
    rows = [(k, v.tolist(), int(k % 2)) for k, v in enumerate(x)]
    want = {r[0]: r for r in near_by_hand(rows)}
    got = {r[0]: tuple(r) for r in collisions.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    total = sum(r[1] for r in want.values())
    assert all(got[k][1] <= want[k][1] for k in want)
    assert sum(r[1] for r in got.values()) >= 0.995 * total > 1000
    assert sum(got[k][2] != want[k][2] for k in want) <= 4


def test_calibrated_recall():
    """Partners at the threshold that the calibration didn't see pass the count, and meet in a list, as often as stated."""
    rng = np.random.default_rng(8)
    u = collisions.unit(rng.standard_normal((6000, 64)))
    plan = collisions.calibrate(u[:2000], 0.93, 20000)
    x = u[2000:]
    aside = rng.standard_normal(x.shape)
    aside -= (aside * x).sum(1, keepdims=True) * x
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    met = (np.abs((x - y) @ plan.counted.T) <= plan.half_width).sum(1)
    assert (met >= plan.count).mean() >= 0.995
    a, b = plan.codes(x), plan.codes(y)
    assert (a == b).any(1).mean() >= 0.995 and plan.lists > 3
    far = collisions.unit(rng.standard_normal(x.shape))
    assert ((np.abs((x - far) @ plan.counted.T) <= plan.half_width).sum(1) >= plan.count).mean() < 0.05
    assert (plan.codes(far)[:, 0] == a[:, 0]).mean() < 0.1


# --- whitening -------------------------------------------------------------------------


def dense(rows, k=16):
    """x, n, S, eigenvalues and directions by a dense solver; rows as vectors."""
    dim = max(map(len, rows))
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1000000 for c in r] + [1000000] * (dim - len(r)) for r in rows])
    own = np.unique(x, axis=0)
    n, s = len(own), own.sum(0)
    z = own - s / n
    w, u = np.linalg.eigh(z.T @ z / n)
    return x, n, s, w[::-1][:k], u[:, ::-1][:, :k], np.trace(z.T @ z / n)


@pytest.mark.parametrize(("n", "dim"), [(300, 24), (60, 3), (40, 40), (500, 20)])
def test_whitening_against_a_dense_solver(spark, n, dim):
    rng = np.random.default_rng(dim)
    x = (rng.standard_normal((n, dim)) * np.linspace(3, 0.2, dim)).astype(np.float32)
    x[: n // 3] = x[0]
    rows = [v.tolist() for v in x]
    out = whitening.whiten(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")).collect()
    whole, m, s, value, vector, trace = dense(rows)
    kept = value > 1e-12 * value[0]
    value, vector = value[kept], vector[:, kept]
    assert len(out) == n * len(value) and {r.n for r in out} == {m}
    got = np.zeros((n, len(value)))
    for r in out:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.identity_error <= 1e-8 and abs(r.explained / (value[r.component - 1] / trace) - 1) <= 1e-8
        assert int(r.deviation) == int(sum((m * int(a) - int(b)) ** 2 for a, b in zip(whole[r.vec_id], s)))
    want = (whole - s / m) @ vector / np.sqrt(value)
    want *= np.sign((got * want).sum(0))
    assert np.abs(got - want).max() < 1e-6


def test_whitening_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, whitened string, x int"
    rows = [(1, [1.0, 2.0], "a", 1), (1, [1.0, 2.0], "a", 1), (None, [3.0, 0.5], "b", 2), (4, None, "c", 3), (5, [NAN, 1.0], "d", 4), (6, [None, 1.0], "e", 5), (7, [INF, 1.0], "f", 6), (8, [0.25], "g", 7), (9, [], "h", 8), (10, [1e38, 1.0], "i", 9)]
    df = spark.createDataFrame(rows, schema)
    out = whitening.whiten(df).collect()
    assert sorted({r.vec_id for r in out}, key=repr) == [1, 10, 8, 9, None] and {r.n for r in out} == {5}
    assert len(out) == 6 and all(r.deviation >= 0 for r in out)  # beside the huge entry the other one's variance is zero to rounding
    assert len(whitening.whiten(df.where("not vec_id <=> 10")).collect()) == 10
    assert not whitening.whiten(df.limit(0)).collect()
    assert not whitening.whiten(df.where("vec_id = 1")).collect()  # one distinct vector: nothing varies
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0]) for k in range(9)], "vec_id long, embedding array<double>")
    got = whitening.whiten(line).collect()
    assert {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12


def test_lanczos_restarts_and_large_spaces():
    """Closed spaces, repeated eigenvalues, and an end by residuals before the space is full."""
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    for spectrum, early in ((np.r_[[9.0] * 4, [5.0] * 3, np.zeros(53)], False), (np.r_[[100.0, 80, 60, 40], np.full(56, 1.0)], True), (np.ones(60), True)):
        a = q * spectrum @ q.T
        value, vector, passes = whitening.leading(lambda b, a=a: a @ b, 60, 4)
        assert np.allclose(value, np.sort(spectrum)[::-1][:4], atol=1e-10)
        assert np.abs(a @ vector - vector * value).max() < 1e-9 and np.abs(vector.T @ vector - np.eye(4)).max() < 1e-12
        assert passes <= 15 and (not early or passes < 15)


def test_deviations_beyond_64_bits():
    centre = whitening.Centre(10**9, [3 * 10**9, -(10**9)])
    x = np.array([[whitening.SHIFT + 200, whitening.SHIFT - 7]])
    assert int(centre.deviations(x)[0].as_py()) == (197 * 10**9) ** 2 + (6 * 10**9) ** 2


# --- hard negatives --------------------------------------------------------------------


def mine_by_hand(rows, every=5):
    fine = [(i, v, l) for i, v, l in rows if l is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max([len(v) for _, v, _ in fine], default=0)
    q = [[math.floor(256 * float(np.float32(c))) for c in v] + [0] * (dim - len(v)) for _, v, _ in fine]
    out = []
    last = lambda k: (fine[k][0] is None, fine[k][0] or 0)
    for a, (i, _, la) in enumerate(fine):
        if i is None or i % every:
            continue
        score = [sum(x * y for x, y in zip(q[a], p)) for p in q]
        pos = sorted((k for k in range(len(fine)) if k != a and fine[k][2] == la), key=lambda k: (-score[k], last(k)))[:5]
        for p in pos:
            neg = sorted((k for k in range(len(fine)) if fine[k][2] != la and 50 * score[p] <= 100 * score[k] <= 95 * score[p]), key=lambda k: (-score[k], last(k)))[:3]
            out += [(i, fine[p][0], r + 1, fine[k][0], score[p], score[k]) for r, k in enumerate(neg)]
    return sorted(out, key=repr)


def mine(spark, rows, every=5):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(*r, "x") for r in rows], f"{SCHEMA}, score string")
    return sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % every == 0, F.col("label")).collect()), key=repr)


@pytest.mark.parametrize("kind", ["random", "clusters", "grid"])
def test_hard_negatives(spark, monkeypatch, kind):
    """Small groups and slices; far clusters let bounds rule cells out; a grid has many ties."""
    monkeypatch.setattr(hard_negatives, "GROUP", 8)
    monkeypatch.setattr(hard_negatives, "LEAST_SLICE", 16)
    served = []
    bounds = hard_negatives.Cells.bounds
    monkeypatch.setattr(hard_negatives.Cells, "bounds", lambda self, x: served.append(1) or bounds(self, x))
    rng = np.random.default_rng(7)
    n = 400
    if kind == "random":
        x = rng.standard_normal((n, 6))
    elif kind == "clusters":
        x = rng.standard_normal((8, 6))[rng.integers(0, 8, n)] * 4 + 0.2 * rng.standard_normal((n, 6))
    else:
        x = rng.integers(0, 3, (n, 3)) / 2
    rows = [(k, v.tolist(), int(rng.integers(0, 3))) for k, v in enumerate(x.astype(np.float32))]
    want = mine_by_hand(rows)
    assert len(want) > 100 and mine(spark, rows) == want


def test_hard_negatives_odd_rows(spark):
    v, w = [1.0, 0.5], [0.9, 0.3]
    rows = [(0, v, 0), (1, v, 0), (2, w, 1), (3, None, 1), (4, w, None), (6, [NAN, 1.0], 1), (7, [None, 1.0], 1), (8, [0.9], 1), (9, [], 1), (None, w, 1), (None, v, 0), (10, [-1.0, -1.0], 0), (15, [INF], 0), (20, [0.0, 0.0], 4), (25, [0.0, 0.0], 4)]
    assert mine(spark, rows) == mine_by_hand(rows)
    assert mine(spark, []) == [] and mine(spark, [(1, v, 0)]) == [] and mine(spark, [(0, v, 0)]) == [] and mine(spark, [(0, v, 0), (1, w, 1)]) == []
    big = [(0, [1e30, 1.0], 0), (1, [1e30, 1.0], 0), (2, [6e4, 1.0], 1)]
    assert mine(spark, big) == [(0, 1, 1, 2, (1 << 48) + 65536, (1 << 24) * 256 * 60000 + 65536)]
    same = [(k, v, 0) for k in range(12)] + [(k, w, 1) for k in range(12, 30)]
    assert mine(spark, same) == mine_by_hand(same)


def test_bounds_hold():
    """No row is nearer or farther from an anchor than its cell's bounds say, and far cells are ruled out."""
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((9, 5))[rng.integers(0, 9, 600)] * 500 + 20 * rng.standard_normal((600, 5))).astype(int)
    reach = float((x.astype(float) ** 2).sum(1).max())
    pick = x[:12].astype(float)
    cells = hard_negatives.Cells(np.column_stack((pick, np.sqrt(np.maximum(0, reach - (pick**2).sum(1))))), reach)
    d = cells.distances(x, False)
    home = d.argmin(1)
    cells.least = np.array([d[home == c, c].min(initial=np.inf) for c in range(12)])
    cells.most = np.array([d[home == c, c].max(initial=-np.inf) for c in range(12)])
    low, high = cells.bounds(x)
    true = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + reach - 2.0 * x @ x.T))
    slack = hard_negatives.SLACK * reach**0.5
    assert (true >= low[:, home] - slack).all() and (true <= high[:, home] + slack).all()
    nearest = np.sort(true, 1)[:, 5]
    assert (low > nearest[:, None]).mean() > 0.2
