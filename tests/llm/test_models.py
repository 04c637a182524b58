"""Quality, toxicity and mixing: held-out accuracy, gradients, optimal rates, odd rows."""

import random
import zlib

import numpy as np
import pytest

from quillon.llm import mixing, quality, toxicity
from quillon.llm.labels import HELD_OUT

WORDS = ["lorem", "ipsum", "dolor", "sit", "amet", "sed", "quia", "non"]


def corpus(n=260):
    rng = random.Random(9)
    rows, labels = [], []
    for d in range(n):
        w = [rng.choice(WORDS) for _ in range(rng.randint(5, 160))]
        low, toxic = d % 4 == 0, d % 3 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["zorgon", "blaxt", "zorgish"])
        rows.append((d, " ".join(x.upper() + "!!" for x in w) if low else " ".join(w).capitalize() + "."))
        labels.append((d, int(not low), int(toxic)))
    rows += [(900, None), (901, ""), (902, "  "), (903, "lorem " * 20000), (5, rows[5][1]), (None, "lorem")]
    labels += [(3, None, None), (5000, 1, 1), (None, 0, 1)]
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, label string, score int").cache()
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache(), rows, labels


def check(out, rows, labels, column, threshold):
    assert len(out) == len(rows)
    want = {d: v for d, *v in labels if d is not None}
    right = []
    for r in out:
        fold = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == HELD_OUT
        assert r.held_out == fold and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
        if fold and r.doc_id in want and want[r.doc_id][column] is not None:
            right.append(r.predicted == want[r.doc_id][column])
    return np.mean(right)


def test_quality(tables):
    docs, labels, rows, known = tables
    out = quality.score(docs, quality.train(docs, labels)).collect()
    assert check(out, rows, known, 0, quality.THRESHOLD) > 0.95
    model = quality.train(docs, labels)
    good = {r.doc_id for r in out if r.predicted == 1}
    assert {r.doc_id for r in quality.keep_good(docs, model).collect()} == good
    assert not quality.score(docs.limit(0), model).collect()
    alone = quality.train(docs, labels.limit(0))
    assert {round(r.score, 6) for r in quality.score(docs, alone).collect()} == {0.5}


def test_dual_descent_reaches_the_primal_optimum():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 120)
    rows = [np.unique(np.concatenate((rng.integers(0, 50, 8) + 50 * k, rng.integers(100, 140, 4)))) for k in y]
    model = quality.fit(rows, y)
    assert np.mean([(model.margin(r) > 0) == k for r, k in zip(rows, y)]) == 1


def test_toxicity(tables, monkeypatch):
    docs, labels, rows, known = tables
    monkeypatch.setattr(toxicity, "EPOCHS", 30)
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert check(out, rows, known, 1, toxicity.THRESHOLD) > 0.9
    assert not toxicity.score(docs.limit(0), model).collect()
    same = {r.score for r in out if r.doc_id == 5}
    assert len(same) == 1


def test_network_gradients():
    """Backpropagation against differences, with short windows among full ones."""
    rng = np.random.default_rng(0)
    texts = ["aa bb cc " * 30, "dd ee", "ff"]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    c = toxicity.Coded(np.concatenate(raw), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    p = {k: v.astype(np.float64) for k, v in toxicity.init(rng).items()}
    text, begin, size = c.windows()
    index, x = toxicity._index(c, begin, size), toxicity.embed(p, c).astype(np.float64)
    seed = rng.normal(size=len(text))
    saved = toxicity.forward(p, x, index, size, keep=True)
    grad = toxicity.backward(p, x, index, size, saved, seed)
    value = lambda: float(toxicity.forward(p, x, index, size).astype(np.float64) @ seed)
    for name in ("w", "b", "u", "v", "o", "c"):
        flat, g = p[name].reshape(-1), grad[name].reshape(-1)
        for k in rng.choice(len(flat), min(4, len(flat)), replace=False):
            keep = flat[k]
            flat[k] = keep + 1e-2
            up = value()
            flat[k] = keep - 1e-2
            down = value()
            flat[k] = keep
            assert g[k] == pytest.approx((up - down) / 2e-2, rel=0.08, abs=2e-3), name


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 112, 113, 500):
        raw = np.frombuffer(b"w " * n, np.uint8)
        c = toxicity.Coded(raw, np.array([0, len(raw)]))
        _, begin, size = c.windows()
        seen = {k for b, s in zip(begin, size) for k in range(b, b + s)}
        assert seen == set(range(n)) and (len(begin) == 1 or (np.diff(begin) < toxicity.SPAN).all())


def test_mixing(tables):
    docs, labels, rows, _ = tables
    out = mixing.mix(docs, labels, {"good": 0.8, "low": 0.1, "toxic": 0.1}).collect()
    assert len(out) == len(rows)
    assert docs.columns == out[0].__fields__[: len(docs.columns)]
    t = np.array([r.mix_tokens for r in out], float)
    p = np.array([[r.mix_p_good, r.mix_p_low, r.mix_p_toxic] for r in out])
    r = np.array([x.mix_rate for x in out])
    assert (r >= 0).all() and np.allclose(p.sum(axis=1), 1)
    got = (t * r) @ p / t.sum()
    assert np.abs(got - [0.8, 0.1, 0.1]).max() < 0.02
    # Optimality: where a rate is positive its gradient is nought, elsewhere it isn't negative.
    g = p @ (got - np.array([0.8, 0.1, 0.1])) + mixing.RIDGE * (r - 1)
    assert np.abs(g[(r > 1e-9) & (t > 0)]).max() < 5e-3 and (g[r <= 1e-9] > -5e-3).all()
    assert all(abs(x.mix_copies - x.mix_rate) < 1 for x in out)
    assert not mixing.mix(docs.limit(0), labels).collect()


def test_mixing_keeps_clashing_columns(tables, spark):
    _, labels, _, _ = tables
    docs = spark.createDataFrame([(1, "a b", 7)], "doc_id long, text string, mix_rate int")
    row = mixing.mix(docs, labels).first()
    assert row.mix_rate == 7 and row._mix_rate is not None


def test_toxicity_trains_on_whole_texts(spark, monkeypatch):
    """A short passage of a long labelled text reaches the network wherever it lies."""
    rng = random.Random(4)
    clean = lambda n: [rng.choice(WORDS) for _ in range(n)]
    rows = []
    for d in range(80):
        w = clean(6000)
        if d % 2:
            w[(at := 70 + 71 * d) : at + 3] = ["zorgon", "blaxt", "zorgish"]
        rows.append((d, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in range(80)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: seen.extend(zip(texts, y.tolist(), strict=True)) or {})
    toxicity.train(docs, labels)
    assert len(seen) > 40 and {t for t, _ in seen} <= {t for _, t in rows}
    assert all(("zorgon blaxt zorgish" in t) == bool(k) for t, k in seen)


def plain_logit(p, text):
    """The largest logit of a text's windows, each gone through word by word."""
    def word_vector(w):
        raw = np.frombuffer(w, np.uint8)
        c = toxicity.Coded(raw, np.array([0, len(raw)]))
        return np.concatenate((p["word"][c.place[0]], np.mean([p["gram"][g] for g in c.gram], axis=0)))

    sig = lambda v: 1 / (1 + np.exp(-v))
    own, h = [word_vector(w) for w in text.encode().split()], toxicity.HIDDEN
    starts = list(range(0, max(1, len(own) - toxicity.SPAN + toxicity.STEP), toxicity.STEP)) if len(own) > toxicity.SPAN else [0]
    best = -np.inf
    for s in starts:
        s = min(s, max(0, len(own) - toxicity.SPAN))
        window = own[s : s + toxicity.SPAN]
        states = np.zeros((len(window), 2, h))
        for d, order in enumerate((range(len(window)), range(len(window) - 1, -1, -1))):
            state = np.zeros(h)
            for k in order:
                g, r = window[k] @ p["w"][d] + p["b"][d], state @ p["u"][d]
                z, a = sig(g[:h] + r[:h]), sig(g[h : 2 * h] + r[h : 2 * h])
                n = np.tanh(g[2 * h :] + a * r[2 * h :])
                state = n + z * (state - n)
                states[k, d] = state
        if len(window):
            e = np.array([sum(states[k, d] @ p["v"][d] for d in (0, 1)) for k in range(len(window))])
            att = np.exp(e - e.max())
            att /= att.sum()
            context = [sum(att[k] * states[k, d] for k in range(len(window))) for d in (0, 1)]
        else:
            context = [np.zeros(h), np.zeros(h)]
        best = max(best, sum(context[d] @ p["o"][d] for d in (0, 1)) + p["c"][0])
    return best


def test_toxicity_scores_every_window():
    """Logits of texts of all lengths, scored together, against going through each window by itself."""
    rng = random.Random(6)
    net = np.random.default_rng(4)
    p = {k: v.astype(np.float64) for k, v in toxicity.init(net).items()}
    p["b"], p["c"] = net.normal(0, 0.3, p["b"].shape), np.array([0.2])
    texts = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (0, 1, 2, 63, 64, 65, 111, 112, 113, 160, 161, 400)] + ["Ünï cödé x", "  a\n\tb  "]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    got = toxicity.text_logits(p, np.concatenate(raw), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    assert np.allclose(got, [plain_logit(p, t) for t in texts], atol=2e-4)


def test_rates_reach_the_least_squares(spark):
    """Against a dense solver of the same quadratic program; an unreachable fit raises."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.6, 0.3, 0.3], 40)
    t = rng.integers(0, 300, 40)
    narrow = spark.createDataFrame([(int(n), *map(float, q)) for n, q in zip(t, p)], "tokens long, p_good double, p_low double, p_toxic double")
    goal = np.array([0.2, 0.7, 0.1])
    rates = mixing.fit_rates(narrow, dict(zip(mixing.DOMAINS, goal)))
    w = t / t.sum()

    def value(r):
        return ((w * r) @ p - goal) @ ((w * r) @ p - goal) / 2 + mixing.RIDGE / 2 * (w @ (r - 1) ** 2)

    r = np.ones(40)
    for _ in range(200000):
        r = np.maximum(0, r - 0.9 * (p @ ((w * r) @ p - goal) + mixing.RIDGE * (r - 1)))
    assert value(rates.at(p)[0]) <= value(r) + 2e-8 and rates.gap <= mixing.GAP
    with pytest.raises(RuntimeError):
        few = pytest.MonkeyPatch()
        few.setattr(mixing, "MOST_STEPS", 2)
        try:
            mixing.fit_rates(narrow, dict(zip(mixing.DOMAINS, goal)))
        finally:
            few.undo()


@pytest.mark.parametrize(
    ("spread", "goal", "met"),
    [((30, 0.02, 0.02), (0.94, 0.01, 0.05), False), ((0.4, 0.05, 0.05), (0.94, 0.01, 0.05), True), ((30, 0.02, 0.02), (0, 0, 1), False), ((0.05, 0.05, 0.05), (0, 0.5, 0.5), True)],
)
def test_rates_take_few_passes(spark, spread, goal, met):
    """Nearly pure posteriors, where most rates stay near one, and targets that can't be met, which are reported."""
    rng = np.random.default_rng(3)
    p, t = rng.dirichlet(spread, 800), rng.integers(0, 3000, 800)
    narrow = spark.createDataFrame([(int(n), *map(float, q)) for n, q in zip(t, p)], "tokens long, p_good double, p_low double, p_toxic double")
    rates = mixing.fit_rates(narrow, dict(zip(mixing.DOMAINS, goal)))
    assert rates.passes <= 20 and rates.gap <= mixing.GAP
    shares = (t / t.sum() * rates.at(p)[0]) @ p
    assert np.allclose([rates.missed[d] for d in mixing.DOMAINS], shares - np.array(goal), atol=1e-9)
    assert (max(map(abs, rates.missed.values())) < 0.02) == met


def test_dual_descent_finds_the_optimum(monkeypatch):
    """The linear model against projected gradient ascent on the whole dual, with the same scaling and caps."""
    monkeypatch.setattr(quality, "EPOCHS", 3000)
    rng = np.random.default_rng(5)
    y = np.array([k % 2 for k in range(40)])
    rows = [np.unique(np.concatenate((rng.choice(30, 5, replace=False), 40 + rng.choice(20, 3, replace=False) + 10 * label))) for label in y]
    model = quality.fit(rows, y)
    train = np.flatnonzero(np.arange(40) % quality.CALIBRATE != 0)
    count = np.full((2, quality.DIM), quality.SMOOTH)
    for k in train:
        count[y[k], rows[k]] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    x = np.zeros((len(train), 80))
    for i, k in enumerate(train):
        x[i, rows[k]] = ratio[rows[k]] / np.sqrt(len(rows[k]))
    x = np.hstack((x, np.ones((len(train), 1))))
    sign = np.where(y[train] == 1, 1.0, -1.0)
    share = np.array([(y[train] == 0).mean(), (y[train] == 1).mean()])
    cap = quality.COST * 0.5 / share[y[train]]
    q = (sign[:, None] * x) @ (sign[:, None] * x).T
    a, rate = np.zeros(len(train)), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(200000):
        a = np.clip(a - rate * (q @ a - 1), 0, cap)
    best = (a * sign) @ x
    primal = lambda v: v @ v / 2 + (cap * np.maximum(0, 1 - sign * (x @ v))).sum()
    own = np.append(np.where(ratio[:80] == 0, 0, model.weight[:80] / np.where(ratio[:80] == 0, 1, ratio[:80])), model.bias)
    assert primal(own) <= primal(best) * 1.02 + 1e-6
