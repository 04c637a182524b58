"""Toxicity: a bidirectional gated recurrent network over overlapping windows, in numpy.

A word enters as a learnt vector of its hashed form next to the mean of learnt
vectors of its byte trigrams, with marks at both ends. A text is read in windows
of ``SPAN`` words, each starting ``STEP`` words after the last and the last one
ending with the text; a shorter text is one window. Each window runs through the
network in both directions, attention pools the states into one logit, and a
text scores as its highest window. Training sees document labels only: the
window that scores highest carries the gradient.

Defined results: null, empty and blank texts are one window without words, which
gets the logit of the output's bias alone; equal texts get equal scores; without
labels of both classes every score is the share of label 1 (0 without any);
labels, lang, source and doc_id never enter a score; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.labels import held_out, training_rows
from quillon.llm.scratch import written
from quillon.llm.textnp import LOWER, SPACED, blocks, words

SPAN, STEP = 64, 48
HIDDEN = 8
WORD_PLACES, WORD_DIM = 1 << 14, 8
GRAM_PLACES, GRAM_DIM = 1 << 15, 12
THRESHOLD = 0.3
#: Labelled rows with label 1 and with label 0 that the network is trained on at most, chosen by hash of the id.
TRAIN_ROWS = (1500, 3000)
#: Bytes of their texts at most, which the driver holds; a text that would go beyond is left out, whole.
TRAIN_BYTES = 256 << 20
EPOCHS, BATCH, RATE = 14, 48, 0.006
#: Windows run at once.
WIDE = 2048
#: Of the training rows one in so many only sets the scores' scale.
CALIBRATE = 5


class Coded:
    """Distinct words of a block as network input: word place, and trigram places back to back."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        h, at, start, end = words(raw, offs, SPACED)
        self.first = np.searchsorted(at, np.arange(len(offs)))
        some, where, self.word = np.unique(h, return_index=True, return_inverse=True)
        self.place = (some >> np.uint64(40)).astype(np.int64) & (WORD_PLACES - 1)
        s, size = start[where], (end - start)[where]
        # Bytes of each distinct word between marks 0 and 1, which no word holds.
        room = size + 2
        self.cut = np.concatenate(([0], np.cumsum(size)))  # one trigram a byte
        at0 = np.concatenate(([0], np.cumsum(room)))
        flat = np.zeros(at0[-1], np.int64)
        if len(some):
            inner = np.arange(self.cut[-1]) - np.repeat(self.cut[:-1], size)
            flat[np.repeat(at0[:-1] + 1, size) + inner] = LOWER[raw[np.repeat(s, size) + inner]]
            flat[at0[1:] - 1] = 1
            k = np.repeat(at0[:-1], size) + inner
            code = flat[k] * 65536 + flat[k + 1] * 256 + flat[k + 2]
            self.gram = ((code * 0x9E3779B1) >> 9) & (GRAM_PLACES - 1)
        else:
            self.gram = np.zeros(0, np.int64)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, words) of every window."""
        n = np.diff(self.first)
        count = np.maximum(1, -(-(n - SPAN) // STEP) + 1)
        text = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        begin = np.minimum(k * STEP, np.maximum(0, n[text] - SPAN))
        return text, self.first[text] + begin, np.minimum(SPAN, n[text])


def init(rng: np.random.Generator) -> dict[str, np.ndarray]:
    d = WORD_DIM + GRAM_DIM
    put = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    return {
        "word": put(0.05, WORD_PLACES, WORD_DIM), "gram": put(0.3, GRAM_PLACES, GRAM_DIM),
        "w": put(1 / np.sqrt(d), 2, d, 3 * HIDDEN), "b": np.zeros((2, 3 * HIDDEN), np.float32), "u": put(1 / np.sqrt(HIDDEN), 2, HIDDEN, 3 * HIDDEN),
        "v": put(0.3, 2, HIDDEN), "o": put(0.5, 2, HIDDEN), "c": np.zeros(1, np.float32),
    }


def embed(p: dict[str, np.ndarray], c: Coded) -> np.ndarray:
    """Vectors of the distinct words, and one row of zeros."""
    x = np.zeros((len(c.place) + 1, WORD_DIM + GRAM_DIM), np.float32)
    if len(c.place):
        x[:-1, :WORD_DIM] = p["word"][c.place]
        x[:-1, WORD_DIM:] = np.add.reduceat(p["gram"][c.gram], c.cut[:-1], axis=0) / np.diff(c.cut)[:, None].astype(np.float32)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(p: dict[str, np.ndarray], x: np.ndarray, index: np.ndarray, size: np.ndarray, keep: bool = False):
    """Logits of windows. index (SPAN, windows): rows of x, the last one beyond ``size``."""
    t, b = index.shape
    gates = np.matmul(x[None], p["w"]) + p["b"][:, None]
    gates[:, -1] = 0
    h = np.zeros((2, b, HIDDEN), np.float32)
    states = np.empty((t, 2, b, HIDDEN), np.float32)
    full = bool((size == t).all())
    tape = []
    for k in range(t):
        i, j = index[k], index[t - 1 - k]
        g = np.stack((gates[0][i], gates[1][j]))
        r = np.matmul(h, p["u"])
        s = _sigmoid(g[:, :, : 2 * HIDDEN] + r[:, :, : 2 * HIDDEN])
        z, a = s[:, :, :HIDDEN], s[:, :, HIDDEN:]
        rn = r[:, :, 2 * HIDDEN :]
        n = np.tanh(g[:, :, 2 * HIDDEN :] + a * rn)
        new = n + z * (h - n)
        live = None
        if not full:
            live = np.stack((k < size, t - 1 - k < size))[:, :, None]
            new = np.where(live, new, h)
        if keep:
            tape.append((h, z, a, rn, n, live))
        h = new
        states[k, 0], states[t - 1 - k, 1] = h[0], h[1]
    e = np.einsum("tdbh,dh->tb", states, p["v"])
    if not full:
        e[np.arange(t)[:, None] >= size] = -1e9
    e -= e.max(axis=0)
    att = np.exp(e)
    att /= att.sum(axis=0)
    ctx = np.einsum("tb,tdbh->dbh", att, states)
    if not full:
        ctx[:, size == 0] = 0
    logit = np.einsum("dbh,dh->b", ctx, p["o"]) + p["c"][0]
    return (logit, states, att, ctx, tape) if keep else logit


def backward(p, x, index, size, saved, dlogit) -> dict[str, np.ndarray]:
    """Gradients by parameter; "x" for the word vectors."""
    _, states, att, ctx, tape = saved
    t, b = index.shape
    g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "gram")}
    g["c"][0] = dlogit.sum()
    g["o"] = np.einsum("dbh,b->dh", ctx, dlogit)
    dctx = p["o"][:, None, :] * dlogit[None, :, None]
    dctx[:, size == 0] = 0
    datt = np.einsum("dbh,tdbh->tb", dctx, states)
    de = att * (datt - (att * datt).sum(axis=0))
    g["v"] = np.einsum("tb,tdbh->dh", de, states)
    ds = att[:, None, :, None] * dctx[None] + de[:, None, :, None] * p["v"][None, :, None, :]
    dgate = np.zeros((2, len(x), 3 * HIDDEN), np.float32)
    dh = np.zeros((2, b, HIDDEN), np.float32)
    ut = p["u"].transpose(0, 2, 1)
    for k in range(t - 1, -1, -1):
        h, z, a, rn, n, live = tape[k]
        dh = dh + np.stack((ds[k, 0], ds[t - 1 - k, 1]))
        d = dh if live is None else np.where(live, dh, 0)
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * z * (1 - z)
        da = dn * rn * a * (1 - a)
        dr = np.concatenate((dz, da, dn * a), axis=2)
        g["u"] += np.matmul(h.transpose(0, 2, 1), dr)
        dg = np.concatenate((dz, da, dn), axis=2)
        g["b"] += dg.sum(axis=1)
        np.add.at(dgate[0], index[k], dg[0])
        np.add.at(dgate[1], index[t - 1 - k], dg[1])
        back = d * z + np.matmul(dr, ut)
        dh = back if live is None else np.where(live, back, dh)
    dgate[:, -1] = 0
    g["w"] = np.matmul(x.T[None], dgate)
    g["x"] = np.matmul(dgate, p["w"].transpose(0, 2, 1)).sum(axis=0)
    return g


def _index(c: Coded, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    k = np.arange(SPAN)[:, None]
    at = np.where(k < size, np.minimum(begin + k, max(0, len(c.word) - 1)), -1)
    return np.where(at >= 0, c.word[at] if len(c.word) else 0, len(c.place))


def logits(p: dict[str, np.ndarray], c: Coded) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words, logit) of every window of a block."""
    text, begin, size = c.windows()
    x, out = embed(p, c), np.empty(len(text), np.float32)
    order = np.argsort(size == SPAN, kind="stable")  # short ones together
    split = int((size < SPAN).sum())
    for lo, hi in ((0, split), (split, len(text))):
        for s in range(lo, hi, WIDE):
            k = order[s : min(s + WIDE, hi)]
            out[k] = forward(p, x, _index(c, begin[k], size[k]), size[k])
    return text, begin, size, out


def text_logits(p: dict[str, np.ndarray], raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    text, _, _, out = logits(p, Coded(raw, offs))
    top = np.full(len(offs) - 1, -np.inf, np.float32)
    np.maximum.at(top, text, out)
    return top


def fit(texts: list[str], y: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """The network's parameters, with "slope" and "shift" that turn a logit to a score."""
    rng = np.random.Generator(np.random.PCG64(seed))
    p = init(rng)
    if len(set(y.tolist())) < 2:
        p["o"][:] = 0
        share = float(y.mean()) if len(y) else 0.0
        return p | {"slope": np.float64(0), "shift": np.float64(np.log((share + 1e-6) / (1 - share + 1e-6)))}
    apart = np.arange(len(y)) % CALIBRATE == 0
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0

    def coded(rows: np.ndarray) -> Coded:
        raw = [np.frombuffer(texts[k].encode(), np.uint8) for k in rows]
        return Coded(np.concatenate(raw), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))

    train = np.flatnonzero(~apart)
    for epoch in range(EPOCHS):
        order = rng.permutation(train)
        for s in range(0, len(order), BATCH):
            rows = order[s : s + BATCH]
            c = coded(rows)
            text, begin, size, out = logits(p, c)
            if epoch == 0:  # at first any window may be the one
                out = rng.random(len(out))
            best = np.lexsort((out, text))[np.append(np.flatnonzero(np.diff(text)), len(text) - 1)]
            x = embed(p, c)
            drop = rng.random(len(x)) < 0.3  # learn to do without the whole word
            x[drop, :WORD_DIM] = 0
            index = _index(c, begin[best], size[best])
            saved = forward(p, x, index, size[best], keep=True)
            d = (_sigmoid(saved[0]) - y[rows]).astype(np.float32) / len(rows)
            g = backward(p, x, index, size[best], saved, d)
            dx = g.pop("x")[:-1]
            dx[drop[:-1], :WORD_DIM] = 0
            g["word"] = np.zeros_like(p["word"])
            np.add.at(g["word"], c.place, dx[:, :WORD_DIM])
            g["gram"] = np.zeros_like(p["gram"])
            if len(c.gram):
                size_of = np.diff(c.cut)
                hit = np.flatnonzero(np.abs(dx).sum(axis=1))  # words of the chosen windows
                many = size_of[hit]
                at = np.repeat(c.cut[hit] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
                np.add.at(g["gram"], c.gram[at], np.repeat(dx[hit, WORD_DIM:] / many[:, None], many, axis=0))
            step += 1
            rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * (1 - 0.8 * epoch / EPOCHS)
            for k, v in p.items():
                m, q = moment[k]
                m += 0.1 * (g[k] - m)
                q += 0.001 * (g[k] * g[k] - q)
                v -= (rate * m / (np.sqrt(q) + 1e-8)).astype(np.float32)
    k = np.flatnonzero(apart)
    top = np.full(len(k), -np.inf)
    for s in range(0, len(k), BATCH):
        text, _, _, out = logits(p, coded(k[s : s + BATCH]))
        np.maximum.at(top, s + text, out.astype(float))
    t = y[k].astype(float)
    goal = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(a * top + b, -40, 40)))
        v = q * (1 - q)
        hess = np.array([[(v * top * top).sum() + 0.01, (v * top).sum()], [(v * top).sum(), v.sum() + 0.01]])
        move = np.linalg.solve(hess, [((q - goal) * top).sum() + 0.01 * (a - 1), (q - goal).sum() + 0.01 * b])
        size = max(1.0, np.abs(move).max())
        a, b = a - move[0] / size, b - move[1] / size
        if np.abs(move).max() < 1e-6:
            break
    return p | {"slope": np.float64(max(a, 0.0)), "shift": np.float64(b)}


def scores(p: dict[str, np.ndarray], raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    m = p["slope"] * text_logits(p, raw, offs).astype(np.float64) + p["shift"]
    return 1 / (1 + np.exp(-np.clip(m, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", limits: tuple[int, int] = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> dict[str, np.ndarray]:
    """A network trained on at most ``limits`` labelled ids of class 1 and 0, outside the held-out fold.

    The rows are sampled, their texts are whole: the driver holds up to ``TRAIN_BYTES`` of them, and each epoch scores all their windows.
    """
    parts = [training_rows(docs, labels.where(pick), label_col, limit, id_col, text_col) for pick, limit in zip((F.col(label_col) > 0, F.col(label_col) <= 0), limits, strict=True)]
    rows = parts[0].unionByName(parts[1]).select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "label")
    rows = written(rows.groupBy("doc_id").agg(F.max("label").alias("label"), F.max("text").alias("text")), "toxicity-training")
    size = rows.select("doc_id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # at most the limits' rows
    left, out = TRAIN_BYTES, set()
    for r in size:
        if r["n"] <= left:
            left -= r["n"]
        else:
            out.add(r["doc_id"])
    if out:
        rows = rows.where(~F.col("doc_id").isin(sorted(out)))
    got = sorted((r["doc_id"], r["label"], r["text"]) for r in rows.collect())
    order = np.random.Generator(np.random.PCG64(11)).permutation(len(got))
    return fit([got[k][2] for k in order], np.array([int(got[k][1] > 0) for k in order]))


def score(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [scores(model, raw, offs) for _, raw, offs in blocks(batch.column(2), 2 << 20)]
            s = np.concatenate(s) if s else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
