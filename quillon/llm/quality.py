"""Quality classifier: a naive Bayes support vector machine.

Features are indicators of n-grams of a whole text: byte trigrams, and unigrams
and bigrams of word shapes (kinds of the first and last character, length, and
whether the word repeats the one before), hashed to ``DIM`` places. Indicators
are scaled by the log ratio of the classes' (smoothed) counts and divided by the
root of their number; a linear hinge-loss model is fitted by dual coordinate
descent, and a logistic curve fitted on rows kept apart turns margins to scores.

Defined results: null and empty texts have no n-grams and get the score of the
bias alone; equal texts get equal scores; without labels of both classes every
score is the share of label 1 (0.5 without any); labels, lang, source and doc_id
never enter a score; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.labels import held_out, training_rows
from quillon.llm.textnp import SPACED, blocks, words

DIM = 1 << 17
#: Labelled rows that the model is fitted on at most, chosen by hash of the id.
TRAIN_ROWS = 6000
THRESHOLD = 0.7
COST, EPOCHS, SMOOTH = 1.0, 12, 1.0
#: Of the training rows one in so many calibrates the scores.
CALIBRATE = 5

_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 not ASCII, 5 stop, 6 comma, 7 shout
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
_KIND[[46, 63]], _KIND[[44, 59]], _KIND[33] = 5, 6, 7


def features(raw: np.ndarray, offs: np.ndarray, found: tuple[np.ndarray, ...] | None = None) -> Iterator[np.ndarray]:
    """The sorted feature numbers of each text; ``found``: its words, if the caller has them."""
    h, at, start, end = found or words(raw, offs, SPACED)
    same = np.zeros(len(h), np.int64)
    same[1:] = (h[1:] == h[:-1]) & (at[1:] == at[:-1])
    shape = ((_KIND[raw[start]] * 8 + _KIND[raw[end - 1]]) * 4 + np.minimum(3, (end - start) // 4)) * 2 + same
    pair = np.zeros(len(h), np.int64)
    pair[1:] = (shape[:-1] * 512 + shape[1:] + 1) * 0x9E3779B1 % 65521
    b = raw.astype(np.uint32)
    tri = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)) >> 16  # the product's upper half, below 65536
    first = np.searchsorted(at, np.arange(len(offs)))
    seen = np.zeros(DIM, bool)
    for k in range(len(offs) - 1):
        seen[tri[offs[k] : max(offs[k], offs[k + 1] - 2)]] = True
        a, z = first[k], first[k + 1]
        if z > a:
            seen[65536 + shape[a:z]] = True
            seen[65536 + (pair[a + 1 : z] % 65000) + 512] = True
        own = np.flatnonzero(seen)
        seen[own] = False
        yield own


def packed(own: np.ndarray) -> bytes:
    """A text's feature numbers, or a bit for each place where that is shorter: at most DIM / 8 bytes."""
    if 4 * len(own) >= DIM // 8:
        bits = np.zeros(DIM, bool)
        bits[own] = True
        return np.packbits(bits).tobytes()
    return own.astype(np.uint32).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if len(data) == DIM // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8)))
    return np.frombuffer(data, np.uint32)


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, own: np.ndarray) -> float:
        return float(self.weight[own].sum() / np.sqrt(len(own)) + self.bias) if len(own) else self.bias

    def score(self, own: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(own) + self.shift, -40, 40))))


def fit(rows: list[np.ndarray] | list[bytes], y: np.ndarray) -> Model:
    """Fit on feature rows, as they are or packed, with labels 0 and 1. Packed rows are opened one at a time."""
    at = lambda k: unpacked(rows[k]) if isinstance(rows[k], bytes) else rows[k]
    if len(set(y.tolist())) < 2:
        p = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return Model(np.zeros(DIM, np.float32), 0.0, 0.0, float(np.log(p / (1 - p))))
    apart = np.arange(len(y)) % CALIBRATE == 0
    if len(set(y[apart].tolist())) < 2 or len(set(y[~apart].tolist())) < 2:
        apart = np.ones(len(y), bool)
        train = np.arange(len(y))
    else:
        train = np.flatnonzero(~apart)
    count = np.full((2, DIM), SMOOTH)
    for k in train:
        count[int(y[k]), at(k)] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    w, bias = np.zeros(DIM), 0.0
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.array([(y[train] == 0).mean(), (y[train] == 1).mean()])
    cap = COST * 0.5 / share[y.astype(int)]  # classes weigh the same in total
    scale = lambda own: ratio[own] / np.sqrt(max(1, len(own)))
    norm = {int(k): float(v @ v) + 1.0 for k in train for v in (scale(at(k)),)}
    alpha, rng = dict.fromkeys(norm, 0.0), np.random.Generator(np.random.PCG64(7))
    for _ in range(EPOCHS):
        moved = 0.0
        for k in rng.permutation(train).tolist():
            own = at(k)
            x = scale(own)
            grad = sign[k] * (float(w[own] @ x) + bias) - 1
            new = min(max(alpha[k] - grad / norm[k], 0.0), cap[k])
            if (step := (new - alpha[k]) * sign[k]) != 0:
                w[own] += step * x
                bias += step
                alpha[k] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    model = Model((w * ratio).astype(np.float32), bias, 1.0, 0.0)
    m = np.array([model.margin(at(k)) for k in np.flatnonzero(apart)])
    t = y[apart].astype(float)
    pos, neg = t.sum(), len(t) - t.sum()
    goal = np.where(t == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps with a little ridge
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
        v, g = p * (1 - p), p - goal
        hess = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(hess, [(g * m).sum() + 1e-3 * (a - 1), g.sum()])
        size = max(1.0, np.abs(step).max())
        a, b = a - step[0] / size, b - step[1] / size
        if np.abs(step).max() < 1e-6:
            break
    model.slope, model.shift = float(max(a, 0.0)), float(b)
    return model


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [packed(f) for _, raw, offs in blocks(batch.column("text")) for f in features(raw, offs)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("label"), pa.array(own, pa.binary())], ["doc_id", "label", "own"])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", limit: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from at most ``limit`` labelled ids outside the held-out fold; their features alone reach the driver, at most DIM / 8 bytes a row."""
    rows = training_rows(docs, labels, label_col, limit, id_col, text_col).mapInArrow(_extract, "doc_id string, label int, own binary")
    got = sorted((r[0], r[1], r[2]) for r in rows.groupBy("doc_id").agg(F.max("label"), F.max("own")).collect())
    return fit([bytes(r[2]) for r in got], np.array([int(r[1] > 0) for r in got]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [model.score(f) for _, raw, offs in blocks(batch.column(2)) for f in features(raw, offs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose predicted label is 0, all columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [model.score(f) >= THRESHOLD for _, raw, offs in blocks(batch.column(at)) for f in features(raw, offs)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
