"""Mixing to target weights by soft membership.

A classifier fitted on the labelled table predicts each document's domain
posteriors: two naive Bayes support vector machines with logistic calibration,
one telling low quality from the rest, one telling toxic from good. A document of t tokens and posteriors p adds t * r * p to the expected domain
totals at rate r. Nonnegative rates are fitted by projected gradient steps on

    |expected totals - targets|^2 / 2 + RIDGE / 2 * sum of t * (r - 1)^2,

totals in shares of the token budget. Each gradient is scaled by the inverse
second derivative over the documents whose rate is above zero, then projected
on r >= 0. That second derivative is a multiple of the identity plus a matrix of
the rank of the domains, so a step's rates are max(0, 1 - p . m / RIDGE) with one
multiplier a domain: no rates and no path of steps are stored. Every step is one
sum over all documents, which tries the lengths in ``STEPS`` together, and only
sums of the domains reach the driver. The multipliers are a point of the dual, so
a duality gap says when to stop: the objective is within ``GAP`` of its minimum
then, and a fit that doesn't get there in ``MOST_STEPS`` raises an error. Targets
that can't be met, or that the ridge holds back, are no error: ``Rates.missed``
and a log line say by how much each share differs. Texts are scored once;
posteriors are written.

Defined results: null and empty texts have no tokens, the
posteriors of the models' biases, and a rate like any other; equal texts get
equal posteriors and rates; an empty table gives an empty result; where only one
class has labelled rows, or none, all documents have the same posteriors; extra columns are kept unread.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.labels import training_rows
from quillon.llm.quality import Model, features, fit, packed
from quillon.llm.scratch import written
from quillon.llm.textnp import SPACED, blocks, words

DOMAINS = ("good", "low", "toxic")
#: Share of the tokens that each domain should have in the mixture.
TARGETS = {"good": 0.9, "low": 0.05, "toxic": 0.05}
#: Labelled rows that the classifier is fitted on at most, chosen by hash of the id.
TRAIN_ROWS = 6000
RIDGE = 1e-3
#: The fit ends when the objective (squared shares) is known to be so close to its minimum.
GAP = 1e-8
MOST_STEPS = 60
#: Lengths of a step that one pass tries, as parts of the full one.
STEPS = (1.0, 0.5, 0.25, 0.125, 0.0625, 0.015625)
#: Misses of a target by more than this share are logged as warnings.
MISS = 0.005


@dataclass
class Classifier:
    """Low quality or not, and toxic or not if it isn't low: two calibrated binary models."""

    low: Model
    toxic: Model

    def posterior(self, own: np.ndarray) -> tuple[float, float, float]:
        low, toxic = self.low.score(own), self.toxic.score(own)
        return (1 - low) * (1 - toxic), low, (1 - low) * toxic


def fit_classifier(rows: list[np.ndarray] | list[bytes], y: np.ndarray) -> Classifier:
    """From feature rows and numbers of their domains."""
    other = np.flatnonzero(y != 1)
    return Classifier(fit(rows, (y == 1).astype(int)), fit([rows[k] for k in other], (y[other] == 2).astype(int)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [packed(f) for _, raw, offs in blocks(batch.column("text")) for f in features(raw, offs)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("label"), pa.array(own, pa.binary())], ["doc_id", "label", "own"])


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Low quality makes a row "low", else toxicity makes it "toxic", else it is "good"."""
    domain = F.when(F.col("quality") == 0, 1).when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0)
    rows = training_rows(docs, labels.withColumn("domain", domain), "domain", limit, id_col, text_col)
    found = rows.mapInArrow(_extract, "doc_id string, label int, own binary").groupBy("doc_id").agg(F.max("label"), F.max("own")).collect()
    got = sorted((r[0], r[1], r[2]) for r in found)
    return fit_classifier([bytes(r[2]) for r in got], np.array([r[1] for r in got], np.int64))


@dataclass
class Rates:
    """The fitted multipliers of the domains, and what the fit left open.

    ``missed``: by how much each domain's share of the token budget exceeds its
    target (below zero: falls short); ``passes``: sums over all documents taken.
    """

    multipliers: np.ndarray
    ridge: float = RIDGE
    gap: float = float("inf")
    missed: dict[str, float] = field(default_factory=dict)
    passes: int = 0

    def at(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rate, whether it is free, that is above zero) of documents with posteriors p (rows)."""
        own = 1 - (p @ self.multipliers) / self.ridge
        return np.maximum(0.0, own), own > 0


_P = [f"p_{d}" for d in DOMAINS]


def members(docs: DataFrame, model: Classifier, text_col: str = "text", names: tuple[str, ...] = ("tokens", *_P)) -> DataFrame:
    """``docs`` with tokens and posteriors of every row."""
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()), *[T.StructField(c, T.DoubleType()) for c in names[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw, offs in blocks(batch.column(at)):
                n = len(offs) - 1
                found = words(raw, offs, SPACED)
                p = np.array([model.posterior(f) for f in features(raw, offs, found)]).reshape(n, len(DOMAINS))
                new = [pa.array(np.bincount(found[1], minlength=n), pa.int64()), *(pa.array(p[:, k]) for k in range(p.shape[1]))]
                yield pa.RecordBatch.from_arrays([*batch.slice(row, n).columns, *new], schema.names)

    return docs.mapInArrow(run, schema)


def _sums(narrow: DataFrame, tried: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One pass: for each row of multipliers, the expected domain totals, the sum of t * (r - 1)^2, and that of t * p p' over free documents."""
    k = len(DOMAINS)
    size = k + 1 + k * k
    names = [f"s{i}" for i in range(len(tried) * size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(tried), size))
        for batch in batches:
            if len(batch):
                p, t = np.stack([batch.column(c).to_numpy() for c in _P], 1), batch.column("tokens").to_numpy().astype(float)
                for i, m in enumerate(tried):
                    r, free = Rates(m).at(p)
                    total[i] += np.concatenate(((t * r) @ p, [t @ (r - 1) ** 2], ((t * free)[:, None] * p).T @ p), axis=None)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total.ravel()], names)

    out = narrow.mapInArrow(run, ", ".join(f"{c} double" for c in names)).agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in names]).first()
    x = np.array(list(out)).reshape(len(tried), size)
    return x[:, :k], x[:, k], x[:, k + 1 :].reshape(-1, k, k)


def fit_rates(narrow: DataFrame, targets: dict[str, float], budget: float | None = None) -> Rates:
    """Rates for documents with tokens and posteriors as in ``members``; ``budget``: tokens of the mixture, all there are by default."""
    k = len(DOMAINS)
    total = float(budget or narrow.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] or 1)
    goal = np.array([targets.get(d, 0.0) for d in DOMAINS])
    goal = goal / max(goal.sum(), 1e-12)
    at, tried = -np.inf, np.zeros((1, k))
    rates = Rates(np.zeros(k))
    for passes in range(1, MOST_STEPS + 1):
        own, far, free = _sums(narrow, tried)
        residual = own / total - goal
        # The least value of the Lagrangian bounds the objective from below; the longest step that raises it most is taken.
        bound = np.einsum("ij,ij->i", tried, residual) - (tried**2).sum(1) / 2 + RIDGE / 2 * far / total
        best = int(np.argmax(bound))
        if bound[best] > at:
            at, slope, curve = bound[best], residual[best] - tried[best], free[best] / total / RIDGE + np.eye(k)
            rates = Rates(tried[best], RIDGE, float(slope @ slope) / 2, dict(zip(DOMAINS, residual[best].tolist(), strict=True)), passes)
            shrink = 1.0
        else:
            shrink /= 2.0 ** len(STEPS)
        if rates.gap <= GAP:
            return rates
        tried = rates.multipliers + shrink * np.array(STEPS)[:, None] * np.linalg.solve(curve, slope)
    raise RuntimeError(f"rates are not fitted after {MOST_STEPS} passes: the objective may be {rates.gap:.3g} above its minimum")


def mix(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True
) -> DataFrame:
    """``docs`` with tokens, posteriors, rate, and copies: the rate rounded up or down by a hash of the row, right on average.

    New columns are named mix_tokens, mix_p_<domain>, mix_rate, mix_copies; of a
    clashing name the older column stays and the new one gets a "_" in front.
    Without ``keep_text`` the text column is left out, and is not written with the posteriors.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    names = ["mix_tokens", *(f"mix_{c}" for c in _P), "mix_rate", "mix_copies"]
    lot = "_chance"
    while lot in docs.columns:
        lot = "_" + lot
    taken = {*docs.columns, lot}
    for i, name in enumerate(names):
        while name in taken:
            name = "_" + name
        names[i] = name
        taken.add(name)
    chance = F.pmod(F.xxhash64(F.lit(17), *[docs[c] for c in (id_col, text_col)]), F.lit(1 << 20)) / (1 << 20)
    rated = members(docs.select(*[docs[c] for c in docs.columns], chance.alias(lot)), model, text_col, tuple(names[:-2]))
    rated = written(rated if keep_text else rated.drop(text_col), "members")
    rates = fit_rates(rated.select(*[F.col(c).alias(n) for c, n in zip(names[:-2], ("tokens", *_P), strict=True)]), targets or TARGETS, budget)
    log = logging.getLogger(__name__)
    log.log(logging.WARNING if max(map(abs, rates.missed.values())) > MISS else logging.INFO, "rates fitted in %d passes; shares differ from their targets by %s", rates.passes, {d: round(x, 5) for d, x in rates.missed.items()})

    @F.pandas_udf("double")
    def rate(*p: pd.Series) -> pd.Series:
        return pd.Series(rates.at(np.stack([x.to_numpy(dtype=float) for x in p], 1))[0])

    out = rated.withColumn(names[-2], rate(*names[1:-2])).withColumn(names[-1], F.floor(F.col(names[-2]) + F.col(lot)).cast("long"))
    return out.select(*[c for c in docs.columns if keep_text or c != text_col], *names)
