"""Whitening of embeddings by matrix-free block Lanczos.

Each entry c of a vector becomes the whole number x = floor(64 c) + 1000000. The
covariance V of the distinct vectors x is never formed: a pass over them, on the
executors, multiplies it with a block of directions, sum of z (z' Q) / n over the
centred vectors z. The blocks are orthogonalised against the whole basis, twice;
directions that vanish in this (a breakdown: the space found so far is closed
under V) are replaced by random ones, so that the search restarts beside it. The
Rayleigh-Ritz step uses the products of all passes. Iteration ends when the
residuals of the leading pairs are below ``TOLERANCE`` of the largest eigenvalue,
or the basis spans the space. The trace comes from the exact deviations, the
identity error from the whitened values themselves.

Only sums of the size of a block reach the driver; sums of whole numbers are
exact. A further pass over the rows projects them.

Defined results: rows whose vector is null or holds null or non-finite entries
are dropped; rows with a null id, and repeated rows, count as rows like any
other, repeated vectors once in the fit; shorter vectors are filled up with 0;
entries beyond +-2^45 count as that; components whose eigenvalue is zero to
rounding (fewer distinct vectors than components, constant entries) have no
whitened value and are left out; an empty table, or one distinct vector, gives an
empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import vectors
from quillon.llm.scratch import written

SCALE, SHIFT, MOST = 64, 1000000, float(1 << 51)
COMPONENTS = 16
#: Residuals, as a part of the largest eigenvalue.
TOLERANCE = 1e-13
#: A direction of which less than this is left after orthogonalisation is replaced.
BREAKDOWN = 1e-10
#: Eigenvalues below this part of the largest, times the dimension, count as zero.
ZERO = 1e-15
#: Whole numbers are summed in two halves of so many bits.
HALF = 26


@dataclass
class Centre:
    """Number of vectors, and exact sums of x - SHIFT by dimension."""

    n: int
    sums: list[int]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - SHIFT) - self.mean

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n x - S)^2, exact."""
        y = x - SHIFT
        most = self.n * (float(np.abs(y).max(initial=0)) + max(map(abs, self.mean), default=0.0)) + 1
        if most**2 * len(self.sums) < 2.0**62:
            return pa.array(((self.n * y - np.array(self.sums, np.int64)) ** 2).sum(1), pa.int64()).cast(pa.decimal128(38, 0))
        wide = self.n * y.astype(object) - np.array(self.sums, object)
        return pa.array([_decimal(v) for v in (wide * wide).sum(1)], pa.decimal128(38, 0))


def _decimal(v: int):
    from decimal import Decimal

    return Decimal(v) if v < 10**38 else None


@dataclass
class Whitening:
    """The fitted transform: directions (a column each) with eigenvalues, explained shares, and the error of the whitened covariance."""

    centre: Centre
    directions: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float
    passes: int

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (self.centre.centred(x) @ self.directions) / np.sqrt(self.eigenvalues)


def whole_numbers(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """Written rows (vec_id, x) of all that isn't dropped, and their dimension."""
    fine = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v")).where(vectors.finite(F.col("v")))
    dim = vectors.dimension(fine, "v")
    x = F.transform(F.col("v").cast("array<double>"), lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(MOST)), F.lit(-MOST))) + F.lit(SHIFT).cast("long"))
    return written(fine.select("vec_id", vectors.padded(x, dim, F.lit(SHIFT).cast("long")).alias("x")), "whole-numbers"), dim


def _summed(rows: DataFrame, dim: int, width: int, block, kind: str = "double") -> np.ndarray:
    """Sums of ``block(x)``, a matrix of ``width`` columns, over the vectors: each task adds its own, Spark those of the tasks by row of the matrix."""
    names = [f"s{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                own = block(vectors.matrix(batch.column("x"), dim))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *(pa.array(np.ascontiguousarray(c)) for c in total.T)], ["i", *names])

    found = rows.select("x").mapInArrow(run, f"i long, {', '.join(f'{c} {kind}' for c in names)}").groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect()
    return np.array([r[1:] for r in sorted(found)], np.int64 if kind == "long" else float).reshape(-1, width)


def centre_of(fit: DataFrame, dim: int) -> Centre:
    def halves(x: np.ndarray) -> np.ndarray:
        y = x - SHIFT
        return np.stack(((y >> HALF).sum(0), (y & ((1 << HALF) - 1)).sum(0), np.full(dim, len(y))), 1)

    got = _summed(fit, dim, 3, halves, "long")
    return Centre(int(got[0, 2]) if len(got) else 0, [(int(h) << HALF) + int(lo) for h, lo, _ in got])


def _orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, room: int) -> np.ndarray:
    """``block`` orthogonal to ``basis``, at most ``room`` columns; what vanishes is replaced by random directions."""
    out = np.zeros((len(block), 0))
    for column in list(block.T[:room]):
        for _ in range(4):
            size = np.linalg.norm(column)
            own = column / size if size > 0 else rng.standard_normal(len(column))
            before = np.linalg.norm(own)
            for _ in range(2):  # full reorthogonalisation, twice
                for q in (basis, out):
                    own = own - q @ (q.T @ own)
            left = np.linalg.norm(own)
            if left > BREAKDOWN * before:
                for q in (basis, out):
                    own = own - q @ (q.T @ own)
                out = np.hstack((out, (own / np.linalg.norm(own))[:, None]))
                break
            column = rng.standard_normal(len(column))  # breakdown: restart
    return out


def leading(product, dim: int, wanted: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``wanted`` largest eigenpairs of the symmetric matrix behind ``product(Q)``, and the passes taken."""
    rng = np.random.default_rng(seed)
    basis, images = np.zeros((dim, 0)), np.zeros((dim, 0))
    block, passes = _orthonormal(rng.standard_normal((dim, wanted)), basis, rng, dim), 0
    while True:
        image = product(block)
        passes += 1
        basis, images = np.hstack((basis, block)), np.hstack((images, image))
        small = basis.T @ images
        value, vector = np.linalg.eigh((small + small.T) / 2)
        value, vector = value[::-1][:wanted], vector[:, ::-1][:, :wanted]
        residual = np.linalg.norm(images @ vector - basis @ vector * value, axis=0)
        # Residuals only end the search once the basis is larger than one block: a closed space found at once may miss larger values.
        if basis.shape[1] >= dim or (basis.shape[1] > wanted and residual.max() <= TOLERANCE * max(abs(value[0]), 1e-300)):
            return value, basis @ vector, passes
        block = _orthonormal(image, basis, rng, dim - basis.shape[1])


def fit(rows: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening | None:
    """From rows (vec_id, x); None where there is nothing to whiten."""
    if not dim:
        return None
    once = written(rows.select("x").distinct(), "fit-list")
    centre = centre_of(once, dim)
    if centre.n < 2:
        return None
    n = centre.n

    def deviation(x: np.ndarray) -> np.ndarray:
        own = centre.deviations(x)
        return np.array([[own.cast(pa.float64()).to_numpy().sum() if not own.null_count else (centre.centred(x) ** 2).sum() * float(n) ** 2]])

    trace = float(_summed(once, dim, 1, deviation)[0, 0]) / float(n) ** 3  # a deviation is n^2 |z|^2

    def product(q: np.ndarray) -> np.ndarray:
        def block(x: np.ndarray) -> np.ndarray:
            z = centre.centred(x)
            return z.T @ (z @ q)

        return _summed(once, dim, q.shape[1], block) / n

    value, vector, passes = leading(product, dim, min(components, dim))
    own = value > ZERO * dim * max(value[0], 0.0)
    if not own.any():
        return None
    value, vector = value[own], vector[:, own]
    vector = vector * np.sign(vector[np.abs(vector).argmax(0), np.arange(len(value))])  # the largest entry is positive
    out = Whitening(centre, vector, value, value / trace, 0.0, passes + 2)

    def outer(x: np.ndarray) -> np.ndarray:
        w = out.apply(x)
        return w.T @ w

    out.identity_error = float(np.abs(_summed(once, dim, len(value), outer) / n - np.eye(len(value))).max())
    return out


def whiten(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row and component; deviation is a decimal of 38 digits."""
    rows, dim = whole_numbers(embeddings, id_col, vec_col)
    found = fit(rows, dim, components)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    k = len(found.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors.matrix(batch.column("x"), dim)
            m = len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, found.centre.n, np.int64)), found.centre.deviations(x).take(each), pa.array(found.apply(x).ravel()), pa.array(np.tile(found.explained, m)), pa.array(np.full(m * k, found.identity_error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
