"""Embedding whitening by shifted Cholesky QR: Gram passes, triangular solves, and the SVD of the composed factor.

1. Components become whole numbers; the fit list holds each distinct vector once. One pass counts it and sums each
   dimension exactly.
2. A Gram pass centres the rows, solves them through the triangular factors found so far and adds up their products:
   a task gives out one triangle of the width squared, and Spark sums them. The first factor is the Cholesky factor of the
   Gram matrix plus a small multiple of the unit matrix, so it exists for any rank. Each further pass makes the rows
   nearer to orthonormal and adds a factor; it is shifted only where the plain factorisation fails.
3. The product R of the factors satisfies R'R = X'X. Its singular values and right singular vectors are those of the
   centred rows, found without squaring the condition number. Shifts only add multiples of X'X and of the unit matrix,
   so they move no component.

The driver holds matrices of the width squared and nothing that grows with the rows.

Edges: rows without vector, or with a missing or non-finite component, are dropped; a null id stays. Shorter vectors
count as zero beyond their end. Whole numbers stand as 2^40 at most. Repeated rows count once in the fit and keep a
result each. A component without variance has ``whitened`` null (``explained`` is null too if there is none at all);
``deviation`` is null where it does not fit 64 bits. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import durable
from tideline.llm.hardneg import finite, matrix

UNIT = 2.0**-53
LIMIT = 2**40
#: Most Gram passes; full rank takes two or three.
PASSES = 5
#: Rows are orthonormal enough when no entry of their Gram matrix is further from the unit matrix.
ORTHONORMAL = 1e-10
#: A component below this share of the largest variance has none.
NO_VARIANCE = 1e-13


@dataclass
class Fit:
    """What the fit list says: its size, exact sums, and unit components with their variances, largest first."""

    n: int
    sums: list[int]
    components: np.ndarray
    variance: np.ndarray
    total: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])

    def weights(self, k: int) -> np.ndarray:
        """Columns that whiten a centred row; none where there is no variance."""
        good = self.variance[:k] > NO_VARIANCE * max(float(self.variance[0]) if len(self.variance) else 0.0, 0.0)
        scale = np.where(good, 1 / np.sqrt(np.where(good, self.variance[:k], 1.0)), np.nan)
        return self.components[:, :k] * scale


def whole(vector: Column, scale: int, width: int) -> Column:
    """floor(scale * x) as long, filled up with zeros."""
    numbers = F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("bigint"))
    return F.when(F.size(vector) < width, F.concat(numbers, F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size(vector)))).otherwise(numbers)


def solve(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows times the inverse of an upper triangular factor, column after column."""
    out = np.empty_like(rows)
    for j in range(factor.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def _sums(points: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums of the dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + 1, object)
        for batch in batches:
            x = matrix(batch.column("x"), width)
            total += np.append(x.sum(axis=0), len(x)).astype(object)  # a batch's sum fits 64 bits
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array([str(t) for t in total])], names=["i", "part"])

    parts = points.mapInArrow(run, "i int, part string").groupBy("i").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s"))
    found = {r["i"]: int(r["s"]) for r in parts.collect()}  # one number a dimension
    return found.get(width, 0), [found.get(i, 0) for i in range(width)]


def _gram(points: DataFrame, width: int, prepare) -> tuple[np.ndarray, np.ndarray]:
    """Sums of products, and sums, of ``prepare(rows)`` (any number of columns up to the width)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = sums = None
        for batch in batches:
            q = prepare(matrix(batch.column("x"), width).astype(np.float64))
            products = q.T @ q if products is None else products + q.T @ q
            sums = q.sum(axis=0) if sums is None else sums + q.sum(axis=0)
        if products is not None:
            i, j = np.triu_indices(len(sums))
            i, j = np.append(i, np.arange(len(sums))), np.append(j, np.full(len(sums), -1))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.append(products[np.triu_indices(len(sums))], sums))], names=["i", "j", "part"])

    parts = points.mapInArrow(run, "i int, j int, part double").groupBy("i", "j").agg(F.sum("part").alias("s")).collect()
    size = 1 + max(r["i"] for r in parts)
    gram, sums = np.zeros((size, size)), np.zeros(size)
    for r in parts:
        if r["j"] < 0:
            sums[r["i"]] = r["s"]
        else:
            gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["s"]
    return gram, sums


def fit(points: DataFrame, width: int) -> Fit:
    """Components of ``points`` (column x, each vector once), which must be a written table: it is read once a pass."""
    n, sums = _sums(points, width)
    plain = Fit(n, sums, np.eye(width), np.zeros(width), 0.0, 0)
    if n == 0 or width == 0:
        return plain
    mean = plain.mean
    factors: list[np.ndarray] = []
    unit = np.eye(width)
    total = 0.0
    for turn in range(PASSES):
        done = list(factors)

        def prepare(x: np.ndarray, done: list = done) -> np.ndarray:
            x = x - mean
            for factor in done:
                x = solve(x, factor)
            return x

        gram, _ = _gram(points, width, prepare)
        if turn == 0:
            total = float(np.trace(gram))
            if total == 0.0:
                return plain
        elif np.abs(gram - unit).max() <= ORTHONORMAL:
            break
        norm = float(np.linalg.norm(gram, 2))
        shift = 11 * (n * width + width * (width + 1)) * UNIT * norm
        try:
            if turn == 0:
                raise np.linalg.LinAlgError
            factor = np.linalg.cholesky(gram).T
            if np.diag(factor).min() ** 2 < shift:  # only rounding is left in some direction
                raise np.linalg.LinAlgError
        except np.linalg.LinAlgError:
            factor = np.linalg.cholesky(gram + shift * unit).T
        factors.append(factor)
    composed = unit
    for factor in factors:
        composed = factor @ composed
    _, spread, components = np.linalg.svd(composed)
    components = components.T
    peak = np.abs(components).argmax(axis=0)
    components = components * np.sign(components[peak, np.arange(width)])
    return Fit(n, sums, components, spread**2 / n, total / n, len(factors))


def identity_error(points: DataFrame, width: int, fitted: Fit, k: int) -> float | None:
    """Largest entry of the whitened fit list's covariance minus the unit matrix, over components with variance."""
    if not fitted.n:
        return None
    weights, mean = fitted.weights(k), fitted.mean
    weights = weights[:, ~np.isnan(weights).any(axis=0)]
    if not weights.shape[1]:
        return None
    products, sums = _gram(points, width, lambda x: (x - mean) @ weights)
    centre = sums / fitted.n
    return float(np.abs(products / fitted.n - np.outer(centre, centre) - np.eye(len(sums))).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2 of each row, exact; None beyond 64 bits."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most * most * max(1, x.shape[1]) < 2**63:
        d = x * n - np.array(sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    d = x.astype(object) * n - np.array(sums, object)
    return [v if v < 2**63 else None for v in (d * d).sum(axis=1)]


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding) and component, with the figures of the fit.

    Result: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.
    """
    kept = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("e")).where(finite(F.col("embedding")))
    width = kept.agg(F.max(F.size("e"))).first()[0] or 0
    rows = kept.select("vec_id", whole(F.col("e"), scale, width).alias("x"))
    points = durable(rows.select("x").distinct())
    fitted = fit(points, width)
    k = min(components, width)
    error = identity_error(points, width, fitted, k)
    weights, mean, sums, n = fitted.weights(k), fitted.mean, fitted.sums, fitted.n
    explained = [float(v / fitted.total) if fitted.total > 0 else None for v in fitted.variance[:k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), width)
            white = (x - mean) @ weights
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(white.ravel(), from_pandas=True),
                    pa.array(explained * m, pa.float64()),
                    pa.array([error] * (m * k), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
