"""Principal components of samples over features, centred and unscaled.

One route for any number of features and samples: a block Krylov space of the matrix that features share, grown from
the long table. Each step multiplies the newest block of directions by the centred matrix and back, as two equi-joins
with sums that combine on the map side. Centring is implicit: column means enter as corrections of the sums, so no
centred copy is written; neither are cells that have no row, whose value depends on the sample alone (``base``). The
directions are made orthonormal with themselves and all earlier ones in Arrow passes over one row per feature. The
space holds the exact components once it is as wide as the matrix' rank, and mostly long before; it is grown until the
wanted components no longer change the matrix' image, and restarted from its best directions where it gets too wide.

The driver holds matrices of ``BLOCK * DEPTH`` columns at most; a feature's row holds twice as many numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tideline.functions.numeric import magnitude
from tideline.functions.text import percent_label
from tideline.operators.rank import top_k
from tideline.session import durable

#: Directions a step, steps before a restart, and restarts before giving up.
BLOCK, DEPTH, RESTARTS = 64, 6, 40
#: A direction shorter than this share of the matrix' image is rounding.
NOTHING = 1e-13
#: The image of a component may differ from its multiple by this share of the largest variance.
TOLERANCE = 1e-10


class Components(NamedTuple):
    scores: DataFrame  # sample, PC1..PCk
    loadings: DataFrame  # feature, PC1..PCk
    variance: DataFrame  # component, variance, share, label


def total_variance(df: DataFrame) -> DataFrame:
    """Sum over features of their variance across samples, one row."""
    per = df.groupBy("feature").agg(F.var_samp("value").alias("v"))
    return per.agg(F.sum("v").alias("total_variance"), F.count(F.lit(1)).alias("features"))


# ---- passes over one row per feature, in Arrow batches ---------------------------------------------


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Number and list columns side by side, one row per feature."""
    parts = []
    for name in names:
        column = batch.column(name)
        if pa.types.is_list(column.type):
            parts.append(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))
        else:
            parts.append(column.to_numpy(zero_copy_only=False)[:, None])
    return np.concatenate(parts, axis=1).astype(float)


def gram(df: DataFrame, names: list[str]) -> np.ndarray:
    """Sums over all rows of the products of all pairs of columns; a task gives out one triangle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch, names)
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "part"])

    found = df.select(*names).mapInArrow(run, "i int, j int, part double").groupBy("i", "j").agg(F.sum("part").alias("s")).toPandas()
    i, j = found["i"].to_numpy(), found["j"].to_numpy()
    out = np.zeros((int(i.max()) + 1,) * 2)
    out[i, j] = out[j, i] = found["s"].to_numpy()
    return out


def _combined(df: DataFrame, names: list[str], weights: np.ndarray, out: str, keep: list[str]) -> DataFrame:
    """``keep`` and the columns ``names`` times a matrix, as one list column."""
    schema = df.select(*keep).schema.add(out, ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _matrix(batch, names) @ weights
            offsets = pa.array(np.arange(len(made) + 1, dtype=np.int32) * weights.shape[1])
            lists = pa.ListArray.from_arrays(offsets, pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists], names=[*keep, out])

    return df.select(*dict.fromkeys([*keep, *names])).mapInArrow(run, schema)


def _whitened(g: np.ndarray, least: float) -> np.ndarray:
    """Weights that make columns with this Gram matrix orthonormal. Columns no longer than ``least`` are left out, and
    directions in which the others differ by next to nothing."""
    length = np.sqrt(np.maximum(np.diag(g), 0.0))
    long = np.flatnonzero(length > least)
    if not len(long):
        return np.zeros((len(g), 0))
    unit = g[np.ix_(long, long)] / np.outer(length[long], length[long])
    values, vectors = np.linalg.eigh(unit)
    good = values > 1e-12 * values[-1]
    out = np.zeros((len(g), int(good.sum())))
    out[long] = vectors[:, good] / np.sqrt(values[good]) / length[long, None]
    return out


# ---- the matrix, as sums over the long table --------------------------------------------------------


class _Cells:
    """The centred matrix of samples by features; cells without a row stand at their sample's base."""

    def __init__(self, df: DataFrame, base: DataFrame | None):
        cells = df.select("feature", "sample", F.col("value").cast("double").alias("value"))
        if base is None:
            cells = cells.withColumn("_d", F.col("value"))
            self.samples = None
        else:
            self.samples = durable(base.select("sample", F.col("base").cast("double").alias("base")))
            cells = cells.join(self.samples, "sample").withColumn("_d", F.col("value") - F.col("base"))
        self.cells = durable(cells)
        if base is None:
            self.n = self.cells.agg(F.count_distinct("sample")).first()[0]
            shift = 0.0
        else:
            self.n, shift = self.samples.agg(F.count(F.lit(1)), F.avg("base")).first()
            shift = shift or 0.0
        mean = F.sum("_d") / F.lit(float(max(self.n, 1))) + F.lit(shift)
        self.features = durable(self.cells.groupBy("feature").agg(mean.alias("mu")))

    def total(self) -> float:
        """Sum of squares of the centred matrix."""
        over = self.cells.join(self.features, "feature")
        if self.samples is None:
            return over.agg(F.sum((F.col("value") - F.col("mu")) ** 2)).first()[0] or 0.0
        shift, about = self.samples.agg(F.avg("base"), F.var_pop("base")).first()
        listed = over.agg(F.sum((F.col("value") - F.col("mu")) ** 2 - (F.col("base") - F.col("mu")) ** 2)).first()[0] or 0.0
        zeros = self.features.agg(F.sum((F.lit(shift) - F.col("mu")) ** 2 + F.lit(about))).first()[0] or 0.0
        return listed + zeros * self.n

    def scores(self, block: DataFrame, name: str, ones: np.ndarray, means: np.ndarray) -> DataFrame:
        """(sample, s0, s1, ...): the matrix times a list column, whose sums with ones and with the means are given."""
        b = len(ones)
        own = self.cells.join(block.select("feature", name), "feature").groupBy("sample")
        own = own.agg(*[F.sum(F.col("_d") * F.get(name, F.lit(i))).alias(f"s{i}") for i in range(b)])
        if self.samples is None:
            return own.select("sample", *[(F.col(f"s{i}") - F.lit(float(means[i]))).alias(f"s{i}") for i in range(b)])
        every = self.samples.join(own, "sample", "left")
        return every.select("sample", *[(F.coalesce(F.col(f"s{i}"), F.lit(0.0)) + F.col("base") * F.lit(float(ones[i])) - F.lit(float(means[i]))).alias(f"s{i}") for i in range(b)])

    def image(self, scores: DataFrame, b: int) -> DataFrame:
        """(feature, z): the transposed matrix times the scores. Their sums vanish, so only the base needs a correction."""
        s = [f"s{i}" for i in range(b)]
        plus = [0.0] * b
        if self.samples is not None:
            row = scores.join(self.samples, "sample").agg(*[F.sum(F.col(c) * F.col("base")).alias(c) for c in s]).first()
            plus = [row[c] or 0.0 for c in s]
        sums = self.cells.join(scores, "sample").groupBy("feature").agg(*[F.sum(F.col("_d") * F.col(c)).alias(c) for c in s])
        return sums.select("feature", F.array(*[F.col(c) + F.lit(float(p)) for c, p in zip(s, plus, strict=True)]).alias("z"))


def _start(cells: _Cells, width: int) -> DataFrame:
    random = [(F.pmod(F.xxhash64("feature", F.lit(i)), F.lit(1_000_003)) / 1_000_003.0 - 0.5) for i in range(width)]
    return cells.features.select("feature", "mu", F.lit(1.0).alias("one"), F.array(*random).alias("w"))


def _krylov(cells: _Cells, k: int) -> tuple[DataFrame, np.ndarray]:
    """Loadings (feature, mu, one, l: list of k) and the sums of squares of their scores."""
    known = ["feature", "mu", "one"]
    fresh = _start(cells, BLOCK)  # known, and w: candidates for directions
    names, weights = ["w"], _whitened(gram(fresh, ["w"]), 0.0)
    for _ in range(RESTARTS):
        blocks: list[tuple[str, str]] = []  # names of the list columns of directions and of their images
        while True:
            held = known + [c for pair in blocks for c in pair]
            # orthonormal with themselves: twice, since once loses digits
            fresh = durable(_combined(fresh, names, weights, "w", held))
            h = gram(fresh, ["one", "mu", "w"])
            again = _whitened(h[2:, 2:], 0.0)
            q, z = f"q{len(blocks)}", f"z{len(blocks)}"
            space = _combined(fresh, ["w"], again, q, held)
            ones, means = h[0, 2:] @ again, h[1, 2:] @ again
            scores = cells.scores(space, q, ones, means)
            scores = scores if cells.samples is None else durable(scores)
            space = durable(space.join(cells.image(scores, len(ones)), "feature").withColumnRenamed("z", z))
            blocks.append((q, z))
            qs, zs = [pair[0] for pair in blocks], [pair[1] for pair in blocks]
            m = gram(space, [*qs, *zs])
            r, newest = len(m) // 2, len(ones)
            t = (m[:r, r:] + m[r:, :r]) / 2
            values, vectors = np.linalg.eigh((t + t.T) / 2)
            values, vectors = values[::-1], vectors[:, ::-1]
            scale, top = max(float(values[0]), 0.0), min(k, r)
            lead = vectors[:, :top]
            if _miss(space, qs, zs, lead, values[:top], m) <= TOLERANCE * scale and scale > 0:
                return _combined(space, qs, lead, "l", known), values[:top]
            if len(blocks) == DEPTH:
                break
            # the newest image, without what the space holds already; what rounding left of that goes with the lengths
            first = np.concatenate([-t[:, -newest:], np.eye(newest)])
            fresh = durable(_combined(space, [*qs, z], first, "w", [*held, q, z]))
            h = gram(fresh, [*qs, "w"])
            over = h[:r, r:]
            weights = _whitened(h[r:, r:] - over.T @ over, NOTHING * scale)
            if not weights.shape[1]:  # the space is all there is
                return _combined(space, qs, lead, "l", known), values[:top]
            names, weights = [*qs, "w"], np.concatenate([-over @ weights, weights])
        fresh = durable(_combined(space, qs, vectors[:, :BLOCK], "w", known))
        names, weights = ["w"], _whitened(gram(fresh, ["w"]), 0.0)
    raise RuntimeError(f"components have not converged in {RESTARTS} restarts")


def _miss(space: DataFrame, qs: list[str], zs: list[str], lead: np.ndarray, values: np.ndarray, m: np.ndarray) -> float:
    """How far the images of the components are from their multiples, at most. Near convergence the known products
    lose it in rounding, so it is then summed row by row."""
    both = np.concatenate([-lead * values, lead])
    rough = float(np.sqrt(np.maximum(np.diag(both.T @ m @ both), 0.0)).max())
    if rough > 1e-6 * float(values[0]):
        return rough
    return float(np.sqrt(np.diag(gram(_combined(space, [*qs, *zs], both, "e", []), ["e"])).max()))


def pca(df: DataFrame, k: int = 2, *, base: DataFrame | None = None) -> Components:
    """Scores, loadings and variance shares; the largest loading of a component is positive.

    ``df`` is the long matrix. Without ``base`` it has a row for every cell; with it (sample, base) a cell without
    a row has its sample's base value, and ``base`` lists all samples.
    """
    cells = _Cells(df, base)
    directions, squares = _krylov(cells, k)
    found = len(squares)
    pcs = [f"PC{i + 1}" for i in range(k)]
    listed = directions.select("feature", "mu", "one", *[(F.get("l", F.lit(i)) if i < found else F.lit(0.0)).alias(p) for i, p in enumerate(pcs)])
    listed = durable(listed)
    ends = [F.max_by(p, F.struct(F.abs(p), F.col("feature"))).alias(p) for p in pcs]
    row = listed.agg(*ends, *[F.sum(p).alias(f"o{p}") for p in pcs], *[F.sum(F.col("mu") * F.col(p)).alias(f"m{p}") for p in pcs]).first()
    sign = [-1.0 if row[p] < 0 else 1.0 for p in pcs]
    loadings = listed.select("feature", *[(F.col(p) * s).alias(p) for p, s in zip(pcs, sign, strict=True)])
    ones, means = (np.array([row[f"{c}{p}"] * s for p, s in zip(pcs, sign, strict=True)]) for c in "om")
    scores = cells.scores(loadings.withColumn("l", F.array(*pcs)), "l", ones, means)
    scores = scores.withColumnsRenamed({f"s{i}": p for i, p in enumerate(pcs)})
    total, freedom = cells.total(), max(cells.n - 1, 1)
    rows = []
    for i, p in enumerate(pcs):
        square = float(squares[i]) if i < found else 0.0
        rows.append((p, square / freedom, square / total if total else None))
    variance = df.sparkSession.createDataFrame(rows, "component string, variance double, share double")
    label = F.lit(None).cast("string")
    for p in pcs:
        label = F.when(F.col("component") == p, percent_label(p, F.col("share"))).otherwise(label)
    return Components(scores, loadings, variance.withColumn("label", label))


def top_contributors(loadings: DataFrame, n: int = 30) -> DataFrame:
    """The features with the longest (PC1, PC2) vectors."""
    sized = loadings.withColumn("magnitude", magnitude(F.col("PC1"), F.col("PC2")))
    return top_k(sized, F.col("magnitude"), n, ["feature"])
