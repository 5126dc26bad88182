"""Per-feature linear models on long (feature, sample, value) matrices.

Designs have a handful of factor levels shared by all features, so a fit needs only sums per
(feature, level): one aggregation with map-side combine, then arithmetic on one row per feature.
A fitted table has one row per feature: ``beta`` and ``cov`` (unscaled, row by row) in the order of
the coefficients, ``sigma``, ``df`` and ``amean``.

The count model takes a group column (``by``): every group of samples is filtered, normalised, weighted, fitted and
moderated on its own, all in one plan. Its zeros stay implicit. A cell without a count has a log value that
depends on its sample alone, so sums over all cells are sums over the samples plus differences in the cells with a
count; where a weight depends on feature and sample, zero cells exist as rows of one stage only, summed before they
could be shuffled or written.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.numeric import r_log2
from tideline.functions.special import digamma, lgamma, t_p_udf, trigamma, trigamma_inverse
from tideline.operators.adjust import p_adjust
from tideline.operators.counts import filter_features, sample_blocks, tmm
from tideline.operators.reshape import cast_wide
from tideline.operators.smooth import Curves, Line, lowess, middles, per_group
from tideline.session import durable

Contrasts = Mapping[str, Mapping[str, float]]


def versus(baseline: str, levels: Sequence[str]) -> dict[str, dict[str, float]]:
    """Each level minus the baseline."""
    return {level: {level: 1.0, baseline: -1.0} for level in levels}


def fit_oneway(
    df: DataFrame, samples: DataFrame, stage: str, levels: Sequence[str], *, weight: str | None = None
) -> DataFrame:
    """One mean per level and feature, optionally weighted."""
    cells = df.where(F.col("value").isNotNull()).join(samples.select("sample", stage), "sample")
    cells = cells.where(F.col(stage).isin(list(levels)))
    if weight:
        centre = cells.groupBy("feature").agg(F.avg("value").alias("_centre"))
        cells = cells.join(centre, "feature").withColumn("value", F.col("value") - F.col("_centre"))
    v = F.col("value")
    w = F.col(weight) if weight else F.lit(1.0)
    aggs = []
    for i, level in enumerate(levels):
        here = F.col(stage) == level
        aggs += [F.sum(F.when(here, w)).alias(f"_w{i}"), F.sum(F.when(here, w * v)).alias(f"_s{i}")]
        # central moments do not cancel; the weighted form is centred on the feature's mean first
        spread = F.sum(F.when(here, w * v * v)) if weight else F.var_pop(F.when(here, v))
        aggs.append(spread.alias(f"_q{i}"))
    about = F.first("_centre") if weight else F.lit(0.0)
    sums = cells.groupBy("feature").agg(F.count(F.lit(1)).alias("_n"), (F.avg(v) + about).alias("amean"), about.alias("_about"), *aggs)
    k = range(len(levels))
    mass, mean = [F.col(f"_w{i}") for i in k], [F.col(f"_s{i}") / F.col(f"_w{i}") for i in k]
    left = [
        F.coalesce(F.col(f"_q{i}") - F.col(f"_s{i}") * mean[i] if weight else F.col(f"_q{i}") * mass[i], F.lit(0.0))
        for i in k
    ]
    used = sum([F.when(m.isNotNull(), 1).otherwise(0) for m in mass][1:], F.when(mass[0].isNotNull(), 1).otherwise(0))
    sse = F.greatest(sum(left[1:], left[0]), F.lit(0.0))
    cov = F.array(*[1 / mass[i] if i == j else F.lit(0.0) for i in k for j in k])
    out = sums.withColumn("df", (F.col("_n") - used).cast("double")).withColumn("_sse", sse)
    return out.select(
        "feature", F.array(*[m + F.col("_about") for m in mean]).alias("beta"), cov.alias("cov"),
        F.when(F.col("df") > 0, F.sqrt(F.col("_sse") / F.col("df"))).alias("sigma"), "df", "amean",
    )


def _rows_of(levels: Sequence[str], batches: Sequence[str], sum_coded: bool) -> np.ndarray:
    """Design rows of every (level, batch) cell: level indicators, then batch columns."""
    rows = []
    for i in range(len(levels)):
        for b in range(len(batches)):
            row = [1.0 if i == j else 0.0 for j in range(len(levels))]
            if sum_coded:
                last = b == len(batches) - 1
                row += [-1.0 if last else (1.0 if b == j else 0.0) for j in range(len(batches) - 1)]
            else:
                row += [1.0 if b == j else 0.0 for j in range(1, len(batches))]
            rows.append(row)
    return np.array(rows)


def _solver(design: np.ndarray):
    """Column function: cell counts and centred cell sums -> coefficients, covariance, explained SS."""
    p = design.shape[1]

    @F.pandas_udf("beta array<double>, cov array<double>, explained double, rank int")
    def solve(n: pd.Series, s: pd.Series) -> pd.DataFrame:
        counts = np.array([np.asarray(x, float) for x in n]).reshape(len(n), design.shape[0])
        sums = np.array([np.asarray(x, float) for x in s]).reshape(counts.shape)
        beta = np.full((len(counts), p), np.nan)
        cov = np.full((len(counts), p, p), np.nan)
        explained, rank = np.zeros(len(counts)), np.zeros(len(counts), int)
        # features with the same missing cells share one normal matrix
        patterns, which = np.unique(counts, axis=0, return_inverse=True)
        for g, pattern in enumerate(patterns):
            rows = np.flatnonzero(which.ravel() == g)
            seen = design[pattern > 0]
            est: list[int] = []
            for j in range(p):  # a coefficient that adds no rank is not estimable
                if len(seen) and np.linalg.matrix_rank(seen[:, [*est, j]]) > len(est):
                    est.append(j)
            if not est:
                continue
            x = design[:, est]
            inverse = np.linalg.inv(x.T @ (pattern[:, None] * x))
            right = sums[rows] @ x
            b = right @ inverse
            beta[np.ix_(rows, est)] = b
            cov[np.ix_(rows, est, est)] = inverse
            explained[rows] = np.einsum("ij,ij->i", b, right)
            rank[rows] = len(est)
        return pd.DataFrame({
            "beta": [[None if np.isnan(v) else v for v in row] for row in beta],
            "cov": [[None if np.isnan(v) else v for v in m.ravel()] for m in cov],
            "explained": explained,
            "rank": rank,
        })

    return solve


def fit_shared(
    df: DataFrame,
    samples: DataFrame,
    stage: str,
    levels: Sequence[str],
    batch: str,
    batches: Sequence[str],
    *,
    sum_coded: bool = False,
) -> DataFrame:
    """Level means with an additive batch effect; coefficients are the levels, then the batch columns."""
    design = _rows_of(levels, batches, sum_coded)
    cells = df.where(F.col("value").isNotNull()).join(samples.select("sample", stage, batch), "sample")
    cells = cells.where(F.col(stage).isin(list(levels)) & F.col(batch).isin(list(batches)))
    v = F.col("value")
    places = [(a, b) for a in levels for b in batches]
    here = [(F.col(stage) == a) & (F.col(batch) == b) for a, b in places]
    sums = cells.groupBy("feature").agg(
        F.count(F.lit(1)).alias("_n"), F.avg(v).alias("amean"), F.var_pop(v).alias("_v"),
        *[F.count_if(c).alias(f"_n{i}") for i, c in enumerate(here)],
        *[F.coalesce(F.sum(F.when(c, v)), F.lit(0.0)).alias(f"_s{i}") for i, c in enumerate(here)],
    )
    k = range(len(places))
    centred = F.array(*[F.col(f"_s{i}") - F.col(f"_n{i}") * F.col("amean") for i in k])
    solved = _solver(design)(F.array(*[F.col(f"_n{i}").cast("double") for i in k]), centred)
    out = sums.select("feature", "_n", "amean", "_v", solved.alias("_f"))
    # sums were centred on the feature mean; the level columns add up to one, so it goes back there
    shift = F.transform("_f.beta", lambda b, i: b + F.when(i < len(levels), F.col("amean")).otherwise(0.0))
    sse = F.greatest(F.col("_n") * F.col("_v") - F.col("_f.explained"), F.lit(0.0))
    df_resid = (F.col("_n") - F.col("_f.rank")).cast("double")
    return out.select(
        "feature", shift.alias("beta"), F.col("_f.cov").alias("cov"),
        F.when(df_resid > 0, F.sqrt(sse / df_resid)).alias("sigma"), df_resid.alias("df"), "amean",
    )


def remove_batch(
    df: DataFrame, samples: DataFrame, stage: str, levels: Sequence[str], batch: str, batches: Sequence[str]
) -> DataFrame:
    """Subtract the sum-coded batch term of a fit that keeps the stage design."""
    fit = fit_shared(df, samples, stage, levels, batch, batches, sum_coded=True)
    k = len(levels)
    effect = [F.coalesce(F.col("beta")[k + j], F.lit(0.0)) for j in range(len(batches) - 1)]
    last = -sum(effect[1:], effect[0])
    term = F.when(F.col(batch) == batches[-1], last)
    for b, e in zip(batches, effect):
        term = term.when(F.col(batch) == b, e)
    cells = df.join(samples.select("sample", batch), "sample").join(fit.select("feature", "beta"), "feature")
    return cells.select("feature", "sample", (F.col("value") - term).alias("value"))


def _by(by: str | None) -> list[str]:
    return [by] if by else []


def contrast(fit: DataFrame, coefs: Sequence[str], contrasts: Contrasts, *, by: str | None = None) -> DataFrame:
    """One row per feature and contrast: log fold change and its unscaled standard deviation."""
    k = len(coefs)
    rows = []
    for name, weights in contrasts.items():
        used = [(list(coefs).index(c), w) for c, w in weights.items() if w != 0]
        lfc = [F.lit(w) * F.col("beta")[i] for i, w in used]
        var = [F.lit(w * x) * F.col("cov")[i * k + j] for i, w in used for j, x in used]
        rows.append(F.struct(
            F.lit(name).alias("contrast"), sum(lfc[1:], lfc[0]).alias("lfc"),
            F.sqrt(sum(var[1:], var[0])).alias("unscaled"),
        ))
    wide = fit.select(*_by(by), "feature", "sigma", "df", "amean", F.explode(F.array(*rows)).alias("_c"))
    return wide.select(*_by(by), "feature", "_c.contrast", "_c.lfc", "_c.unscaled", "sigma", "df", "amean")


class Prior(NamedTuple):
    """Degrees of freedom and variance of the prior, and the pooled degrees of freedom."""

    df: float
    variance: float
    pooled: float


def variance_priors(fit: DataFrame, *, by: str | None = None) -> dict[object, Prior]:
    """The prior of each group's variances, from sums per residual degrees of freedom.

    With one number of degrees of freedom the prior comes from the mean and spread of the log variances.
    With several, that spread mixes noises of different size; then the prior is the most likely one
    under the scaled F law of the variances, found along its degrees of freedom. For each of these the
    prior variance follows from a weighted mean of the log variances, so the search is over one number.
    """
    keys = _by(by)
    var = fit.where((F.col("df") > 0) & F.col("sigma").isNotNull()).select(*keys, "df", (F.col("sigma") ** 2).alias("_x"))
    x = F.log("_x")
    # one row per group and number of degrees of freedom: at most as many as there are samples
    summary = [F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("spread"), F.min("_x").alias("least"), F.max("_x").alias("most")]
    sums = var.groupBy(*keys, "df").agg(*summary).collect()
    if not sums:
        return {}
    ends: dict = {}
    for r in sums:
        least, most = ends.get(r[by] if by else None, (math.inf, 0.0))
        ends[r[by] if by else None] = (min(least, r["least"]), max(most, r["most"]))
    if any(least < 1e-5 * most for least, most in ends.values()):  # else no variance is below the floor
        middle = middles(Line(var, by, "_x"))
        var = var.withColumn("_x", F.greatest(F.col("_x"), per_group(by, {g: 1e-5 * (m or 1.0) for g, m in middle.items()})))
        sums = var.groupBy(*keys, "df").agg(*summary).collect()
    classes: dict[object, list[tuple[float, int, float, float]]] = {}
    for r in sums:
        half = np.array([r["df"] / 2])
        shift = float(np.log(half)[0] - digamma(half)[0])
        classes.setdefault(r[by] if by else None, []).append((r["df"], r["n"], r["mean"] + shift, r["spread"]))
    out, several = {}, {}
    for g, rows in classes.items():
        df, n, mean, spread = (np.array(c, float) for c in zip(*sorted(rows), strict=True))
        total = n.sum()
        centre = (n * mean).sum() / total
        around = (n * (spread + (mean - centre) ** 2)).sum()
        noise = (n * trigamma(df / 2)).sum() / total
        extra = around / (total - 1) - noise if total > 1 else 0.0
        pooled = float((n * df).sum())
        if len(df) > 1 and total > 1:
            several[g] = (df, n, mean, pooled)
        d0 = 2 * trigamma_inverse(extra) if extra > 0 else float("inf")
        out[g] = Prior(d0, _prior_variance(d0, df, n, mean), pooled)
    if several:
        out.update(_likely_priors(var, several, by))
    return out


def _prior_variance(d0: float, df: np.ndarray, n: np.ndarray, mean: np.ndarray) -> float:
    """The prior variance that the mean log variances have under ``d0`` prior degrees of freedom."""
    if math.isinf(d0):
        w = n / trigamma(df / 2)
        return float(np.exp((w * mean).sum() / w.sum())) if len(df) > 1 else float(np.exp(mean[0]))
    half = np.array([d0 / 2])
    w = n / (trigamma(df / 2) + trigamma(half)[0])
    return float(np.exp((w * mean).sum() / w.sum() + digamma(half)[0] - math.log(d0 / 2)))


#: Prior degrees of freedom tried at once, and how often the best stretch of them is cut again.
TRIES, ZOOMS = 24, 6


def _likely_priors(var: DataFrame, groups: dict, by: str | None) -> dict[object, Prior]:
    """The most likely prior of each group, by narrowing d0 / (1 + d0) between 0 and 1."""
    bounds = {g: (0.0, 1.0) for g in groups}
    best: dict[object, tuple[float, float, float]] = {}
    for _ in range(ZOOMS):
        tried = {}
        for g, (df, n, mean, _) in groups.items():
            grid = np.linspace(*bounds[g], TRIES + 2)[1:]
            # the end of the first stretch is the infinite prior
            d0 = np.array([t / (1 - t) if t < 1 else np.inf for t in grid])
            tried[g] = (grid, d0, np.array([_prior_variance(d, df, n, mean) for d in d0]))
        terms = []
        for i in range(TRIES + 1):
            s0 = per_group(by, {g: float(t[2][i]) for g, t in tried.items()})
            d0 = per_group(by, {g: float(t[1][i]) if np.isfinite(t[1][i]) else -1.0 for g, t in tried.items()})
            ratio = F.col("df") * F.col("_x") / s0
            finite = (F.col("df") + d0) / 2 * F.log1p(ratio / d0)
            terms.append(F.sum(F.when(d0 > 0, finite).otherwise(ratio / 2)).alias(f"l{i}"))
        logs = F.sum(F.when(F.col("df") != 2, (F.col("df") / 2 - 1) * F.log("_x")).otherwise(0.0)).alias("logs")
        for r in var.groupBy(*_by(by)).agg(logs, *terms).collect():
            g = r[by] if by else None
            if g not in groups:
                continue
            df, n, mean, _ = groups[g]
            grid, d0, s0 = tried[g]
            like = np.array([_log_constants(d, s, df, n) + r["logs"] - r[f"l{i}"] for i, (d, s) in enumerate(zip(d0, s0, strict=True))])
            top = int(like.argmax())
            if g not in best or like[top] > best[g][0]:
                best[g] = (float(like[top]), float(d0[top]), float(s0[top]))
            low = bounds[g][0] if top == 0 else grid[top - 1]
            bounds[g] = (float(low), float(grid[min(top + 1, TRIES)]))
    return {g: Prior(d0, s0, groups[g][3]) for g, (_, d0, s0) in best.items()}


def _log_constants(d0: float, s0: float, df: np.ndarray, n: np.ndarray) -> float:
    """What the log likelihood of all variances holds besides sums over them."""
    half = df / 2
    each = half * np.log(df / s0) - lgamma(half)
    if math.isinf(d0):
        each = each - half * math.log(2)
    else:
        each = each - half * math.log(d0) + lgamma(half + d0 / 2) - lgamma(np.array([d0 / 2]))
    return float((n * each).sum())


def variance_prior(fit: DataFrame) -> tuple[float, float, float]:
    """The prior of a table without groups."""
    return tuple(variance_priors(fit).get(None, Prior(float("inf"), float("nan"), 0.0)))


def ebayes(fit: DataFrame, coefs: Sequence[str], contrasts: Contrasts, *, by: str | None = None) -> DataFrame:
    """Moderated t and p per feature and contrast: variances shrunk towards the group's common prior."""
    fit = durable(fit)  # one row per feature, read by the prior and again by the tests
    priors = variance_priors(fit, by=by)
    if by is None and not priors:
        priors = {None: Prior(float("inf"), float("nan"), 0.0)}
    d0 = per_group(by, {g: p.df if math.isfinite(p.df) else -1.0 for g, p in priors.items()})
    s0, pooled = (per_group(by, {g: float(p[i]) for g, p in priors.items()}) for i in (1, 2))
    tests = contrast(fit, coefs, contrasts, by=by)
    s2, df = F.col("sigma") ** 2, F.col("df")
    shrunk = F.when(df > 0, (d0 * s0 + df * s2) / (d0 + df)).otherwise(s0)
    post = F.when(d0 < 0, s0).otherwise(shrunk)
    total = F.when(d0 < 0, pooled).otherwise(F.least(df + d0, pooled))
    tests = tests.withColumns({"s2_post": post, "df_total": total})
    tests = tests.withColumn("t", F.col("lfc") / (F.col("unscaled") * F.sqrt("s2_post")))
    return tests.withColumn("p", F.when(F.col("t").isNotNull(), t_p_udf("t", "df_total")))


def classify(tests: DataFrame, *, p_max: float = 0.05, lfc_min: float = 1.0) -> DataFrame:
    """Significant and up/down per test; both limits are strict."""
    hit = (F.col("padj") < p_max) & (F.abs(F.col("lfc")) > lfc_min)
    out = tests.withColumn("significant", hit)
    regulation = F.when(F.col("significant") & (F.col("lfc") < 0), "Down").when(F.col("significant"), "Up")
    return out.withColumn("regulation", regulation.otherwise("None"))


def results(tests: DataFrame, *, p_max: float = 0.05, lfc_min: float = 1.0, by: str | None = None) -> DataFrame:
    """Result table of all contrasts, adjusted within each contrast."""
    tests = durable(tests.select(*_by(by), "feature", "contrast", "lfc", "p"))
    adjusted = p_adjust(tests, [*_by(by), "contrast"], "p", "bh")
    return classify(adjusted, p_max=p_max, lfc_min=lfc_min).select(
        *_by(by), "feature", "lfc", "padj", F.col("contrast").alias("stage"), "significant", "regulation"
    )


MILLION = math.log2(1e6)
#: log2 of the half count that stands for a zero, per million and per unit of library size.
ZERO = MILLION - 1.0


class Scales(NamedTuple):
    """Samples with their level and log2 library size, and what their zero cells add up to per level."""

    samples: DataFrame  # [by], sample, stage, place, _log (log2 size), _zero (a zero's value), _about (its mean over the level)
    zeros: dict  # group -> per level the number of samples, the mean of their zeros, and the squares about it
    mean_log: dict  # group -> mean log2 size over all samples


def log_scales(samples: DataFrame, factors: DataFrame, stage: str, levels: Sequence[str], *, by: str | None = None) -> Scales:
    """The scales of the samples in ``factors``."""
    keys = _by(by)
    place = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col(stage)).cast("int")
    sized = factors.select(*keys, "sample", F.log2(F.col("lib_size") * F.col("factor") + 1).alias("_log"))
    sized = sized.join(samples.select(*keys, "sample", stage, place.alias("place")), [*keys, "sample"], "left")
    sized = sized.withColumn("_zero", F.lit(ZERO) - F.col("_log"))
    found = sized.groupBy(*keys, "place").agg(F.count(F.lit(1)).alias("n"), F.avg("_zero").alias("m"), F.var_pop("_zero").alias("v"), F.avg("_log").alias("log")).collect()
    zeros: dict = {}
    logs: dict = {}
    for r in found:
        g = r[by] if by else None
        at = zeros.setdefault(g, [(0.0, 0.0, 0.0)] * len(levels))
        if r["place"]:
            at[r["place"] - 1] = (float(r["n"]), r["m"], r["v"] * r["n"])
        logs.setdefault(g, []).append((r["n"], r["log"]))
    mean_log = {g: sum(n * m for n, m in rows) / sum(n for n, _ in rows) for g, rows in logs.items()}
    about = per_group(by, {g: [m for _, m, _ in rows] for g, rows in zeros.items()})
    known = sized.where(F.col("place") > 0).withColumn("_about", F.element_at(about, F.col("place")))
    return Scales(known, zeros, mean_log)


def _log_cells(df: DataFrame, scales: Scales, by: str | None) -> DataFrame:
    """The cells with a count, their log value ``value`` and what it would be without one, ``_zero``."""
    cells = df.where(F.col("value") > 0).join(scales.samples, [*_by(by), "sample"])
    return cells.withColumn("value", F.log2(F.col("value") + 0.5) + F.lit(MILLION) - F.col("_log"))


def fit_counts(cells: DataFrame, features: DataFrame, scales: Scales, levels: Sequence[str], *, by: str | None = None) -> DataFrame:
    """:func:`fit_oneway` on log counts whose zero cells are not listed.

    A level's sum over all its samples is that of their zeros, which is known, plus what the listed cells differ
    from a zero.
    """
    keys = _by(by)
    k = range(len(levels))
    v, z = F.col("value") - F.col("_about"), F.col("_zero") - F.col("_about")
    aggs = []
    for i in k:
        here = F.col("place") == i + 1
        aggs += [F.sum(F.when(here, v - z)).alias(f"_s{i}"), F.sum(F.when(here, v * v - z * z)).alias(f"_q{i}")]
    listed = cells.groupBy(*keys, "feature").agg(*aggs)
    every = features.join(listed, [*keys, "feature"], "left")
    n, centre, squares = ([per_group(by, {g: rows[i][j] for g, rows in scales.zeros.items()}) for i in k] for j in range(3))
    shift = [F.when(n[i] > 0, F.coalesce(F.col(f"_s{i}"), F.lit(0.0)) / F.nullif(n[i], F.lit(0.0))) for i in k]
    mean = [centre[i] + shift[i] for i in k]
    over = [squares[i] + F.coalesce(F.col(f"_q{i}"), F.lit(0.0)) - shift[i] * shift[i] * n[i] for i in k]
    left = [F.when(n[i] > 0, F.greatest(over[i], F.lit(0.0))).otherwise(0.0) for i in k]
    total, used = sum(n[1:], n[0]), sum([F.when(m > 0, 1).otherwise(0) for m in n][1:], F.when(n[0] > 0, 1).otherwise(0))
    weighed = [F.coalesce(n[i] * mean[i], F.lit(0.0)) for i in k]
    out = every.withColumn("df", (total - used).cast("double"))
    return out.select(
        *keys, "feature", F.array(*mean).alias("beta"), F.array(*[1 / F.nullif(n[i], F.lit(0.0)) if i == j else F.lit(0.0) for i in k for j in k]).alias("cov"),
        F.when(F.col("df") > 0, F.sqrt(sum(left[1:], left[0]) / F.col("df"))).alias("sigma"), "df", (sum(weighed[1:], weighed[0]) / total).alias("amean"),
    )


class Trend(NamedTuple):
    """What the weights of a count matrix need: scales, the plain fit, and the trend of spread with size."""

    scales: Scales
    fit: DataFrame
    curves: Curves


def count_trend(
    df: DataFrame, samples: DataFrame, factors: DataFrame, stage: str, levels: Sequence[str],
    *, span: float = 0.5, by: str | None = None,
) -> Trend:
    """Spread of log counts against their size, smoothed over one point per feature."""
    scales = log_scales(samples, factors, stage, levels, by=by)
    features = df.select(*_by(by), "feature").distinct()
    fit = durable(fit_counts(_log_cells(df, scales, by), features, scales, levels, by=by))
    size = F.col("amean") + per_group(by, {g: m - MILLION for g, m in scales.mean_log.items()})
    points = fit.where(F.col("sigma").isNotNull()).select(*_by(by), size.alias("x"), F.sqrt("sigma").alias("y"))
    return Trend(scales, fit, lowess(points, span=span, by=by))


def _weight(trend: Trend, beta: Column) -> Column:
    """The precision of a cell whose fitted log value is ``beta`` per million."""
    return F.pow(trend.curves.at(beta + F.col("_log") - F.lit(MILLION)), F.lit(-4.0))


def voom(
    df: DataFrame, samples: DataFrame, factors: DataFrame, stage: str, levels: Sequence[str], *, span: float = 0.5
) -> DataFrame:
    """(feature, sample, value, weight): log-CPM with precision weights from the mean-variance trend.

    One row per listed feature and sample: this is the dense result. The trend and its fit need no zero cell.
    """
    trend = count_trend(df, samples, factors, stage, levels, span=span)
    zeros = _zero_cells(trend, None)
    listed = df.where(F.col("value") > 0).select("feature", "sample", F.log2(F.col("value") + 0.5).alias("_y"))
    cells = zeros.join(listed, ["feature", "sample"], "left")
    value = F.coalesce(F.col("_y"), F.lit(-1.0)) + F.lit(MILLION) - F.col("_log")
    return cells.select("feature", "sample", value.alias("value"), _weight(trend, F.col("_beta")).alias("weight"))


def _zero_cells(trend: Trend, by: str | None) -> DataFrame:
    """Every feature and sample, with the feature's fitted value for the sample's level."""
    keys = _by(by)
    n = int(sum(level[0] for rows in trend.scales.zeros.values() for level in rows))
    blocks = sample_blocks(trend.scales.samples.select(*keys, "place", "sample", "_log", "_zero"), [*keys, "place"], ["sample", "_log", "_zero"], n)
    fitted = trend.fit.select(*keys, "feature", F.posexplode("beta").alias("_i", "_beta")).where(F.col("_beta").isNotNull())
    fitted = fitted.withColumn("place", F.col("_i") + 1)
    return fitted.join(blocks, [*keys, "place"]).select(*keys, "feature", "place", "_beta", F.explode("_members").alias("_s")).select(*keys, "feature", "place", "_beta", "_s.*")


def fit_weighted_counts(df: DataFrame, trend: Trend, levels: Sequence[str], *, by: str | None = None) -> DataFrame:
    """The weighted fit over all cells: zero cells are made and summed within a stage, listed ones add the difference."""
    keys = _by(by)
    w, off = _weight(trend, F.col("_beta")), F.col("_zero") - F.col("_beta")
    zeros = _zero_cells(trend, by).select(*keys, "feature", "place", w.alias("w"), off.alias("z"))
    zeros = zeros.select(*keys, "feature", "place", "w", (F.col("w") * F.col("z")).alias("s"), (F.col("w") * F.col("z") * F.col("z")).alias("q"))
    cells = _log_cells(df, trend.scales, by).join(trend.fit.select(*keys, "feature", "beta"), [*keys, "feature"])
    cells = cells.withColumn("_beta", F.element_at("beta", F.col("place")))
    seen = F.col("value") - F.col("_beta")
    cells = cells.select(*keys, "feature", "place", w.alias("w"), (seen - off).alias("s"), (seen * seen - off * off).alias("q"))
    cells = cells.select(*keys, "feature", "place", F.lit(0.0).alias("w"), (F.col("w") * F.col("s")).alias("s"), (F.col("w") * F.col("q")).alias("q"))
    aggs = []
    for i in range(len(levels)):
        here = F.col("place") == i + 1
        aggs += [F.sum(F.when(here, F.col(c))).alias(f"_{c}{i}") for c in "wsq"]
    sums = zeros.unionByName(cells).groupBy(*keys, "feature").agg(*aggs)
    out = sums.join(trend.fit.select(*keys, "feature", F.col("beta").alias("_b"), "df", "amean"), [*keys, "feature"])
    k = range(len(levels))
    mass = [F.nullif(F.col(f"_w{i}"), F.lit(0.0)) for i in k]  # none where a group has no trend
    shift = [F.col(f"_s{i}") / mass[i] for i in k]
    left = [F.coalesce(F.greatest(F.col(f"_q{i}") - F.col(f"_s{i}") * shift[i], F.lit(0.0)), F.lit(0.0)) for i in k]
    return out.select(
        *keys, "feature", F.array(*[F.col("_b")[i] + shift[i] for i in k]).alias("beta"),
        F.array(*[1 / mass[i] if i == j else F.lit(0.0) for i in k for j in k]).alias("cov"),
        F.when(F.col("df") > 0, F.sqrt(sum(left[1:], left[0]) / F.col("df"))).alias("sigma"), "df", "amean",
    )


def count_tests(
    df: DataFrame, samples: DataFrame, stage: str, levels: Sequence[str], contrasts: Contrasts,
    *, n: int = 3, threshold: float = 20, span: float = 0.5, by: str | None = None,
) -> DataFrame:
    """Moderated tests of counts: subset, filter, normalise, weight, fit, moderate.

    ``samples`` lists the samples of each group ``by``; a sample may belong to several groups. Features are
    filtered after the samples are subset; the order changes the result.
    """
    subset = df.join(samples.select(*_by(by), "sample").distinct(), "sample")
    kept = durable(filter_features(subset, n, threshold, by=by))
    factors = tmm(kept, by=by)
    trend = count_trend(kept, samples, factors, stage, levels, span=span, by=by)
    return ebayes(fit_weighted_counts(kept, trend, levels, by=by), levels, contrasts, by=by)


def count_de(
    df: DataFrame, samples: DataFrame, stage: str, levels: Sequence[str], contrasts: Contrasts,
    *, n: int = 3, threshold: float = 20, span: float = 0.5, by: str | None = None, p_max: float = 0.05, lfc_min: float = 1.0,
) -> DataFrame:
    """Differential expression of counts, of all groups in one plan: :func:`count_tests`, adjusted and classified."""
    tests = count_tests(df, samples, stage, levels, contrasts, n=n, threshold=threshold, span=span, by=by)
    return results(tests, p_max=p_max, lfc_min=lfc_min, by=by)


def concentration_de(
    df: DataFrame, samples: DataFrame, stage: str, levels: Sequence[str], contrasts: Contrasts,
    *, batch: str | None = None, batches: Sequence[str] = (),
) -> DataFrame:
    """Differential abundance of log values, with or without an additive batch effect."""
    if batch is None:
        fit, coefs = fit_oneway(df, samples, stage, levels), list(levels)
    else:
        fit = fit_shared(df, samples, stage, levels, batch, batches)
        coefs = [*levels, *batches[1:]]
    return results(ebayes(fit, coefs, contrasts))


def lfc_grid(results: DataFrame, group: str, groups: Sequence[str], stages: Sequence[str]) -> DataFrame:
    """Feature by (group, stage) fold changes, stages outermost, zero where a feature was filtered out of a group."""
    label = F.concat(F.col(group), F.lit(", "), F.lower("stage"))
    labelled = results.where(F.col(group).isin(list(groups)) & F.col("stage").isin(list(stages)))
    names = [f"{g}, {stage.lower()}" for stage in stages for g in groups]
    return cast_wide(labelled.select("feature", "lfc", label.alias("label")), ["feature"], "label", "lfc", names, fill=0.0)


def lfc_from_baseline(df: DataFrame, ratio: Column) -> DataFrame:
    """log2 of a ratio to baseline, -infinity at zero."""
    return df.withColumn("lfc", r_log2(ratio))
