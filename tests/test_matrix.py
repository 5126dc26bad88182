import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.functions.special import digamma, trigamma, trigamma_inverse
from tideline.operators import counts as K
from tideline.operators import linear as M
from tideline.operators import pca as P
from tideline.operators import smooth as SM
from tideline.session import durable

STAGES = ["Baseline", "Early", "Late"]


def long(spark, x, kind="double"):
    cells = [(f"f{i:03d}", j, (int if kind == "bigint" else float)(v)) for i, row in enumerate(x) for j, v in enumerate(row) if not (isinstance(v, float) and math.isnan(v))]
    return spark.createDataFrame(cells, f"feature string, sample int, value {kind}")


def meta(spark, n, batch=lambda j: "A" if j % 4 < 2 else "B"):
    return spark.createDataFrame([(j, STAGES[j % 3], batch(j)) for j in range(n)], "sample int, stage string, batch string")


def count_matrix(seed=1, features=90, samples=12):
    rng = np.random.default_rng(seed)
    mean = rng.gamma(0.6, 120, features)[:, None] * rng.uniform(0.5, 2, samples)[None, :]
    return rng.poisson(mean * rng.gamma(4, 0.25, (features, samples)))


# ---- plain references, written directly from the published formulas


def plain_tmm(x):
    x = x[(x > 0).any(axis=1)].astype(float)
    lib = x.sum(axis=0)
    q = np.quantile(x / lib, 0.75, axis=0)
    ref = int(np.argmin(np.abs(q - q.mean())))
    out = []
    for j in range(x.shape[1]):
        ok = (x[:, j] > 0) & (x[:, ref] > 0)
        o, r = x[ok, j], x[ok, ref]
        m = np.round(np.log2(o / lib[j]) - np.log2(r / lib[ref]), 12)
        a = np.round((np.log2(o / lib[j]) + np.log2(r / lib[ref])) / 2, 12)
        v = (lib[j] - o) / lib[j] / o + (lib[ref] - r) / lib[ref] / r
        rank = lambda z: np.array([(z < t).sum() + ((z == t).sum() + 1) / 2 for t in z])
        n = len(m)
        lo_m, lo_a = math.floor(n * 0.3) + 1, math.floor(n * 0.05) + 1
        rm, ra = rank(m), rank(a)
        keep = (rm >= lo_m) & (rm <= n + 1 - lo_m) & (ra >= lo_a) & (ra <= n + 1 - lo_a)
        out.append(0.0 if np.abs(m).max() < 1e-6 else (m[keep] / v[keep]).sum() / (1 / v[keep]).sum())
    return lib, 2 ** (np.array(out) - np.mean(out))


def plain_lowess(x, y, span=0.5, rounds=3):
    order = np.argsort(x, kind="stable")
    xs, ys, n = x[order], y[order], len(x)
    q, delta, width = max(min(int(span * n + 1e-7), n), 2), 0.01 * (xs[-1] - xs[0]), xs[-1] - xs[0]
    rw = np.ones(n)
    for step in range(rounds + 1):
        fit, last, i = np.full(n, np.nan), None, 0
        while True:
            d = np.abs(xs - xs[i])
            h = np.sort(d)[q - 1]
            w = np.where(d <= 0.999 * h, np.where(d <= 0.001 * h, 1, (1 - (d / h) ** 3) ** 3), 0) * rw
            w = w / w.sum()
            a = (w * xs).sum()
            c = (w * (xs - a) ** 2).sum()
            if math.sqrt(c) > 0.001 * width:
                w = w * (1 + (xs[i] - a) / c * (xs - a))
            fit[i] = (w * ys).sum()
            if last is not None and i - last > 1:
                fit[last + 1 : i] = np.interp(xs[last + 1 : i], xs[[last, i]], fit[[last, i]])
            last = i
            if last == n - 1:
                break
            i = max(last + 1, int(np.searchsorted(xs, xs[last] + delta, side="right")) - 1)
        if step == rounds:
            break
        e = np.abs(ys - fit)
        s = 6 * np.median(e)
        r = e / s
        rw = np.where(r <= 0.001, 1, np.where(r <= 0.999, (1 - r**2) ** 2, 0))
    return xs, fit


def plain_fit(y, design, w=None):
    w = np.ones_like(y) if w is None else w
    xtx = design.T @ (w[:, None] * design)
    b = np.linalg.solve(xtx, design.T @ (w * y))
    df = len(y) - design.shape[1]
    return b, np.linalg.inv(xtx), math.sqrt((w * (y - design @ b) ** 2).sum() / df), df


def onehot(n):
    return np.array([[1.0 if j % 3 == k else 0.0 for k in range(3)] for j in range(n)])


# ---- counts


def test_filter_needs_three_samples_strictly_above_twenty(spark):
    df = long(spark, np.array([[21, 21, 21, 0], [21, 21, 20, 20], [99, 99, 0, 0]]), "bigint")
    assert {r.feature for r in K.filter_features(df).collect()} == {"f000"}


def test_dense_matrix_has_every_cell_once(spark):
    x = count_matrix()
    sparse = long(spark, x, "bigint").where("value > 0")
    got = K.complete_cells(sparse, meta(spark, x.shape[1])).collect()
    assert len(got) == (x > 0).any(axis=1).sum() * x.shape[1]
    assert all(r.value == x[int(r.feature[1:]), r.sample] for r in got)


def test_normalisation_factors(spark):
    x = count_matrix(seed=4)
    lib, factor = plain_tmm(x)
    for df in (long(spark, x, "bigint"), long(spark, x, "bigint").where("value > 0")):
        got = sorted(K.tmm(df).collect())
        assert [r.lib_size for r in got] == list(lib)
        assert [r.factor for r in got] == pytest.approx(list(factor), rel=1e-10)
    assert np.log(factor).mean() == pytest.approx(0, abs=1e-12)


def test_log_cpm_prior_scales_with_the_library(spark):
    x = count_matrix(seed=4)
    lib, factor = plain_tmm(x)
    eff = lib * factor
    pad = 2 * eff / eff.mean()
    want = np.log2((x + pad) / (eff + 2 * pad) * 1e6)
    df = long(spark, x, "bigint")
    for r in K.log_cpm(df, K.tmm(df)).collect():
        assert r.value == pytest.approx(want[int(r.feature[1:]), r.sample], rel=1e-10)


# ---- smoothing and weights


@pytest.mark.parametrize("seed,n", [(0, 60), (1, 400)])
def test_smooth_equals_the_published_algorithm(spark, seed, n):
    rng = np.random.default_rng(seed)
    x = np.round(rng.gamma(2, 3, n), 3 if seed else 1)
    y = np.sin(x / 3) + rng.standard_t(2, n) / 5
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    curves = SM.lowess(durable(df))
    xs, want = plain_lowess(x, y)
    assert np.interp(xs, curves.knots[None], curves.values[None]) == pytest.approx(want, abs=1e-8)
    read = df.select("x", curves.at(F.col("x")).alias("f")).toPandas()
    assert read["f"].to_numpy() == pytest.approx(np.interp(read["x"], curves.knots[None], curves.values[None]), abs=1e-12)


def test_smooth_of_many_points_in_groups(spark):
    """Far more points than ranges at a time, and far more points than anchors; a group of one point; equal points."""
    rng = np.random.default_rng(5)
    parts = {"a": rng.gamma(2, 3, 200_000), "b": np.round(rng.normal(size=3000), 2), "c": np.array([4.0]), "d": np.full(7, 2.5)}
    frames = [pd.DataFrame({"g": g, "x": x, "y": np.sin(x / 3) + rng.standard_t(2, len(x)) / 5}) for g, x in parts.items()]
    every = pd.concat(frames)
    curves = SM.lowess(durable(spark.createDataFrame(every)), by="g", held=5000)
    for g in ("a", "b"):
        mine = every[every["g"] == g]
        xs, want = plain_lowess(mine["x"].to_numpy(), mine["y"].to_numpy())
        assert np.interp(xs, curves.knots[g], curves.values[g]) == pytest.approx(want, abs=1e-9)
    for g in ("c", "d"):
        assert curves.values[g] == pytest.approx([every[every["g"] == g]["y"].mean()])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False).map(lambda v: round(v, 3)), min_size=2, max_size=40, unique=True), st.integers(0, 2**32))
def test_steps_of_a_curve_give_its_value(knots, seed):
    knots = np.sort(np.array(knots))
    rng = np.random.default_rng(seed)
    values = rng.normal(size=len(knots))
    t = SM._steps(knots, values)
    x = np.concatenate([knots, rng.uniform(knots[0], knots[-1], 200)])
    i = np.clip(np.floor((x - knots[0]) * t["scale"]).astype(int), 0, SM.STEPS - 1)
    got = t["value"][i] + t["slope"][i] * (x - t["edge"][i]) + (t["bend"][i] * np.maximum(x[:, None] - t["knot"][i], 0)).sum(axis=1)
    steep = np.abs(np.diff(values) / np.diff(knots)).max() * (knots[-1] - knots[0])
    assert got == pytest.approx(np.interp(x, knots, values), abs=1e-9 + 1e-11 * steep)


def test_precision_weights(spark):
    x = count_matrix(seed=7, features=120, samples=12)
    x = x[(x > 5).sum(axis=1) >= 3]
    lib, factor = plain_tmm(x)
    eff = lib * factor + 1
    y = np.log2((x + 0.5) / eff * 1e6)
    design = onehot(12)
    fits = [plain_fit(row, design) for row in y]
    sx = y.mean(axis=1) + np.log2(eff).mean() - np.log2(1e6)
    sy = np.sqrt([f[2] for f in fits])
    gx, gy = plain_lowess(sx, sy)
    fitted = np.array([design @ f[0] for f in fits]) + np.log2(eff) - np.log2(1e6)
    want = np.interp(fitted, gx, gy) ** -4.0
    df = long(spark, x, "bigint")
    for r in M.voom(df, meta(spark, 12), K.tmm(df), "stage", STAGES).collect():
        i = int(r.feature[1:])
        assert r.value == pytest.approx(y[i, r.sample], rel=1e-10)
        assert r.weight == pytest.approx(want[i, r.sample], rel=1e-6)


# ---- linear models


def test_weighted_oneway_fit(spark):
    rng = np.random.default_rng(3)
    y, w = rng.normal(8, 1, (6, 12)), rng.uniform(0.2, 4, (6, 12))
    df = long(spark, y).join(long(spark, w).withColumnRenamed("value", "w"), ["feature", "sample"])
    for r in M.fit_oneway(df, meta(spark, 12), "stage", STAGES, weight="w").collect():
        i = int(r.feature[1:])
        b, cov, sigma, free = plain_fit(y[i], onehot(12), w[i])
        assert r.beta == pytest.approx(b) and r.sigma == pytest.approx(sigma, rel=1e-9) and r.df == free
        assert np.array(r["cov"]).reshape(3, 3) == pytest.approx(cov)


def batch_design(n):
    return np.c_[onehot(n), [0.0 if j % 4 < 2 else 1.0 for j in range(n)]]


def test_shared_fit_with_missing_cells(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(1000, 1, (5, 14))
    y[1, [0, 4]] = np.nan
    y[2, 7] = np.nan
    design = batch_design(14)
    for r in M.fit_shared(long(spark, y), meta(spark, 14), "stage", STAGES, "batch", ["A", "B"]).collect():
        i = int(r.feature[1:])
        ok = ~np.isnan(y[i])
        b, cov, sigma, free = plain_fit(y[i, ok], design[ok])
        assert r.beta == pytest.approx(b, rel=1e-10) and r.sigma == pytest.approx(sigma, rel=1e-7) and r.df == free
        assert np.array(r["cov"]).reshape(4, 4) == pytest.approx(cov, abs=1e-10)


def test_shared_fit_without_batch_equals_oneway(spark):
    rng = np.random.default_rng(6)
    df, who = long(spark, rng.normal(size=(4, 9))), meta(spark, 9, lambda j: "A")
    a = {r.feature: r for r in M.fit_shared(df, who, "stage", STAGES, "batch", ["A"]).collect()}
    for r in M.fit_oneway(df, who, "stage", STAGES).collect():
        assert a[r.feature].beta == pytest.approx(r.beta) and a[r.feature].sigma == pytest.approx(r.sigma)


def test_confounded_batch_is_not_estimable(spark):
    rng = np.random.default_rng(8)
    who = meta(spark, 9, lambda j: "B" if j % 3 == 2 else "A")
    r = M.fit_shared(long(spark, rng.normal(size=(1, 9))), who, "stage", STAGES, "batch", ["A", "B"]).first()
    assert r.beta[3] is None and None not in r.beta[:3] and r.df == 6


def test_no_batch_effect_is_left(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(size=(5, 16)) + batch_design(16)[:, 3] * 4
    who = meta(spark, 16)
    clean = M.remove_batch(long(spark, y), who, "stage", STAGES, "batch", ["A", "B"])
    for r in M.fit_shared(clean, who, "stage", STAGES, "batch", ["A", "B"]).collect():
        assert r.beta[3] == pytest.approx(0, abs=1e-10)


def test_moderated_tests(spark):
    rng = np.random.default_rng(11)
    y = rng.normal(size=(200, 12)) * rng.gamma(2, 0.5, 200)[:, None]
    fits = [plain_fit(row, onehot(12)) for row in y]
    s2, df = np.array([f[2] ** 2 for f in fits]), 9.0
    e = np.log(s2) - digamma(np.array([df / 2]))[0] + math.log(df / 2)
    extra = e.var(ddof=1) - trigamma(np.array([df / 2]))[0]
    d0 = 2 * trigamma_inverse(extra)
    s0 = math.exp(e.mean() + digamma(np.array([d0 / 2]))[0] - math.log(d0 / 2))
    post = (d0 * s0 + df * s2) / (d0 + df)
    got = M.ebayes(M.fit_oneway(long(spark, y), meta(spark, 12), "stage", STAGES), STAGES, M.versus("Baseline", ["Late"])).collect()
    for r in got:
        i = int(r.feature[1:])
        lfc = fits[i][0][2] - fits[i][0][0]
        assert r.s2_post == pytest.approx(post[i], rel=1e-7)
        assert r.t == pytest.approx(lfc / math.sqrt(post[i] * 0.5), rel=1e-7)
        assert r.df_total == pytest.approx(df + d0, rel=1e-6)


def test_equal_variances_give_an_infinite_prior(spark):
    y = np.tile(np.array([0.0, 1, 2, 1, 0, 2, 2, 1, 0]), (6, 1)) + np.arange(6)[:, None]
    fit = M.fit_oneway(long(spark, y), meta(spark, 9), "stage", STAGES)
    d0, s0, pooled = M.variance_prior(fit)
    assert math.isinf(d0) and pooled == 36
    got = M.ebayes(fit, STAGES, M.versus("Baseline", ["Early"])).first()
    assert got.df_total == 36 and got.s2_post == pytest.approx(s0)


def scaled_f_likelihood(s2, df, d0, s0):
    x, half = s2 / s0, df / 2
    if math.isinf(d0):
        each = half * np.log(half) - [math.lgamma(h) for h in half] + (half - 1) * np.log(x) - half * x
    else:
        gamma = np.array([math.lgamma(h + d0 / 2) - math.lgamma(h) - math.lgamma(d0 / 2) for h in half])
        each = gamma + half * np.log(df / d0) + (half - 1) * np.log(x) - (half + d0 / 2) * np.log1p(df * x / d0)
    return (each - np.log(s0)).sum()


def test_prior_of_unequal_degrees_of_freedom(spark):
    rng = np.random.default_rng(17)
    df = rng.choice([2.0, 5.0, 9.0, 14.0], 1500)
    s2 = 0.7 * rng.chisquare(df) / df / (rng.chisquare(6, 1500) / 6)
    fit = spark.createDataFrame([(i, float(math.sqrt(v)), float(d), "ab"[i % 2]) for i, (v, d) in enumerate(zip(s2, df, strict=True))], "feature int, sigma double, df double, g string")
    priors = M.variance_priors(fit, by="g")
    for k, g in enumerate("ab"):
        own, d = s2[k::2], df[k::2]
        e = np.log(own) + np.log(d / 2) - digamma(d / 2)
        def at(d0, e=e, own=own, d=d):
            w = 1 / (trigamma(d / 2) + trigamma(np.array([d0 / 2]))[0])
            s0 = math.exp((w * e).sum() / w.sum() + digamma(np.array([d0 / 2]))[0] - math.log(d0 / 2))
            return scaled_f_likelihood(own, d, d0, s0), s0
        grid = np.exp(np.linspace(math.log(0.5), math.log(200), 4000))
        best = max(grid, key=lambda d0: at(d0)[0])
        assert priors[g].df == pytest.approx(best, rel=5e-3)
        assert priors[g].variance == pytest.approx(at(best)[1], rel=1e-3)
        assert priors[g].pooled == d.sum()
    # a constant variance has the infinite prior
    flat = spark.createDataFrame([(i, float(math.sqrt(rng.chisquare(d) / d)), float(d)) for i, d in enumerate(rng.choice([40.0, 60.0], 300))], "feature int, sigma double, df double")
    d0, s0, _ = M.variance_prior(flat)
    assert d0 > 100 and s0 == pytest.approx(1, rel=0.05)


def test_moderated_tests_with_missing_cells(spark):
    rng = np.random.default_rng(23)
    y = rng.normal(size=(120, 12)) * rng.gamma(2, 0.5, 120)[:, None]
    y[rng.random(y.shape) < 0.15] = np.nan
    y = y[[all(np.isfinite(row[k::3]).any() for k in range(3)) and np.isfinite(row).sum() > 4 for row in y]]
    fit = M.fit_oneway(long(spark, y), meta(spark, 12), "stage", STAGES)
    d0, s0, pooled = M.variance_prior(fit)
    for r in M.ebayes(fit, STAGES, M.versus("Baseline", ["Late"])).collect():
        row = y[int(r.feature[1:])]
        ok = np.isfinite(row)
        b, cov, sigma, df = plain_fit(row[ok], onehot(12)[ok])
        post = (d0 * s0 + df * sigma**2) / (d0 + df) if math.isfinite(d0) else s0
        assert r.s2_post == pytest.approx(post, rel=1e-7)
        assert r.t == pytest.approx((b[2] - b[0]) / math.sqrt(post * (cov[0, 0] + cov[2, 2])), rel=1e-7)
        assert r.df_total == pytest.approx(min(df + d0, pooled), rel=1e-9)


def test_groups_in_one_plan_equal_groups_alone(spark):
    rng = np.random.default_rng(31)
    mean = rng.gamma(1.2, 60, 80)[:, None] * rng.uniform(0.5, 2, 18)[None, :]
    x = rng.poisson(mean)
    cells = long(spark, x, "bigint").where("value > 0")
    groups = {"all": range(18), "one": range(0, 9), "two": range(6, 18)}
    who = spark.createDataFrame([(g, j, STAGES[j % 3]) for g, js in groups.items() for j in js], "grp string, sample int, stage string")
    contrasts = M.versus("Baseline", ["Early", "Late"])
    together = M.count_tests(cells, who, "stage", STAGES, contrasts, by="grp").collect()
    got = {(r.grp, r.feature, r.contrast): r for r in together}
    seen = 0
    for g, js in groups.items():
        alone = M.count_tests(cells, who.where(F.col("grp") == g).drop("grp"), "stage", STAGES, contrasts).collect()
        for r in alone:
            other = got[g, r.feature, r.contrast]
            assert (other.lfc, other.t, other.p) == pytest.approx((r.lfc, r.t, r.p), rel=1e-9)
            seen += 1
    assert seen == len(got)
    # and the plain formulas give the same weighted fit
    js = list(groups["one"])
    sub = x[:, js]
    sub = sub[(sub > 20).sum(axis=1) >= 3]
    names = [f"f{i:03d}" for i in np.flatnonzero((x[:, js] > 20).sum(axis=1) >= 3)]
    lib, factor = plain_tmm(sub)
    eff = lib * factor + 1
    y = np.log2((sub + 0.5) / eff * 1e6)
    design = np.array([[1.0 if j % 3 == k else 0.0 for k in range(3)] for j in js])
    fits = [plain_fit(row, design) for row in y]
    gx, gy = plain_lowess(y.mean(axis=1) + np.log2(eff).mean() - np.log2(1e6), np.sqrt([f[2] for f in fits]))
    weights = np.interp(np.array([design @ f[0] for f in fits]) + np.log2(eff) - np.log2(1e6), gx, gy) ** -4.0
    for name, row, w in zip(names, y, weights, strict=True):
        b, cov, sigma, df = plain_fit(row, design, w)
        r = got["one", name, "Late"]
        assert r.lfc == pytest.approx(b[2] - b[0], rel=1e-8)
        assert r.sigma == pytest.approx(sigma, rel=1e-7) and r.unscaled == pytest.approx(math.sqrt(cov[0, 0] + cov[2, 2]), rel=1e-8)


def test_classification_limits_are_strict(spark):
    # fixed values: published rows (name, lfc, padj, significant, regulation)
    rows = [
        ("RANTES", 0.999668, 0.001, False, "None"), ("IP-10", 1.72386662613691, 0.00127408357410086, True, "Up"),
        ("MIP-1β", -1.10308591429217, 0.047894563985878, True, "Down"), ("ITAC", -1.02854194455983, 0.104872723316987, False, "None"),
        ("PSGL-1", 0.219082627396945, 0.56553109911878, False, "None"), ("edge", 1.0, 0.01, False, "None"), ("edge", 2.0, 0.05, False, "None"),
    ]
    df = spark.createDataFrame(rows, "feature string, lfc double, padj double, s boolean, r string")
    for r in M.classify(df).collect():
        assert (r.significant, r.regulation) == (r.s, r.r)


def test_grid_fills_a_filtered_feature_with_zero(spark):
    rows = [("g1", 1.5, "Early", "HD"), ("g1", 2.5, "Late", "HD"), ("g2", -1.0, "Early", "LD-V"), ("g1", 9.0, "Middle", "HD"), ("g1", 9.0, "Early", "other")]
    df = spark.createDataFrame(rows, "feature string, lfc double, stage string, grp string")
    got = M.lfc_grid(df, "grp", ["HD", "LD-V"], ["Early", "Late"])
    assert got.columns == ["feature", "HD, early", "LD-V, early", "HD, late", "LD-V, late"]
    assert sorted(map(tuple, got.collect())) == [("g1", 1.5, 0.0, 2.5, 0.0), ("g2", 0.0, -1.0, 0.0, 0.0)]


def test_whole_count_comparison_finds_the_planted_features(spark):
    rng = np.random.default_rng(21)
    mean = rng.gamma(2, 80, 60)[:, None] * np.ones(15)[None, :]
    late = np.array([j % 3 == 2 for j in range(15)])
    mean[:4, late] *= 8
    mean[4:7, late] /= 8
    df = long(spark, rng.poisson(mean), "bigint")
    got = M.count_de(df, meta(spark, 15), "stage", STAGES, M.versus("Baseline", ["Early", "Late"])).collect()
    up = {r.feature for r in got if r.stage == "Late" and r.regulation == "Up"}
    down = {r.feature for r in got if r.stage == "Late" and r.regulation == "Down"}
    assert up == {"f000", "f001", "f002", "f003"} and down == {"f004", "f005", "f006"}
    assert not any(r.significant for r in got if r.stage == "Early")


# ---- components


def same_components(parts, x):
    """``x``: features by samples."""
    c = x - x.mean(axis=1, keepdims=True)
    u, d, vt = np.linalg.svd(c, full_matrices=False)
    scores = parts.scores.orderBy("sample").toPandas()
    load = parts.loadings.orderBy("feature").toPandas()
    for k, name in enumerate(("PC1", "PC2")):
        assert np.abs(scores[name].to_numpy()) == pytest.approx(np.abs(vt[k] * d[k]), abs=1e-6)
        assert np.abs(load[name].to_numpy()) == pytest.approx(np.abs(u[:, k]), abs=1e-7)
        assert load[name].to_numpy()[np.abs(load[name].to_numpy()).argmax()] > 0
    assert load[["PC1", "PC2"]].to_numpy().T @ load[["PC1", "PC2"]].to_numpy() == pytest.approx(np.eye(2), abs=1e-8)
    share = {r.component: (r.share, r.label) for r in parts.variance.collect()}
    want = d**2 / (d**2).sum()
    assert share["PC1"][0] == pytest.approx(want[0]) and share["PC1"][1] == f"PC1 ({round(100 * want[0])}%)"
    assert share["PC2"][0] == pytest.approx(want[1])


@pytest.mark.parametrize(("features", "block", "depth"), [(30, 4, 3), (70, 32, 12)])
def test_components(spark, monkeypatch, features, block, depth):
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "DEPTH", depth)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(features, 2)) @ np.diag([6, 3]) @ rng.normal(size=(2, 18)) + rng.normal(size=(features, 18)) + 50
    same_components(P.pca(long(spark, x), 2), x)


def test_components_with_unlisted_cells(spark):
    rng = np.random.default_rng(13)
    base = rng.normal(3, 2, 20)
    x = np.tile(base, (40, 1))
    listed = rng.random((40, 20)) < 0.3
    listed[0] = True
    x[listed] += rng.gamma(2, 2, listed.sum())
    cells = long(spark, np.where(listed, x, np.nan))
    same_components(P.pca(cells, 2, base=spark.createDataFrame([(j, float(b)) for j, b in enumerate(base)], "sample int, base double")), x)


def test_constant_matrix_has_no_component(spark):
    parts = P.pca(long(spark, np.ones((4, 5))), 2)
    assert [r.variance for r in parts.variance.collect()] == pytest.approx([0.0, 0.0], abs=1e-12)
    assert all(abs(r.PC1) < 1e-9 for r in parts.scores.collect())


def test_contributors_are_ordered_by_length(spark):
    df = spark.createDataFrame([("a", 0.3, 0.4), ("b", -0.6, 0.0), ("c", 0.1, 0.1)], "feature string, PC1 double, PC2 double")
    assert [(r.feature, round(r.magnitude, 9)) for r in P.top_contributors(df, 2).collect()] == [("b", 0.6), ("a", 0.5)]


def test_fold_change_from_a_zero_count(spark):
    df = spark.createDataFrame([(0.0, 4.0), (8.0, 4.0), (1.0, None)], "v double, b double")
    got = [r.lfc for r in M.lfc_from_baseline(df, F.col("v") / F.col("b")).collect()]
    assert got == [-math.inf, 1.0, None]


def test_reference_sample_where_upper_quartiles_are_zero(spark):
    # one count in ten features per sample: all upper quartiles are zero, the sample with the most roots is the reference
    cells = [(f, s, float(v)) for s, row in enumerate([[9, 4], [100, 50], [3, 2]]) for f, v in enumerate(row)] + [(f, s, 0.0) for s in range(3) for f in range(2, 40)]
    df = spark.createDataFrame(cells + [(50 + k, 1, 1.0) for k in range(5)] + [(60 + k, 0, 1.0) for k in range(5)], "feature int, sample int, value double")
    got = {r["sample"]: r["factor"] for r in K.tmm(df).collect()}
    assert set(got) == {0, 1, 2} and all(v > 0 for v in got.values())


def test_a_sample_without_counts_raises(spark):
    df = spark.createDataFrame([(0, "a", 5.0), (1, "a", 7.0), (0, "b", 0.0)], "feature int, sample string, value double")
    with pytest.raises(ValueError, match="without any count"):
        K.tmm(df)
