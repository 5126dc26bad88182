import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import nonparametric as NP
from tideline.operators import survival as SV
from tideline.operators.adjust import p_adjust

AML = [  # a public remission trial: arm, weeks, relapse
    *[("kept", t, e) for t, e in [(9, 1), (13, 1), (13, 0), (18, 1), (23, 1), (28, 0), (31, 1), (34, 1), (45, 0), (48, 1), (161, 0)]],
    *[("none", t, e) for t, e in [(5, 1), (5, 1), (8, 1), (8, 1), (12, 1), (16, 0), (23, 1), (27, 1), (30, 1), (33, 1), (43, 1), (45, 1)]],
]


def midranks(v):
    v = np.asarray(v)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def table(spark, seed=5, n=240):
    rng = np.random.default_rng(seed)
    rows = []
    for s in ("p", "q"):
        for i in range(n):
            g = "abcd"[rng.integers(0, 4)]
            rows.append((s, g, float(rng.integers(0, 30)) / 3 if s == "p" else float(rng.normal())))
    rows += [("p", "a", None), ("q", None, 3.0)]
    return spark.createDataFrame(rows, "s string, g string, v double"), [r for r in rows if None not in r]


def test_ranksum_exact_small_sample(spark):
    df = spark.createDataFrame([("x", v) for v in (1.1, 2.2, 3.3)] + [("y", v) for v in (4.0, 5.0, 6.0)], "g string, v double")
    r = NP.ranksum(df, [], "g", "v", ["x", "y"]).first()
    assert (r.n1, r.n2, r.w) == (3, 3, 0.0) and r.p == pytest.approx(0.1)


def test_ranksum_with_ties_uses_the_corrected_normal(spark):
    df, rows = table(spark)
    got = {r.s: r for r in NP.ranksum(df, ["s"], "g", "v", ["a", "b"]).collect()}
    for s in ("p", "q"):
        x = [v for k, g, v in rows if k == s and g == "a"]
        y = [v for k, g, v in rows if k == s and g == "b"]
        m, n = len(x), len(y)
        w = midranks(x + y)[:m].sum() - m * (m + 1) / 2
        ties = sum(c**3 - c for c in np.unique(x + y, return_counts=True)[1])
        sd = math.sqrt(m * n / 12 * (m + n + 1 - ties / ((m + n) * (m + n - 1))))
        gap = w - m * n / 2
        assert got[s].w == w and got[s].z == pytest.approx((gap - np.sign(gap) * 0.5) / sd)


def test_kruskal_equals_squared_ranksum_for_two_groups(spark):
    df, rows = table(spark)
    two = df.where("g in ('a', 'b')")
    h = {r.s: r.h for r in NP.kruskal(two, ["s"], "g", "v").collect()}
    for s in ("p", "q"):
        x = [v for k, g, v in rows if k == s and g == "a"]
        y = [v for k, g, v in rows if k == s and g == "b"]
        m, n = len(x), len(y)
        r = midranks(x + y)
        ties = sum(c**3 - c for c in np.unique(x + y, return_counts=True)[1])
        var = m * n / 12 * (m + n + 1 - ties / ((m + n) * (m + n - 1)))
        assert h[s] == pytest.approx((r[:m].sum() - m * (m + n + 1) / 2) ** 2 / var)


def test_kruskal_constant_values_have_no_test(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 1.0)], "g string, v double")
    r = NP.kruskal(df, [], "g", "v").first()
    assert r.h is None and r.p is None


def test_dunn_pairs_signs_and_holm(spark):
    df, rows = table(spark)
    got = [r for r in NP.dunn(df, ["s"], "g", "v", ["d", "a", "b", "c"]).collect() if r.s == "p"]
    assert [(r.group1, r.group2) for r in sorted(got, key=lambda r: (r.group1 != "d", r.group1, r.group2))][:3] == [("d", "a"), ("d", "b"), ("d", "c")]
    v = np.array([x for k, g, x in rows if k == "p"])
    g = np.array([x for k, x, _ in rows if k == "p"])
    r, n = midranks(v), len(v)
    ties = sum(c**3 - c for c in np.unique(v, return_counts=True)[1])
    for row in got:
        a, b = g == row.group1, g == row.group2
        se = math.sqrt((n * (n + 1) / 12 - ties / (12 * (n - 1))) * (1 / a.sum() + 1 / b.sum()))
        assert row.z == pytest.approx((r[b].mean() - r[a].mean()) / se)
        assert row.p == pytest.approx(math.erfc(abs(row.z) / math.sqrt(2)))
    p = sorted(x.p for x in got)
    holm = np.minimum(1, np.maximum.accumulate([(len(p) - i) * x for i, x in enumerate(p)]))
    assert sorted(x.padj for x in got) == pytest.approx(list(holm))


def test_gated_posthoc_only_opens_below_alpha(spark):
    rng = np.random.default_rng(0)
    rows = [("moved", str(d), float(rng.normal() + 3 * (d == 2))) for d in range(3) for _ in range(20)]
    rows += [("still", str(d), float(i)) for d in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "f string, d string, v double")
    got = NP.gated_dunn(df, ["f"], "d", "v", ["0", "1", "2"], "0").collect()
    assert [(r.f, r.group1, r.group2) for r in got] == [("moved", "0", "2")]


def test_adjustments_match_published_example(spark):
    df = spark.createDataFrame([("a", p) for p in (0.01, 0.02, 0.03, 0.04, 0.05)] + [("b", 0.2), ("b", None)], "f string, p double")
    for method, want in (("holm", [0.05, 0.08, 0.09, 0.09, 0.09]), ("bh", [0.05] * 5)):
        got = p_adjust(df, ["f"], "p", method).orderBy("f", "p").collect()
        assert [r.padj for r in got if r.f == "a"] == pytest.approx(want)
        assert [r.padj for r in got if r.f == "b"] == [None, 0.2]


def test_adjustments_agree_with_brute_force(spark):
    rng = np.random.default_rng(9)
    p = np.round(rng.beta(0.4, 2, 700), 3)
    p[:250] = 1.0  # a third of the family shares one p
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "i int, p double")
    order = np.argsort(p, kind="stable")
    m = len(p)
    holm, bh = np.empty(m), np.empty(m)
    holm[order] = np.minimum(1, np.maximum.accumulate((m - np.arange(m)) * p[order]))
    bh[order] = np.minimum(1, np.minimum.accumulate((m / np.arange(1, m + 1) * p[order])[::-1])[::-1])
    for method, want in (("holm", holm), ("bh", bh)):
        got = p_adjust(df, [], "p", method).orderBy("i").toPandas()["padj"].to_numpy()
        assert got == pytest.approx(want, abs=1e-12)
    assert (bh <= holm + 1e-15).all()


def test_product_limit_of_published_trial(spark):
    df = spark.createDataFrame(AML, "arm string, t int, e int")
    got = {(r.arm, r.t): r for r in SV.km_curve(df, "t", "e", "arm").collect()}
    assert got["kept", 9].survival == pytest.approx(10 / 11) and got["kept", 9].n_risk == 11
    assert got["kept", 13].survival == pytest.approx(10 / 11 * 9 / 10)
    assert got["kept", 48].survival == pytest.approx(0.18409, abs=1e-5)
    assert got["kept", 161].n_event == 0 and got["kept", 161].survival == got["kept", 48].survival
    assert got["none", 45].survival == 0.0


def test_curve_without_censoring_is_one_minus_ecdf(spark):
    t = [3, 1, 4, 1, 5, 9, 2, 6]
    df = spark.createDataFrame([("g", x, 1) for x in t], "arm string, t int, e int")
    for r in SV.km_curve(df, "t", "e", "arm").collect():
        assert r.survival == pytest.approx(sum(x > r.t for x in t) / len(t))


def test_logrank_of_published_trial(spark):
    df = spark.createDataFrame(AML, "arm string, t int, e int")
    arms = {r.arm: r for r in SV.logrank_arms(df, "t", "e", "arm", ["kept", "none"]).collect()}
    assert arms["kept"].expected == pytest.approx(10.69, abs=5e-3) and arms["none"].expected == pytest.approx(7.31, abs=5e-3)
    assert (arms["kept"].observed, arms["none"].observed) == (7, 11)
    r = SV.logrank(df, "t", "e", "arm", ["kept", "none"]).first()
    assert r.chi2 == pytest.approx(3.396, abs=1e-3) and r.df == 1 and r.p == pytest.approx(0.0653, abs=1e-4)


def test_logrank_ignores_an_arm_without_subjects(spark):
    df = spark.createDataFrame(AML, "arm string, t int, e int")
    full = SV.logrank(df, "t", "e", "arm", ["kept", "absent", "none"]).first()
    assert full.df == 1 and full.chi2 == pytest.approx(3.396, abs=1e-3)


def test_row_order_and_partitions_do_not_matter(spark):
    df, _ = table(spark)
    a = sorted(map(tuple, NP.kruskal(df, ["s"], "g", "v").collect()))
    b = sorted(map(tuple, NP.kruskal(df.orderBy(F.rand(3)).repartition(13), ["s"], "g", "v").collect()))
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert [x[2] for x in a] == pytest.approx([x[2] for x in b], rel=1e-12)
