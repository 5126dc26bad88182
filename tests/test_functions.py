import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import levels as L
from tideline.functions import numeric as N
from tideline.functions import special as S
from tideline.functions import text as X


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_ratio_keeps_infinities_and_drops_zero_over_zero(spark):
    df = rows(spark, [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (3.0, 2.0), (None, 1.0)], "a double, b double")
    got = [r[0] for r in df.select(N.r_div(F.col("a"), F.col("b"))).collect()]
    assert got == [math.inf, -math.inf, None, 1.5, None]
    # a positive value over a zero baseline still counts as at least doubled
    assert df.where(N.r_div(F.col("a"), F.col("b")) >= 2).count() == 1


def test_log2_of_zero_and_below(spark):
    df = rows(spark, [(0.0,), (8.0,), (-1.0,), (None,)], "a double")
    assert [r[0] for r in df.select(N.r_log2(F.col("a"))).collect()] == [-math.inf, 3.0, None, None]


def test_strict_aggregate_is_missing_when_any_input_is(spark):
    df = rows(spark, [("x", 1.0), ("x", None), ("y", 2.0), ("y", 4.0)], "k string, v double")
    got = {r.k: r.m for r in df.groupBy("k").agg(N.strict(F.avg, F.col("v")).alias("m")).collect()}
    assert got == {"x": None, "y": 3.0}


def test_clamp_and_detection_limit(spark):
    df = rows(spark, [(-1.0,), (0.0,), (5.0,), (None,)], "a double")
    got = df.select(N.clamp(F.col("a"), 0.0, 1.0).alias("c"), N.floor_at_limit(F.col("a"), 50).alias("l")).collect()
    assert [r.c for r in got] == [0.0, 0.0, 1.0, None]
    assert [r.l for r in got] == [-1.0, 50.0, 5.0, None]


def test_elapsed_days_use_whole_seconds(spark):
    df = spark.sql("select timestamp_ntz'2024-01-02 12:00:00.9' b, timestamp_ntz'2024-01-01 00:00:00' a")
    assert df.select(N.elapsed_days(F.col("b"), F.col("a"))).first()[0] == 1.5


def test_levels(spark):
    df = rows(spark, [("27.5",), ("1",), ("7",), (None,)], "arm string")
    got = df.select(L.level_rank(F.col("arm"), L.ARM), L.as_level(F.col("arm"), L.ARM)).collect()
    assert [tuple(r) for r in got] == [(1, "27.5"), (3, "1"), (None, None), (None, None)]
    assert L.relevel(L.ARM, "1") == ["1", "27.5", "10", "0.1"]
    with pytest.raises(ValueError):
        L.relevel(L.ARM, "5")


def test_text_cases(spark):
    df = rows(spark, [("fever (d3); NA low",)], "s string")
    got = df.select(X.sentence_case(F.col("s")), X.cap_first(F.col("s"))).first()
    assert tuple(got) == ("Fever (d3); na low", "Fever (d3); NA low")


def test_regex_helpers_touch_the_first_match_only(spark):
    df = rows(spark, [("IL-6_cc_x",), ("plain",)], "s string")
    got = df.select(X.str_remove(F.col("s"), "_[a-z]+"), X.str_extract(F.col("s"), "_([a-z]+)")).collect()
    assert [tuple(r) for r in got] == [("IL-6_x", "cc"), ("plain", None)]
    named = rows(spark, [("Stress granule\\nsignaling\\nend",)], "s string")
    assert named.select(X.str_replace(F.col("s"), r"\\n", "\n")).first()[0] == "Stress granule\nsignaling\\nend"


def test_p_text_and_stars(spark):
    df = rows(spark, [(0.05,), (0.034,), (0.00012,), (0.5,), (1e-20,), (0.0096,), (1.0,)], "p double")
    got = [r[0] for r in df.select(X.p_text(F.col("p"))).collect()]
    assert got == ["p=0.05", "p=0.03", "p=1e-04", "p=0.5", "p=<2e-16", "p=0.01", "p=1"]
    marks = [r[0] for r in df.select(X.stars(F.col("p"))).collect()]
    assert marks == ["*", "*", "***", "ns", "****", "**", "ns"]


def test_arrows_are_half_open(spark):
    df = rows(spark, [(v,) for v in (0.5, 0.51, 1.99, 2.0, 4.99, 5.0, 10.0, 20.0)], "r double")
    got = [r[0] for r in df.select(X.step_label(F.col("r"))).collect()]
    assert got == ["↓", None, None, "↑", "↑", "↑↑", "↑↑↑", "↑↑↑↑"]


def test_percent_label_rounds_half_to_even(spark):
    df = rows(spark, [(0.125,), (0.135,), (0.374,)], "s double")
    got = [r[0] for r in df.select(X.percent_label("PC1", F.col("s"))).collect()]
    assert got[0] == "PC1 (12%)" and got[2] == "PC1 (37%)"


# ---- distributions, against published table values


def test_tail_probabilities():
    assert S.norm_two_sided([1.959963984540054])[0] == pytest.approx(0.05, abs=1e-12)
    assert S.chi2_upper([3.841458820694124, 9.487729036781154], [1, 4]) == pytest.approx([0.05, 0.05], abs=1e-12)
    t = np.array([0.01, 0.7, 3.0, 40.0])
    assert S.t_two_sided(t, 1) == pytest.approx(1 - 2 / np.pi * np.arctan(t), abs=1e-13)
    assert S.t_two_sided(t, 2) == pytest.approx(1 - t / np.sqrt(2 + t * t), abs=1e-13)
    assert S.t_two_sided([2.2281388519649385], [10])[0] == pytest.approx(0.05, abs=1e-10)
    assert S.t_two_sided([1.959963984540054], [np.inf])[0] == pytest.approx(0.05, abs=1e-12)


def test_t_quantiles():
    got = S.t_upper_quantile(0.95, np.array([1.0, 4.0, 30.0, 0.0]))
    assert got[:3] == pytest.approx([12.7062047364, 2.7764451052, 2.0422724563], abs=1e-9)
    assert np.isnan(got[3])


def test_gamma_derivatives():
    assert S.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-13)
    assert S.trigamma(np.array([1.0]))[0] == pytest.approx(math.pi**2 / 6, abs=1e-13)
    for v in (1e-3, 0.3, 5.0, 80.0):
        assert S.trigamma(np.array([S.trigamma_inverse(v)]))[0] == pytest.approx(v, rel=1e-9)
    assert S.trigamma_inverse(0.0) == math.inf


def test_exact_ranksum_against_enumeration():
    from itertools import combinations

    n1, n2 = 3, 4
    stats = [sum(c) - n1 * (n1 + 1) / 2 for c in combinations(range(1, n1 + n2 + 1), n1)]
    for w in range(n1 * n2 + 1):
        low = sum(s <= w for s in stats) / len(stats)
        high = sum(s >= w for s in stats) / len(stats)
        assert S.ranksum_exact(n1, n2, w) == pytest.approx(min(1, 2 * min(low, high)))


def test_tails_with_very_many_degrees_of_freedom():
    from tideline.functions.special import chi2_upper, t_two_sided

    # Cornish-Fisher reference of the chi-squared tail, and the normal limit of Student's
    from statistics import NormalDist

    def wilson_hilferty(x, df):
        return 1 - NormalDist().cdf(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5)

    for df in (1e6, 1e7, 1e8, 1e9, 1e10):
        for z in (-3.0, -2.0, 0.0, 0.5, 3.0):
            x = df + z * (2 * df) ** 0.5
            assert abs(float(chi2_upper(x, df)) - wilson_hilferty(x, df)) < 3e-6
        for t in (0.01, 1.0, 3.0):
            assert abs(float(t_two_sided(t, df)) - 2 * (1 - NormalDist().cdf(t))) < 3 / df + 1e-12
    # both forms meet where one takes over
    for f, x in ((chi2_upper, 2e5 + 700.0), (t_two_sided, 2.0)):
        at = 2e5 if f is chi2_upper else 1e5
        low, high = float(f(x, at * (1 - 1e-9))), float(f(x, at * (1 + 1e-9)))
        assert abs(low - high) < 1e-6
