import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tideline.llm import whitening
from tideline.llm.catalog import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string, component string"


def brute(rows, k=4):
    """(id, x) of the kept rows, n, S, variances and components from the plain covariance."""
    kept = [(v, e) for v, e in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    width = max((len(e) for _, e in kept), default=0)
    kept = [(v, [math.floor(256 * float(c)) for c in e] + [0] * (width - len(e))) for v, e in kept]
    points = sorted({tuple(x) for _, x in kept})
    n = len(points)
    sums = [sum(c) for c in zip(*points, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)] for x in points])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return kept, n, sums, values[::-1], vectors[:, ::-1]


def compare(got, rows, k=4):
    kept, n, sums, values, vectors = brute(rows)
    assert Counter((r["vec_id"], r["component"]) for r in got) == Counter((v, c) for v, _ in kept for c in range(1, k + 1))
    held = {}
    for v, x in kept:
        held.setdefault(v, []).append(x)
    sign = {}
    for r in got:
        c = r["component"] - 1
        x = held[r["vec_id"]]
        if len(x) > 1 and any(y != x[0] for y in x):
            continue
        assert r["n"] == n
        assert r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x[0], sums, strict=True))
        want = float(np.dot([float(Fraction(n * a - s, n)) for a, s in zip(x[0], sums, strict=True)], vectors[:, c]) / np.sqrt(values[c]))
        if abs(want) > 1e-3:
            sign.setdefault(c, np.sign(want) == np.sign(r["whitened"]))
        assert r["whitened"] == pytest.approx(want if sign.get(c, True) else -want, abs=1e-7)
        assert r["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9)
        assert r["identity_error"] < 1e-9


def edge_rows():
    rng = random.Random(4)
    rows = [(i, [float(np.float32(rng.gauss(0, 1 + d))) for d in range(6)]) for i in range(500)]
    rows += [(7, list(rows[7][1]))] * 40 + [(9000 + i, list(rows[3][1])) for i in range(300)]  # one vector many times
    rows += [(600, None), (601, [None] * 6), (602, [float("nan")] + [0.0] * 5), (603, [0.0] * 5 + [float("-inf")]), (None, [0.5] * 6), (604, [0.25, -0.5]), (605, []), (606, [-0.0] * 6)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(v, e, 1, "x", "x", "x") for v, e in rows], SCHEMA).repartition(4)


def test_matches_brute_force(spark):
    rows = edge_rows()
    compare(whitening.whiten(frame(spark, rows)).collect(), rows)


def test_query_on_the_whole_table(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    compare(QUERIES["op13_whitening"](spark, small).collect(), rows)


def test_badly_conditioned_rows(spark):
    rng = random.Random(8)
    # variances over fourteen orders of magnitude
    rows = [(i, [rng.gauss(0, 10.0 ** (4 - 1.2 * d)) for d in range(6)]) for i in range(400)]
    rows = [(v, [float(np.float32(c)) for c in e]) for v, e in rows]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert max(r["identity_error"] for r in got) < 1e-9


@pytest.mark.parametrize("width", [5, 2])
def test_lower_rank(spark, width):
    rng = random.Random(2)
    base = [(rng.randint(-300, 300) / 256, rng.randint(-9, 9) / 256) for _ in range(200)]
    rows = [(i, ([a, b, a + b, 0.5, a - b] if width == 5 else [a, b])) for i, (a, b) in enumerate(base)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r["component"] for r in got if r["whitened"] is not None} == {1, 2}
    assert {r["component"] for r in got} == set(range(1, min(4, width) + 1))
    assert all(r["identity_error"] < 1e-4 for r in got)
    kept, n, sums, values, vectors = brute(rows)
    for r in got:
        if r["component"] <= 2:
            x = dict(kept)[r["vec_id"]]
            want = abs(np.dot([a - s / n for a, s in zip(x, sums, strict=True)], vectors[:, r["component"] - 1]) / np.sqrt(values[r["component"] - 1]))
            assert abs(r["whitened"]) == pytest.approx(want, abs=1e-6)
            assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-6)


def test_no_variance_and_empty(spark):
    got = whitening.whiten(frame(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).collect()
    assert len(got) == 4
    assert all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["n"] == 1 and r["deviation"] == 0 for r in got)
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(frame(spark, [(1, [])])).count() == 0


def test_exact_sums_and_deviations():
    x = np.array([[2**39, -(2**39)], [1, 2]])
    assert whitening.deviations(x, 3, [5, 7]) == [None, 4 + 1]
    assert whitening.deviations(x[1:], 10**12, [0, 0]) == [None]


def test_solve_is_the_triangular_solve():
    rng = np.random.default_rng(1)
    r = np.triu(rng.normal(size=(9, 9))) + 3 * np.eye(9)
    a = rng.normal(size=(20, 9))
    assert np.allclose(whitening.solve(a, r) @ r, a)
