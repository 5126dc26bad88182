import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.llm import hardneg
from tideline.llm.catalog import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, x string, tile string, place string"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.integers(1, 70), st.integers(1, 70), st.integers(1, 8), st.sampled_from([3, 2**20, 2**28]), st.integers(0, 2**32))
def test_strassen_is_exact(m, k, n, leaf, most, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-most, most, (m, k)), rng.integers(-most, most, (k, n))
    want = [[sum(int(x) * int(y) for x, y in zip(r, c, strict=True)) for c in b.T[:5]] for r in a[:5]]
    got = hardneg.strassen(a, b, leaf)
    assert got.shape == (m, n)
    assert got[:5, :5].tolist() == want
    assert (got == a @ b).all()


def test_heaps_merge_to_the_same():
    rng = np.random.default_rng(3)
    row, score, ids = rng.integers(0, 6, 500), rng.integers(-4, 4, 500), rng.permutation(500)
    whole, left, right = (hardneg.Heaps(6, 4) for _ in range(3))
    whole.push(row, score, ids)
    left.push(row[:200], score[:200], ids[:200])
    right.push(row[200:], score[200:], ids[200:])
    left.push(*right.entries())
    for r in range(6):
        want = sorted((-s, i) for q, s, i in zip(row, score, ids, strict=True) if q == r)[:4]
        assert [(-s, i) for s, i in zip(whole.score[r], whole.id[r], strict=True)] == want
    assert (left.score == whole.score).all() and (left.id == whole.id).all()


def brute(rows, anchor, scale=256):
    kept = []
    for vec_id, e, label in rows:
        if vec_id is None or label is None or e is None or any(c is None or not math.isfinite(c) for c in e):
            continue
        kept.append((vec_id, label, [math.floor(scale * float(c)) for c in e]))
    out = Counter()
    for i, (a, label, x) in enumerate(kept):
        if not anchor(a):
            continue
        dot = lambda y: sum(p * q for p, q in zip(x, y, strict=False))
        scored = [(-dot(y), v, other) for j, (v, other, y) in enumerate(kept) if j != i]
        for minus, p, _ in sorted(s for s in scored if s[2] == label)[:5]:
            good = sorted((s, v) for s, v, other in scored if other != label and 50 * -minus <= 100 * -s <= 95 * -minus)[:3]
            for rank, (s, n) in enumerate(good, 1):
                out[(a, p, rank, n, -minus, -s)] += 1
    return out


def found(df):
    return Counter((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


def edge_rows():
    rng = random.Random(9)
    rows = []
    for i in range(400):
        label = 1 if i % 3 == 0 else rng.randrange(4)
        e = [float(np.float32(rng.gauss(0.4, 0.5))) for _ in range(7)]
        if i % 10 == 0 and rows:
            e = list(rows[rng.randrange(len(rows))][1])  # ties
        rows.append((i, e, label))
    rows += [(50, list(rows[50][1]), rows[50][2])] * 2  # repeated rows, one of them an anchor
    rows = [tuple(r) for r in rows]
    odd = [(1000, None, 1), (1050, [None] + [0.1] * 6, 1), (1100, [float("nan")] * 7, 1), (1150, [float("inf")] * 7, 1), (1200, [0.5] * 7, None), (None, [0.5] * 7, 1), (1250, [0.5, 0.25], 2), (1300, [], 1), (1350, [0.0] * 7, 3)]
    return rows + odd


@pytest.mark.parametrize(("tile", "part"), [(16_384, 16_384), (4, 30)])
def test_matches_brute_force(spark, tile, part):
    rows = edge_rows()
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(4)
    got = found(hardneg.mine(df, F.col("vec_id") % 50 == 0, tile=tile, part=part))
    want = brute(rows, lambda v: v % 50 == 0)
    assert sum(want.values()) > 50
    assert got == want


def test_strips_and_batches(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "STRIP", 3)
    rows = edge_rows()
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    assert found(hardneg.mine(df, F.col("vec_id") % 2 == 0, part=100)) == brute(rows, lambda v: v % 2 == 0)


def test_windows_of_odd_scores(spark):
    # one component: scores are products, so windows are met and missed by one
    rows = [(0, [1 / 256], 0), (1, [41 / 256], 0)] + [(10 + k, [k / 256], 1) for k in range(18, 42)]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    got = found(hardneg.mine(df, F.col("vec_id") == 0, n_negatives=40))
    assert sorted(k[5] for k in got) == list(range(21, 39))


def test_huge_components_stand_as_the_bound(spark):
    rows = [(0, [3e38, 1.0], 0), (1, [3e38, 1.0], 0), (2, [1e38, 0.0], 1), (3, [-3e38, 0.0], 1), (4, [1_000_000.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    limit = math.isqrt((2**63 - 1) // 2)
    limit = min(limit, 2**31 - 1)
    got = hardneg.mine(df, F.col("vec_id") == 0).collect()
    assert {r["positive_score"] for r in got} <= {limit * limit + 65536}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert hardneg.mine(df, F.col("vec_id") % 50 == 0).count() == 0
    lone = spark.createDataFrame([(0, [1.0], 1, "x", "x", "x", "x")], SCHEMA)
    assert hardneg.mine(lone, F.col("vec_id") % 50 == 0).count() == 0


def test_query_on_the_whole_table(spark, small):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    rows = [(v, e, (label + 1) % 10 if v % 7 == 0 else label) for v, e, label in rows]
    assert found(QUERIES["op12_hard_negatives"](spark, small)) == brute(rows, lambda v: v % 50 == 0)
