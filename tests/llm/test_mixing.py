import itertools
import random
import re
import tracemalloc
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm import mixing


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), min_size=1, max_size=5), st.integers(0, 60))
def test_fit_takes_what_there_is_and_is_as_near_as_its_window_allows(counts, budget):
    taken = mixing.fit_counts(counts, budget)
    assert all(0 <= n <= counts[length] for length, n in taken.items())
    total = sum(length * n for length, n in counts.items())
    made = sum(length * n for length, n in taken.items())
    if budget <= total:
        assert abs(made - budget) <= max(counts) / 2


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 9), st.integers(1, 2), min_size=1, max_size=4), st.integers(1, 30))
def test_fit_is_exact_where_the_rest_can_be_met(counts, budget):
    total = sum(length * n for length, n in counts.items())
    base = {length: min(n, n * budget // total) for length, n in counts.items()}
    left = [length for length, n in counts.items() for _ in range(n - base[length])]
    rest = budget - sum(length * n for length, n in base.items())
    sums = {sum(c) for k in range(len(left) + 1) for c in itertools.combinations(left, k)}
    made = sum(length * n for length, n in mixing.fit_counts(counts, budget).items())
    assert abs(made - budget) == min(abs(rest - s) for s in sums)


def test_large_counts_are_met_exactly():
    counts = {n: 10_000 + n for n in range(3, 4000, 7)}
    budget = 3_141_592_653
    assert sum(length * n for length, n in mixing.fit_counts(counts, budget).items()) == budget


def brute_targets(totals):
    """Targets by sharing again and again; ``totals`` in the order of the sources."""
    weight = [(5, 2, 1)[i % 3] for i in range(len(totals))]
    stopped = set()
    while True:
        rest = sum(totals) - sum(3 * totals[i] for i in stopped)
        free = sum(w for i, w in enumerate(weight) if i not in stopped)
        out = [3 * totals[i] if i in stopped else rest * weight[i] / free for i in range(len(totals))]
        more = {i for i, t in enumerate(out) if t > 3 * totals[i] * (1 + 1e-12)}
        if not more - stopped:
            return out
        stopped |= more


def test_mix_of_edge_rows(edge):
    rows = edge.collect()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows]
    source = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    totals = [sum(n for n, r in zip(size, rows, strict=True) if r["source"] == s) for s in source]
    want = dict(zip(totals, brute_targets(totals), strict=True))
    got = mixing.mix_documents(edge).collect()
    assert sorted(r["size"] for r in got) == sorted(size)
    taken = defaultdict(int)
    for r in got:
        assert abs(r["target"] - want[r["source_size"]]) < 1e-6
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[r["source_size"]] += r["taken"]
    for total, t in want.items():
        longest = max((r["size"] for r in got if r["source_size"] == total), default=0)
        assert abs(taken[total] - t) <= longest / 2 + 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_documents(edge.repartition(5)).collect()))


def test_targets_stop_and_reshare(spark):
    totals = [("s" + s, s, n) for s, n in [("a", 10), ("b", 5000), ("c", 0), ("d", 40), ("e", 7), ("f", 900)]]
    rows = mixing.targets(spark.createDataFrame(totals, "key string, source string, source_size long")).collect()
    got = {r["key"]: r["target"] for r in rows}
    want = brute_targets([n for *_, n in totals])
    assert all(abs(got[k] - t) < 1e-6 for (k, *_), t in zip(totals, want, strict=True))


def test_rows_are_repeated_as_the_mix_takes_them(edge):
    made = mixing.mixed_rows(edge)
    assert made.columns == edge.columns
    words = sum(len((r["text"] or "").split()) for r in made.collect())
    assert words == sum(r["taken"] for r in mixing.mix_documents(edge).collect())


def test_empty_table(empty):
    assert mixing.mix_documents(empty).count() == 0
    assert mixing.mixed_rows(empty).count() == 0


def test_one_more_very_long_document_is_taken_where_that_is_nearer():
    assert mixing.fit_counts({40_000: 10}, 395_000) == {40_000: 10}
    assert mixing.fit_counts({1_000_000: 1}, 900_000) == {1_000_000: 1}
    assert mixing.fit_counts({1_000_000: 1}, 400_000) == {1_000_000: 0}


def test_few_long_documents_are_fitted_as_near_as_any_choice():
    rng = random.Random(1)
    for _ in range(150):
        counts = {rng.randint(17_000, 90_000): rng.randint(1, 3) for _ in range(rng.randint(1, 4))}
        budget = rng.randint(1, sum(length * n for length, n in counts.items()))
        taken = mixing.fit_counts(counts, budget)
        assert all(0 <= n <= counts[length] for length, n in taken.items())
        made = sum(length * n for length, n in taken.items())
        choices = itertools.product(*[range(n + 1) for n in counts.values()])
        assert abs(budget - made) == min(abs(budget - sum(length * n for length, n in zip(counts, c, strict=True))) for c in choices)


def test_memory_of_the_fit_does_not_follow_the_number_of_lengths():
    counts = {100_000 + i: 1 for i in range(1_000)}
    budget = 20 * 99_900 + 2_000_000 - 3_000
    tracemalloc.start()
    try:
        taken = mixing.fit_counts(counts, budget)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert abs(budget - sum(length * n for length, n in taken.items())) <= 50_000
    assert peak < 30 << 20


def test_a_far_rest_of_a_very_long_document_is_left():
    assert mixing.fit_counts({8_000_000: 2, 1: 1}, 3_900_000) == {8_000_000: 0, 1: 1}
    assert mixing.fit_counts({8_000_000: 2, 1: 1}, 4_100_000) == {8_000_000: 1, 1: 0}
