import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import aggregate as A
from tideline.operators import columns as C
from tideline.operators import joins as J
from tideline.operators import rank as W
from tideline.operators import reshape as R
from tideline.operators import scan as S
from tideline.operators import sets as U
from tideline.sources import tables as T


def tuples(df, *order):
    return sorted([tuple(r) for r in df.collect()], key=str)


# ---- chunked scans


def test_chunks_keep_the_order_of_any_doubles(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([
        rng.normal(size=500), rng.normal(size=300) * 1e-300, 10.0 ** rng.uniform(-320, 308, 500),
        2.0 ** np.arange(-1074, 1024, 7), np.nextafter(2.0 ** np.arange(-20, 20), 0), [0.0, 5e-324, 1.7976931348623157e308, np.inf],
    ])
    v = np.unique(np.concatenate([v, -v]))
    df = spark.createDataFrame([(float(x),) for x in v], "v double").select("v", S.order_chunk(F.col("v")).alias("c"))
    got = df.orderBy("v").toPandas()
    assert (np.diff(got["c"].to_numpy()) >= 0).all()
    assert got.loc[got.v == 0, "c"].item() == 0


def test_quantiles_match_linear_interpolation(spark):
    rng = np.random.default_rng(2)
    data = [("a", float(x)) for x in rng.exponential(10, 501)] + [("b", float(x)) for x in rng.integers(0, 5, 240)]
    data += [("c", 7.0), (None, 1.0), (None, 2.0), ("a", None)]
    df = spark.createDataFrame(data, "g string, v double")
    probs = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q93": 0.93, "q1": 1.0}
    got = {r["g"]: r for r in S.quantiles(df, ["g"], "v", probs).collect()}
    for g in ("a", "b", "c", None):
        x = [v for k, v in data if k == g and v is not None]
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(x, p), abs=1e-12), (g, name)


def test_quantiles_with_implicit_zeros(spark):
    df = spark.createDataFrame([("s", 4.0), ("s", 8.0), ("t", 5.0)], "g string, v double")
    got = {r.g: r for r in S.quantiles(df, ["g"], "v", {"q": 0.75, "m": 0.5}, total=4).collect()}
    assert got["s"].q == np.quantile([0, 0, 4, 8], 0.75) and got["s"].m == np.quantile([0, 0, 4, 8], 0.5)
    assert got["t"].q == np.quantile([0, 0, 0, 5], 0.75) and got["t"].m == 0


def test_rank_table_shares_ranks_among_equal_values(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(-40, 40, 900) / 7
    values[:300] = 1.5  # one value fills a third of the table
    df = spark.createDataFrame([("x", float(v)) for v in values] + [("y", 1.0)], "g string, v double")
    got = {(r.g, r.v): r["rank"] for r in S.rank_table(df, ["g"], "v").collect()}
    for v in np.unique(values):
        assert got["x", v] == (values < v).sum() + ((values == v).sum() + 1) / 2
    assert got["y", 1.0] == 1


def test_prefix_sums_descending_with_missing_stratum(spark):
    df = spark.createDataFrame([(None, 1.0, 5), (None, 2.0, 7), ("a", 1e9, 1), ("a", -3.0, 2)], "g string, t double, n int")
    got = {(r.g, r.t): (r.k_before, r.k_tie, r.k_total) for r in S.prefix_sums(df, ["g"], "t", {"k": F.col("n")}, descending=True).collect()}
    assert got == {(None, 2.0): (0, 7, 12), (None, 1.0): (7, 5, 12), ("a", 1e9): (0, 1, 3), ("a", -3.0): (1, 2, 3)}


def test_number_levels_by_text_and_number(spark):
    df = spark.createDataFrame([("b", 3), ("a", 3), ("c", 1), ("c", 9)], "k string, d int")
    assert tuples(S.number_levels(df, "k", "d")) == [("a", 2), ("b", 3), ("c", 1)]
    nums = spark.createDataFrame([(10, 3), (9, 3), (-4, 3)], "k bigint, d int")
    assert tuples(S.number_levels(nums, "k", "d")) == [(-4, 1), (10, 3), (9, 2)]


# ---- columns, reshapes, joins


def test_prefix_selection_ignores_case(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Mean cell` int, meanX int, Hct int")
    assert C.select_prefix(df, ["mean"]).columns == ["Mean cell", "meanX"]
    assert C.select_prefix(df, ["MEAN"], drop=True).columns == ["Hct"]


def test_later_overwrites_win(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "v double")
    got = C.set_where(df, "m", [(F.col("v") > 0, "low"), (F.col("v") > 2, "high")])
    assert [r.m for r in got.collect()] == ["low", "high", None]


def test_melt_keeps_column_order_and_odd_names(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "id int, `GEq/mL` double, `Glucose (GLU)` double")
    long = R.melt(df, ["id"], ordinal="o")
    assert tuples(long) == [(1, "GEq/mL", 2.0, 1), (1, "Glucose (GLU)", None, 2)]
    back = R.cast_wide(long, ["id"], "feature", "value", ["GEq/mL", "Glucose (GLU)"], fill=0.0)
    assert tuples(back) == [(1, 2.0, 0.0)]


def test_two_values_for_one_cell_are_an_error(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", 3.0)], "id int, f string, v double")
    with pytest.raises(Exception, match="more than one v"):
        R.cast_wide(df, ["id"], "f", "v", ["a"]).collect()


def test_crosstab_fills_zero_and_bounds_lead(spark):
    df = spark.createDataFrame([("x", "S"), ("x", "S"), ("y", "D")], "arm string, o string")
    assert tuples(R.crosstab(df, "arm", "o", ["S", "D"])) == [("x", 2, 0), ("y", 0, 1)]
    wide = spark.createDataFrame([("Late", 1.0)], "k string, p double")
    assert [r.k for r in R.with_bounds(wide, "k", 0, 3).collect()] == ["Max", "Min", "Late"]


def test_baseline_stays_missing_without_a_start(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (1, 3, 9.0), (2, 3, 4.0)], "k int, t int, v double")
    got = tuples(J.with_baseline(df, ["k"], "v", F.col("t") == 0).select("k", "t", "baseline"))
    assert got == [(1, 0, 5.0), (1, 3, 5.0), (2, 3, None)]


def test_group_max_is_missing_with_a_missing_value(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 9.0), (2, 4.0), (2, None)], "k int, v double")
    assert tuples(J.with_group_max(df, ["k"], "v", "top").select("k", "top").distinct()) == [(1, 9.0), (2, None)]


def test_several_controls_do_not_fan_out(spark):
    df = spark.createDataFrame([("b1", "Control", 10.0), ("b1", "Control", 20.0), ("b1", "n1", 3.0)], "batch string, id string, v double")
    assert tuples(J.with_control(df, "batch", "v", F.col("id") == "Control")) == [("b1", "n1", 3.0, 15.0)]


def test_group_join_keeps_the_missing_group(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 3.0), (None, 5.0)], "g string, v double")
    got = {r.g: r.median for r in A.summary_stats(df, ["g"], "v").collect()}
    assert got == {"a": 1.0, None: 4.0}


def test_full_join_chain(spark):
    a = spark.createDataFrame([(1, "x")], "k int, a string")
    b = spark.createDataFrame([(2, "y")], "k int, b string")
    c = spark.createDataFrame([(2, "z"), (3, "w")], "k int, c string")
    assert tuples(J.full_join_all([a, b, c], "k")) == [(1, "x", None, None), (2, None, "y", "z"), (3, None, None, "w")]


# ---- ranks and aggregates


def test_ties_are_kept_or_broken_as_asked(spark):
    df = spark.createDataFrame([("k", 1, 5.0), ("k", 2, 9.0), ("k", 3, 9.0), ("k", 4, None), ("m", 1, None)], "k string, t int, v double")
    for n in (1, 2):
        assert tuples(W.top_n(df, ["k"], "v", n).select("t")) == [(2,), (3,)]
    assert tuples(W.top_n(df, ["k"], "v", 3).select("t")) == [(1,), (2,), (3,)]
    assert tuples(W.peak_by(df, ["k"], "v", ["t"])) == [("k", 2, 9.0), ("m", 1, None)]
    assert tuples(W.trough_by(df, ["k"], "v", ["t"])) == [("k", 1, 5.0), ("m", 1, None)]
    assert tuples(W.first_by(df, ["k"], "t").select("k", "t")) == [("k", 1), ("m", 1)]
    assert tuples(W.last_by(df, ["k"], "t").select("k", "t")) == [("k", 4), ("m", 1)]


def test_dominant_class_follows_the_levels_not_the_alphabet(spark):
    df = spark.createDataFrame([(1, "decreased appetite"), (1, "anorexia"), (2, "decreased appetite")], "k int, c string")
    got = tuples(W.dominant_class(df, ["k"], "c", ["decreased appetite", "anorexia"]))
    assert got == [(1, "anorexia"), (2, "decreased appetite")]


def test_rank_filters_limit_groups_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "id as v")
    top = W.top_n(df, ["k"], "v", 5)
    assert top.count() == 15 and top.columns == ["k", "v"]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_mean_interval(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (7, 8, 8, 8, 8, 7)] + [("b", 4.0)], "g string, v double")
    got = {r.g: r for r in A.mean_ci(df, ["g"], "v").collect()}
    half = 2.570581836 * np.sqrt(4 / 15 / 6)  # tabulated t for 5 degrees of freedom
    assert got["a"].lower == pytest.approx(23 / 3 - half, abs=1e-8) and got["a"].upper == pytest.approx(23 / 3 + half, abs=1e-8)
    assert got["b"].lower is None and got["b"].se is None


def test_box_whiskers_stop_at_the_last_value_inside(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 5, 100)], "g string, v double")
    r = A.box_stats(df, ["g"], "v").first()
    assert (r.q1, r.median, r.q3, r.low, r.high, r.outliers) == (2.25, 3.5, 4.75, 1.0, 5.0, 1)


def test_collapse_orders_by_the_given_column(spark):
    df = spark.createDataFrame([("k", "b", 10), ("k", "a", 9), ("k", "c", 2)], "k string, x string, t int")
    assert A.collapse(df, ["k"], "x", ["t"]).first()["x"] == "c, a, b"
    assert A.collapse(df, ["k"], "t", ["t"], out="d").first()["d"] == "2, 9, 10"


def test_percent_and_duration(spark):
    df = spark.createDataFrame([("a", "S"), ("a", "D"), ("a", "D"), ("b", "S"), ("c", None)], "g string, o string")
    got = {r.g: (r.D, r.percent) for r in A.percent_outcome(df, "g", "o", "D", "S").collect()}
    assert got == {"a": (2, 66.7), "b": (0, 0.0), "c": (0, None)}
    ends = spark.createDataFrame([("x", 12), ("x", 12)], "k string, e int")
    starts = spark.createDataFrame([("x", 8)], "k string, s int")
    assert tuples(A.duration(ends, starts, "k", "s", "e")) == [("x", 8, 12, 5)]


def test_overall_copy_and_union(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "g string, v int")
    both = U.with_overall(df, "g")
    assert tuples(both) == [("Overall", 1), ("Overall", 2), ("a", 1), ("b", 2)]
    assert U.union_all([df, df.select("v", "g")]).count() == 4


# ---- sources


def test_delimited_files(spark, tmp_path):
    listed = tmp_path / "short.csv"
    listed.write_bytes("﻿Canonical Pathways,Nickname\r\nStress Granule Signaling Pathway,Stress granule\\nsignaling\r\n".encode())
    got = T.read_csv(spark, str(listed), "`Canonical Pathways` string, Nickname string").collect()
    assert [tuple(r) for r in got] == [("Stress Granule Signaling Pathway", "Stress granule\\nsignaling")]
    scores = tmp_path / "scores.tsv"
    scores.write_bytes(b"Canonical Pathways\tLate\tEarly\r\nNecroptosis Signaling Pathway\t2.449\t\r\nISGylation\t1.414\t0.447\r\n")
    df = T.read_tsv(spark, str(scores), "`Canonical Pathways` string, Late double, Early double")
    assert [tuple(r) for r in df.collect()] == [("Necroptosis Signaling Pathway", 2.449, None), ("ISGylation", 1.414, 0.447)]


def test_result_files_round_trip(spark, tmp_path):
    df = T.values_table(spark, [("a", 1.5, "None"), ("b", None, "Up")], "gene string, lfc double, regulation string")
    T.write_csv(df, str(tmp_path / "r"))
    assert tuples(T.read_csv(spark, str(tmp_path / "r"), df.schema)) == tuples(df)
    T.write_table(df, str(tmp_path / "p"))
    assert tuples(spark.read.parquet(str(tmp_path / "p"))) == tuples(df)


def test_values_of_one_magnitude_are_parted(spark):
    rng = np.random.default_rng(8)
    seconds = np.unique(1_704_067_200 + rng.integers(0, 7 * 86_400, 100_000)).astype(float)
    df = spark.createDataFrame([("w", float(v)) for v in seconds] + [("x", 1.0)], "g string, v double")
    parts = S.chunked(df, ["g"], "v", full=500).groupBy("g", S.CHUNK).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("z")).orderBy("g", S.CHUNK).collect()
    own = [r for r in parts if r["g"] == "w"]
    assert len(own) > 100 and max(r["n"] for r in own) < 1500
    assert all(left["z"] < right["a"] for left, right in zip(own, own[1:]))
    got = S.rank_table(df, ["g"], "v").where("g = 'w'").orderBy("v").select("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, len(seconds) + 1))


def test_missing_keys_are_a_group(spark):
    from tideline.operators import rank as K
    from tideline.operators.reshape import crosstab

    df = spark.createDataFrame([(None, 1, 5), (None, 2, 7), (1, 1, 3), (1, 2, 3), (1, 3, 9)], "k int, t int, v int")
    pick = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert pick(K.first_by(df, ["k"], "t")) == pick(df.where("t = 1"))
    assert pick(K.last_by(df, ["k"], "t")) == sorted([(None, 2, 7), (1, 3, 9)], key=str)
    assert pick(K.top_n(df, ["k"], "v", 2)) == pick(df)
    counted = crosstab(df, "k", "t", [1, 2, 3])
    assert pick(counted) == sorted([(None, 1, 1, 0), (1, 1, 1, 1)], key=str)


def test_texts_of_a_large_group_are_joined_in_order(spark):
    from tideline.operators.aggregate import collapse

    df = spark.range(200_000).selectExpr("if(id < 150000, 'hot', 'k' || id % 50) AS g", "cast((id * 7919) % 200000 AS int) AS t", "id % 3 AS label")
    got = {r["g"]: r["label"] for r in collapse(df, ["g"], "label", ["t"], ",").collect()}
    rows = sorted((t, g, label) for g, t, label in map(tuple, df.collect()))
    want = {}
    for _, g, label in rows:
        want.setdefault(g, []).append(str(label))
    assert got == {g: ",".join(labels) for g, labels in want.items()}
    words = spark.createDataFrame([(1, w, w) for w in ("b", "abcde", "abcd", "é", "abcdf", "a", None)], "g int, w string, x string")
    assert collapse(words, ["g"], "w", ["x"], " ").first()["w"] == "a abcd abcde abcdf b é"


def test_fan_out_reads_once_and_repeats_rows(spark):
    from tideline.operators.sets import fan_out

    df = fan_out(spark.range(6), {"low": F.col("id") < 3, "even": F.col("id") % 2 == 0, "none": F.col("id") > 9}, "part")
    assert sorted((r["part"], r["id"]) for r in df.collect()) == [("even", 0), ("even", 2), ("even", 4), ("low", 0), ("low", 1), ("low", 2)]
    assert df._jdf.queryExecution().executedPlan().toString().count("Range") == 1


def test_trim_bounds_by_average_rank(spark):
    import math

    from tideline.operators.scan import trim_bounds

    values = [1.0, 1.0, 1.0, 2.0, 3.0, 3.0, 4.0, 5.0, 5.0, 9.0, -7.5, 0.0]
    df = spark.createDataFrame([("a", v, -v) for v in values] + [("b", 1.0, 2.0)], "g string, m double, a double")
    got = {r["g"]: r for r in trim_bounds(df, ["g"], {"m": 0.3, "a": 0.05}).collect()}
    for name, sign, trim in (("m", 1, 0.3), ("a", -1, 0.05)):
        own = [sign * v for v in values]
        first = math.floor(len(own) * trim) + 1
        rank = {v: sum(w < v for w in own) + (own.count(v) + 1) / 2 for v in own}
        stay = {v for v in own if first <= rank[v] <= len(own) + 1 - first}
        low, high = got["a"][f"{name}_low"], got["a"][f"{name}_high"]
        kept = {v for v in own if (v > low["x"] or (v == low["x"] and low["in"])) and (v < high["x"] or (v == high["x"] and high["in"]))}
        assert kept == stay
    assert got["b"]["m_low"]["x"] == got["b"]["m_high"]["x"] == 1.0


def test_study_days_count_from_the_first_event(spark, tmp_path):
    from tideline.plans import bindings as B

    rows = [(1, 7, "view", 1.0, "2024-03-30 23:59:59"), (2, 7, "view", 3.0, "2024-04-01 00:00:00"), (3, 8, "click", 5.0, "2024-05-01 12:00:00")]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts string").withColumn("ts", F.expr("cast(ts as timestamp_ntz)"))
    df.write.parquet(f"{tmp_path}/events.parquet")
    assert sorted((r["subject"], r["t"]) for r in B.obs(spark, str(tmp_path)).collect()) == [(7, 0), (7, 2), (8, 32)]
    early = B.obs(spark, str(tmp_path), days=(0, 1))
    assert [(r["subject"], r["t"]) for r in early.collect()] == [(7, 0)]
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in early._jdf.queryExecution().executedPlan().toString()
