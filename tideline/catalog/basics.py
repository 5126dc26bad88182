"""Sources, projections, filters, joins, reshapes, aggregates, windows, sorts, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog.registry import q6, query, r6
from tideline.functions import levels as L
from tideline.functions import numeric as N
from tideline.functions import text as X
from tideline.operators import aggregate as A
from tideline.operators import columns as C
from tideline.operators import joins as J
from tideline.operators import rank as W
from tideline.operators import reshape as R
from tideline.operators import sets as U
from tideline.operators.scan import number_levels
from tideline.plans import bindings as B
from tideline.plans.bindings import sql_with, table
from tideline.session import scratch_path
from tideline.sources import tables as S

FEATURES = B.FEATURES
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

# ---------------------------------------------------------------- sources


@query("src_tables", """SELECT r_name, n_name, COUNT(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey
    JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def _(spark, sf):
    t = S.load_tables(spark, sf, ["region", "nation", "supplier"])
    return (
        t["region"].join(t["nation"], F.col("r_regionkey") == F.col("n_regionkey"))
        .join(t["supplier"], F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"))
    )


@query("src_inline", sql_with("obs") + """SELECT feature, label, COUNT(*) AS n
    FROM obs JOIN (VALUES ('click','assay 1'), ('view','assay 2')) v(feature, label) USING (feature) GROUP BY 1, 2""")
def _(spark, sf):
    named = S.values_table(spark, [("click", "assay 1"), ("view", "assay 2")], "feature string, label string")
    return B.obs(spark, sf).join(named, "feature").groupBy("feature", "label").agg(F.count(F.lit(1)).alias("n"))


def _round_trip(spark, df, sep):
    path = scratch_path(spark)
    S.write_csv(df, path, sep=sep)
    return S.read_csv(spark, path, df.schema, sep=sep)


@query("src_csv_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(spark, sf):
    return _round_trip(spark, table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), ",")


@query("src_tsv_round_trip", "SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN s_acctbal END AS late FROM supplier")
def _(spark, sf):
    late = F.when(F.col("s_acctbal") > 5000, F.col("s_acctbal")).alias("late")
    return _round_trip(spark, table(spark, sf, "supplier").select("s_suppkey", late), "\t")


@query("src_table_round_trip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 0")
def _(spark, sf):
    path = scratch_path(spark)
    S.write_table(table(spark, sf, "supplier").where("s_acctbal > 0").drop("s_nationkey"), path)
    return spark.read.parquet(path)


# ---------------------------------------------------------------- projection, filter, predicates


@query("proj_select", "SELECT l_tax, l_orderkey, l_linenumber FROM lineitem")
def _(spark, sf):
    return B.wide(spark, sf).select("l_tax", "l_orderkey", "l_linenumber")


@query("proj_drop", "SELECT p_partkey, p_name, p_brand, p_type FROM part")
def _(spark, sf):
    return table(spark, sf, "part").drop("p_size", "p_retailprice")


@query("proj_prefix", "SELECT l_discount, l_tax, l_quantity FROM lineitem")
def _(spark, sf):
    value = C.select_prefix(B.wide(spark, sf), ["L_DISC", "L_TAX", "l_quant", "l_line"])
    return C.select_prefix(value, ["l_line"], drop=True)


@query("proj_rename", sql_with("subj") + "SELECT subject AS nhp, arm AS dose, death AS end_day, event, outcome FROM subj")
def _(spark, sf):
    return B.subj(spark, sf).withColumnsRenamed({"subject": "nhp", "arm": "dose", "death": "end_day"})


@query("proj_compute", """SELECT l_orderkey, l_linenumber, l_quantity - l_discount AS delta,
    (l_quantity > 25) OR (l_quantity > 15 AND l_tax > 0.05) AS high, l_quantity <= 3 AS low FROM lineitem""")
def _(spark, sf):
    q, tax = F.col("l_quantity"), F.col("l_tax")
    return B.wide(spark, sf).select(
        "l_orderkey", "l_linenumber", (q - F.col("l_discount")).alias("delta"),
        ((q > 25) | ((q > 15) & (tax > 0.05))).alias("high"), (q <= 3).alias("low"),
    )


@query("filt_compare", sql_with("obs") + f"SELECT subject, t, feature, {q6('value')} AS value FROM obs WHERE t > 0 AND value >= 60 AND feature <> 'error'")
def _(spark, sf):
    kept = B.obs(spark, sf).where((F.col("feature") != "error") & (F.col("t") > 0) & (F.col("value") >= 60))
    return kept.withColumn("value", r6("value"))


@query("filt_in", sql_with("subj") + "SELECT * FROM subj WHERE arm IN ('27.5', '10') AND subject NOT IN (4, 5, 8)")
def _(spark, sf):
    return B.subj(spark, sf).where(F.col("arm").isin("27.5", "10") & ~F.col("subject").isin(4, 5, 8))


@query("filt_notnull", sql_with("subj") + "SELECT * FROM (SELECT subject, CASE WHEN event = 1 THEN death END AS day FROM subj) WHERE day IS NOT NULL")
def _(spark, sf):
    return B.subj(spark, sf).select("subject", F.when(F.col("event") == 1, F.col("death")).alias("day")).dropna()


@query("filt_regex", "SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name, '^small|^large')")
def _(spark, sf):
    return table(spark, sf, "part").where(~F.col("p_name").rlike("^small|^large")).select("p_partkey", "p_name")


@query("filt_bool", "SELECT l_orderkey, l_linenumber, l_quantity > 40 AS qc FROM lineitem WHERE l_quantity > 40")
def _(spark, sf):
    return B.wide(spark, sf).select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 40).alias("qc")).where("qc")


@query("cond_overwrite", """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 'D' WHEN l_quantity > 30 THEN 'C'
    WHEN l_quantity > 20 THEN 'B' ELSE 'None' END AS grade FROM lineitem""")
def _(spark, sf):
    q = F.col("l_quantity")
    graded = C.set_where(
        B.wide(spark, sf).withColumn("grade", F.lit("None")), "grade", [(q > 20, "B"), (q > 30, "C"), (q > 40, "D")]
    )
    return graded.select("l_orderkey", "l_linenumber", "grade")


@query("null_replace", sql_with("subj") + "SELECT subject, COALESCE(CASE WHEN event = 1 THEN death END, 0) AS day, COALESCE(CASE WHEN event = 1 THEN arm END, 'None') AS note FROM subj")
def _(spark, sf):
    seen = F.col("event") == 1
    raw = B.subj(spark, sf).select("subject", F.when(seen, F.col("death")).alias("day"), F.when(seen, F.col("arm")).alias("note"))
    return C.fill_missing(raw, {"day": 0, "note": "None"})


@query("clamp", "SELECT l_orderkey, l_linenumber, greatest(least(l_quantity, 40.0::DOUBLE), 10.0::DOUBLE) AS capped, greatest(l_discount - 0.05, 0.0::DOUBLE) AS above FROM lineitem")
def _(spark, sf):
    return B.wide(spark, sf).select(
        "l_orderkey", "l_linenumber", N.clamp(F.col("l_quantity"), 10.0, 40.0).alias("capped"),
        N.clamp(F.col("l_discount") - 0.05, lo=0.0).alias("above"),
    )




@query("level_rank", "SELECT r_regionkey, CASE r_name WHEN 'ASIA' THEN 1 WHEN 'AFRICA' THEN 2 WHEN 'EUROPE' THEN 3 END AS ordinal, CASE WHEN r_name IN ('ASIA','AFRICA','EUROPE') THEN r_name END AS level FROM region")
def _(spark, sf):
    listed = ["ASIA", "AFRICA", "EUROPE"]
    name = F.col("r_name")
    return table(spark, sf, "region").select(
        "r_regionkey", L.level_rank(name, listed).alias("ordinal"), L.as_level(name, listed).alias("level")
    )


@query("level_relevel", sql_with("subj") + "SELECT subject, arm, CASE arm WHEN '1' THEN 1 WHEN '27.5' THEN 2 WHEN '10' THEN 3 WHEN '0.1' THEN 4 END AS ordinal FROM subj")
def _(spark, sf):
    return B.subj(spark, sf).select("subject", "arm", L.level_rank(F.col("arm"), L.relevel(L.ARM, "1")).alias("ordinal"))


@query("level_relabel", sql_with("samples") + "SELECT sample, grp, CASE grp WHEN 'HD' THEN 'A' WHEN 'LD-V' THEN 'B' WHEN 'LD-NV' THEN 'B' END AS plate FROM samples")
def _(spark, sf):
    plate = L.relabel(F.col("grp"), {"HD": "A", "LD-V": "B", "LD-NV": "B"})
    return B.samples(spark, sf).select("sample", "grp", plate.alias("plate"))


@query("level_present", sql_with("samples") + "SELECT stage AS level, MIN(CASE stage WHEN 'Baseline' THEN 2 WHEN 'Early' THEN 3 WHEN 'Middle' THEN 4 WHEN 'Late' THEN 6 ELSE 7 END) AS ordinal FROM samples GROUP BY 1")
def _(spark, sf):
    # two levels that no sample has
    return C.present_levels(B.samples(spark, sf), "stage", ["Screening", *L.STAGE[:3], "Interim", *L.STAGE[3:]])


@query("level_by_order", sql_with("subj") + "SELECT subject, CAST(row_number() OVER (ORDER BY death, subject) AS INT) AS level FROM subj")
def _(spark, sf):
    return number_levels(B.subj(spark, sf), "subject", "death")


@query("align_samples", sql_with("counts", "samples") + "SELECT feature, sample, value FROM counts WHERE sample IN (SELECT sample FROM samples WHERE grp <> 'HD')")
def _(spark, sf):
    _, cells = C.align(B.samples(spark, sf).where("grp <> 'HD'"), B.counts(spark, sf), "sample")
    return cells.select("feature", "sample", "value")


# ---------------------------------------------------------------- joins


@query("join_left_dim", sql_with("obs", "subj") + f"SELECT subject, t, feature, {q6('value')} AS value, arm, outcome FROM obs LEFT JOIN subj USING (subject)")
def _(spark, sf):
    joined = B.obs(spark, sf).join(B.subj(spark, sf).select("subject", "arm", "outcome"), "subject", "left")
    return joined.withColumn("value", r6("value"))


@query("join_baseline", sql_with("obs") + f"""SELECT o.subject, o.t, {q6('o.value')} AS value, {q6('b.value')} AS baseline, {q6('o.value - b.value')} AS delta
    FROM (SELECT * FROM obs WHERE feature = 'view') o LEFT JOIN (SELECT * FROM obs WHERE feature = 'view' AND t = 0) b ON o.subject = b.subject""")
def _(spark, sf):
    view = B.obs(spark, sf).where("feature = 'view'").drop("feature")
    first = B.obs(spark, sf, days=(0, 0)).where("feature = 'view'")
    joined = J.with_baseline(view, ["subject"], "value", F.col("t") == 0, source=first)
    return joined.select("subject", "t", r6("value").alias("value"), r6("baseline").alias("baseline"), r6(F.col("value") - F.col("baseline")).alias("delta"))


@query("join_multi_key", sql_with("obs") + f"""SELECT o.subject, o.t, o.feature, {q6('o.value / b.base')} AS fraction FROM obs o
    LEFT JOIN (SELECT subject, feature, AVG(value) AS base FROM obs WHERE t <= 6 GROUP BY 1, 2) b ON o.subject = b.subject AND o.feature = b.feature""")
def _(spark, sf):
    early = B.obs(spark, sf, days=(0, B.BASE_DAYS))
    joined = J.with_baseline(B.obs(spark, sf), ["subject", "feature"], "value", F.col("t") <= B.BASE_DAYS, agg=F.avg, source=early)
    return joined.select("subject", "t", "feature", r6(N.r_div(F.col("value"), F.col("baseline"))).alias("fraction"))


@query("join_control", sql_with("wells") + f"""SELECT w.subject, w.batch, w.dilution, {q6('w.plaques')} AS plaques, {q6('c.control')} AS control FROM (SELECT * FROM wells WHERE subject % 20 <> 0) w
    LEFT JOIN (SELECT batch, AVG(plaques) AS control FROM wells WHERE subject % 20 = 0 GROUP BY 1) c USING (batch)""")
def _(spark, sf):
    joined = J.with_control(B.wells(spark, sf), "batch", "plaques", F.col("subject") % 20 == 0)
    return joined.select("subject", "batch", "dilution", r6("plaques").alias("plaques"), r6("control").alias("control"))


@query("join_right_baseline", sql_with("obs") + f"""SELECT o.subject, o.t, o.feature, {q6('b.baseline')} AS baseline FROM
    (SELECT subject, feature, value AS baseline FROM obs WHERE t = 0) b RIGHT JOIN obs o ON o.subject = b.subject AND o.feature = b.feature""")
def _(spark, sf):
    all_days = B.obs(spark, sf)
    start = all_days.where("t = 0").select("subject", "feature", F.col("value").alias("baseline"))
    return start.join(all_days.drop("value"), ["subject", "feature"], "right").select("subject", "t", "feature", r6("baseline").alias("baseline"))


@query("join_shortlist", """SELECT l.n_nationkey, l.n_name, COALESCE(s.late, 0) AS late, COALESCE(s.early, 0) AS early FROM
    (SELECT s_nationkey AS n_nationkey, COUNT(*) AS late, NULLIF(SUM(CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END), 0)::BIGINT AS early FROM supplier GROUP BY 1) s
    RIGHT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) l USING (n_nationkey)""")
def _(spark, sf):
    scores = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(
        F.count(F.lit(1)).alias("late"), F.nullif(F.count_if(F.col("s_acctbal") < 0), F.lit(0)).alias("early")
    )
    listed = table(spark, sf, "nation").where("n_regionkey < 3")
    return J.shortlist(scores, listed, "n_nationkey", {"late": 0, "early": 0}).select("n_nationkey", "n_name", "late", "early")


@query("join_full", sql_with("obs") + """SELECT subject, a.hi_click, b.hi_view, c.hi_error FROM
    (SELECT subject, COUNT(*) AS hi_click FROM obs WHERE feature='click' AND value > 150 GROUP BY 1) a
    FULL JOIN (SELECT subject, COUNT(*) AS hi_view FROM obs WHERE feature='view' AND value > 150 GROUP BY 1) b USING (subject)
    FULL JOIN (SELECT subject, COUNT(*) AS hi_error FROM obs WHERE feature='error' AND value > 150 GROUP BY 1) c USING (subject)""")
def _(spark, sf):
    high = B.obs(spark, sf).where("value > 150")
    parts = [
        high.where(F.col("feature") == f).groupBy("subject").agg(F.count(F.lit(1)).alias(f"hi_{f}"))
        for f in ("click", "view", "error")
    ]
    return J.full_join_all(parts, "subject")


@query("join_semi", sql_with("counts") + "SELECT feature, sample, value FROM counts WHERE feature IN (SELECT feature FROM counts GROUP BY 1 HAVING MAX(value) > 400)")
def _(spark, sf):
    cells = B.counts(spark, sf)
    passed = cells.groupBy("feature").agg(F.max("value").alias("top")).where("top > 400").select("feature")
    return J.keep(cells, passed, "feature")


@query("join_anti", sql_with("counts") + "SELECT feature, sample, value FROM counts WHERE feature NOT IN (SELECT concat(p_brand,'|',p_type) FROM part WHERE p_size > 48)")
def _(spark, sf):
    poor = table(spark, sf, "part").where("p_size > 48").select(F.concat_ws("|", "p_brand", "p_type").alias("feature"))
    return J.discard(B.counts(spark, sf), poor.distinct(), "feature")


@query("join_distinct", sql_with("obs", "subj") + "SELECT DISTINCT subject, arm, death FROM obs JOIN subj USING (subject) WHERE value > 200")
def _(spark, sf):
    seen = B.obs(spark, sf).where("value > 200").select("subject").distinct()
    return seen.join(B.subj(spark, sf), "subject").select("subject", "arm", "death")


@query("join_units", "SELECT s_suppkey, s_nationkey, n_name AS unit FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def _(spark, sf):
    units = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("unit"))
    return table(spark, sf, "supplier").join(units, "s_nationkey", "left").select("s_suppkey", "s_nationkey", "unit")


# ---------------------------------------------------------------- reshape


@query("melt_ids", """SELECT l_orderkey, l_linenumber, feature, value, CASE feature WHEN 'l_quantity' THEN 1 WHEN 'l_discount' THEN 2 ELSE 3 END AS ordinal
    FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME feature VALUE value)""")
def _(spark, sf):
    return R.melt(B.wide(spark, sf), ["l_orderkey", "l_linenumber"], ordinal="ordinal")


@query("melt_measures", """SELECT l_orderkey, l_linenumber, l_quantity, variable, rate
    FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) ON l_discount, l_tax INTO NAME variable VALUE rate)""")
def _(spark, sf):
    ids = ["l_orderkey", "l_linenumber", "l_quantity"]
    return R.melt(B.wide(spark, sf), ids, ["l_discount", "l_tax"], "variable", "rate")


_PIVOT = ", ".join(f"MAX(CASE WHEN feature = '{f}' THEN x END) AS {f}" for f in FEATURES)


@query("cast_wide", sql_with("obs") + f"SELECT subject, t, {_PIVOT} FROM (SELECT *, {q6('value')} AS x FROM obs) GROUP BY 1, 2")
def _(spark, sf):
    return R.cast_wide(B.obs(spark, sf).withColumn("value", r6("value")), ["subject", "t"], "feature", "value", FEATURES)


@query("cast_fill", sql_with("counts", "samples") + "SELECT feature, " + ", ".join(
    f"CAST(SUM(CASE WHEN stage='{s}' THEN value ELSE 0 END) AS BIGINT) AS {s}" for s in L.STAGE) + " FROM counts JOIN samples USING (sample) GROUP BY 1")
def _(spark, sf):
    cells = B.counts(spark, sf).join(B.samples(spark, sf), "sample")
    return R.cast_wide(cells.groupBy("feature", "stage").agg(F.sum("value").alias("value")), ["feature"], "stage", "value", L.STAGE, fill=0)


@query("crosstab", "SELECT o_orderpriority, COUNT(*) FILTER (o_orderstatus='F') AS F, COUNT(*) FILTER (o_orderstatus='O') AS O, COUNT(*) FILTER (o_orderstatus='P') AS P FROM orders GROUP BY 1")
def _(spark, sf):
    return R.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("transpose_long", sql_with("counts") + "SELECT feature AS sample, sample AS feature, value FROM counts")
def _(spark, sf):
    return R.transpose(B.counts(spark, sf), "feature", "sample").select("feature", "sample", "value")


@query("cast_composite", sql_with("obs", "subj") + f"""SELECT feature, MAX(CASE WHEN outcome='Survived' THEN m END) AS "Survived.mean", MAX(CASE WHEN outcome='Succumbed' THEN m END) AS "Succumbed.mean",
    MAX(CASE WHEN outcome='Survived' THEN n END) AS "Survived.n", MAX(CASE WHEN outcome='Succumbed' THEN n END) AS "Succumbed.n"
    FROM (SELECT feature, outcome, {q6('AVG(value)')} AS m, CAST(COUNT(*) AS DOUBLE) AS n FROM obs JOIN subj USING (subject) GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf):
    per = B.obs(spark, sf).join(B.subj(spark, sf), "subject").groupBy("feature", "outcome").agg(
        r6(F.avg("value")).alias("mean"), F.count("value").cast("double").alias("n")
    )
    long = R.melt(per, ["feature", "outcome"], variable="variable")
    names = [f"{o}.{v}" for o in L.OUTCOME for v in ("mean", "n")]
    return R.cast_composite(long, ["feature"], ["outcome", "variable"], "value", names)


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("bounds_rows", "SELECT 'Max' AS score, " + ", ".join(f'3.0::DOUBLE AS "{r}"' for r in REGIONS) + " UNION ALL SELECT 'Min', " + ", ".join("0.0" for _ in REGIONS)
    + " UNION ALL SELECT 'Late', " + ", ".join(f"CAST(SUM(CASE WHEN r_name='{r}' THEN n_nationkey ELSE 0 END) AS DOUBLE)" for r in REGIONS)
    + " FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf):
    joined = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    score = joined.groupBy(F.lit("Late").alias("score"), "r_name").agg(F.sum("n_nationkey").cast("double").alias("v"))
    return R.with_bounds(R.cast_wide(score, ["score"], "r_name", "v", REGIONS), "score", 0, 3)


# ---------------------------------------------------------------- aggregation


@query("agg_mean", sql_with("obs", "subj") + f"SELECT arm, feature, {q6('AVG(value)')} AS mean FROM obs JOIN subj USING (subject) GROUP BY 1, 2")
def _(spark, sf):
    return B.obs(spark, sf).join(B.subj(spark, sf), "subject").groupBy("arm", "feature").agg(r6(N.strict(F.avg, F.col("value"))).alias("mean"))


@query("agg_summary", f"SELECT event_type AS feature, COUNT(value) AS n, {q6('AVG(value)')} AS mean, {q6('quantile_cont(value, 0.5)')} AS median, MIN(value) AS min, MAX(value) AS max FROM events GROUP BY 1")
def _(spark, sf):
    out = A.summary_stats(table(spark, sf, "events").withColumnRenamed("event_type", "feature"), ["feature"], "value")
    return out.select("feature", "n", r6("mean").alias("mean"), r6("median").alias("median"), "min", "max")


@query("agg_count", sql_with("subj") + "SELECT outcome, COUNT(*) AS subjects FROM subj GROUP BY 1")
def _(spark, sf):
    return B.subj(spark, sf).groupBy("outcome").agg(F.count(F.lit(1)).alias("subjects"))


@query("agg_minmax", sql_with("obs", "subj") + f"SELECT feature, outcome, {q6('MAX(value)')} AS max, {q6('MIN(value)')} AS min FROM obs JOIN subj USING (subject) GROUP BY 1, 2")
def _(spark, sf):
    both = B.obs(spark, sf).join(B.subj(spark, sf), "subject").groupBy("feature", "outcome")
    return both.agg(r6(F.max("value")).alias("max"), r6(F.min("value")).alias("min"))


@query("agg_percent", """SELECT o_orderpriority, COUNT(*) FILTER (o_orderstatus='O') AS O, COUNT(*) FILTER (o_orderstatus='F') AS F,
    round(100.0::DOUBLE * COUNT(*) FILTER (o_orderstatus='F') / COUNT(*) FILTER (o_orderstatus IN ('O','F')), 1) AS percent FROM orders GROUP BY 1""")
def _(spark, sf):
    return A.percent_outcome(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", "F", "O")


@query("agg_replicates", f"SELECT l_suppkey, l_partkey, {q6('AVG(l_extendedprice)')} AS l_extendedprice FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    keys = ["l_suppkey", "l_partkey"]
    out = A.merge_replicates(table(spark, sf, "lineitem").select(*keys, "l_extendedprice"), keys, "l_extendedprice")
    return out.withColumn("l_extendedprice", r6("l_extendedprice"))


@query("agg_collapse", sql_with("obs") + "SELECT subject, feature, string_agg(CAST(t AS VARCHAR), ', ' ORDER BY t) AS days FROM obs WHERE value > 120 GROUP BY 1, 2")
def _(spark, sf):
    return A.collapse(B.obs(spark, sf).where("value > 120"), ["subject", "feature"], "t", ["t"], out="days")


@query("agg_duration", sql_with("subj", "obs") + """SELECT s.subject, s.t, d.death, d.death - s.t + 1 AS duration FROM
    (SELECT subject, MAX(t) AS t FROM obs WHERE feature='view' AND value < 10 GROUP BY 1) s LEFT JOIN subj d USING (subject)""")
def _(spark, sf):
    starts = B.obs(spark, sf).where("feature = 'view' and value < 10").groupBy("subject").agg(F.max("t").alias("t"))
    return A.duration(B.subj(spark, sf), starts, "subject", "t", "death").select("subject", "t", "death", "duration")


@query("agg_distinct", sql_with("obs", "subj") + "SELECT DISTINCT t, outcome FROM obs JOIN subj USING (subject)")
def _(spark, sf):
    return B.obs(spark, sf).join(B.subj(spark, sf), "subject").select("t", "outcome").distinct()


@query("agg_keys", sql_with("obs") + "SELECT subject, feature FROM obs GROUP BY 1, 2")
def _(spark, sf):
    return B.obs(spark, sf).select("subject", "feature").distinct()


@query("win_group_max", sql_with("obs") + f"SELECT subject, t, {q6('value / MAX(value) OVER (PARTITION BY subject)')} AS share FROM obs WHERE feature = 'click'")
def _(spark, sf):
    top = J.with_group_max(B.obs(spark, sf).where("feature = 'click'"), ["subject"], "value", "top")
    return top.select("subject", "t", r6(N.r_div(F.col("value"), F.col("top"))).alias("share"))


_BOX = """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
    e AS (SELECT v.event_type, value, q1, median, q3, value BETWEEN q1 - 1.5::DOUBLE*(q3-q1) AND q3 + 1.5::DOUBLE*(q3-q1) AS inside FROM events v JOIN q ON v.event_type = q.event_type)
    SELECT event_type AS feature, round(q1,6) AS q1, round(median,6) AS median, round(q3,6) AS q3, MIN(value) FILTER (inside) AS low, MAX(value) FILTER (inside) AS high,
    COUNT(*) FILTER (NOT inside) AS outliers FROM e GROUP BY event_type, q1, median, q3"""


@query("agg_box", _BOX)
def _(spark, sf):
    box = A.box_stats(table(spark, sf, "events").withColumnRenamed("event_type", "feature"), ["feature"], "value")
    return box.withColumns({c: r6(c) for c in ("q1", "median", "q3")})


# ---------------------------------------------------------------- windows, ranks, sorts


@query("win_first_ties", sql_with("obs") + f"SELECT subject, t, feature, {q6('value')} AS value FROM obs WHERE value > 100 QUALIFY rank() OVER (PARTITION BY subject ORDER BY t) = 1")
def _(spark, sf):
    return W.first_by(B.obs(spark, sf).where("value > 100"), ["subject"], "t").withColumn("value", r6("value"))


@query("win_last_ties", sql_with("obs") + f"SELECT subject, t, feature, {q6('value')} AS value FROM obs QUALIFY rank() OVER (PARTITION BY subject ORDER BY t DESC) = 1")
def _(spark, sf):
    return W.last_by(B.obs(spark, sf), ["subject"], "t").withColumn("value", r6("value"))


@query("win_peak", sql_with("obs") + f"SELECT subject, feature, t, {q6('value')} AS value FROM obs QUALIFY row_number() OVER (PARTITION BY subject, feature ORDER BY value DESC, t) = 1")
def _(spark, sf):
    return W.peak_by(B.obs(spark, sf), ["subject", "feature"], "value", ["t"]).withColumn("value", r6("value"))


@query("win_trough", sql_with("obs") + f"SELECT subject, feature, t, {q6('value')} AS value FROM obs QUALIFY row_number() OVER (PARTITION BY subject, feature ORDER BY value, t) = 1")
def _(spark, sf):
    return W.trough_by(B.obs(spark, sf), ["subject", "feature"], "value", ["t"]).withColumn("value", r6("value"))


@query("win_topn", sql_with("counts") + "SELECT feature, sample, value FROM counts QUALIFY rank() OVER (PARTITION BY sample ORDER BY value DESC) <= 8")
def _(spark, sf):
    return W.top_n(B.counts(spark, sf), ["sample"], "value", 8)


@query("win_topn_abs", sql_with("assay") + "SELECT sample, feature, value, sign FROM (SELECT *, value > 0 AS sign FROM assay) QUALIFY rank() OVER (PARTITION BY sample, sign ORDER BY abs(value) DESC) <= 10")
def _(spark, sf):
    return W.top_n_abs(B.assay(spark, sf).withColumn("sign", F.col("value") > 0), ["sample", "sign"], "value", 10)


@query("topk_global", "SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(l_quantity*l_quantity + l_tax*l_tax), 6) AS magnitude FROM lineitem ORDER BY sqrt(l_quantity*l_quantity + l_tax*l_tax) DESC, l_orderkey, l_linenumber, l_partkey LIMIT 30")
def _(spark, sf):
    size = N.magnitude(F.col("l_quantity"), F.col("l_tax"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    top = W.top_k(table(spark, sf, "lineitem").select(*keys, size.alias("magnitude")), F.col("magnitude"), 30, keys)
    return top.withColumn("magnitude", r6("magnitude"))


@query("win_dominant", sql_with("obs") + """SELECT subject, t, feature FROM (SELECT *, CASE feature WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS o FROM obs)
    QUALIFY rank() OVER (PARTITION BY subject, t ORDER BY o DESC) = 1""")
def _(spark, sf):
    return W.dominant_class(B.obs(spark, sf).select("subject", "t", "feature"), ["subject", "t"], "feature", ["view", "click", "purchase", "signup", "error"])


@query("sort_asc", sql_with("subj") + "SELECT subject, arm, death FROM subj ORDER BY arm, death, subject")
def _(spark, sf):
    return B.subj(spark, sf).select("subject", "arm", "death").orderBy("arm", "death", "subject")


@query("sort_desc", sql_with("wells") + f"SELECT subject, batch, dilution, {q6('plaques')} AS plaques FROM wells ORDER BY dilution DESC, subject, batch")
def _(spark, sf):
    return B.wells(spark, sf).withColumn("plaques", r6("plaques")).orderBy(F.desc("dilution"), "subject", "batch")


@query("sort_predicate", sql_with("samples") + "SELECT sample, grp FROM samples ORDER BY grp = 'LD-V', sample")
def _(spark, sf):
    return B.samples(spark, sf).select("sample", "grp").orderBy(F.col("grp") == "LD-V", "sample")


# ---------------------------------------------------------------- set operations


@query("set_overall", sql_with("subj") + "SELECT g AS arm, COUNT(*) AS n, CAST(SUM(event) AS BIGINT) AS events FROM (SELECT arm AS g, event FROM subj UNION ALL SELECT 'Overall', event FROM subj) GROUP BY 1")
def _(spark, sf):
    both = U.with_overall(B.subj(spark, sf), "arm")
    return both.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("events"))


@query("set_union_all", sql_with("obs") + f"""SELECT subject, feature, 'chem' AS kind, {q6('value')} AS value FROM obs WHERE feature IN ('click','purchase','view')
    UNION ALL SELECT subject, feature, 'hema', {q6('value')} FROM obs WHERE feature IN ('error','signup')""")
def _(spark, sf):
    o = B.obs(spark, sf).select("subject", "feature", r6("value").alias("value"))
    chem = o.where(F.col("feature").isin("click", "purchase", "view")).withColumn("kind", F.lit("chem"))
    return U.union_all([chem, o.where(F.col("feature").isin("error", "signup")).withColumn("kind", F.lit("hema"))])


@query("set_union_list", sql_with("obs") + " UNION ALL ".join(
    f"SELECT 'week {w}' AS part, feature, COUNT(*) AS n FROM obs WHERE t // 7 = {w} GROUP BY 2" for w in range(5)))
def _(spark, sf):
    weeks = {f"week {w}": F.expr(f"t div 7 = {w}") for w in range(5)}
    return U.fan_out(B.obs(spark, sf), weeks, "part").groupBy("part", "feature").agg(F.count(F.lit(1)).alias("n"))


@query("set_intersect", sql_with("samples") + "SELECT sample FROM samples WHERE stage = 'Late' INTERSECT SELECT sample FROM samples WHERE batch = 'A'")
def _(spark, sf):
    s = B.samples(spark, sf)
    return s.where("stage = 'Late'").select("sample").intersect(s.where("batch = 'A'").select("sample"))


# ---------------------------------------------------------------- scalar functions


@query("fn_log2", "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_discount = 0 THEN '-inf'::DOUBLE ELSE log2(l_discount) END, 6) AS lg FROM lineitem")
def _(spark, sf):
    lg = N.r_log2(F.col("l_discount"))
    shown = F.when(F.abs(lg) == N.INF, lg).otherwise(r6(lg))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", shown.alias("lg"))


@query("fn_log10", f"SELECT event_id, {q6('log10(value + 1)')} AS lg, {q6('-log10(value / 1000)')} AS neg FROM events")
def _(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", r6(F.log10(v + 1)).alias("lg"), r6(N.neg_log10(v / 1000)).alias("neg"))


@query("fn_magnitude", "SELECT s_suppkey, round(sqrt(s_acctbal*s_acctbal + s_nationkey*s_nationkey), 6) AS m, abs(s_acctbal) AS a FROM supplier")
def _(spark, sf):
    a = F.col("s_acctbal")
    return table(spark, sf, "supplier").select("s_suppkey", r6(N.magnitude(a, F.col("s_nationkey").cast("double"))).alias("m"), F.abs(a).alias("a"))


@query("fn_round", f"SELECT s_suppkey, {q6('s_acctbal', 1)} AS one, 'PC1 (' || CAST(CAST(round_even(100*(s_suppkey % 37)/37.0::DOUBLE, 0) AS INT) AS VARCHAR) || '%)' AS label FROM supplier")
def _(spark, sf):
    label = X.percent_label("PC1", (F.col("s_suppkey") % 37) / F.lit(37.0))
    return table(spark, sf, "supplier").select("s_suppkey", r6("s_acctbal", 1).alias("one"), label.alias("label"))


@query("fn_ratio", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax = 0 AND l_discount = 0 THEN NULL WHEN l_tax = 0 THEN 'inf'::DOUBLE ELSE round(l_discount / l_tax, 6) END AS ratio,
    CASE WHEN l_tax = 0 AND l_discount = 0 THEN NULL WHEN l_tax = 0 THEN true ELSE l_discount / l_tax >= 2 END AS doubled FROM lineitem""")
def _(spark, sf):
    ratio = N.r_div(F.col("l_discount"), F.col("l_tax"))
    shown = F.when(ratio == N.INF, ratio).otherwise(r6(ratio))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", shown.alias("ratio"), (ratio >= 2).alias("doubled"))


@query("fn_cast", sql_with("subj") + "SELECT subject, CASE outcome WHEN 'Survived' THEN 0 WHEN 'Succumbed' THEN 1 END AS flag, CAST(death AS DOUBLE) AS days FROM subj")
def _(spark, sf):
    flag = L.level_rank(F.col("outcome"), L.OUTCOME) - 1
    return B.subj(spark, sf).select("subject", flag.cast("int").alias("flag"), F.col("death").cast("double").alias("days"))


@query("fn_elapsed_days", "SELECT event_id, round((epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-01 00:00:00')) / 86400.0::DOUBLE, 8) AS days FROM events")
def _(spark, sf):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf, "events").select("event_id", r6(N.elapsed_days(F.col("ts"), start), 8).alias("days"))


@query("fn_concat", "SELECT n_nationkey, n_name || ' (d' || n_regionkey || ')' AS label, concat_ws('.', n_name, n_regionkey) AS dotted FROM nation")
def _(spark, sf):
    label = F.concat("n_name", F.lit(" (d"), F.col("n_regionkey").cast("string"), F.lit(")"))
    return table(spark, sf, "nation").select("n_nationkey", label.alias("label"), F.concat_ws(".", "n_name", F.col("n_regionkey").cast("string")).alias("dotted"))


@query("fn_lower", "SELECT c_custkey, lower(c_mktsegment) AS seg FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.lower("c_mktsegment").alias("seg"))


@query("fn_sentence", "SELECT c_custkey, upper(left(c_mktsegment,1)) || lower(substr(c_mktsegment, 2)) AS seg FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.sentence_case(F.col("c_mktsegment")).alias("seg"))


@query("fn_capfirst", "SELECT p_partkey, upper(left(p_name,1)) || substr(p_name, 2) AS name FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.cap_first(F.col("p_name")).alias("name"))


@query("fn_str_remove", "SELECT n_nationkey, regexp_replace(n_name, '_.+', '') AS stem FROM nation")
def _(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", X.str_remove(F.col("n_name"), "_.+").alias("stem"))


@query("fn_str_extract", r"SELECT p_partkey, nullif(regexp_extract(p_brand || ' (' || p_type || ')', '\(([A-Z]+)\)', 1), '') AS code, nullif(regexp_extract(p_name, '^(b[a-z]+)', 1), '') AS head FROM part")
def _(spark, sf):
    named = F.concat("p_brand", F.lit(" ("), "p_type", F.lit(")"))
    return table(spark, sf, "part").select(
        "p_partkey", X.str_extract(named, r"\(([A-Z]+)\)").alias("code"), X.str_extract(F.col("p_name"), "^(b[a-z]+)").alias("head")
    )


@query("fn_str_detect", "SELECT p_partkey, regexp_matches(p_type, 'ECO|PRO') AS hit FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_type").rlike("ECO|PRO").alias("hit"))


@query("fn_str_replace", r"SELECT p_partkey, regexp_replace(replace(p_name, ' ', '\n'), '\\n', chr(10)) AS name FROM part")
def _(spark, sf):
    literal = F.replace(F.col("p_name"), F.lit(" "), F.lit("\\n"))
    return table(spark, sf, "part").select("p_partkey", X.str_replace(literal, r"\\n", "\n").alias("name"))


@query("fn_p_text", """SELECT l_orderkey, l_linenumber, l_partkey, 'p=' || CASE WHEN l_tax = 0 THEN '<2e-16' ELSE rtrim(rtrim(printf('%.2f', l_tax), '0'), '.') END AS label FROM lineitem""")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.p_text(F.col("l_tax")).alias("label"))


@query("fn_step_label", "SELECT event_id, CASE WHEN value/20 >= 20 THEN '↑↑↑↑' WHEN value/20 >= 10 THEN '↑↑↑' WHEN value/20 >= 5 THEN '↑↑' WHEN value/20 >= 2 THEN '↑' WHEN value/20 <= 0.5 THEN '↓' END AS arrows FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", X.step_label(F.col("value") / 20).alias("arrows"))


@query("fn_stars", "SELECT event_id, CASE WHEN p <= 0.0001 THEN '****' WHEN p <= 0.001 THEN '***' WHEN p <= 0.01 THEN '**' WHEN p <= 0.05 THEN '*' ELSE 'ns' END AS mark FROM (SELECT event_id, value / 500 AS p FROM events)")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", X.stars(F.col("value") / 500).alias("mark"))


@query("fn_pseudocount", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + 100 AS shown, CASE WHEN l_tax = 0 THEN 50 ELSE l_tax END AS floor FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") + 100).alias("shown"), N.floor_at_limit(F.col("l_tax"), 50).alias("floor")
    )
