"""Composite cohort results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog.basics import FEATURES
from tideline.catalog.registry import q6, query, r6, sql_norm_p
from tideline.catalog.stats import PEAK_ARM, WEEKS, dunn_sql, kruskal_sql, mean_ci_sql, ranksum_p_sql, ranksum_sql
from tideline.operators import nonparametric as NP
from tideline.operators.reshape import cast_wide
from tideline.plans import bindings as B
from tideline.plans import cohort as C
from tideline.plans.bindings import DAY_SQL, sql_with, table
from tideline.session import durable

HIGH = ["27.5", "10"]
BOUNDS = ["mean", "se", "lower", "upper"]


def _interval_sql(source, value):
    bounds = ", ".join(f"{q6(c)} AS {c}" for c in BOUNDS)
    return f"SELECT arm, n, {bounds} FROM {mean_ci_sql(source, 'arm', value)}"


def _test_sql(source, group, value, a, b, strata=""):
    """The columns of a rank-sum test, over all rows where there are no strata."""
    keys = f"{strata}, " if strata else ""
    every = source if strata else f"(SELECT *, 1 AS one FROM {source})"
    return f"SELECT {keys}n1, n2, w, z, {q6('p')} AS p FROM {ranksum_p_sql(every, strata or 'one', group, value, a, b)}"


def _rounded(df, *names):
    return df.withColumns({n: r6(n) for n in names})


@query("coh_lethality", sql_with("subj") + """SELECT arm, COUNT(*) FILTER (event=0) AS "Survived", COUNT(*) FILTER (event=1) AS "Succumbed", round(100.0::DOUBLE*SUM(event)/COUNT(*), 1) AS percent FROM subj GROUP BY 1""")
def _(spark, sf):
    return C.lethality(B.subj(spark, sf))


@query("coh_outcome_table", sql_with("subj") + """SELECT arm, COUNT(*) FILTER (event=0) AS "Survived", COUNT(*) FILTER (event=1) AS "Succumbed" FROM subj GROUP BY 1""")
def _(spark, sf):
    return C.outcome_table(B.subj(spark, sf))


@query("coh_time_to_event", sql_with("subj") + _interval_sql("(SELECT * FROM subj WHERE event = 1)", "death"))
def _(spark, sf):
    return _rounded(C.time_to_event(B.subj(spark, sf)), *BOUNDS)


@query("coh_time_to_event_test", sql_with("subj") + _test_sql("(SELECT arm, CAST(death AS DOUBLE) AS death FROM subj WHERE event = 1)", "arm", "death", "27.5", "10"))
def _(spark, sf):
    return _rounded(C.time_to_event_test(B.subj(spark, sf), HIGH), "z", "p")


@query("coh_elapsed", """SELECT event_id, user_id AS subject, round((epoch(date_trunc('second', ts)) - MIN(epoch(date_trunc('second', ts))) OVER (PARTITION BY user_id))/86400.0::DOUBLE, 8) AS elapsed FROM events""")
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.col("user_id").alias("subject"), "ts")
    timed = C.since_start(events, F.lit(True), "ts")
    return timed.select("event_id", "subject", r6("elapsed", 8).alias("elapsed"))


@query("coh_ever_positive", sql_with("obs", "subj") + "SELECT DISTINCT subject, arm, outcome FROM obs JOIN subj USING (subject) WHERE feature = 'error' AND value > 200")
def _(spark, sf):
    return C.ever_positive(B.obs(spark, sf).where("feature = 'error'"), B.subj(spark, sf), 200)


_ONSET = "(SELECT subject, t, value, arm, outcome FROM obs JOIN subj USING (subject) WHERE feature = 'error' AND value > 100 QUALIFY rank() OVER (PARTITION BY subject ORDER BY t) = 1)"


@query("coh_onset", sql_with("obs", "subj") + f"SELECT arm, COUNT(*) AS n, {q6('AVG(t)')} AS mean, {q6('quantile_cont(CAST(t AS DOUBLE), 0.5)')} AS median, MIN(t) AS min, MAX(t) AS max FROM {_ONSET} GROUP BY 1")
def _(spark, sf):
    start = C.onset(B.obs(spark, sf).where("feature = 'error'"), B.subj(spark, sf), 100)
    out = C.summary_stats(start, ["arm"], "t")
    return _rounded(out, "mean", "median").select("arm", "n", "mean", "median", "min", "max")


def _starts(spark, sf):
    return C.onset(B.obs(spark, sf).where("feature = 'error'"), B.subj(spark, sf), 100)


@query("coh_onset_interval", sql_with("obs", "subj") + _interval_sql(_ONSET, "t"))
def _(spark, sf):
    return _rounded(C.onset_interval(_starts(spark, sf)), *BOUNDS)


@query("coh_onset_test", sql_with("obs", "subj") + _test_sql(_ONSET, "arm", "t", "27.5", "10"))
def _(spark, sf):
    return _rounded(NP.ranksum(_starts(spark, sf), [], "arm", "t", HIGH), "z", "p")


_DURATION = f"(SELECT subject, o.arm, o.t, death, death - o.t + 1 AS duration FROM {_ONSET} o JOIN subj USING (subject))"


def _durations(spark, sf):
    subjects = durable(B.subj(spark, sf))
    return C.durations(C.onset(B.obs(spark, sf).where("feature = 'error'"), subjects, 100), subjects)


@query("coh_duration", sql_with("obs", "subj") + f"SELECT subject, arm, t, death, duration FROM {_DURATION}")
def _(spark, sf):
    return _durations(spark, sf)


@query("coh_duration_summary", sql_with("obs", "subj") + f"SELECT arm, COUNT(*) AS n, {q6('AVG(duration)')} AS mean, {q6('quantile_cont(CAST(duration AS DOUBLE), 0.5)')} AS median, MIN(duration) AS min, MAX(duration) AS max FROM {_DURATION} GROUP BY 1")
def _(spark, sf):
    out = C.summary_stats(_durations(spark, sf), ["arm"], "duration")
    return _rounded(out, "mean", "median").select("arm", "n", "mean", "median", "min", "max")


@query("coh_duration_interval", sql_with("obs", "subj") + _interval_sql(_DURATION, "duration"))
def _(spark, sf):
    return _rounded(C.mean_ci(_durations(spark, sf), ["arm"], "duration"), *BOUNDS)


@query("coh_duration_test", sql_with("obs", "subj") + _test_sql(_DURATION, "arm", "duration", "27.5", "10"))
def _(spark, sf):
    return _rounded(NP.ranksum(_durations(spark, sf), [], "arm", "duration", HIGH), "z", "p")


@query("coh_relative_capped", sql_with("obs") + f"""SELECT o.subject, o.t, {q6('b.base')} AS baseline, {q6('least(o.value/b.base, 1.0::DOUBLE)')} AS relative FROM (SELECT * FROM obs WHERE feature='click' AND t > 0) o
    LEFT JOIN (SELECT subject, AVG(value) AS base FROM obs WHERE feature='click' AND t BETWEEN 1 AND 4 GROUP BY 1) b ON o.subject = b.subject""".replace("least(o.value/b.base, 1.0::DOUBLE)", "CASE WHEN o.value/b.base > 1 THEN 1.0::DOUBLE ELSE o.value/b.base END"))
def _(spark, sf):
    early = B.obs(spark, sf, days=(1, 4)).where("feature = 'click'")
    out = C.relative_capped(B.obs(spark, sf).where("feature = 'click'"), early=early)
    return _rounded(out.select("subject", "t", "baseline", "relative"), "baseline", "relative")


@query("coh_first_detection", sql_with("obs", "subj") + "SELECT subject, " + ", ".join(f"MIN(t) FILTER (feature='{f}') AS {f}" for f in FEATURES) + """, arm, outcome FROM obs JOIN subj USING (subject)
    WHERE value > 80 GROUP BY subject, arm, outcome""")
def _(spark, sf):
    return C.first_detection(B.obs(spark, sf), B.subj(spark, sf), FEATURES, 80)


_ONSET_F = "(SELECT subject, feature, t, round(value, 9) AS value, arm FROM obs JOIN subj USING (subject) WHERE value > 100 QUALIFY rank() OVER (PARTITION BY subject, feature ORDER BY t) = 1)"


@query("coh_onset_value", sql_with("obs", "subj") + _test_sql(_ONSET_F, "arm", "value", "27.5", "10", "feature"))
def _(spark, sf):
    values = B.obs(spark, sf).withColumn("value", F.round("value", 9))
    return _rounded(C.onset_value(values, B.subj(spark, sf), HIGH, 100), "z", "p")


@query("coh_peak", sql_with("obs", "subj") + f"SELECT arm, feature, COUNT(*) AS n, {q6('AVG(value)')} AS mean, {q6('quantile_cont(value, 0.5)')} AS median, {q6('MIN(value)')} AS min, {q6('MAX(value)')} AS max FROM {PEAK_ARM} GROUP BY 1, 2")
def _(spark, sf):
    out = C.peak_summary(B.obs(spark, sf), B.subj(spark, sf))
    return _rounded(out, "mean", "median", "min", "max").select("arm", "feature", "n", "mean", "median", "min", "max")


@query("coh_peak_omnibus", sql_with("obs", "subj") + f"SELECT feature, n, {q6('h')} AS h, df, {q6('p')} AS p FROM ({kruskal_sql(PEAK_ARM, 'feature', 'arm', 'value')})")
def _(spark, sf):
    return _rounded(C.peak_omnibus(B.obs(spark, sf), B.subj(spark, sf)), "h", "p")


@query("coh_peak_outcome", sql_with("obs", "subj") + f"""SELECT s.feature, outcome, {q6('max')} AS max, {q6('min')} AS min, w, {q6('p')} AS p, CASE WHEN p <= 0.0001 THEN '****' WHEN p <= 0.001 THEN '***' WHEN p <= 0.01 THEN '**' WHEN p <= 0.05 THEN '*' ELSE 'ns' END AS mark FROM
    (SELECT feature, outcome, MAX(value) AS max, MIN(value) AS min FROM {PEAK_ARM} GROUP BY 1, 2) s JOIN (SELECT feature, w, p FROM {ranksum_p_sql(PEAK_ARM, 'feature', 'outcome', 'value', 'Survived', 'Succumbed')}) USING (feature)""")
def _(spark, sf):
    return _rounded(C.peak_by_outcome(B.obs(spark, sf), B.subj(spark, sf)), "max", "min", "p")


_TISSUE = "(SELECT o.subject, o.feature, floor(value*10)/10 AS value, outcome FROM obs o JOIN subj USING (subject) WHERE feature <> 'signup')"


@query("coh_tissue", sql_with("obs", "subj") + f""", tis AS {_TISSUE}, q AS (SELECT feature, outcome, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM tis GROUP BY 1, 2),
    b AS (SELECT feature, outcome, q1, median, q3, value, value BETWEEN q1 - 1.5::DOUBLE*(q3-q1) AND q3 + 1.5::DOUBLE*(q3-q1) AS inside FROM tis JOIN q USING (feature, outcome)),
    r AS (SELECT feature, p FROM {ranksum_p_sql('tis', 'feature', 'outcome', 'value', 'Survived', 'Succumbed')})
    SELECT feature, outcome, {q6('q1')} AS q1, {q6('median')} AS median, {q6('q3')} AS q3, {q6('MIN(value) FILTER (inside)')} AS low, {q6('MAX(value) FILTER (inside)')} AS high, COUNT(*) FILTER (NOT inside) AS outliers, {q6('p')} AS p
    FROM b JOIN r USING (feature) GROUP BY feature, outcome, q1, median, q3, p""")
def _(spark, sf):
    values = B.obs(spark, sf).withColumn("value", F.floor(F.col("value") * 10) / 10)
    return _rounded(C.tissue_comparison(values, B.subj(spark, sf), ["signup"]), "q1", "median", "q3", "low", "high", "p")


@query("coh_panel", sql_with("obs", "subj") + f"""SELECT subject, t, feature, {q6('value')} AS value, kind, outcome, arm, death, CASE WHEN subject = 7 THEN 'special' ELSE outcome END AS grp,
    CASE WHEN t <> 29 AND t = death THEN 'Terminal' ELSE CAST(t AS VARCHAR) END AS moment FROM
    (SELECT k.subject, k.t, f.feature, o.value, f.kind FROM (SELECT DISTINCT subject, t FROM obs) k CROSS JOIN (VALUES ('click','chem'),('view','chem'),('error','hema'),('purchase','hema')) f(feature, kind)
     LEFT JOIN obs o ON o.subject = k.subject AND o.t = k.t AND o.feature = f.feature) LEFT JOIN subj USING (subject)""")
def _(spark, sf):
    wide = cast_wide(B.obs(spark, sf), ["subject", "t"], "feature", "value", ["click", "error", "purchase", "signup", "view"])
    chem, hema = wide.select("subject", "t", "click", "view"), wide.select("subject", "t", "error", "purchase", "signup")
    out = C.panel(chem, hema, B.subj(spark, sf), drop=["Sign"], special=7, last_day=B.END)
    return _rounded(out, "value")


_WEEKLY = "(SELECT o.subject, 'week ' || (t // 7) AS week, feature, value FROM obs o JOIN subj USING (subject) WHERE outcome = '{outcome}')"


def _change_points(outcome):
    source = _WEEKLY.format(outcome=outcome)
    gate = f"SELECT feature FROM ({kruskal_sql(source, 'feature', 'week', 'value')}) WHERE p < 0.7"
    sql = sql_with("obs", "subj") + f"SELECT feature, group1, group2, {q6('z')} AS z, {q6('padj')} AS padj FROM {dunn_sql(source, 'feature', 'week', 'value', 'week')} WHERE group1 = 'week 0' AND padj < 0.7 AND feature IN ({gate})"

    def plan(spark, sf):
        some = B.subj(spark, sf).where(F.col("outcome") == outcome).select("subject")
        weekly = B.obs(spark, sf).join(some, "subject", "left_semi")
        weekly = weekly.withColumn("week", F.concat(F.lit("week "), F.expr("t div 7").cast("string")))
        out = NP.gated_dunn(weekly, ["feature"], "week", "value", WEEKS, "week 0", alpha=0.7)
        return _rounded(out.select("feature", "group1", "group2", "z", "padj"), "z", "padj")

    return plan, sql


for _name, _outcome in (("coh_change_points", "Succumbed"), ("coh_change_points_survived", "Survived")):
    _plan, _sql = _change_points(_outcome)
    query(_name, _sql)(_plan)


_EXTREME = """(SELECT subject, feature, comparison, round(value, 9) AS value, outcome FROM (SELECT subject, feature, value, 'D0' AS comparison FROM obs WHERE t = 0
    UNION ALL SELECT subject, feature, MIN(value), 'Min' FROM obs GROUP BY 1, 2 UNION ALL SELECT subject, feature, MAX(value), 'Max' FROM obs GROUP BY 1, 2) JOIN subj USING (subject))"""


@query("coh_extremes", sql_with("obs", "subj") + _test_sql(_EXTREME, "outcome", "value", "Survived", "Succumbed", "feature, comparison"))
def _(spark, sf):
    values = B.obs(spark, sf).withColumn("value", F.round("value", 9))
    out = C.extremes_test(values, B.subj(spark, sf))
    return _rounded(out.select("feature", "comparison", "n1", "n2", "w", "z", "p"), "z", "p")


@query("coh_extremes_table", sql_with("obs", "subj") + f"SELECT subject, feature, comparison, {q6('value')} AS value, outcome FROM {_EXTREME}")
def _(spark, sf):
    return _rounded(C.extremes(B.obs(spark, sf), B.subj(spark, sf)), "value")


# titer sheet: one row per (subject, t, antigen), two measured classes
_SHEET = f"(SELECT user_id AS subject, {DAY_SQL} AS t, event_type AS antigen, MAX(floor(value/50))*50 AS igm, MIN(floor(value/50))*50 AS igg FROM events GROUP BY 1, 2, 3)"


def _sheet(spark, sf):
    step = F.floor(F.col("value") / 50)
    return table(spark, sf, "events").groupBy(
        F.col("user_id").alias("subject"), B.study_day(table(spark, sf, "events")).alias("t"), F.col("event_type").alias("antigen")
    ).agg((F.max(step) * 50).cast("double").alias("igm"), (F.min(step) * 50).cast("double").alias("igg"))


_LAST = f"(SELECT * FROM {_SHEET} QUALIFY rank() OVER (PARTITION BY subject, antigen ORDER BY t DESC) = 1)"
_TITER = f"(SELECT subject, antigen, t, class, CAST(titer AS DOUBLE) AS titer, outcome FROM (SELECT subject, antigen, t, 'igm' AS class, igm AS titer FROM {_LAST} UNION ALL SELECT subject, antigen, t, 'igg', igg FROM {_LAST}) JOIN subj USING (subject))"
_TITER_TEST = f"""(SELECT class, antigen, n1, n2, w, {sql_norm_p('zz')} AS p FROM ({ranksum_sql(_TITER, 'class, antigen', 'outcome', 'titer', 'Survived', 'Succumbed', ', z AS zz')}))"""


@query("coh_endpoint_titer", sql_with("subj") + f"""SELECT class, antigen, n1, n2, w, {q6('p')} AS p, {q6('padj')} AS padj, CASE WHEN padj <= 0.0001 THEN '****' WHEN padj <= 0.001 THEN '***' WHEN padj <= 0.01 THEN '**' WHEN padj <= 0.05 THEN '*' ELSE 'ns' END AS mark FROM
    (SELECT *, least(1.0::DOUBLE, max(p*(m-before)) OVER (ORDER BY p)) AS padj FROM (SELECT *, COUNT(*) OVER () AS m, rank() OVER (ORDER BY p) - 1 AS before FROM {_TITER_TEST}))""")
def _(spark, sf):
    titers = C.endpoint_titer(_sheet(spark, sf), B.subj(spark, sf), ["subject", "antigen"], ["igm", "igg"])
    return _rounded(C.endpoint_titer_test(titers, "antigen").drop("z"), "p", "padj")


@query("coh_endpoint_titer_table", sql_with("subj") + f"SELECT subject, antigen, t, class, titer, outcome, CASE WHEN titer = 0 THEN 50.0::DOUBLE ELSE titer END AS shown FROM {_TITER}")
def _(spark, sf):
    return C.endpoint_titer(_sheet(spark, sf), B.subj(spark, sf), ["subject", "antigen"], ["igm", "igg"])


@query("coh_titer_series", sql_with("subj") + f"""SELECT subject, t, antigen, class, titer, outcome, titer + 100 AS shown FROM (SELECT subject, t, antigen, 'igm' AS class, CAST(igm AS DOUBLE) AS titer FROM {_SHEET}
    UNION ALL SELECT subject, t, antigen, 'igg', CAST(igg AS DOUBLE) FROM {_SHEET}) JOIN subj USING (subject)""")
def _(spark, sf):
    return C.titer_series(_sheet(spark, sf), B.subj(spark, sf), ["subject", "t", "antigen"], ["igm", "igg"])


@query("coh_assay_series", sql_with("obs", "subj") + f"SELECT subject, t, {q6('value')} AS value, arm, outcome, {q6('value + 24')} AS shown FROM obs LEFT JOIN subj USING (subject) WHERE feature = 'purchase'")
def _(spark, sf):
    some = B.obs(spark, sf).where("feature = 'purchase'").drop("feature")
    return _rounded(C.assay_series(some, B.subj(spark, sf), 24), "value", "shown")


_RED = """(SELECT w.subject, batch, dilution, plaques, control, CASE WHEN 100*(control - plaques)/control < 0 THEN 0.0::DOUBLE ELSE 100*(control - plaques)/control END AS reduction FROM (SELECT * FROM wells WHERE subject % 20 <> 0) w
    LEFT JOIN (SELECT batch, AVG(plaques) AS control FROM wells WHERE subject % 20 = 0 GROUP BY 1) USING (batch))"""


def _reductions(spark, sf):
    return C.percent_reduction(B.wells(spark, sf), F.col("subject") % 20 == 0)


@query("coh_percent_reduction", sql_with("wells") + f"SELECT subject, batch, dilution, {q6('plaques')} AS plaques, {q6('control')} AS control, {q6('reduction')} AS reduction FROM {_RED}")
def _(spark, sf):
    return _rounded(_reductions(spark, sf), "plaques", "control", "reduction").select("subject", "batch", "dilution", "plaques", "control", "reduction")


@query("coh_dilution_curve", sql_with("wells", "subj") + f"SELECT subject, batch, dilution, {q6('reduction')} AS reduction, arm || ' PFU' AS arm FROM {_RED} JOIN subj USING (subject)")
def _(spark, sf):
    out = C.dilution_curve(_reductions(spark, sf), B.subj(spark, sf))
    return _rounded(out.select("subject", "batch", "dilution", "reduction", "arm"), "reduction")


_BEST = f"(SELECT subject, round(MAX(reduction), 9) AS reduction, outcome FROM {_RED} JOIN subj USING (subject) WHERE dilution = 10 GROUP BY subject, outcome)"


@query("coh_best_response", sql_with("wells", "subj") + _test_sql(_BEST, "outcome", "reduction", "Survived", "Succumbed"))
def _(spark, sf):
    best = C.best_response(_reductions(spark, sf), B.subj(spark, sf), 10).withColumn("reduction", F.round("reduction", 9))
    return _rounded(NP.ranksum(best, [], "outcome", "reduction", C.OUTCOME), "z", "p")


@query("coh_best_response_table", sql_with("wells", "subj") + f"SELECT subject, {q6('MAX(reduction)')} AS reduction, outcome FROM {_RED} JOIN subj USING (subject) WHERE dilution = 10 GROUP BY subject, outcome")
def _(spark, sf):
    best = C.best_response(_reductions(spark, sf), B.subj(spark, sf), 10)
    return _rounded(best.select("subject", "reduction", "outcome"), "reduction")
