"""Survival, nonparametric tests and multiple-test adjustment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog.registry import q6, query, r6, sql_chi2_p, sql_norm_p, sql_t_p
from tideline.functions.levels import ARM, OUTCOME
from tideline.operators import aggregate as A
from tideline.operators import nonparametric as NP
from tideline.operators import survival as SV
from tideline.operators.adjust import p_adjust
from tideline.operators.sets import with_overall
from tideline.plans import bindings as B
from tideline.plans.bindings import sql_with, table

# ---------------------------------------------------------------- SQL building blocks


def ranked(source: str, strata: str, group: str, value: str) -> str:
    """Mid-ranks and tie sizes of a source, per stratum."""
    part = f"PARTITION BY {strata}" if strata else ""
    return f"""(SELECT *, rank() OVER ({part} ORDER BY {value}) + (count(*) OVER ({part + ',' if strata else 'PARTITION BY'} {value}) - 1) / 2.0::DOUBLE AS mid,
        count(*) OVER ({part + ',' if strata else 'PARTITION BY'} {value}) AS tie FROM {source} WHERE {value} IS NOT NULL AND {group} IS NOT NULL)"""


def ranksum_sql(source: str, strata: str, group: str, value: str, a: str, b: str, out: str = "") -> str:
    """n1, n2, w, z of a two-sample rank-sum test."""
    keys = f"{strata}, " if strata else ""
    by = f"GROUP BY {strata}" if strata else ""
    only = f"(SELECT * FROM {source} WHERE {group} IN ('{a}', '{b}'))"
    return f"""SELECT {keys} n1, n2, w, {q6('z')} AS z {out} FROM (SELECT *, CASE WHEN v > 0 THEN (w - n1*n2/2.0::DOUBLE - 0.5*sign(w - n1*n2/2.0::DOUBLE)) / sqrt(v) END AS z FROM
        (SELECT {keys} n1, n2, r1 - n1*(n1+1)/2.0::DOUBLE AS w, ties, n1*n2/12.0::DOUBLE*((n1+n2+1) - ties/((n1+n2)*(n1+n2-1)::DOUBLE)) AS v FROM
        (SELECT {keys} COUNT(*) FILTER ({group}='{a}') AS n1, COUNT(*) FILTER ({group}='{b}') AS n2, SUM(mid) FILTER ({group}='{a}') AS r1, SUM(tie::DOUBLE*tie - 1) AS ties
        FROM {ranked(only, strata, group, value)} {by}) WHERE n1 > 0 AND n2 > 0))"""


def ranksum_p_sql(source: str, strata: str, group: str, value: str, a: str, b: str) -> str:
    """n1, n2, w, z and p of a two-sample rank-sum test, as a subquery. Below fifty a group and without ties p comes
    from the numbers of ways in which each w can arise, counted by a recursion in whole numbers; else from z."""
    keys = f"{strata}, " if strata else ""
    return f"""(WITH RECURSIVE rs AS ({ranksum_sql(source, strata, group, value, a, b, ", CAST(ties AS DOUBLE) AS tied, z AS zz")}),
        sizes AS (SELECT DISTINCT n1, n2 FROM rs WHERE n1 < 50 AND n2 < 50 AND tied = 0),
        ways AS (SELECT n1, n2, 0 AS i, u, CAST(CASE WHEN u = 0 THEN 1 ELSE 0 END AS HUGEINT) AS c FROM sizes, LATERAL (SELECT unnest(range(0, n1*n2 + 1)) AS u) UNION ALL
            SELECT n1, n2, i + 1, u, CAST(SUM(d) OVER (PARTITION BY n1, n2, u % (i + 1) ORDER BY u) AS HUGEINT) FROM
            (SELECT n1, n2, i, u, c - COALESCE(lag(c, n2 + i + 1) OVER (PARTITION BY n1, n2 ORDER BY u), 0) AS d FROM ways WHERE i < n1)),
        tails AS (SELECT n1, n2, u, CAST(SUM(c) OVER (PARTITION BY n1, n2 ORDER BY u) AS DOUBLE) / CAST(SUM(c) OVER (PARTITION BY n1, n2) AS DOUBLE) AS low FROM ways WHERE i = n1)
        SELECT {keys}rs.n1, rs.n2, w, z, CASE WHEN low IS NULL THEN {sql_norm_p('zz')} WHEN zz IS NOT NULL THEN least(1.0::DOUBLE, 2*low) END AS p
        FROM rs LEFT JOIN tails ON rs.n1 = tails.n1 AND rs.n2 = tails.n2 AND tied = 0 AND u = CAST(least(w, rs.n1*rs.n2 - w) AS BIGINT))"""


def mean_ci_sql(source: str, keys: str, value: str, level: float = 0.95) -> str:
    """n, mean, se and the bounds of a t interval per group, as a subquery. The quantile is found by halving, from the
    tail that Simpson's rule gives."""
    return f"""(WITH RECURSIVE ms AS (SELECT {keys}, COUNT({value}) AS n, AVG({value}) AS mean, stddev_samp({value})/sqrt(COUNT({value})) AS se FROM {source} GROUP BY {keys}),
        tq AS (SELECT DISTINCT CAST(n - 1 AS DOUBLE) AS df, 0.0::DOUBLE AS lo, 700.0::DOUBLE AS hi, 0 AS i FROM ms WHERE n > 1 UNION ALL
            SELECT df, CASE WHEN p > {1 - level:.6g}::DOUBLE THEN mid ELSE lo END, CASE WHEN p > {1 - level:.6g}::DOUBLE THEN hi ELSE mid END, i + 1 FROM
            (SELECT *, (lo + hi)/2 AS mid, {sql_t_p('((lo + hi)/2)', 'df', 800)} AS p FROM tq WHERE i < 52))
        SELECT {keys}, n, mean, CASE WHEN n > 1 THEN se END AS se, mean - (lo + hi)/2*se AS lower, mean + (lo + hi)/2*se AS upper FROM ms LEFT JOIN tq ON df = n - 1 AND i = 52)"""


_BOUNDS = ", ".join(f"{q6(c)} AS {c}" for c in ("mean", "se", "lower", "upper"))


def kruskal_sql(source: str, strata: str, group: str, value: str) -> str:
    keys = f"{strata}, " if strata else ""
    by = f"GROUP BY {strata}" if strata else ""
    return f"""SELECT {keys} n, h, df, {sql_chi2_p('h', 'df')} AS p FROM (SELECT {keys} CAST(n AS BIGINT) AS n, (12.0::DOUBLE/(n*(n+1))*s - 3*(n+1)) / (1 - ties/(n::DOUBLE*n*n - n)) AS h, k - 1 AS df FROM
        (SELECT {keys} SUM(n) AS n, SUM(r*r/n) AS s, SUM(t) AS ties, COUNT(*) AS k FROM
        (SELECT {keys} {group}, COUNT(*) AS n, SUM(mid) AS r, SUM(tie::DOUBLE*tie - 1) AS t FROM {ranked(source, strata, group, value)} GROUP BY {keys} {group}) {by}) WHERE k > 1)"""


def dunn_sql(source: str, strata: str, group: str, value: str, ordinal: str) -> str:
    """All pairs with z, p and Holm-adjusted p per stratum; ``ordinal`` maps a group to its order."""
    names = [x.strip() for x in strata.split(",")]
    same = " AND ".join(f"a.{x} = b.{x}" for x in names)
    first = ", ".join(f"a.{x}" for x in names)
    part = f"PARTITION BY {strata}"
    return f"""(WITH g AS (SELECT {strata}, {group} AS grp, {ordinal} AS o, COUNT(*) AS n, AVG(mid) AS m, SUM(tie::DOUBLE*tie - 1) AS t FROM {ranked(source, strata, group, value)} GROUP BY {strata}, {group}),
        s AS (SELECT *, SUM(n) OVER ({part}) AS big, SUM(t) OVER ({part}) AS ties FROM g),
        z AS (SELECT {first}, a.grp AS group1, b.grp AS group2, a.n AS n1, b.n AS n2, (b.m - a.m) / sqrt((a.big*(a.big+1)/12.0::DOUBLE - a.ties/(12.0::DOUBLE*(a.big-1))) * (1.0::DOUBLE/a.n + 1.0::DOUBLE/b.n)) AS z
            FROM s a JOIN s b ON {same} AND a.o < b.o),
        p AS (SELECT *, {sql_norm_p('z')} AS p FROM z),
        k AS (SELECT *, rank() OVER ({part} ORDER BY p) - 1 AS before, COUNT(*) OVER ({part}) AS m FROM p)
        SELECT *, least(1.0::DOUBLE, max(p * (m - before)) OVER ({part} ORDER BY p)) AS padj FROM k)"""


ARM_ORDER = "CASE {c} WHEN '27.5' THEN 1 WHEN '10' THEN 2 WHEN '1' THEN 3 ELSE 4 END"
PEAK = "(SELECT subject, feature, MAX(value) AS value FROM obs GROUP BY 1, 2)"
PEAK_ARM = f"(SELECT p.*, arm, outcome FROM {PEAK} p JOIN subj USING (subject))"
DAILY = "(SELECT o.*, arm, outcome FROM (SELECT subject, t, feature, floor(value/5) AS value FROM obs) o JOIN subj USING (subject))"


def _peaks(spark, sf):
    top = B.obs(spark, sf).groupBy("subject", "feature").agg(F.max("value").alias("value"))
    return top.join(B.subj(spark, sf), "subject")


def _daily(spark, sf):
    """Coarse daily values: many ties."""
    coarse = B.obs(spark, sf).withColumn("value", F.floor(F.col("value") / 5).cast("double"))
    return coarse.join(B.subj(spark, sf), "subject")


# ---------------------------------------------------------------- survival


@query("stat_km", sql_with("subj") + f"""SELECT arm, death, n_risk, n_event, {q6('CASE WHEN MAX(CASE WHEN n_event = n_risk THEN 1 ELSE 0 END) OVER w = 1 THEN 0 ELSE exp(SUM(CASE WHEN n_event = n_risk THEN 0 ELSE ln(1 - n_event/n_risk::DOUBLE) END) OVER w) END')} AS survival FROM
    (SELECT arm, death, CAST(SUM(n) OVER (PARTITION BY arm ORDER BY death DESC) AS BIGINT) AS n_risk, n_event FROM
    (SELECT arm, death, COUNT(*) AS n, CAST(SUM(event) AS BIGINT) AS n_event FROM (SELECT arm, death, event FROM subj UNION ALL SELECT 'Overall', death, event FROM subj) GROUP BY 1, 2))
    WINDOW w AS (PARTITION BY arm ORDER BY death)""")
def _(spark, sf):
    curve = SV.km_curve(with_overall(B.subj(spark, sf), "arm"), "death", "event", "arm")
    return curve.withColumn("survival", r6("survival"))


@query("stat_logrank_oe", sql_with("subj") + f""", t AS (SELECT death, COUNT(*) AS n, SUM(event) AS d FROM subj GROUP BY 1),
    r AS (SELECT death, d, SUM(n) OVER (ORDER BY death DESC) AS at_risk FROM t), h AS (SELECT death, SUM(d/at_risk::DOUBLE) OVER (ORDER BY death) AS hazard FROM r)
    SELECT arm, COUNT(*) AS n, CAST(SUM(event) AS BIGINT) AS observed, {q6('SUM(hazard)')} AS expected FROM subj JOIN h USING (death) GROUP BY 1""")
def _(spark, sf):
    arms = SV.logrank_arms(B.subj(spark, sf), "death", "event", "arm", ARM)
    return arms.withColumn("expected", r6("expected"))


_LR2 = """, x AS (SELECT death, event, CASE WHEN arm IN ('27.5','10') THEN 'high' ELSE 'low' END AS side FROM subj),
    t AS (SELECT death, COUNT(*) AS n, COUNT(*) FILTER (side='high') AS n1, SUM(event) AS d, SUM(event) FILTER (side='high') AS d1 FROM x GROUP BY 1),
    r AS (SELECT d, COALESCE(d1, 0) AS d1, SUM(n) OVER (ORDER BY death DESC)::DOUBLE AS r, SUM(n1) OVER (ORDER BY death DESC)::DOUBLE AS r1 FROM t),
    s AS (SELECT SUM(d1 - d*r1/r) AS u, SUM(CASE WHEN r > 1 THEN d*(r-d)/(r-1)*(r1/r)*(1-r1/r) ELSE 0 END) AS v FROM r)"""


@query("stat_logrank_two", sql_with("subj") + _LR2 + f" SELECT {q6('u*u/v')} AS chi2, 1 AS df, {q6(sql_chi2_p('(u*u/v)', '1'))} AS p FROM s")
def _(spark, sf):
    side = F.when(F.col("arm").isin("27.5", "10"), "high").otherwise("low")
    test = SV.logrank(B.subj(spark, sf).withColumn("side", side), "death", "event", "side", ["high", "low"])
    return test.select(r6("chi2").alias("chi2"), "df", r6("p").alias("p"))


@query("stat_logrank", sql_with("subj") + f""", t AS (SELECT death, SUM(event)::DOUBLE AS d, COUNT(*) AS n, COUNT(*) FILTER (arm='27.5') AS a, COUNT(*) FILTER (arm='10') AS b, COUNT(*) FILTER (arm='1') AS c FROM subj GROUP BY 1),
    r AS (SELECT d, SUM(n) OVER w AS r, SUM(a) OVER w / SUM(n) OVER w AS a, SUM(b) OVER w / SUM(n) OVER w AS b, SUM(c) OVER w / SUM(n) OVER w AS c FROM t WINDOW w AS (ORDER BY death DESC)),
    k AS (SELECT *, CASE WHEN r > 1 THEN d*(r-d)/(r-1) ELSE 0 END AS s FROM r),
    o AS (SELECT SUM(event) FILTER (arm='27.5')::DOUBLE AS oa, SUM(event) FILTER (arm='10')::DOUBLE AS ob, SUM(event) FILTER (arm='1')::DOUBLE AS oc FROM subj),
    v AS (SELECT SUM(s*a*(1-a)) AS aa, SUM(s*b*(1-b)) AS bb, SUM(s*c*(1-c)) AS cc, -SUM(s*a*b) AS ab, -SUM(s*a*c) AS ac, -SUM(s*b*c) AS bc, SUM(d*a) AS ea, SUM(d*b) AS eb, SUM(d*c) AS ec FROM k),
    u AS (SELECT v.*, oa - ea AS x, ob - eb AS y, oc - ec AS z FROM v, o),
    i AS (SELECT *, aa*(bb*cc - bc*bc) - ab*(ab*cc - bc*ac) + ac*(ab*bc - bb*ac) AS det FROM u),
    f AS (SELECT (x*x*(bb*cc-bc*bc) + y*y*(aa*cc-ac*ac) + z*z*(aa*bb-ab*ab) + 2*x*y*(ac*bc-ab*cc) + 2*x*z*(ab*bc-ac*bb) + 2*y*z*(ab*ac-aa*bc)) / det AS chi2 FROM i)
    SELECT {q6('chi2')} AS chi2, 3 AS df, {q6(sql_chi2_p('chi2', '3'))} AS p FROM f""")
def _(spark, sf):
    test = SV.logrank(B.subj(spark, sf), "death", "event", "arm", ARM)
    return test.select(r6("chi2").alias("chi2"), "df", r6("p").alias("p"))


# ---------------------------------------------------------------- rank tests


@query("stat_ranksum", sql_with("obs", "subj") + f"SELECT feature, n1, n2, w, z, {q6('p')} AS p FROM {ranksum_p_sql(DAILY, 'feature', 'arm', 'value', '27.5', '10')}")
def _(spark, sf):
    out = NP.ranksum(_daily(spark, sf), ["feature"], "arm", "value", ["27.5", "10"])
    return out.select("feature", "n1", "n2", "w", r6("z").alias("z"), r6("p").alias("p"))


@query("stat_ranksum_by", sql_with("obs", "subj") + f"SELECT feature, t, n1, n2, w, z, {q6('p')} AS p FROM {ranksum_p_sql(DAILY, 'feature, t', 'outcome', 'value', 'Survived', 'Succumbed')}")
def _(spark, sf):
    out = NP.ranksum(_daily(spark, sf), ["feature", "t"], "outcome", "value", OUTCOME)
    return out.select("feature", "t", "n1", "n2", "w", r6("z").alias("z"), r6("p").alias("p"))


@query("stat_kruskal", sql_with("obs", "subj") + f"SELECT feature, n, {q6('h')} AS h, df, {q6('p')} AS p FROM ({kruskal_sql(DAILY, 'feature', 'arm', 'value')})")
def _(spark, sf):
    out = NP.kruskal(_daily(spark, sf), ["feature"], "arm", "value")
    return out.select("feature", "n", r6("h").alias("h"), "df", r6("p").alias("p"))


@query("stat_dunn", sql_with("obs", "subj") + f"SELECT feature, group1, group2, n1, n2, {q6('z')} AS z, {q6('p')} AS p, {q6('padj')} AS padj FROM {dunn_sql(PEAK_ARM, 'feature', 'arm', 'value', ARM_ORDER.format(c='arm'))}")
def _(spark, sf):
    out = NP.dunn(_peaks(spark, sf), ["feature"], "arm", "value", ARM)
    return out.select("feature", "group1", "group2", "n1", "n2", *[r6(c).alias(c) for c in ("z", "p", "padj")])


WEEKS = ["week 0", "week 1", "week 2", "week 3", "week 4"]
_WEEKLY = "(SELECT subject, 'week ' || (t // 7) AS week, feature, value FROM obs)"
_GATED = f"""SELECT feature, group1, group2, n1, n2, {q6('z')} AS z, {q6('p')} AS p, {q6('padj')} AS padj FROM {dunn_sql(_WEEKLY, 'feature', 'week', 'value', "week")}
    WHERE group1 = 'week 0' AND padj < 0.6 AND feature IN (SELECT feature FROM ({kruskal_sql(_WEEKLY, 'feature', 'week', 'value')}) WHERE p < 0.6)"""


@query("stat_gated", sql_with("obs") + _GATED)
def _(spark, sf):
    weekly = B.obs(spark, sf).withColumn("week", F.concat(F.lit("week "), F.expr("t div 7").cast("string")))
    out = NP.gated_dunn(weekly, ["feature"], "week", "value", WEEKS, "week 0", alpha=0.6)
    return out.select("feature", "group1", "group2", "n1", "n2", *[r6(c).alias(c) for c in ("z", "p", "padj")])


# ---------------------------------------------------------------- adjustment

_PV = "(SELECT l_suppkey % 7 AS fam, l_orderkey, l_linenumber, l_partkey, l_tax * l_discount * l_quantity / 4 AS p FROM lineitem)"


def _p_values(spark, sf):
    p = F.col("l_tax") * F.col("l_discount") * F.col("l_quantity") / 4
    return table(spark, sf, "lineitem").select((F.col("l_suppkey") % 7).alias("fam"), "l_orderkey", "l_linenumber", "l_partkey", p.alias("p"))


@query("stat_holm", f"""SELECT fam, l_orderkey, l_linenumber, l_partkey, {q6('p')} AS p, {q6('least(1.0::DOUBLE, max(p*(m-before)) OVER (PARTITION BY fam ORDER BY p))')} AS padj FROM
    (SELECT *, COUNT(*) OVER (PARTITION BY fam) AS m, rank() OVER (PARTITION BY fam ORDER BY p) - 1 AS before FROM {_PV})""")
def _(spark, sf):
    out = p_adjust(_p_values(spark, sf), ["fam"], "p", "holm")
    return out.withColumns({"p": r6("p"), "padj": r6("padj")})


@query("stat_bh", f"""SELECT fam, l_orderkey, l_linenumber, l_partkey, {q6('p')} AS p, {q6('least(1.0::DOUBLE, min(p*m/upto) OVER (PARTITION BY fam ORDER BY p DESC))')} AS padj FROM
    (SELECT *, COUNT(*) OVER (PARTITION BY fam) AS m, COUNT(*) OVER (PARTITION BY fam ORDER BY p) AS upto FROM {_PV})""")
def _(spark, sf):
    out = p_adjust(_p_values(spark, sf), ["fam"], "p", "bh")
    return out.withColumns({"p": r6("p"), "padj": r6("padj")})


# ---------------------------------------------------------------- mean interval

@query("agg_mean_ci", sql_with("obs", "subj") + f"SELECT arm, feature, n, {_BOUNDS} FROM {mean_ci_sql('(SELECT * FROM obs JOIN subj USING (subject))', 'arm, feature', 'value')}")
def _(spark, sf):
    out = A.mean_ci(B.obs(spark, sf).join(B.subj(spark, sf), "subject"), ["arm", "feature"], "value")
    return out.select("arm", "feature", "n", *[r6(c).alias(c) for c in ("mean", "se", "lower", "upper")])
