"""Count and log-value matrices: filters, normalisation, models, moderated tests, components."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tideline.catalog.registry import q6, query, r6, sql_digamma, sql_t_p, sql_tetragamma, sql_trigamma
from tideline.functions.levels import GROUP, STAGE
from tideline.functions.numeric import INF, r_div, r_log2
from tideline.operators import counts as K
from tideline.operators import linear as M
from tideline.operators import pca as P
from tideline.operators.joins import with_baseline
from tideline.plans import bindings as B
from tideline.plans import differential as D
from tideline.plans.bindings import sql_with, table
from tideline.session import durable

SHOWN = ["Early", "Middle", "Late"]
CONTRASTS = M.versus("Baseline", SHOWN)
BATCHES = ["A", "B"]

# ---------------------------------------------------------------- SQL building blocks

_DENSE = """, dense AS (SELECT f.feature, s.sample, COALESCE(c.value, 0) AS value FROM (SELECT DISTINCT feature FROM counts) f
    CROSS JOIN (SELECT DISTINCT sample FROM samples) s LEFT JOIN counts c ON c.feature = f.feature AND c.sample = s.sample)"""
_TMM = """, lib AS (SELECT sample, CAST(SUM(value) AS DOUBLE) AS lib FROM counts GROUP BY 1),
    uq AS (SELECT sample, lib, quantile_cont(CAST(value AS DOUBLE), 0.75) / lib AS q FROM dense JOIN lib USING (sample) GROUP BY 1, 2),
    ref AS (SELECT sample, lib FROM uq ORDER BY abs(q - (SELECT AVG(q) FROM uq)), sample LIMIT 1),
    base AS (SELECT feature, value, ref.lib AS nr FROM counts JOIN ref USING (sample) WHERE value > 0),
    ma AS (SELECT c.sample, round(log2(c.value/lib) - log2(b.value/nr), 12) AS m, round((log2(c.value/lib) + log2(b.value/nr))/2, 12) AS a,
        (lib - c.value)/lib/c.value + (nr - b.value)/nr/b.value AS v FROM counts c JOIN lib USING (sample) JOIN base b USING (feature) WHERE c.value > 0),
    rk AS (SELECT *, COUNT(*) OVER (PARTITION BY sample) AS n, rank() OVER (PARTITION BY sample ORDER BY m) + (COUNT(*) OVER (PARTITION BY sample, m) - 1)/2.0::DOUBLE AS rm,
        rank() OVER (PARTITION BY sample ORDER BY a) + (COUNT(*) OVER (PARTITION BY sample, a) - 1)/2.0::DOUBLE AS ra FROM ma),
    tf AS (SELECT sample, SUM(m/v)/SUM(1/v) AS f FROM rk WHERE rm BETWEEN floor(n*0.3::DOUBLE)+1 AND n - floor(n*0.3::DOUBLE) AND ra BETWEEN floor(n*0.05::DOUBLE)+1 AND n - floor(n*0.05::DOUBLE) GROUP BY 1),
    tmm AS (SELECT sample, lib, pow(2, COALESCE(f, 0) - AVG(COALESCE(f, 0)) OVER ()) AS factor FROM lib LEFT JOIN tf USING (sample))"""
_LOGCPM = _TMM + """, eff AS (SELECT sample, lib*factor AS l, 2*lib*factor/AVG(lib*factor) OVER () AS pad FROM tmm),
    logcpm AS (SELECT feature, sample, log2((value + pad)/(l + 2*pad)*1e6::DOUBLE) AS value FROM dense JOIN eff USING (sample))"""


def oneway_sql(matrix: str, samples: str) -> str:
    """CTEs st (per feature and stage), fit (per feature) and contr (per feature and contrast)."""
    return f""", st AS (SELECT feature, stage, COUNT(*) AS n, AVG(value) AS m, var_pop(value)*COUNT(*) AS ss FROM {matrix} JOIN {samples} USING (sample) GROUP BY 1, 2),
    fit AS (SELECT feature, CAST(SUM(n) - COUNT(*) AS DOUBLE) AS df, sqrt(SUM(ss)/(SUM(n) - COUNT(*))) AS sigma FROM st GROUP BY 1),
    contr AS (SELECT a.feature, a.stage, a.m - b.m AS lfc, sqrt(1.0::DOUBLE/a.n + 1.0::DOUBLE/b.n) AS unscaled, sigma, df FROM st a JOIN st b ON a.feature = b.feature AND b.stage = 'Baseline'
        AND a.stage IN ('Early','Middle','Late') JOIN fit ON fit.feature = a.feature)"""


def batch_sql(matrix: str, samples: str) -> str:
    """The same CTEs for stage plus a two-level batch, by partialling the stage means out of the batch
    indicator, and ``effect`` with the batch coefficient per feature."""
    return f""", x AS (SELECT feature, sample, stage, value, CASE batch WHEN 'B' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS z FROM {matrix} JOIN {samples} USING (sample)),
    sm AS (SELECT feature, stage, COUNT(*) AS n, AVG(value) AS m, AVG(z) AS zm FROM x GROUP BY 1, 2),
    effect AS (SELECT feature, SUM((z - zm)*(value - m))/SUM((z - zm)*(z - zm)) AS b, SUM((z - zm)*(z - zm)) AS szz FROM x JOIN sm USING (feature, stage) GROUP BY 1),
    fit AS (SELECT feature, CAST(COUNT(*) - 6 AS DOUBLE) AS df, sqrt(SUM(pow(value - m - b*(z - zm), 2))/(COUNT(*) - 6)) AS sigma FROM x JOIN sm USING (feature, stage) JOIN effect USING (feature) GROUP BY 1),
    st AS (SELECT feature, stage, n, zm, m - b*zm AS m FROM sm JOIN effect USING (feature)),
    contr AS (SELECT a.feature, a.stage, a.m - b.m AS lfc, sqrt(1.0::DOUBLE/a.n + 1.0::DOUBLE/b.n + pow(a.zm - b.zm, 2)/szz) AS unscaled, sigma, df FROM st a JOIN st b ON a.feature = b.feature AND b.stage = 'Baseline'
        AND a.stage IN ('Early','Middle','Late') JOIN fit ON fit.feature = a.feature JOIN effect ON effect.feature = a.feature)"""


EBAYES = f""", e AS (SELECT df, ln(sigma*sigma) - {sql_digamma('(df/2)')} + ln(df/2) AS e, {sql_trigamma('(df/2)')} AS g FROM fit),
    h AS (SELECT AVG(e) AS mean, var_samp(e) - AVG(g) AS extra, SUM(df) AS pooled FROM e),
    newton AS (SELECT 0 AS i, 0.5::DOUBLE + 1/extra AS y FROM h WHERE extra > 0 UNION ALL
        SELECT i + 1, y + {sql_trigamma('y')}*(1 - {sql_trigamma('y')}/extra)/{sql_tetragamma('y')} FROM newton, h WHERE i < 25),
    prior AS (SELECT mean, pooled, y, CASE WHEN y IS NULL THEN exp(mean) ELSE exp(mean + {sql_digamma('y')} - ln(y)) END AS s0 FROM h LEFT JOIN (SELECT * FROM newton WHERE i = 25) ON true),
    post AS (SELECT contr.*, CASE WHEN y IS NULL THEN s0 ELSE (2*y*s0 + df*sigma*sigma)/(2*y + df) END AS s2, CASE WHEN y IS NULL THEN pooled ELSE least(df + 2*y, pooled) END AS dft FROM contr, prior),
    tt AS (SELECT *, lfc/(unscaled*sqrt(s2)) AS t FROM post),
    eb AS (SELECT *, {sql_t_p('t', 'dft', 600)} AS p FROM tt)"""
RESULT = """, bh AS (SELECT *, COUNT(p) OVER (PARTITION BY stage) AS mm, COUNT(p) OVER (PARTITION BY stage ORDER BY p) AS upto FROM eb),
    adj AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0::DOUBLE, min(p*mm/upto) OVER (PARTITION BY stage ORDER BY p DESC NULLS LAST)) END AS padj FROM bh),
    res AS (SELECT feature, stage, lfc, padj, padj < {p} AND abs(lfc) > {f} AS significant, CASE WHEN padj < {p} AND abs(lfc) > {f} THEN CASE WHEN lfc < 0 THEN 'Down' ELSE 'Up' END ELSE 'None' END AS regulation FROM adj)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _between(at: str, curve: str) -> str:
    """SQL text: rows of ``at`` (id, x) with the curve's value, constant beyond its ends."""
    return f"""SELECT p.id, CASE WHEN c.a1 IS NULL THEN c.f0 WHEN p.x <= c.a0 THEN c.f0 ELSE c.f0 + (p.x - c.a0)/(c.a1 - c.a0)*(c.f1 - c.f0) END AS f
        FROM (SELECT id, x, greatest(x, (SELECT min(a) FROM {curve})) AS xx FROM {at}) p ASOF LEFT JOIN (SELECT a AS a0, f AS f0, lead(a) OVER (ORDER BY a) AS a1, lead(f) OVER (ORDER BY a) AS f1 FROM {curve}) c ON p.xx >= c.a0"""


def lowess_sql(points: str, out: str, span: float = 0.5, rounds: int = 3) -> str:
    """CTEs that smooth ``points`` (id, x, y); the last, ``out``, has the knots (a, f)."""
    k = f"{out}_"
    text = f""", {k}n AS (SELECT COUNT(*) AS n, min(x) AS lo, max(x) AS hi, greatest(least(CAST(floor({span}::DOUBLE*COUNT(*) + 1e-7::DOUBLE) AS BIGINT), COUNT(*)), 2) AS q FROM {points}),
    {k}walk AS (SELECT lo AS a FROM {k}n UNION ALL
        SELECT coalesce(max(p.x) FILTER (p.x <= w.a + 0.01::DOUBLE*(hi - lo)), min(p.x)) FROM {k}walk w, {points} p, {k}n WHERE p.x > w.a GROUP BY w.a),
    {k}reach AS (SELECT a, d AS h FROM (SELECT a, abs(x - a) AS d, row_number() OVER (PARTITION BY a ORDER BY abs(x - a)) AS i FROM {k}walk, {points}), {k}n WHERE i = q),
    {k}near AS (SELECT a, id, x - a AS u, y, CASE WHEN abs(x - a) <= 0.001::DOUBLE*h THEN 1.0::DOUBLE ELSE pow(1 - pow(abs(x - a)/h, 3), 3) END AS w FROM {k}reach, {points} WHERE abs(x - a) <= 0.999::DOUBLE*h),
    {k}w0 AS (SELECT id, 1.0::DOUBLE AS rw FROM {points})"""
    for r in range(rounds + 1):
        name = out if r == rounds else f"{k}f{r}"
        text += f""", {k}m{r} AS (SELECT a, SUM(w*rw) AS w, SUM(w*rw*u)/SUM(w*rw) AS u, SUM(w*rw*u*u)/SUM(w*rw) AS uu, SUM(w*rw*y)/SUM(w*rw) AS y, SUM(w*rw*u*y)/SUM(w*rw) AS uy FROM {k}near JOIN {k}w{r} USING (id) GROUP BY 1),
    {name} AS (SELECT a, y - u*CASE WHEN sqrt(greatest(uu - u*u, 0)) > 0.001::DOUBLE*(hi - lo) THEN (uy - u*y)/(uu - u*u) ELSE 0 END AS f FROM {k}m{r}, {k}n)"""
        if r < rounds:
            text += f""", {k}e{r} AS (SELECT id, abs(y - f) AS e FROM {points} JOIN ({_between(points, name)}) USING (id)),
    {k}w{r + 1} AS (SELECT id, CASE WHEN e/s <= 0.001::DOUBLE THEN 1.0::DOUBLE WHEN e/s <= 0.999::DOUBLE THEN pow(1 - pow(e/s, 2), 2) ELSE 0.0::DOUBLE END AS rw FROM {k}e{r}, (SELECT 6*median(e) AS s FROM {k}e{r}))"""
    return text


def count_model_sql(where: str, k: str = "", *, n: int = 3, threshold: int = 20, filtered: bool = True) -> str:
    """CTEs of the weighted count model over the samples for which ``where`` holds, with names that end in ``k``: the cells
    ``cell{k}`` (feature, sample, value, weight), and ``fit{k}`` and ``contr{k}`` as the plain models have them."""
    enough = f"WHERE feature IN (SELECT feature FROM sub{k} GROUP BY 1 HAVING COUNT(*) FILTER (value > {threshold}) >= {n})" if filtered else ""
    tmm = _TMM
    for name in ("lib", "uq", "ref", "base", "ma", "rk", "tf", "tmm"):
        tmm = re.sub(rf"(?<![\w.]){name} AS \(", f"{name}{k} AS (", tmm)
        tmm = re.sub(rf"(FROM|JOIN) {name}\b", rf"\1 {name}{k}", tmm)
    tmm = tmm.replace(f"ref{k}.lib", "ref.lib").replace(f"JOIN ref{k} USING", f"JOIN ref{k} AS ref USING").replace("counts", f"kept{k}").replace("dense", f"dense{k}")
    return f""", sel{k} AS (SELECT sample, stage FROM samples WHERE {where}),
    sub{k} AS (SELECT feature, sample, value FROM counts JOIN sel{k} USING (sample)),
    kept{k} AS (SELECT * FROM sub{k} {enough}),
    dense{k} AS (SELECT f.feature, s.sample, COALESCE(c.value, 0) AS value FROM (SELECT DISTINCT feature FROM kept{k}) f CROSS JOIN (SELECT DISTINCT sample FROM kept{k}) s LEFT JOIN kept{k} c ON c.feature = f.feature AND c.sample = s.sample){tmm},
    size{k} AS (SELECT sample, stage, log2(lib*factor + 1) AS lg, AVG(log2(lib*factor + 1)) OVER () AS mlg FROM tmm{k} JOIN sel{k} USING (sample)),
    y{k} AS (SELECT feature, sample, stage, log2(value + 0.5::DOUBLE) + log2(1e6::DOUBLE) - lg AS value, lg, mlg FROM dense{k} JOIN size{k} USING (sample)),
    plain{k} AS (SELECT feature, stage, COUNT(*) AS n, AVG(value) AS m, var_pop(value)*COUNT(*) AS ss FROM y{k} GROUP BY 1, 2),
    pts{k} AS (SELECT feature AS id, SUM(n*m)/SUM(n) + (SELECT any_value(mlg) FROM size{k}) - log2(1e6::DOUBLE) AS x, sqrt(sqrt(SUM(ss)/(SUM(n) - COUNT(*)))) AS y FROM plain{k} GROUP BY 1 HAVING SUM(n) > COUNT(*)){lowess_sql(f"pts{k}", f"curve{k}")},
    spot{k} AS (SELECT feature || '#' || sample AS id, feature, sample, stage, value, m + lg - log2(1e6::DOUBLE) AS x FROM y{k} JOIN plain{k} USING (feature, stage)),
    cell{k} AS (SELECT feature, sample, stage, value, pow(f, -4) AS weight FROM spot{k} JOIN ({_between(f"spot{k}", f"curve{k}")}) USING (id)),
    st{k} AS (SELECT feature, stage, COUNT(*) AS n, SUM(weight) AS mass, SUM(weight*value)/SUM(weight) AS m FROM cell{k} GROUP BY 1, 2),
    fit{k} AS (SELECT feature, CAST(COUNT(*) - COUNT(DISTINCT stage) AS DOUBLE) AS df, sqrt(SUM(weight*pow(value - m, 2))/nullif(COUNT(*) - COUNT(DISTINCT stage), 0)) AS sigma FROM cell{k} JOIN st{k} USING (feature, stage) GROUP BY 1),
    contr{k} AS (SELECT fit.feature, shown.stage, a.m - b.m AS lfc, sqrt(1/a.mass + 1/b.mass) AS unscaled, sigma, df FROM fit{k} fit CROSS JOIN (VALUES ('Early'), ('Middle'), ('Late')) shown(stage)
        LEFT JOIN st{k} a ON a.feature = fit.feature AND a.stage = shown.stage LEFT JOIN st{k} b ON b.feature = fit.feature AND b.stage = 'Baseline')"""


COUNT_TABLES = recursive(sql_with("counts", "samples"))
VIREMIC, HD, LDV, AVIREMIC = "grp <> 'LD-NV'", "grp = 'HD'", "grp = 'LD-V'", "grp = 'LD-NV'"


def count_result_sql(where: str, p: str = "0.05", f: str = "1") -> str:
    return COUNT_TABLES + count_model_sql(where) + EBAYES + RESULT.format(p=p, f=f)


COUNT_FIT = COUNT_TABLES + count_model_sql("true", filtered=False) + EBAYES
COUNT_RESULT = COUNT_FIT + RESULT.format(p="0.4", f="0.1")
ROUNDED = f"SELECT feature, stage, {q6('lfc')} AS lfc, {q6('padj')} AS padj, significant, regulation FROM res"


def pca_sql(matrix: str, squarings: int = 18) -> str:
    """CTEs of the first two components of ``matrix`` (feature, sample, value): ``load`` and ``score`` per component,
    ``vari`` with variances. A covariance squared again and again becomes the projection on its leading direction;
    the second one comes from what is left."""
    text = f""", cen AS (SELECT feature, sample, value - AVG(value) OVER (PARTITION BY feature) AS v FROM {matrix}),
    freedom AS (SELECT COUNT(DISTINCT sample) - 1 AS n FROM cen),
    cov1 AS (SELECT a.feature AS i, b.feature AS j, SUM(a.v*b.v)/(SELECT n FROM freedom) AS c FROM cen a JOIN cen b USING (sample) GROUP BY 1, 2)"""
    for pc in (1, 2):
        text += f", p{pc}_0 AS (SELECT i, j, c/(SELECT SUM(c) FROM cov{pc} WHERE i = j) AS c FROM cov{pc})"
        for s in range(squarings):
            text += f", q{pc}_{s} AS (SELECT a.i, b.j, SUM(a.c*b.c) AS c FROM p{pc}_{s} a JOIN p{pc}_{s} b ON a.j = b.i GROUP BY 1, 2), p{pc}_{s + 1} AS (SELECT i, j, c/(SELECT SUM(c) FROM q{pc}_{s} WHERE i = j) AS c FROM q{pc}_{s})"
        text += f""", d{pc} AS (SELECT i, c/sqrt(SUM(c*c) OVER ()) AS c FROM p{pc}_{squarings} WHERE j = (SELECT arg_max(i, c) FROM p{pc}_{squarings} WHERE i = j)),
    v{pc} AS (SELECT i AS feature, c*(SELECT CASE WHEN arg_max(c, abs(c)) < 0 THEN -1 ELSE 1 END FROM d{pc}) AS c FROM d{pc}),
    l{pc} AS (SELECT SUM(a.c*m.c*b.c) AS l FROM cov{pc} m JOIN v{pc} a ON a.feature = m.i JOIN v{pc} b ON b.feature = m.j)"""
        if pc == 1:
            text += ", cov2 AS (SELECT m.i, m.j, m.c - l*a.c*b.c AS c FROM cov1 m JOIN v1 a ON a.feature = m.i JOIN v1 b ON b.feature = m.j, l1)"
    return text + """, load AS (SELECT v1.feature, v1.c AS pc1, v2.c AS pc2 FROM v1 JOIN v2 USING (feature)),
    score AS (SELECT sample, SUM(v*pc1) AS pc1, SUM(v*pc2) AS pc2 FROM cen JOIN load USING (feature) GROUP BY 1),
    total AS (SELECT SUM(c) AS t FROM cov1 WHERE i = j),
    vari AS (SELECT 'PC1' AS component, l AS variance, l/t AS share FROM l1, total UNION ALL SELECT 'PC2', l, l/t FROM l2, total)"""


# ---------------------------------------------------------------- plans shared below


def _dense(spark, sf):
    return K.complete_cells(B.counts(spark, sf), B.samples(spark, sf))


def _count_tests(spark, sf):
    """Moderated tests of the whole count matrix, no feature filtered out."""
    return M.count_tests(B.counts(spark, sf), B.samples(spark, sf), "stage", STAGE, CONTRASTS, n=0)


def _study(spark, sf, *groups):
    """Result table of the count comparison in some study groups, all in one plan."""
    return M.count_de(B.counts(spark, sf), B.study_samples(spark, sf, list(groups)), "stage", STAGE, CONTRASTS, by="study")


def _rounded(df, *names):
    return df.withColumns({n: r6(n) for n in names})


# ---------------------------------------------------------------- counts


@query("mat_filter", sql_with("counts") + "SELECT feature, sample, value FROM counts WHERE feature IN (SELECT feature FROM counts GROUP BY 1 HAVING COUNT(*) FILTER (value > 450) >= 3)")
def _(spark, sf):
    return K.filter_features(B.counts(spark, sf), 3, 450).select("feature", "sample", "value")


@query("mat_dense", sql_with("counts", "samples") + _DENSE + " SELECT * FROM dense")
def _(spark, sf):
    return _dense(spark, sf)


@query("mat_tmm", sql_with("counts", "samples") + _DENSE + _TMM + f" SELECT sample, lib AS lib_size, {q6('factor')} AS factor FROM tmm")
def _(spark, sf):
    return _rounded(K.tmm(durable(B.counts(spark, sf))), "factor")


@query("mat_logcpm", sql_with("counts", "samples") + _DENSE + _LOGCPM + f" SELECT feature, sample, {q6('value')} AS value FROM logcpm")
def _(spark, sf):
    cells = durable(B.counts(spark, sf))
    dense = K.complete_cells(cells, B.samples(spark, sf))
    return _rounded(K.log_cpm(dense, K.tmm(cells)), "value")


@query("mat_log2", sql_with("counts", "samples") + _DENSE + " SELECT feature, sample, CASE WHEN value = 0 THEN '-inf'::DOUBLE ELSE round(log2(value), 6) END AS value FROM dense")
def _(spark, sf):
    logged = r_log2(F.col("value"))
    return _dense(spark, sf).select("feature", "sample", F.when(logged == -INF, logged).otherwise(r6(logged)).alias("value"))


# ---------------------------------------------------------------- models


@query("mat_oneway", sql_with("assay", "assay_samples") + oneway_sql("assay", "assay_samples") + f" SELECT feature, stage, {q6('m')} AS beta, {q6('sigma')} AS sigma, df FROM st JOIN fit USING (feature)")
def _(spark, sf):
    fit = M.fit_oneway(B.assay(spark, sf), B.assay_samples(spark, sf), "stage", STAGE)
    named = F.arrays_zip(F.array(*[F.lit(s) for s in STAGE]).alias("stage"), "beta")
    long = fit.select("feature", F.explode(named).alias("c"), "sigma", "df")
    return _rounded(long.select("feature", "c.stage", "c.beta", "sigma", "df"), "beta", "sigma")


@query("mat_oneway_w", sql_with("assay", "assay_samples") + f""", w AS (SELECT feature, stage, value, 1.0::DOUBLE + (sample % 4) AS w FROM assay JOIN assay_samples USING (sample)),
    g AS (SELECT feature, stage, COUNT(*) AS n, SUM(w*value)/SUM(w) AS m FROM w GROUP BY 1, 2)
    SELECT feature, {q6('sqrt(SUM(w*(value - m)*(value - m))/(COUNT(*) - 5))')} AS sigma, {q6("MAX(m) FILTER (stage='Late') - MAX(m) FILTER (stage='Baseline')")} AS lfc FROM w JOIN g USING (feature, stage) GROUP BY 1""")
def _(spark, sf):
    weighted = B.assay(spark, sf).withColumn("w", F.lit(1.0) + F.col("sample") % 4)
    fit = M.fit_oneway(weighted, B.assay_samples(spark, sf), "stage", STAGE, weight="w")
    lfc = F.col("beta")[STAGE.index("Late")] - F.col("beta")[STAGE.index("Baseline")]
    return fit.select("feature", r6("sigma").alias("sigma"), r6(lfc).alias("lfc"))


@query("mat_lm", sql_with("assay", "assay_samples") + batch_sql("assay", "assay_samples") + f" SELECT feature, {q6('b')} AS batch, {q6('sigma')} AS sigma, df, {q6('m')} AS baseline FROM effect JOIN fit USING (feature) JOIN st USING (feature) WHERE stage = 'Baseline'")
def _(spark, sf):
    fit = M.fit_shared(B.assay(spark, sf), B.assay_samples(spark, sf), "stage", STAGE, "batch", BATCHES)
    return fit.select("feature", r6(F.col("beta")[5]).alias("batch"), r6("sigma").alias("sigma"), "df", r6(F.col("beta")[0]).alias("baseline"))


@query("mat_batch", sql_with("assay", "assay_samples") + batch_sql("assay", "assay_samples") + f" SELECT feature, sample, {q6('value - b*(z - 0.5::DOUBLE)')} AS value FROM x JOIN effect USING (feature)")
def _(spark, sf):
    out = M.remove_batch(B.assay(spark, sf), B.assay_samples(spark, sf), "stage", STAGE, "batch", BATCHES)
    return _rounded(out, "value")


@query("mat_contrast", sql_with("assay", "assay_samples") + batch_sql("assay", "assay_samples") + f" SELECT feature, stage AS contrast, {q6('lfc')} AS lfc, {q6('unscaled')} AS unscaled FROM contr")
def _(spark, sf):
    fit = M.fit_shared(B.assay(spark, sf), B.assay_samples(spark, sf), "stage", STAGE, "batch", BATCHES)
    out = M.contrast(fit, [*STAGE, "B"], CONTRASTS).select("feature", "contrast", "lfc", "unscaled")
    return _rounded(out, "lfc", "unscaled")


@query("mat_ebayes", COUNT_FIT + f" SELECT feature, stage AS contrast, {q6('lfc')} AS lfc, {q6('s2')} AS s2_post, {q6('t')} AS t, {q6('p')} AS p FROM eb")
def _(spark, sf):
    tests = _count_tests(spark, sf).select("feature", "contrast", "lfc", "s2_post", "t", "p")
    return _rounded(tests, "lfc", "s2_post", "t", "p")


@query("mat_classify", COUNT_RESULT + ROUNDED)
def _(spark, sf):
    return _rounded(M.results(_count_tests(spark, sf), p_max=0.4, lfc_min=0.1), "lfc", "padj")


@query("mat_voom", COUNT_TABLES + count_model_sql("true", filtered=False) + f" SELECT feature, sample, {q6('value')} AS value, {q6('weight')} AS weight FROM cell")
def _(spark, sf):
    cells = durable(B.counts(spark, sf))
    return _rounded(M.voom(cells, B.samples(spark, sf), K.tmm(cells), "stage", STAGE), "value", "weight")


# ---------------------------------------------------------------- components


_SCORES = f" SELECT s.sample, stage, batch, grp, {q6('pc1')} AS \"PC1\", {q6('pc2')} AS \"PC2\" FROM score s LEFT JOIN assay_samples m ON m.sample = s.sample"
_VARIANCE = f" SELECT component, {q6('variance')} AS variance, {q6('share')} AS share, component || ' (' || CAST(round_even(100*share, 0) AS INT) || '%)' AS label FROM vari"


@query("mat_pca", recursive(sql_with("assay", "assay_samples")) + pca_sql("assay") + _SCORES)
def _(spark, sf):
    parts = P.pca(B.assay(spark, sf))
    return _rounded(parts.scores.join(B.assay_samples(spark, sf), "sample", "left"), "PC1", "PC2")


@query("mat_pca_batch", sql_with("assay", "assay_samples") + batch_sql("assay", "assay_samples") + ", clean AS (SELECT feature, sample, value - b*(z - 0.5::DOUBLE) AS value FROM x JOIN effect USING (feature))" + pca_sql("clean") + _SCORES)
def _(spark, sf):
    meta = B.assay_samples(spark, sf)
    clean = M.remove_batch(B.assay(spark, sf), meta, "stage", STAGE, "batch", BATCHES)
    return _rounded(P.pca(clean).scores.join(meta, "sample", "left"), "PC1", "PC2")


_KEPT_COUNTS = sql_with("counts", "samples").replace("counts AS (", "every AS (") + ", counts AS (SELECT * FROM every WHERE feature IN (SELECT feature FROM every GROUP BY 1 HAVING COUNT(*) FILTER (value > 20) >= 3))" + _DENSE + _LOGCPM


@query("mat_pca_counts", _KEPT_COUNTS + pca_sql("logcpm") + _VARIANCE)
def _(spark, sf):
    kept = durable(K.filter_features(B.counts(spark, sf)))
    factors = K.tmm(kept)
    # cells without a count stay unlisted
    return _rounded(P.pca(K.log_cpm(kept, factors), base=K.log_cpm_base(factors)).variance, "variance", "share")


@query("mat_pca_labels", sql_with("assay") + pca_sql("assay") + _VARIANCE)
def _(spark, sf):
    return _rounded(P.pca(B.assay(spark, sf)).variance, "variance", "share")


@query("mat_loadings", sql_with("assay") + pca_sql("assay") + f" SELECT feature, {q6('pc1')} AS \"PC1\", {q6('pc2')} AS \"PC2\" FROM load")
def _(spark, sf):
    return _rounded(P.pca(B.assay(spark, sf)).loadings, "PC1", "PC2")


@query("mat_pca_total_var", sql_with("assay") + f"SELECT {q6('SUM(v)')} AS total_variance, COUNT(*) AS features FROM (SELECT feature, var_samp(value) AS v FROM assay GROUP BY 1)")
def _(spark, sf):
    return _rounded(P.total_variance(B.assay(spark, sf)), "total_variance")


@query("mat_contrib", sql_with("assay") + pca_sql("assay") + f" SELECT feature, {q6('pc1')} AS \"PC1\", {q6('pc2')} AS \"PC2\", {q6('sqrt(pc1*pc1 + pc2*pc2)')} AS magnitude FROM load ORDER BY sqrt(pc1*pc1 + pc2*pc2) DESC, feature LIMIT 30")
def _(spark, sf):
    return _rounded(P.top_contributors(P.pca(B.assay(spark, sf)).loadings, 30), "PC1", "PC2", "magnitude")


# ---------------------------------------------------------------- fold changes


@query("mat_lfc_baseline", sql_with("obs") + """SELECT o.subject, o.t, o.feature, round(log2(o.value / b.value), 6) + 0::DOUBLE AS lfc FROM obs o LEFT JOIN obs b ON o.subject = b.subject AND o.feature = b.feature AND b.t = 0""")
def _(spark, sf):
    joined = with_baseline(B.obs(spark, sf), ["subject", "feature"], "value", F.col("t") == 0)
    out = M.lfc_from_baseline(joined, r_div(F.col("value"), F.col("baseline")))
    return _rounded(out.select("subject", "t", "feature", "lfc"), "lfc")


_GRID_COLUMNS = ", ".join(
    f"""COALESCE(MAX(CASE WHEN grp = '{g}' AND stage = '{s}' THEN {q6('lfc')} END), 0) AS "{g}, {s.lower()}" """ for s in SHOWN for g in GROUP
)
_GRID_KEYS = {"HD": "_hd", "LD-V": "_ldv", "LD-NV": "_ldnv"}
_GRID_MODELS = "".join(count_model_sql(f"grp = '{g}'", k) for g, k in _GRID_KEYS.items())
_GRID_PARTS = " UNION ALL ".join(f"SELECT '{g}' AS grp, feature, stage, lfc FROM contr{k}" for g, k in _GRID_KEYS.items())


@query("mat_lfc_grid", COUNT_TABLES + _GRID_MODELS + f", grid AS ({_GRID_PARTS}) SELECT feature, {_GRID_COLUMNS} FROM grid GROUP BY 1")
def _(spark, sf):
    grid = D.count_grid(B.counts(spark, sf), B.study_samples(spark, sf, GROUP), "stage", STAGE, CONTRASTS, "study", GROUP, SHOWN)
    return _rounded(grid, *[c for c in grid.columns if c != "feature"])


# ---------------------------------------------------------------- composite tables


@query("omx_timeline", sql_with("obs", "samples") + "SELECT DISTINCT t, stage FROM obs JOIN samples ON subject = sample")
def _(spark, sf):
    joined = B.obs(spark, sf).join(B.samples(spark, sf).withColumnRenamed("sample", "subject"), "subject")
    return joined.select("t", "stage").distinct()


def _one_study(name, group, where):
    @query(name, count_result_sql(where) + ROUNDED)
    def _(spark, sf):
        return _rounded(_study(spark, sf, group).drop("study"), "lfc", "padj")


_one_study("omx_count_de", "viremic", VIREMIC)
_one_study("omx_count_de_aviremic", "LD-NV", AVIREMIC)
_one_study("omx_count_de_hd", "HD", HD)
_one_study("omx_count_de_ldv", "LD-V", LDV)


_STUDIES = {"viremic": VIREMIC, "HD": HD, "LD-V": LDV, "LD-NV": AVIREMIC}


@query("omx_count_de_groups", " UNION ALL ".join(f"SELECT '{study}' AS study, * FROM ({count_result_sql(where)}{ROUNDED})" for study, where in _STUDIES.items()))
def _(spark, sf):
    """Every study group in one plan."""
    return _rounded(_study(spark, sf, *B.STUDY_GROUPS), "lfc", "padj")


_SICK = ", sick AS (SELECT * FROM assay_samples WHERE grp <> 'LD-NV')"
_WELL = ", well AS (SELECT * FROM assay_samples WHERE grp = 'LD-NV')"


@query("omx_conc_de", recursive(sql_with("assay", "assay_samples")) + _SICK + batch_sql("assay", "sick") + EBAYES + RESULT.format(p="0.9", f="0.01") + ROUNDED)
def _(spark, sf):
    some = B.assay_samples(spark, sf).where("grp <> 'LD-NV'")
    fit = M.fit_shared(B.assay(spark, sf), some, "stage", STAGE, "batch", BATCHES)
    tests = M.ebayes(fit, [*STAGE, "B"], CONTRASTS)
    return _rounded(M.results(tests, p_max=0.9, lfc_min=0.01), "lfc", "padj")


@query("omx_conc_de_plain", recursive(sql_with("assay", "assay_samples")) + _WELL + oneway_sql("assay", "well") + EBAYES + RESULT.format(p="0.05", f="1") + ROUNDED)
def _(spark, sf):
    some = B.assay_samples(spark, sf).where("grp = 'LD-NV'")
    return _rounded(M.concentration_de(B.assay(spark, sf), some, "stage", STAGE, CONTRASTS), "lfc", "padj")


_WIDE = ", ".join(f"""MAX(CASE WHEN stage = '{s}' THEN {q6(v)} END) AS "{s}.{v}" """ for s in SHOWN for v in ("lfc", "padj"))


@query("omx_enrich_input", count_result_sql(VIREMIC) + f" SELECT feature, {_WIDE} FROM res GROUP BY 1")
def _(spark, sf):
    return D.enrichment_input(_rounded(_study(spark, sf, "viremic"), "lfc", "padj"), SHOWN)


@query("omx_enrich_input_aviremic", count_result_sql(AVIREMIC) + f" SELECT feature, {_WIDE} FROM res GROUP BY 1")
def _(spark, sf):
    return D.enrichment_input(_rounded(_study(spark, sf, "LD-NV"), "lfc", "padj"), SHOWN)


@query("omx_volcano", count_result_sql(VIREMIC, "0.99", "0.02") + f""", top AS (SELECT feature, stage FROM res WHERE regulation = 'Up' QUALIFY rank() OVER (PARTITION BY stage ORDER BY lfc DESC) <= 8)
    SELECT feature, stage, {q6('lfc')} AS lfc, {q6('-log10(padj)')} AS height, significant, regulation, CASE WHEN top.feature IS NOT NULL THEN feature END AS label FROM res LEFT JOIN top USING (feature, stage)""")
def _(spark, sf):
    results = M.count_de(B.counts(spark, sf), B.study_samples(spark, sf, ["viremic"]), "stage", STAGE, CONTRASTS, by="study", p_max=0.99, lfc_min=0.02)
    return _rounded(D.volcano(results, 8), "lfc", "height")


@query("omx_volcano_both", count_result_sql(AVIREMIC) + f""", top AS (SELECT feature, stage FROM res WHERE significant QUALIFY rank() OVER (PARTITION BY stage, regulation ORDER BY abs(lfc) DESC) <= 5)
    SELECT feature, stage, {q6('lfc')} AS lfc, {q6('-log10(padj)')} AS height, significant, regulation, CASE WHEN top.feature IS NOT NULL THEN feature END AS label FROM res LEFT JOIN top USING (feature, stage)""")
def _(spark, sf):
    return _rounded(D.volcano(_study(spark, sf, "LD-NV"), 5, by_class=True), "lfc", "height")


@query("omx_shortlist", """WITH s AS (SELECT n_name AS pathway, CAST(SUM(s_acctbal > 5000) AS DOUBLE) AS late, CAST(NULLIF(SUM(CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END), 0) AS DOUBLE) AS early FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
    l AS (SELECT n_name AS pathway, replace(n_name, '_', chr(10)) AS nickname, n_nationkey FROM nation WHERE n_regionkey = 2),
    j AS (SELECT nickname, COALESCE(late, 0) AS late, COALESCE(early, 0) AS early FROM s RIGHT JOIN l USING (pathway))
    SELECT score, nickname, value FROM (SELECT 'Max' AS score, nickname, 3.0::DOUBLE AS value FROM j UNION ALL SELECT 'Min', nickname, 0.0 FROM j UNION ALL SELECT 'Early', nickname, early FROM j UNION ALL SELECT 'Late', nickname, late FROM j)""")
def _(spark, sf):
    nation = table(spark, sf, "nation")
    joined = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    scores = joined.groupBy(F.col("n_name").alias("pathway")).agg(
        F.count_if(F.col("s_acctbal") > 5000).cast("double").alias("late"),
        F.nullif(F.count_if(F.col("s_acctbal") < 0), F.lit(0)).cast("double").alias("early"),
    )
    listed = nation.where("n_regionkey = 2").select(
        F.col("n_name").alias("pathway"), F.replace("n_name", F.lit("_"), F.lit("\\n")).alias("nickname")
    )
    return D.pathway_scores(scores, listed)


@query("omx_labels", sql_with("subj", "samples") + "SELECT subject, subject || ', ' || death || ' DPI' AS label FROM subj JOIN samples ON subject = sample WHERE grp = 'LD-V' AND stage NOT IN ('Baseline','Early','Recovered')")
def _(spark, sf):
    joined = B.subj(spark, sf).join(B.samples(spark, sf).withColumnRenamed("sample", "subject"), "subject")
    return D.point_labels(joined, "LD-V", "death")
