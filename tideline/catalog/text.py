"""Per-subject text timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog.registry import query
from tideline.operators.reshape import cast_wide
from tideline.plans import bindings as B
from tideline.plans import timelines as T
from tideline.plans.bindings import VIEW_SQL
from tideline.session import durable

SIGNS = ["view", "click", "error", "purchase", "signup"]


def _temperature(obs, first_day=None):
    first_day = None if first_day is None else first_day.where("feature = 'view'")
    return T.temperature(obs.where("feature = 'view'").select("subject", "t", "value"), first_day)


def _appetite(obs):
    return T.appetite(obs.where("feature = 'click'").select("subject", "t", F.floor(F.col("value") / 10).alias("value")))


def _observations(obs):
    return T.observations(cast_wide(obs.where("value > 150"), ["subject", "t"], "feature", "value", SIGNS), SIGNS)


def _animals(spark, sf):
    ended = F.when(F.col("subject") % 25 == 0, "Sacrificed").otherwise(F.col("outcome"))
    return B.subj(spark, sf).withColumn("outcome", ended)


def _illness(obs, animals):
    topics = [_observations(obs), _appetite(obs), _temperature(obs)]
    return T.illness(T.outcome_sentence(animals), topics, ["observation", "appetite", "temperature"])


def _early():
    return F.col("t") <= B.BASE_DAYS


def _cells(cells):
    return T.cell_counts(cells, _early())


def _chemistry(chem):
    return T.chemistry(T.fold_changes(chem, _early()))


def _arrows(chem):
    return T.arrows(T.fold_changes(chem, _early()), T.ARROW_ANALYTES)


def _pathology(spark, sf):
    chem = durable(B.chem(spark, sf))  # read by two topics
    return T.pathology([_cells(B.cells(spark, sf)), _chemistry(chem), _arrows(chem)])


# ---------------------------------------------------------------- the same, as SQL


def _text_sql(events: str, out: str) -> str:
    return f"""SELECT subject, string_agg(label || ' (d' || days || ')', '; ' ORDER BY ordinal) AS {out} FROM
    (SELECT subject, label, ordinal, string_agg(CAST(t AS VARCHAR), ', ' ORDER BY t) AS days FROM ({events}) GROUP BY 1, 2, 3) GROUP BY 1"""


TEMPERATURE = _text_sql("""WITH x AS (SELECT o.subject, o.t, o.value, o.value - b.value AS d
        FROM obs o LEFT JOIN obs b ON o.subject = b.subject AND b.feature = 'view' AND b.t = 0 WHERE o.feature = 'view')
    SELECT subject, t, 'fever' AS label, 1 AS ordinal FROM x WHERE d > 2.5 OR (d > 1.5 AND value > 103.5)
    UNION ALL SELECT subject, t, 'hypothermia', 2 FROM x WHERE d <= -3.5""", "temperature")
APPETITE = _text_sql("""SELECT subject, t, CASE WHEN share = 0 THEN 'anorexia' ELSE 'decreased appetite' END AS label, CASE WHEN share = 0 THEN 2 ELSE 1 END AS ordinal
    FROM (SELECT subject, t, eaten / MAX(eaten) OVER (PARTITION BY subject) AS share FROM (SELECT subject, t, floor(value / 10) AS eaten FROM obs WHERE feature = 'click'))
    WHERE share <= 0.6""", "appetite")
OBSERVATIONS = _text_sql(f"""SELECT subject, t, feature AS label, list_position({SIGNS}, feature) AS ordinal FROM obs WHERE value > 150""", "observation")
OUTCOME = """SELECT subject, CASE WHEN subject % 25 = 0 THEN 'Scheduled euthanasia at d' || death WHEN outcome = 'Succumbed' THEN 'Succumbed on d' || death
    ELSE 'Survived to study endpoint (d' || death || ')' END || '.' AS outcome FROM subj"""
ILLNESS = f"""SELECT subject, COALESCE(upper(left(c, 1)) || lower(substr(c, 2)), 'None') || '. ' || outcome AS illness FROM
    (SELECT subject, outcome, nullif(concat_ws('; ', observation, appetite, temperature), '') AS c FROM ({OUTCOME})
     FULL JOIN ({OBSERVATIONS}) USING (subject) FULL JOIN ({APPETITE}) USING (subject) FULL JOIN ({TEMPERATURE}) USING (subject))"""


def _change_sql(sheet):
    return f"""SELECT o.subject, o.t, o.feature, o.value / b.base AS change FROM {sheet} o
        JOIN (SELECT subject, feature, AVG(value) AS base FROM {sheet} WHERE t <= 6 GROUP BY 1, 2) b ON o.subject = b.subject AND o.feature = b.feature"""


_CELL_KEYS = list(T.CELL_TEXT)
CELL_SQL = _text_sql(f"""SELECT subject, t, CASE k {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in T.CELL_TEXT.items())} END AS label,
    list_position({_CELL_KEYS}, k) AS ordinal FROM (SELECT subject, t, feature || CASE WHEN change <= 0.65 THEN 'Penia' ELSE 'Tosis' END AS k
    FROM ({_change_sql('cells')}) WHERE change <= 0.65 OR change >= 2)""", "hematology")
CHEMISTRY_SQL = _text_sql(f"""WITH c AS ({_change_sql('chem')})
    SELECT subject, t, 'hyperglycemia' AS label, 2 AS ordinal FROM c WHERE feature LIKE 'Gluc%' AND change >= 2
    UNION ALL SELECT subject, t, 'hyperamylasemia', 3 FROM c WHERE feature LIKE 'Amyl%' AND change >= 2
    UNION ALL SELECT subject, t, 'hypoglycemia', 4 FROM c WHERE feature LIKE 'Gluc%' AND change <= 0.75
    UNION ALL SELECT subject, t, 'hypoalbuminemia', 5 FROM c WHERE feature LIKE 'Albu%' AND change <= 0.75
    UNION ALL SELECT subject, t, 'hypoproteinemia', 6 FROM c WHERE feature LIKE 'Total%' AND change <= 0.75
    UNION ALL SELECT subject, t, 'hypoamylasemia', 7 FROM c WHERE feature LIKE 'Amyl%' AND change <= 0.75
    UNION ALL SELECT subject, t, 'hypocalcemia', 8 FROM c WHERE feature LIKE 'Calc%' AND change <= 0.75
    UNION ALL SELECT subject, t, 'anemia', 1 FROM c WHERE feature IN ('Erythrocytes','Hematocrit','Hemoglobin') GROUP BY 1, 2 HAVING COUNT(*) = 3 AND MAX(change) <= 0.7""", "chemistry")
ARROWS_SQL = f"""SELECT subject, string_agg(analyte || ' ' || text, '; ' ORDER BY analyte) AS arrows FROM (SELECT subject, analyte, string_agg(arrow || ' (d' || days || ')', ', ' ORDER BY arrow) AS text FROM
    (SELECT subject, analyte, arrow, string_agg(CAST(t AS VARCHAR), ', ' ORDER BY t) AS days FROM (SELECT subject, t,
        CASE WHEN feature LIKE '%(%' THEN regexp_extract(feature, '\\(([A-Z]+)\\)', 1) ELSE feature END AS analyte,
        CASE WHEN change >= 20 THEN '↑↑↑↑' WHEN change >= 10 THEN '↑↑↑' WHEN change >= 5 THEN '↑↑' WHEN change >= 2 THEN '↑' WHEN change <= 0.5 THEN '↓' END AS arrow
        FROM ({_change_sql('chem')}) WHERE feature IN ({", ".join(f"'{a}'" for a in T.ARROW_ANALYTES)})) WHERE arrow IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1"""
PATHOLOGY = f"""SELECT subject, upper(left(c, 1)) || substr(c, 2) AS pathology FROM (SELECT subject, concat_ws('; ', hematology, chemistry, arrows) AS c
    FROM ({CELL_SQL}) FULL JOIN ({CHEMISTRY_SQL}) USING (subject) FULL JOIN ({ARROWS_SQL}) USING (subject))"""


def _over_views(body: str) -> str:
    return f"WITH obs AS ({VIEW_SQL['obs']}), subj AS ({VIEW_SQL['subj']}), cells AS ({VIEW_SQL['cells']}), chem AS ({VIEW_SQL['chem']})\n{body}"


query("txt_temperature", _over_views(TEMPERATURE))(lambda spark, sf: _temperature(B.obs(spark, sf), B.obs(spark, sf, days=(0, 0))))
query("txt_appetite", _over_views(APPETITE))(lambda spark, sf: _appetite(B.obs(spark, sf)))
query("txt_observations", _over_views(OBSERVATIONS))(lambda spark, sf: _observations(B.obs(spark, sf)))
query("txt_cellcounts", _over_views(CELL_SQL))(lambda spark, sf: _cells(B.cells(spark, sf)))
query("txt_chemistry", _over_views(CHEMISTRY_SQL))(lambda spark, sf: _chemistry(B.chem(spark, sf)))
query("txt_arrows", _over_views(ARROWS_SQL))(lambda spark, sf: _arrows(B.chem(spark, sf)))
query("txt_pathology", _over_views(PATHOLOGY))(_pathology)


@query("txt_outcome", _over_views(OUTCOME))
def _(spark, sf):
    return T.outcome_sentence(_animals(spark, sf))


@query("txt_illness", _over_views(ILLNESS))
def _(spark, sf):
    return _illness(durable(B.obs(spark, sf)), durable(_animals(spark, sf)))


@query("txt_subject_table", _over_views(f"""SELECT subject, CASE subject % 2 WHEN 0 THEN 'F' ELSE 'M' END AS sex, arm, CAST(arm AS DOUBLE) AS dose, illness, pathology
    FROM subj LEFT JOIN ({ILLNESS}) USING (subject) LEFT JOIN ({PATHOLOGY}) USING (subject) ORDER BY dose DESC, subject"""))
def _(spark, sf):
    sex = F.when(F.col("subject") % 2 == 0, "Female").otherwise("Male")
    obs, animals = durable(B.obs(spark, sf)), durable(_animals(spark, sf))
    shown = animals.withColumn("sex", sex).withColumn("dose", F.col("arm").cast("double"))
    return T.subject_table(shown, _illness(obs, animals), _pathology(spark, sf), {"Female": "F", "Male": "M"})
