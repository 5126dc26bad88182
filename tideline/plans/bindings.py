"""Views of the given tables in the shape of a cohort study, as DataFrames and as plain SQL.

``VIEW_SQL`` is the same definition as text, for checking results with another engine.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.levels import ARM, STAGE

END = 29  # last observed day
BASE_DAYS = 6  # the baseline is the mean over days 0..6


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_STARTS: dict[tuple[str, ...], datetime.date | None] = {}


def study_start(events: DataFrame) -> datetime.date | None:
    """The first day of the study. One small job per set of files; later plans have it as a constant."""
    files = tuple(events.inputFiles())
    if files not in _STARTS:
        _STARTS[files] = events.agg(F.min(F.to_date("ts"))).first()[0]
    return _STARTS[files]


def study_day(events: DataFrame) -> Column:
    """Whole days since the start of the study."""
    return F.datediff(F.to_date("ts"), F.lit(study_start(events)).cast("date"))


def between_days(events: DataFrame, first: int, last: int) -> DataFrame:
    """The events of some study days, as a range of the time stamp that the file reader can use."""
    start = study_start(events)
    if start is None:
        return events
    lo, hi = (F.expr(f"TIMESTAMP_NTZ '{start + datetime.timedelta(days=d)} 00:00:00'") for d in (first, last + 1))
    return events.where((F.col("ts") >= lo) & (F.col("ts") < hi))


def obs(spark: SparkSession, sf: str, days: tuple[int, int] | None = None) -> DataFrame:
    """(subject, t, feature, value): daily mean per subject and feature, of all days or from one to another."""
    events = table(spark, sf, "events")
    kept = between_days(events, *days) if days else events
    return kept.groupBy(F.col("user_id").alias("subject"), study_day(events).alias("t"), F.col("event_type").alias("feature")).agg(
        F.avg("value").alias("value")
    )


FEATURES = ["click", "error", "purchase", "signup", "view"]
# The sheets' columns, to which the events are dealt out.
CELL_TYPES = ["Leukocytes", "Lymphocytes", "Monocytes", "Neutrophils", "Eosinophils", "Basophils", "Erythrocytes", "Platelets"]
ANALYTES = [
    "Glucose (GLU)", "Amylase (AMY)", "Albumin (ALB)", "Total protein (TP)", "Calcium (CA)", "Erythrocytes", "Hematocrit", "Hemoglobin",
    "Alanine aminotransferase (ALT)", "Aspartate transferase (AST)", "Creatinine (CRE)", "C-reactive protein (CRP)",
]


def _sheet(spark: SparkSession, sf: str, names: list[str]) -> DataFrame:
    """(subject, t, feature, value): daily means of all events, each dealt to one of the named columns by type and number."""
    events = table(spark, sf, "events")
    code = F.array_position(F.array(*[F.lit(f) for f in FEATURES]), F.col("event_type")) * 5 + F.col("event_id") % 5
    feature = F.element_at(F.array(*[F.lit(n) for n in names]), (code % len(names) + 1).cast("int"))
    return events.groupBy(F.col("user_id").alias("subject"), study_day(events).alias("t"), feature.alias("feature")).agg(F.avg("value").alias("value"))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cell counts of every type."""
    return _sheet(spark, sf, CELL_TYPES)


def chem(spark: SparkSession, sf: str) -> DataFrame:
    """Concentrations of every analyte that a term or an arrow needs."""
    return _sheet(spark, sf, ANALYTES)


def subj(spark: SparkSession, sf: str) -> DataFrame:
    """One row per subject: arm, time to event, event flag, outcome."""
    hit = (F.col("event_type") == "error") & (F.col("value") > 150)
    arm = F.element_at(F.array(*[F.lit(a) for a in ARM]), (F.col("subject") % 4 + 1).cast("int"))
    events = table(spark, sf, "events")
    return (
        events.groupBy(F.col("user_id").alias("subject"))
        .agg(
            F.coalesce(F.min(F.when(hit, study_day(events))), F.lit(END)).alias("death"),
            F.max(F.when(hit, 1).otherwise(0)).alias("event"),
        )
        .withColumn("arm", arm)
        .withColumn("outcome", F.when(F.col("event") == 1, "Succumbed").otherwise("Survived"))
    )


def counts(spark: SparkSession, sf: str) -> DataFrame:
    """(feature, sample, value): whole-number counts; an absent cell is a true zero."""
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.concat_ws("|", "p_brand", "p_type").alias("feature")
    )
    return (
        table(spark, sf, "lineitem")
        .join(part, "l_partkey")
        .groupBy("feature", F.col("l_suppkey").alias("sample"))
        .agg(F.sum("l_quantity").cast("bigint").alias("value"))
    )


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """(sample, stage, batch, grp)."""
    s = F.col("s_suppkey")
    stage = F.element_at(F.array(*[F.lit(x) for x in STAGE]), (s % 5 + 1).cast("int"))
    return table(spark, sf, "supplier").select(
        s.alias("sample"),
        stage.alias("stage"),
        F.when(s % 2 == 0, "A").otherwise("B").alias("batch"),
        F.when(s % 3 == 0, "HD").when(s % 3 == 1, "LD-V").otherwise("LD-NV").alias("grp"),
    )


#: Groups of samples that the count comparisons run on: all that fell ill together, and each group alone.
STUDY_GROUPS = {"viremic": ("HD", "LD-V"), "HD": ("HD",), "LD-V": ("LD-V",), "LD-NV": ("LD-NV",)}


def study_samples(spark: SparkSession, sf: str, groups: list[str]) -> DataFrame:
    """(study, sample, stage): the samples of the named study groups; one sample may be in several."""
    listed = samples(spark, sf)
    study = F.array_compact(F.array(*[F.when(F.col("grp").isin(*STUDY_GROUPS[g]), F.lit(g)) for g in groups]))
    return listed.select(F.explode(study).alias("study"), "sample", "stage")


def wells(spark: SparkSession, sf: str) -> DataFrame:
    """(subject, batch, dilution, plaques); subjects divisible by 20 act as batch controls."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            F.col("l_suppkey").alias("subject"),
            F.concat("l_returnflag", "l_linestatus").alias("batch"),
            (10 * F.pow(F.lit(2.0), (F.col("l_linenumber") - 1).cast("double"))).cast("int").alias("dilution"),
        )
        .agg(F.avg("l_quantity").alias("plaques"))
    )


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """A wide numeric sheet."""
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")


def assay(spark: SparkSession, sf: str) -> DataFrame:
    """(feature, sample, value): log-scale matrix, dense; features are vector positions."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample"), F.posexplode("embedding").alias("feature", "value")
    ).withColumn("value", F.col("value").cast("double"))


def assay_samples(spark: SparkSession, sf: str) -> DataFrame:
    """(sample, stage, batch, grp) of the log-scale matrix; stage from the label, batch unbalanced."""
    stage = F.element_at(F.array(*[F.lit(x) for x in STAGE]), (F.col("label") % 5 + 1).cast("int"))
    s = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        s.alias("sample"),
        stage.alias("stage"),
        F.when(s % 3 == 0, "A").otherwise("B").alias("batch"),
        F.when(s % 3 == 0, "HD").when(s % 3 == 1, "LD-V").otherwise("LD-NV").alias("grp"),
    )


_STAGE_SQL = "CASE {x} % 5 WHEN 0 THEN 'Baseline' WHEN 1 THEN 'Early' WHEN 2 THEN 'Middle' WHEN 3 THEN 'Late' ELSE 'Recovered' END"
_GRP_SQL = "CASE {x} % 3 WHEN 0 THEN 'HD' WHEN 1 THEN 'LD-V' ELSE 'LD-NV' END"

DAY_SQL = "CAST(date_diff('day', CAST((SELECT min(ts) FROM events) AS DATE), CAST(ts AS DATE)) AS INT)"


def _sheet_sql(names: list[str]) -> str:
    return f"SELECT user_id AS subject, {DAY_SQL} AS t, {names}[(list_position({FEATURES}, event_type)*5 + event_id % 5) % {len(names)} + 1] AS feature, AVG(value) AS value FROM events GROUP BY 1, 2, 3"


VIEW_SQL = {
    "obs": f"SELECT user_id AS subject, {DAY_SQL} AS t, event_type AS feature, AVG(value) AS value FROM events GROUP BY 1, 2, 3",
    "cells": _sheet_sql(CELL_TYPES),
    "chem": _sheet_sql(ANALYTES),
    "subj": f"""SELECT user_id AS subject,
        CASE user_id % 4 WHEN 0 THEN '27.5' WHEN 1 THEN '10' WHEN 2 THEN '1' ELSE '0.1' END AS arm,
        CAST(COALESCE(MIN(CASE WHEN event_type='error' AND value > 150 THEN {DAY_SQL} END), 29) AS INT) AS death,
        MAX(CASE WHEN event_type='error' AND value > 150 THEN 1 ELSE 0 END) AS event,
        CASE WHEN MAX(CASE WHEN event_type='error' AND value > 150 THEN 1 ELSE 0 END) = 1 THEN 'Succumbed' ELSE 'Survived' END AS outcome
        FROM events GROUP BY 1""",
    "counts": "SELECT concat(p_brand,'|',p_type) AS feature, l_suppkey AS sample, CAST(SUM(l_quantity) AS BIGINT) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "samples": f"""SELECT s_suppkey AS sample, {_STAGE_SQL.format(x='s_suppkey')} AS stage,
        CASE s_suppkey % 2 WHEN 0 THEN 'A' ELSE 'B' END AS batch, {_GRP_SQL.format(x='s_suppkey')} AS grp FROM supplier""",
    "wells": "SELECT l_suppkey AS subject, concat(l_returnflag,l_linestatus) AS batch, CAST(10 * power(2, l_linenumber - 1) AS INT) AS dilution, AVG(l_quantity) AS plaques FROM lineitem GROUP BY 1, 2, 3",
    "wide": "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem",
    "assay": "SELECT vec_id AS sample, CAST(i - 1 AS INT) AS feature, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, 65) r(i)",
    "assay_samples": f"""SELECT vec_id AS sample, {_STAGE_SQL.format(x='label')} AS stage,
        CASE vec_id % 3 WHEN 0 THEN 'A' ELSE 'B' END AS batch, {_GRP_SQL.format(x='vec_id')} AS grp FROM embeddings""",
}


def sql_with(*views: str) -> str:
    """A WITH clause that defines the named views over the given tables."""
    return "WITH " + ",\n".join(f"{v} AS ({VIEW_SQL[v]})" for v in views) + "\n"
