"""Tables behind the differential-expression figures and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.numeric import neg_log10
from tideline.functions.text import str_replace
from tideline.operators.joins import shortlist
from tideline.operators.linear import Contrasts, count_tests, lfc_grid
from tideline.operators.rank import top_n, top_n_abs
from tideline.operators.reshape import cast_composite, melt
from tideline.session import durable


def enrichment_input(results: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Feature rows with one lfc and one padj column per stage."""
    long = melt(results.select("feature", "stage", "lfc", "padj"), ["feature", "stage"], variable="variable")
    names = [f"{s}.{v}" for s in stages for v in ("lfc", "padj")]
    return cast_composite(long, ["feature"], ["stage", "variable"], "value", names)


def count_grid(
    counts: DataFrame, samples: DataFrame, stage: str, levels: Sequence[str], contrasts: Contrasts, group: str, groups: Sequence[str], shown: Sequence[str]
) -> DataFrame:
    """Fold changes of every feature in every group and shown stage, each group's counts modelled on their own."""
    tests = count_tests(counts, samples, stage, levels, contrasts, by=group)
    return lfc_grid(tests.withColumnRenamed("contrast", "stage"), group, groups, shown)


def volcano(results: DataFrame, n: int, *, by_class: bool = False) -> DataFrame:
    """Fold change against -log10 adjusted p, with labels on the leading significant features."""
    results = durable(results)  # one row per test, read for the labels and for the points
    if by_class:
        top = top_n_abs(results.where("significant"), ["stage", "regulation"], "lfc", n)
    else:
        top = top_n(results.where("regulation = 'Up'"), ["stage"], "lfc", n)
    labels = top.select("feature", "stage", F.col("feature").alias("label"))
    return results.join(labels, ["feature", "stage"], "left").select(
        "feature", "stage", "lfc", neg_log10(F.col("padj")).alias("height"), "significant", "regulation", "label"
    )


def pathway_scores(scores: DataFrame, listed: DataFrame, low: float = 0.0, high: float = 3.0) -> DataFrame:
    """(score, nickname, value) of the listed pathways: bounds and both stages, blanks as zero,
    the literal line-break mark of a nickname made a real one."""
    found = shortlist(scores, listed, "pathway", {"late": 0.0, "early": 0.0})
    wide = found.select(
        str_replace(F.col("nickname"), r"\\n", "\n").alias("nickname"),
        F.lit(float(high)).alias("Max"), F.lit(float(low)).alias("Min"),
        F.col("early").alias("Early"), F.col("late").alias("Late"),
    )
    return melt(wide, ["nickname"], variable="score")


def point_labels(scored: DataFrame, group: str, day: str) -> DataFrame:
    """Labels for one group's points past the early stages."""
    late = scored.where((F.col("grp") == group) & ~F.col("stage").isin("Baseline", "Early", "Recovered"))
    text = F.concat(F.col("subject").cast("string"), F.lit(", "), F.col(day).cast("string"), F.lit(" DPI"))
    return late.select("subject", text.alias("label"))
