"""Composite cohort results over (subject, t, feature, value) and one row per subject."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.levels import ARM, OUTCOME, level_rank, relabel
from tideline.functions.numeric import clamp, elapsed_days, floor_at_limit, r_div, strict
from tideline.functions.text import stars
from tideline.operators.adjust import p_adjust
from tideline.operators.aggregate import box_stats, duration, mean_ci, merge_replicates, percent_outcome, summary_stats
from tideline.operators.columns import select_prefix, set_where
from tideline.operators.joins import with_baseline, with_control
from tideline.operators.nonparametric import kruskal, ranksum
from tideline.operators.rank import first_by, last_by, peak_by
from tideline.operators.reshape import cast_wide, crosstab, melt
from tideline.operators.sets import union_all
from tideline.session import durable


def lethality(subjects: DataFrame) -> DataFrame:
    """Outcome counts and percent succumbed per arm."""
    return percent_outcome(subjects, "arm", "outcome", OUTCOME[1], OUTCOME[0])


def time_to_event(subjects: DataFrame) -> DataFrame:
    """Mean time and t interval per arm among the subjects with the event."""
    return mean_ci(subjects.where(F.col("outcome") == OUTCOME[1]), ["arm"], "death")


def time_to_event_test(subjects: DataFrame, arms: Sequence[str]) -> DataFrame:
    """Rank-sum test of the times of two arms among the subjects with the event."""
    return ranksum(subjects.where(F.col("outcome") == OUTCOME[1]), [], "arm", "death", arms)


def since_start(events: DataFrame, start: Column, clock: str) -> DataFrame:
    """Fractional days since each subject's own start (its earliest row where ``start`` holds)."""
    timed = with_baseline(events, ["subject"], clock, start, agg=F.min, out="_start")
    return timed.withColumn("elapsed", elapsed_days(F.col(clock), F.col("_start"))).drop("_start")


def ever_positive(values: DataFrame, subjects: DataFrame, above: float) -> DataFrame:
    """Subjects with at least one value above a limit; distinct before the join."""
    seen = values.where(F.col("value") > above).select("subject").distinct()
    return seen.join(subjects, "subject").select("subject", "arm", "outcome")


def onset(values: DataFrame, subjects: DataFrame, above: float, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """First positive rows per subject, ties kept, with the subject's arm and outcome."""
    return first_by(values.where(F.col("value") > above), list(keys), "t").join(
        subjects.select("subject", "arm", "outcome"), "subject", "left"
    )


def onset_interval(starts: DataFrame) -> DataFrame:
    """Mean day of onset and its t interval per arm."""
    return mean_ci(starts, ["arm"], "t")


def durations(starts: DataFrame, subjects: DataFrame) -> DataFrame:
    """Inclusive days from each subject's onset to its end, with the arm."""
    timed = duration(subjects, starts.select("subject", "arm", "t").distinct(), "subject", "t", "death")
    return timed.select("subject", "arm", "t", "death", "duration")


def relative_capped(values: DataFrame, first: int = 1, last: int = 4, early: DataFrame | None = None) -> DataFrame:
    """Values after day 0 relative to the subject's mean of an early window, capped at one. ``early``: a table with the
    window's rows, where there is a narrower one."""
    after = values.where(F.col("t") > 0)
    mean = lambda x: strict(F.avg, x)
    based = with_baseline(after, ["subject"], "value", F.col("t").between(first, last), agg=mean, source=early)
    return based.withColumn("relative", clamp(r_div(F.col("value"), F.col("baseline")), hi=1.0))


def first_detection(values: DataFrame, subjects: DataFrame, assays: Sequence[str], above: float = 0) -> DataFrame:
    """First positive day of each assay, one row per subject, ordered by arm and outcome."""
    found = first_by(values.where(F.col("value") > above), ["subject", "feature"], "t").select("subject", "feature", "t")
    wide = cast_wide(found, ["subject"], "feature", "t", assays)
    dim = subjects.select("subject", "arm", "outcome")
    order = [level_rank(F.col("arm"), ARM), level_rank(F.col("outcome"), OUTCOME), F.col("subject")]
    return wide.join(dim, "subject", "left").orderBy(*order)


def onset_value(values: DataFrame, subjects: DataFrame, arms: Sequence[str], above: float) -> DataFrame:
    """Rank-sum test between two arms of the value at onset, per assay."""
    start = onset(values, subjects, above, ("subject", "feature"))
    return ranksum(start.where(F.col("arm").isin(list(arms))), ["feature"], "arm", "value", arms)


def peaks(values: DataFrame, subjects: DataFrame) -> DataFrame:
    """Peak row per subject and assay with arm and outcome."""
    top = peak_by(values.select("subject", "feature", "t", "value"), ["subject", "feature"], "value", ["t"])
    return top.join(subjects.select("subject", "arm", "outcome"), "subject", "left")


def peak_summary(values: DataFrame, subjects: DataFrame) -> DataFrame:
    """Mean, median and range of the peaks per arm and assay."""
    return summary_stats(peaks(values, subjects), ["arm", "feature"], "value")


def peak_by_outcome(values: DataFrame, subjects: DataFrame) -> DataFrame:
    """Peak range per assay and outcome, with the rank-sum p of the assay."""
    top = peaks(values, subjects)
    test = ranksum(top, ["feature"], "outcome", "value", OUTCOME).select("feature", "w", "p")
    spread = top.groupBy("feature", "outcome").agg(F.max("value").alias("max"), F.min("value").alias("min"))
    return spread.join(test.withColumn("mark", stars(F.col("p"))), "feature", "left")


def tissue_comparison(values: DataFrame, subjects: DataFrame, without: Sequence[str]) -> DataFrame:
    """Box summary per tissue and outcome, with an unadjusted test per tissue."""
    kept = values.where(~F.col("feature").isin(list(without))).join(subjects.select("subject", "outcome"), "subject", "left")
    test = ranksum(kept, ["feature"], "outcome", "value", OUTCOME).select("feature", "p")
    return box_stats(kept, ["feature", "outcome"], "value").join(test, "feature", "left")


def panel(
    chem: DataFrame, hema: DataFrame, subjects: DataFrame, *, drop: Sequence[str], special: int, last_day: int
) -> DataFrame:
    """Both wide sheets as one long panel with display group and terminal label."""
    dim = subjects.select("subject", "outcome", "arm", "death")
    ids = ["subject", "t"]
    hema = select_prefix(hema, drop, drop=True)
    long = union_all([
        melt(chem, ids).withColumn("kind", F.lit("chem")),
        melt(hema, ids).withColumn("kind", F.lit("hema")),
    ]).join(dim, "subject", "left")
    long = long.withColumn("grp", F.col("outcome")).withColumn("moment", F.col("t").cast("string"))
    long = set_where(long, "grp", [(F.col("subject") == special, F.lit("special"))])
    ended = (F.col("t") != last_day) & (F.col("t") == F.col("death"))
    return set_where(long, "moment", [(ended, "Terminal")])


def extremes(values: DataFrame, subjects: DataFrame) -> DataFrame:
    """Baseline, least and greatest value per subject and feature, stacked."""
    found = values.groupBy("subject", "feature").agg(
        F.max(F.when(F.col("t") == 0, F.col("value"))).alias("D0"), F.min("value").alias("Min"), F.max("value").alias("Max")
    )
    stacked = found.unpivot(["subject", "feature"], ["D0", "Min", "Max"], "comparison", "value").where(F.col("value").isNotNull())
    return stacked.select("subject", "feature", "value", "comparison").join(subjects.select("subject", "outcome"), "subject", "left")


def extremes_test(values: DataFrame, subjects: DataFrame) -> DataFrame:
    """Outcome test of the baseline, least and greatest values per feature, unadjusted."""
    tested = ranksum(extremes(values, subjects), ["feature", "comparison"], "outcome", "value", OUTCOME)
    return tested.withColumn("mark", stars(F.col("p")))


def endpoint_titer(sheets: DataFrame, subjects: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Latest titers per subject and antigen in long form, with the detection-limit stand-in."""
    last = last_by(sheets, list(keys), "t")
    long = melt(last, [*keys, "t"], measures, "class", "titer").join(subjects.select("subject", "outcome"), "subject", "left")
    return long.withColumn("shown", floor_at_limit(F.col("titer"), 50))


def endpoint_titer_test(titers: DataFrame, antigen: str) -> DataFrame:
    """Outcome test of log10(titer + 1) per class and antigen, Holm over all of them together."""
    logged = titers.withColumn("_log", F.log10(F.col("titer") + 1))
    tested = durable(ranksum(logged, ["class", antigen], "outcome", "_log", OUTCOME))
    tested = p_adjust(tested, [], "p", "holm")
    return tested.withColumn("mark", stars(F.col("padj")))


def titer_series(sheets: DataFrame, subjects: DataFrame, ids: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Titers over time by class, shifted by the plotting pseudocount."""
    long = melt(sheets, ids, measures, "class", "titer").join(subjects.select("subject", "outcome"), "subject", "left")
    return long.withColumn("shown", F.col("titer") + 100)


def assay_series(values: DataFrame, subjects: DataFrame, floor: float) -> DataFrame:
    """One assay over time with its arm, ordered by arm, shifted by the detection floor."""
    joined = values.join(subjects.select("subject", "arm", "outcome"), "subject", "left")
    shown = joined.withColumn("shown", F.col("value") + F.lit(float(floor)))
    return shown.orderBy(level_rank(F.col("arm"), ARM), "subject", "t")


def percent_reduction(wells: DataFrame, is_control: Column, upper: float | None = None) -> DataFrame:
    """Percent fewer plaques than the batch control, not below zero; replicates are averaged first."""
    merged = merge_replicates(wells, ["subject", "batch", "dilution"], "plaques")
    joined = with_control(merged, "batch", "plaques", is_control)
    share = r_div(100 * (F.col("control") - F.col("plaques")), F.col("control"))
    return joined.withColumn("reduction", clamp(share, 0.0, upper))


def dilution_curve(reductions: DataFrame, subjects: DataFrame) -> DataFrame:
    """Reductions over dilutions with the arm's label, highest dilution first."""
    labelled = reductions.join(subjects.select("subject", "arm"), "subject")
    arm = relabel(F.col("arm"), {a: f"{a} PFU" for a in ARM})
    return labelled.withColumn("arm", arm).orderBy(F.desc("dilution"), "subject", "batch")


def best_response(reductions: DataFrame, subjects: DataFrame, dilution: int) -> DataFrame:
    """Each subject's best reduction at one dilution, with its outcome."""
    at = reductions.where(F.col("dilution") == dilution)
    best = peak_by(at.select("subject", "batch", "reduction"), ["subject"], "reduction", ["batch"])
    return best.join(subjects.select("subject", "outcome"), "subject")


def outcome_table(subjects: DataFrame) -> DataFrame:
    """Arms by outcome, as counts."""
    return crosstab(subjects, "arm", "outcome", OUTCOME)


def peak_omnibus(values: DataFrame, subjects: DataFrame) -> DataFrame:
    """Kruskal-Wallis test of the peaks across arms, per assay."""
    return kruskal(peaks(values, subjects), ["feature"], "arm", "value")
