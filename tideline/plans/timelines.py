"""Per-subject text timelines: threshold rules become dated labels, labels become sentences.

Thresholds reduce the rows before anything is grouped, so a subject's group holds only its events.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.levels import level_rank, relabel
from tideline.functions.numeric import r_div
from tideline.functions.text import cap_first, sentence_case, step_label, str_extract
from tideline.operators.aggregate import collapse
from tideline.operators.columns import col, fill_missing, set_where
from tideline.operators.joins import full_join_all, with_baseline, with_group_max
from tideline.operators.rank import dominant_class
from tideline.operators.reshape import cast_wide, melt

# Outcome phrases.
OUTCOME_TEXT = {
    "Succumbed": "Succumbed on d",
    "Survived": "Survived to study endpoint (d",
    "Sacrificed": "Scheduled euthanasia at d",
}
# Names of low and high cell counts, in text order.
CELL_TEXT = {
    "LeukocytesPenia": "leukopenia",
    "LymphocytesPenia": "lymphopenia",
    "MonocytesPenia": "monocytopenia",
    "NeutrophilsPenia": "neutropenia",
    "EosinophilsPenia": "eosinopenia",
    "BasophilsPenia": "basopenia",
    "ErythrocytesPenia": "erythrocytopenia",
    "PlateletsPenia": "thrombocytopenia",
    "LeukocytesTosis": "leukocytosis",
    "LymphocytesTosis": "lymphocytosis",
    "MonocytesTosis": "monocytosis",
    "ErythrocytesTosis": "erythrocytosis",
    "PlateletsTosis": "thrombocytosis",
    "NeutrophilsTosis": "neutrophilia",
    "EosinophilsTosis": "eosinophilia",
    "BasophilsTosis": "basophilia",
}
# Chemistry terms in text order: analyte, comparison, bound relative to baseline.
CHEMISTRY_TERMS = {
    "Hyperglycemia": ("Glucose (GLU)", ">=", 2.0),
    "Hyperamylasemia": ("Amylase (AMY)", ">=", 2.0),
    "Hypoglycemia": ("Glucose (GLU)", "<=", 0.75),
    "Hypoalbuminemia": ("Albumin (ALB)", "<=", 0.75),
    "Hypoproteinemia": ("Total protein (TP)", "<=", 0.75),
    "Hypoamylasemia": ("Amylase (AMY)", "<=", 0.75),
    "Hypocalcemia": ("Calcium (CA)", "<=", 0.75),
}
ANEMIA = (["Erythrocytes", "Hematocrit", "Hemoglobin"], 0.7)
# Analytes shown with arrows.
ARROW_ANALYTES = [
    "Alanine aminotransferase (ALT)",
    "Aspartate transferase (AST)",
    "Albumin (ALB)",
    "Creatinine (CRE)",
    "C-reactive protein (CRP)",
    "Hematocrit",
    "Hemoglobin",
]


def dated(label: Column, days: Column) -> Column:
    return F.concat(label, F.lit(" (d"), days, F.lit(")"))


def label_text(events: DataFrame, out: str, label: Column | None = None) -> DataFrame:
    """(subject, t, label, ordinal) -> one text per subject: ``label (d1, 2); other (d3)``."""
    label = F.col("label") if label is None else label
    days = collapse(events, ["subject", "label", "ordinal"], "t", ["t"])
    labelled = days.select("subject", "ordinal", dated(label, F.col("t")).alias(out))
    return collapse(labelled, ["subject"], out, ["ordinal"], "; ")


def flags_to_events(flags: DataFrame, names: Sequence[str]) -> DataFrame:
    """Wide booleans to one row per flag that is true."""
    long = melt(flags.select("subject", "t", *[col(n) for n in names]), ["subject", "t"], names, "label", "_on", ordinal="ordinal")
    return long.where("_on").drop("_on")


def temperature(df: DataFrame, first_day: DataFrame | None = None) -> DataFrame:
    """Fever and hypothermia relative to each subject's own day 0, from (subject, t, value). ``first_day``: a table with
    the rows of day 0, where there is a narrower one."""
    delta = F.col("value") - F.col("baseline")
    flags = with_baseline(df, ["subject"], "value", F.col("t") == 0, source=first_day).select(
        "subject", "t",
        ((delta > 2.5) | ((delta > 1.5) & (F.col("value") > 103.5))).alias("fever"),
        (delta <= -3.5).alias("hypothermia"),
    )
    return label_text(flags_to_events(flags, ["fever", "hypothermia"]), "temperature")


def appetite(df: DataFrame) -> DataFrame:
    """Decreased appetite and anorexia as shares of each subject's own maximum."""
    names = ["decreased appetite", "anorexia"]
    share = r_div(F.col("value"), F.col("_top"))
    flags = with_group_max(df, ["subject"], "value", "_top").select(
        "subject", "t", (share <= 0.6).alias(names[0]), (share == 0).alias(names[1])
    )
    worst = dominant_class(flags_to_events(flags, names), ["subject", "t"], "label", names)
    return label_text(worst, "appetite")


def observations(df: DataFrame, signs: Sequence[str]) -> DataFrame:
    """Days of each recorded sign, from one nullable column per sign."""
    seen = melt(df.select("subject", "t", *[col(s).isNotNull().alias(s) for s in signs]), ["subject", "t"], signs, "label", "_on", ordinal="ordinal")
    return label_text(seen.where("_on").drop("_on"), "observation", F.lower("label"))


def outcome_sentence(animals: DataFrame) -> DataFrame:
    """How each subject left the study, from (subject, death, outcome)."""
    text = F.concat(relabel(F.col("outcome"), OUTCOME_TEXT), F.col("death").cast("string"))
    told = animals.select("subject", text.alias("outcome"))
    told = set_where(told, "outcome", [(F.col("outcome").contains("Survived"), F.concat("outcome", F.lit(")")))])
    return told.withColumn("outcome", F.concat("outcome", F.lit(".")))


def join_topics(topics: Sequence[DataFrame], names: Sequence[str], ids: Sequence[str], out: str) -> DataFrame:
    """Full-join topic texts (one row per subject) and put together what is there, in the order of ``names``.

    A subject's topics then stand in one row, so nothing is gathered; a subject without any reads null.
    """
    wide = full_join_all(topics, "subject")
    return wide.select(*ids, F.nullif(F.concat_ws("; ", *[col(n) for n in names]), F.lit("")).alias(out))


def illness(outcomes: DataFrame, topics: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    """The clinical illness column; a subject without any topic reads ``None``."""
    told = join_topics([outcomes, *topics], names, ["subject", "outcome"], "clinical")
    full = fill_missing(told.withColumn("clinical", sentence_case(F.col("clinical"))), {"clinical": "None"})
    return full.select("subject", F.concat("clinical", F.lit(". "), "outcome").alias("illness"))


def cell_counts(df: DataFrame, base_at: Column) -> DataFrame:
    """Named rises and falls of cell counts, from (subject, t, feature, value)."""
    ratio = with_baseline(df, ["subject", "feature"], "value", base_at, agg=F.avg)
    ratio = ratio.withColumn("_ratio", r_div(F.col("value"), F.col("baseline")))
    kind = F.when(F.col("_ratio") <= 0.65, "Penia").when(F.col("_ratio") >= 2, "Tosis")
    changed = ratio.withColumn("_change", F.concat("feature", kind)).where(F.col("_change").isNotNull())
    events = changed.select(
        "subject", "t",
        relabel(F.col("_change"), CELL_TEXT).alias("label"),
        level_rank(F.col("_change"), list(CELL_TEXT)).alias("ordinal"),
    )
    return label_text(events.where(F.col("label").isNotNull()), "hematology")


def fold_changes(df: DataFrame, base_at: Column) -> DataFrame:
    """(subject, t, feature, change): value over the subject's baseline of that feature."""
    joined = with_baseline(df, ["subject", "feature"], "value", base_at, agg=F.avg)
    return joined.select("subject", "t", "feature", r_div(F.col("value"), F.col("baseline")).alias("change"))


def chemistry(changes: DataFrame) -> DataFrame:
    """Named chemistry changes; anemia needs all of its three features low on the same day."""
    trio, low = ANEMIA
    used = sorted({a for a, _, _ in CHEMISTRY_TERMS.values()} | set(trio))
    wide = cast_wide(changes.where(F.col("feature").isin(used)), ["subject", "t"], "feature", "change", used)
    flags = {"Anemia": col(trio[0]) <= low}
    for name in trio[1:]:
        flags["Anemia"] = flags["Anemia"] & (col(name) <= low)
    for term, (analyte, side, bound) in CHEMISTRY_TERMS.items():
        flags[term] = col(analyte) >= bound if side == ">=" else col(analyte) <= bound
    wide = wide.select("subject", "t", *[c.alias(n) for n, c in flags.items()])
    return label_text(flags_to_events(wide, list(flags)), "chemistry", F.lower("label"))


def arrows(changes: DataFrame, analytes: Sequence[str]) -> DataFrame:
    """Fold-change arrows per analyte code; an analyte without a code keeps its name."""
    shown = changes.where(F.col("feature").isin(list(analytes))).select(
        "subject", "t",
        F.coalesce(str_extract(F.col("feature"), r"\(([A-Z]+)\)"), F.col("feature")).alias("analyte"),
        step_label(F.col("change")).alias("arrow"),
    )
    days = collapse(shown.where(F.col("arrow").isNotNull()), ["subject", "analyte", "arrow"], "t", ["t"])
    days = days.withColumn("text", dated(F.col("arrow"), F.col("t")))
    per = collapse(days, ["subject", "analyte"], "text", ["arrow"], ", ")
    per = per.withColumn("text", F.concat_ws(" ", "analyte", "text"))
    return collapse(per, ["subject"], "text", ["analyte"], "; ", "arrows")


def pathology(topics: Sequence[DataFrame], names: Sequence[str] = ("hematology", "chemistry", "arrows")) -> DataFrame:
    """The clinical pathology column in fixed topic order."""
    told = join_topics(topics, list(names), ["subject"], "pathology").where(F.col("pathology").isNotNull())
    return told.withColumn("pathology", cap_first(F.col("pathology")))


def subject_table(animals: DataFrame, illness_text: DataFrame, pathology_text: DataFrame, sex: Mapping[str, str]) -> DataFrame:
    """The final table: subject attributes, both text columns, highest dose first."""
    base = animals.withColumn("sex", relabel(F.col("sex"), sex)).select("subject", "sex", "arm", "dose")
    joined = base.join(illness_text, "subject", "left").join(pathology_text, "subject", "left")
    return joined.orderBy(F.desc("dose"), "subject")
