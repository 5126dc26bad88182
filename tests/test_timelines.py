from pyspark.sql import functions as F

from tideline.plans import cohort as C
from tideline.plans import differential as D
from tideline.plans import timelines as T


def texts(df, name):
    return {r.subject: r[name] for r in df.collect()}


def test_temperature_rules(spark):
    rows = [
        ("a", 0, 101.0), ("a", 3, 103.6), ("a", 10, 103.55), ("a", 2, 97.5), ("a", 5, 97.6),
        ("b", 0, 102.0), ("b", 4, 103.6), ("b", 5, 103.5), ("c", 1, 110.0),
    ]
    got = texts(T.temperature(spark.createDataFrame(rows, "subject string, t int, value double")), "temperature")
    # 103.6-101=2.6 is a fever; 103.55 is one by the second rule; 97.5 is 3.5 below; no day 0 means no event
    assert got == {"a": "fever (d3, 10); hypothermia (d2)", "b": "fever (d4)"}


def test_appetite_anorexia_replaces_decreased_on_its_day(spark):
    rows = [("a", 1, 10.0), ("a", 2, 6.0), ("a", 3, 6.1), ("a", 4, 0.0), ("b", 1, 0.0)]
    got = texts(T.appetite(spark.createDataFrame(rows, "subject string, t int, value double")), "appetite")
    # subject b never ate: 0/0 is missing, so no event
    assert got == {"a": "decreased appetite (d2); anorexia (d4)"}


def test_observations_keep_column_order(spark):
    df = spark.createDataFrame([("a", 2, None, "x"), ("a", 1, "x", "x"), ("b", 1, None, None)], "subject string, t int, `Nasal discharge` string, Ataxia string")
    assert texts(T.observations(df, ["Nasal discharge", "Ataxia"]), "observation") == {"a": "nasal discharge (d1); ataxia (d1, 2)"}


def test_outcome_and_illness(spark):
    animals = spark.createDataFrame([("a", 12, "Succumbed"), ("b", 35, "Survived"), ("c", 7, "Sacrificed")], "subject string, death int, outcome string")
    told = T.outcome_sentence(animals)
    assert texts(told, "outcome") == {"a": "Succumbed on d12.", "b": "Survived to study endpoint (d35).", "c": "Scheduled euthanasia at d7."}
    obs = spark.createDataFrame([("a", "Rash (d3)")], "subject string, observation string")
    fever = spark.createDataFrame([("a", "fever (d2)"), ("b", "fever (d9)")], "subject string, temperature string")
    got = texts(T.illness(told, [obs, fever], ["observation", "temperature"]), "illness")
    assert got == {
        "a": "Rash (d3); fever (d2). Succumbed on d12.",
        "b": "Fever (d9). Survived to study endpoint (d35).",
        "c": "None. Scheduled euthanasia at d7.",
    }


def test_cell_counts_follow_the_fixed_name_order(spark):
    rows = [("a", 0, "Platelets", 100.0), ("a", 3, "Platelets", 65.0), ("a", 4, "Platelets", 66.0), ("a", 0, "Neutrophils", 0.0), ("a", 5, "Neutrophils", 1.0), ("a", 0, "Other", 1.0), ("a", 1, "Other", 9.0)]
    got = texts(T.cell_counts(spark.createDataFrame(rows, "subject string, t int, feature string, value double"), F.col("t") == 0), "hematology")
    # any rise from a zero baseline counts as at least doubled; an unnamed cell type is not told
    assert got == {"a": "thrombocytopenia (d3); neutrophilia (d5)"}


def test_anemia_needs_all_three(spark):
    rows = [("a", t, f, v) for f in ("Erythrocytes", "Hematocrit", "Hemoglobin") for t, v in ((0, 10.0), (3, 7.0), (5, 6.0))]
    rows = [(s, t, f, 9.0 if (t, f) == (5, "Hematocrit") else v) for s, t, f, v in rows]
    rows += [("a", 0, "Glucose (GLU)", 50.0), ("a", 3, "Glucose (GLU)", 100.0), ("a", 5, "Glucose (GLU)", 37.5)]
    df = spark.createDataFrame(rows, "subject string, t int, feature string, value double")
    got = texts(T.chemistry(T.fold_changes(df, F.col("t") == 0)), "chemistry")
    assert got == {"a": "anemia (d3); hyperglycemia (d3); hypoglycemia (d5)"}


def test_arrows_group_by_step_and_keep_names_without_code(spark):
    rows = [("a", t, "Alanine aminotransferase (ALT)", v) for t, v in ((0, 1.0), (2, 2.0), (3, 20.0), (4, 3.0), (6, 0.5))]
    rows += [("a", t, f, v) for f in ("Hematocrit", "Hemoglobin") for t, v in ((0, 10.0), (9, 5.0))]
    df = spark.createDataFrame(rows, "subject string, t int, feature string, value double")
    got = texts(T.arrows(T.fold_changes(df, F.col("t") == 0), T.ARROW_ANALYTES), "arrows")
    assert got == {"a": "ALT ↑ (d2, 4), ↑↑↑↑ (d3), ↓ (d6); Hematocrit ↓ (d9); Hemoglobin ↓ (d9)"}


def test_pathology_and_final_table(spark):
    hema = spark.createDataFrame([("a", "leukopenia (d1)")], "subject string, hematology string")
    chem = spark.createDataFrame([("b", "anemia (d2)")], "subject string, chemistry string")
    arrow = spark.createDataFrame([("a", "ALT ↑ (d2)"), ("b", "CRP ↑ (d2)")], "subject string, arrows string")
    told = T.pathology([arrow, chem, hema])
    assert texts(told, "pathology") == {"a": "Leukopenia (d1); ALT ↑ (d2)", "b": "Anemia (d2); CRP ↑ (d2)"}
    animals = spark.createDataFrame([("a", "Female", "1", 1.0), ("b", "Male", "10", 10.0), ("c", "?", "1", 1.0)], "subject string, sex string, arm string, dose double")
    ill = spark.createDataFrame([("a", "None. x")], "subject string, illness string")
    got = T.subject_table(animals, ill, told, {"Female": "F", "Male": "M"}).collect()
    assert [(r.subject, r.sex, r.illness) for r in got] == [("b", "M", None), ("a", "F", "None. x"), ("c", None, None)]


def test_pathway_shortlist(spark):
    # fixed values: published scores of the six listed pathways
    scores = [
        ("OAS antiviral response", 2.236, 2.0), ("Stress Granule Signaling Pathway", 2.121, 2.0), ("T Cell Exhaustion Signaling Pathway", 2.53, None),
        ("Necroptosis Signaling Pathway", 2.449, None), ("Pathogen Induced Cytokine Storm Signaling Pathway", 0.775, 0.447), ("NF-KB Signaling", -0.816, 0.0),
    ]
    listed = [(p, p.split()[0] + "\\nname") for p, _, _ in scores[:5]]
    got = D.pathway_scores(spark.createDataFrame(scores, "pathway string, late double, early double"), spark.createDataFrame(listed, "pathway string, nickname string"))
    cells = {(r.nickname, r.score): r.value for r in got.collect()}
    assert len(cells) == 20 and cells["T\nname", "Early"] == 0 and cells["OAS\nname", "Early"] == 2 and cells["Necroptosis\nname", "Late"] == 2.449
    assert cells["OAS\nname", "Max"] == 3 and cells["OAS\nname", "Min"] == 0


def test_volcano_labels_lead_their_stage(spark):
    rows = [("a", "Late", 3.0, 0.001, True, "Up"), ("b", "Late", 2.0, 0.001, True, "Up"), ("c", "Late", -4.0, 0.01, True, "Down"), ("d", "Late", 0.1, 0.0, False, "None")]
    df = spark.createDataFrame(rows, "feature string, stage string, lfc double, padj double, significant boolean, regulation string")
    assert {r.feature for r in D.volcano(df, 1).where("label is not null").collect()} == {"a"}
    assert {r.feature for r in D.volcano(df, 1, by_class=True).where("label is not null").collect()} == {"a", "c"}
    assert D.volcano(df, 1).where("feature = 'd'").first().height == float("inf")


def test_reduction_is_bounded_below_only(spark):
    df = spark.createDataFrame([("c", "b1", 10, 20.0), ("x", "b1", 10, 5.0), ("x", "b1", 10, 15.0), ("y", "b1", 10, 30.0), ("z", "b2", 10, 1.0)], "subject string, batch string, dilution int, plaques double")
    got = {r.subject: r.reduction for r in C.percent_reduction(df, F.col("subject") == "c").collect()}
    assert got == {"x": 50.0, "y": 0.0, "z": None}


def test_panel_labels(spark):
    chem = spark.createDataFrame([(1, 0, 5.0), (1, 8, 6.0), (2, 35, 7.0)], "subject int, t int, ALB double")
    hema = spark.createDataFrame([(1, 0, 5.0, 1.0, 2.0)], "subject int, t int, Platelets double, `Mean volume` double, Hematocrit double")
    who = spark.createDataFrame([(1, "Succumbed", "10", 8), (2, "Survived", "1", 35)], "subject int, outcome string, arm string, death int")
    got = {(r.subject, r.t, r.feature): r for r in C.panel(chem, hema, who, drop=["Mean", "Hem"], special=2, last_day=35).collect()}
    assert {f for _, _, f in got} == {"ALB", "Platelets"}
    assert got[1, 8, "ALB"].moment == "Terminal" and got[1, 0, "ALB"].moment == "0" and got[2, 35, "ALB"].moment == "35"
    assert got[2, 35, "ALB"].grp == "special" and got[1, 0, "Platelets"].kind == "hema"
