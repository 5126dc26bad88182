"""Language ID and toxicity: held-out accuracy on the given tables, and the edges."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import langid, toxicity


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_rule(spark):
    rows = spark.range(300).select(F.col("id").alias("doc_id"), langid.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_language_accuracy_on_held_out_rows(docs):
    model = langid.fit(docs)
    assert sorted(model.languages) == ["de", "en", "es", "fr"]
    rows = langid.identify(docs, model, keep=("lang",)).where(langid.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_is_never_an_input_of_a_prediction(spark, docs):
    model = langid.fit(docs)
    changed = docs.selectExpr("doc_id", "text", "'xx' AS lang", "'s' AS source")
    pick = lambda d: sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(d, model).collect())
    assert pick(docs) == pick(changed)
    held = docs.where(langid.held_out(F.col("doc_id")))
    assert not langid.fit(held).languages


def test_language_edges(edge, empty, docs):
    model = langid.fit(docs)
    rows = {(r["doc_id"], r["lang_pred"]): r for r in langid.identify(edge, model).collect()}
    for doc_id in (1, 2, 3):
        assert rows[(doc_id, "und")]["score"] == 0
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(edge, langid.fit(empty)).collect()} == {"und"}
    kept = langid.recognised(edge, langid.fit(empty), 0.2)
    assert kept.columns == edge.columns and not {1, 2, 3} & {r["doc_id"] for r in kept.collect()}


def test_masks_contain_every_language_that_taught_an_n_gram(spark):
    texts = [("aa", "shared words and own alpha"), ("bb", "shared words und eigene beta"), ("cc", "ζητα shared")]
    many = spark.createDataFrame([(i * 3 + k, t, lang) for i in range(40) for k, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.fit(many)
    made, _, _ = langid.grams(["shared"])
    for gram in made:
        assert (model.masks(gram, model.planes[0]) == 7).all()
    assert model.decide(["alpha", "beta", "ζητα", "123", None])[0] == ["aa", "bb", "cc", "und", "und"]


def brute_grams(text, size):
    """The n-grams of a text as strings; a sign that is no letter, and each end, is an edge."""
    low = (text or "").lower()
    sign = lambda i: low[i] if 0 <= i < len(low) and low[i].isalpha() else "\0"
    out = []
    for i, c in enumerate(low):
        if c.isalpha():
            four = sign(i - 1) + c + sign(i + 1) + (sign(i + 2) if sign(i + 1) != "\0" else "\0")
            if size == 2:
                out.append(four[1:3])
            elif size == 3:
                out.append(four[:3])
            elif four[2] != "\0":
                out.append(four)
    return out


def test_learned_languages_and_counts_match_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    rows += [(10**6 + i, t, lang) for i, (t, lang) in enumerate([("Straße über é 12 a1b", "de"), ("the the the", "fr"), ("", "en"), (None, "en"), ("x", None)])]
    docs = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    contains = {}
    for size in langid.SIZES:
        share = {}
        for doc_id, text, lang in map(tuple, rows):
            if lang is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 5:
                share.setdefault(lang, Counter()).update(brute_grams(text, size))
        total = {lang: sum(c.values()) for lang, c in share.items()}
        share = {lang: {g: n / total[lang] for g, n in c.items() if n / total[lang] >= langid.MIN_SHARE} for lang, c in share.items()}
        most = Counter()
        for own in share.values():
            for g, v in own.items():
                most[g] = max(most[g], v)
        for lang, own in share.items():
            contains[lang, size] = {g for g, v in own.items() if v >= langid.RATIO * most[g]}
    texts = [t for _, t, _ in map(tuple, rows[:60])] + ["Straße über", "a", "1 2", None, "zzz the"]
    counts, total, has = model.count(texts)
    for i, text in enumerate(texts):
        every = [(size, g) for size in langid.SIZES for g in brute_grams(text, size)]
        assert total[i] == len(every) and has[i] == any(c.isalpha() for c in text or "")
        exact = [sum(g in contains.get((lang, size), ()) for size, g in every) for lang in model.languages]
        # slots hit by others add a few; the correction takes off what they add on average
        assert np.abs(counts[i] - exact).max() <= 2 + 0.002 * len(every)
    lang, score, _ = model.decide(texts)
    for i, text in enumerate(texts):
        if has[i]:
            best = int(counts[i].argmax())
            assert lang[i] == model.languages[best] and score[i] == pytest.approx(counts[i][best] / total[i])


def test_more_than_sixty_four_languages(spark):
    word = lambda k: "".join(chr(0x4E00 + k * 7 + j) for j in range(6))
    rows = [(i * 70 + k, " ".join([word(k)] * 3), f"l{k:02d}") for i in range(4) for k in range(70)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.planes) == 2
    assert model.decide([word(k) for k in range(70)])[0] == [f"l{k:02d}" for k in range(70)]


def test_recognised_keeps_clean_documents(docs):
    assert langid.recognised(docs, langid.fit(docs), 0.2).count() == docs.where("text IS NOT NULL").count()


def test_toxic_documents_are_caught(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).withColumnRenamed("toxic", "said").join(labels, "doc_id").where(langid.held_out(F.col("doc_id"))).collect()
    found = [r["said"] for r in scored if r["toxic"] == 1]
    assert np.mean(found) > 0.75
    assert np.mean([r["said"] for r in scored if r["toxic"] == 0]) < 0.01
    assert all(0 <= r["severity"] <= 3 and 0 <= r["p_toxic"] <= 1 for r in scored)


def test_ordinal_fit_orders_thresholds_and_grades():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 4, 2000)
    # word k is held with a chance that grows with the grade
    sets = [np.flatnonzero(rng.random(30) < 0.05 + 0.2 * g * (np.arange(30) < 10)) for g in grade]
    flat, bounds = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    model = toxicity.fit_ordinal(flat, bounds, grade)
    assert (np.diff(model.theta) > 0).all()
    z = np.bincount(np.repeat(np.arange(2000), np.diff(bounds)), model.weight[flat], 2000)
    chance = model.grade_chances(z)
    assert np.allclose(chance.sum(1), 1)
    means = [(chance @ np.arange(4))[grade == g].mean() for g in range(4)]
    assert means == sorted(means) and means[3] - means[0] > 1.5


def penalised_likelihood(w, theta, held, grade):
    """Of an ordinal model, from the formula: P(grade <= k) = logistic(theta_k - w x)."""
    total = -toxicity.RIDGE / 2 * (w * w).sum()
    for x, g in zip(held, grade, strict=True):
        below = [0.0, *(1 / (1 + np.exp(-(t - w[x].sum()))) for t in theta), 1.0]
        total += np.log(below[g + 1] - below[g])
    return total


def test_ordinal_fit_is_the_most_likely_one():
    rng = np.random.default_rng(4)
    grade = rng.choice(4, 400, p=[0.55, 0.2, 0.15, 0.1])
    sets = [np.flatnonzero(rng.random(6) < 0.1 + 0.18 * g * (np.arange(6) < 3) + 0.1 * (np.arange(6) == 5)) for g in grade]
    flat, bounds = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    model = toxicity.fit_ordinal(flat, bounds, grade, steps=3000, rate=0.02)
    w, theta = model.weight[:6].astype(float), model.theta
    best = penalised_likelihood(w, theta, sets, grade)
    for _ in range(60):
        step = rng.normal(size=9) * rng.choice([0.3, 0.05, 0.01])
        changed = theta + step[6:]
        if (np.diff(changed) > 0).all():
            assert penalised_likelihood(w + step[:6], changed, sets, grade) <= best + 1e-4


def test_toxicity_edges(spark, edge, empty):
    labels = spark.createDataFrame([(6, 1, 1), (7, 0, 0), (None, 0, 1), (8, 0, None)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for source in (labels, none):
        model = toxicity.fit(edge, source)
        assert toxicity.score(edge, model).count() == edge.count()
        assert toxicity.score(empty, model).count() == 0
    assert not any(r["toxic"] for r in toxicity.score(edge, toxicity.fit(edge, none)).collect())
