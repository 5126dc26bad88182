"""Toxicity as an ordinal severity: a cumulative-link logistic model over sparse word features.

P(severity <= k) = logistic(theta_k - w x) with thresholds theta_0 < theta_1 < ...: one weight vector w is shared by all
thresholds. x holds 1 for each hashed word, and each hashed beginning of a longer word, that occurs in the text. The labels only tell toxic from clean, so the
severities of the toxic fitting rows come from how many typical words (far more frequent in toxic than in clean rows)
they hold: severity 1 up to the lower, 2 up to the upper third of these numbers, else 3; clean rows are 0.

The fit reads at most about ``FIT_ROWS`` labelled rows, which a hash of doc_id picks. Scoring is one pass, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Words, lowered, lists, map_slices, mix, u64
from tideline.llm.langid import held_out
from tideline.llm.licenses import _IS_WORD

FIT_ROWS = 16_000
FEATURE_BITS = 18
PREFIXES = (5, 7, 9)  # bytes of a longer word
MIN_ROWS = 20  # of the fitting rows that hold a word, for it to be a feature
GRADES = 4
RIDGE = 2.0
TOXIC_AT = 0.25
SCORED = "doc_id bigint, severity double, p_toxic double, grade int, toxic boolean"


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word features of each text, flat, and where each text's begin."""
    words = Words(lowered(data), offsets, _IS_WORD)
    text_of = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(words.first))
    made = [(text_of << u64(FEATURE_BITS)) | (words.hash & u64((1 << FEATURE_BITS) - 1))]
    for size in PREFIXES:
        long = np.flatnonzero(words.end - words.start > size)
        start = words.start[long]
        made.append((text_of[long] << u64(FEATURE_BITS)) | (mix(words.span_hash(start, start + size) + u64(size)) & u64((1 << FEATURE_BITS) - 1)))
    key = np.unique(np.concatenate(made))
    return (key & u64((1 << FEATURE_BITS) - 1)).astype(np.int32), np.searchsorted(key, np.arange(len(offsets)).astype(np.uint64) << u64(FEATURE_BITS))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    weight: np.ndarray
    theta: np.ndarray

    def grade_chances(self, z: np.ndarray) -> np.ndarray:
        """P(severity = k) for each text and grade."""
        below = _logistic(self.theta[None, :] - z[:, None])
        edges = np.concatenate([np.zeros((len(z), 1)), below, np.ones((len(z), 1))], 1)
        return np.clip(np.diff(edges, axis=1), 0, 1)


def severities(flat: np.ndarray, bounds: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Severity of each fitting row from its number of typical words."""
    row = np.repeat(np.arange(len(toxic)), np.diff(bounds))
    size = 1 << FEATURE_BITS
    bad = np.bincount(flat, toxic[row], size)
    good = np.bincount(flat, 1 - toxic[row], size)
    odds = (bad + 0.5) / (toxic.sum() + 1) / ((good + 0.5) / ((1 - toxic).sum() + 1))
    typical = (bad >= 5) & (odds > 20)
    held = np.bincount(row, typical[flat], len(toxic))
    some = np.sort(held[(toxic == 1) & (held > 0)])
    lower, upper = (some[len(some) // 3], some[2 * len(some) // 3]) if len(some) else (1, 1)
    return np.where(toxic == 0, 0, 1 + (held > lower) + (held > max(upper, lower + 1))).astype(int)


def fit_ordinal(flat: np.ndarray, bounds: np.ndarray, grade: np.ndarray, steps: int = 250, rate: float = 0.05) -> Model:
    """Weights and thresholds by full-batch gradient steps (Adam) on the penalised log-likelihood."""
    size = 1 << FEATURE_BITS
    rows = len(grade)
    df = np.bincount(flat, minlength=size)
    number = np.full(size, -1)
    used = np.flatnonzero((df >= MIN_ROWS) & (df < 0.5 * rows))
    number[used] = np.arange(len(used))
    row = np.repeat(np.arange(rows), np.diff(bounds))
    col = number[flat]
    row, col = row[col >= 0], col[col >= 0]
    top = GRADES - 1
    counts = np.array([(grade <= k).mean() for k in range(top)])
    cut = np.log(np.clip(counts, 1e-3, 1 - 1e-3)) - np.log1p(-np.clip(counts, 1e-3, 1 - 1e-3))
    cut = np.maximum.accumulate(cut + 1e-3 * np.arange(top))
    # thresholds as a first value and positive steps, so that they stay in order
    free = np.concatenate([[cut[0]], np.log(np.maximum(np.diff(cut), 1e-3))])
    w = np.zeros(len(used))
    moment = [np.zeros(len(w) + top), np.zeros(len(w) + top)]
    for step in range(1, steps + 1):
        theta = free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))])
        z = np.bincount(row, w[col], rows)
        upper = np.where(grade < top, _logistic(theta[np.minimum(grade, top - 1)] - z), 1.0)
        lower = np.where(grade > 0, _logistic(theta[np.maximum(grade - 1, 0)] - z), 0.0)
        chance = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        gz = -(du - dl)  # of the log-likelihood by z
        gt = np.array([du[grade == k].sum() - dl[grade == k + 1].sum() for k in range(top)])
        gw = np.bincount(col, gz[row], len(w)) - RIDGE * w
        gf = np.concatenate([[gt.sum()], np.exp(free[1:]) * np.cumsum(gt[::-1])[::-1][1:]])
        g = np.concatenate([gw, gf]) / rows
        moment[0] = 0.9 * moment[0] + 0.1 * g
        moment[1] = 0.999 * moment[1] + 0.001 * g * g
        change = rate * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.999**step)) + 1e-8)
        w, free = w + change[: len(w)], free + change[len(w) :]
    weight = np.zeros(size, np.float32)
    weight[used] = w
    return Model(weight, free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))]))


def labelled_features(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, toxic, features) of a bounded sample of the labelled rows that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n = known.count()
    share = min(1.0, fit_rows / max(n, 1))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # about fit_rows rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def make():
        def work(batch, data, offsets):
            flat, bounds = _features(data, offsets)
            return {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "features": lists(flat, bounds)}

        return work

    return map_slices(rows.select("doc_id", "toxic", "text"), "text", "doc_id bigint, toxic int, features array<int>", make)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on the labelled sample. Without labels every text gets severity near 0."""
    rows = labelled_features(docs, labels, fit_rows).toArrow().combine_chunks().sort_by("doc_id")
    if not rows.num_rows:
        return Model(np.zeros(1 << FEATURE_BITS, np.float32), 5.0 + np.arange(GRADES - 1))
    column = rows.column("features").combine_chunks()
    bounds = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
    flat = column.flatten().to_numpy()
    toxic = rows.column("toxic").to_numpy()
    return fit_ordinal(flat, bounds, severities(flat, bounds, toxic))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: expected severity (0 to 3), P(severity > 0), likeliest grade, toxic or not.

    A null or empty text has no features and gets the scores of the thresholds alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(batch, data, offsets):
            model = shared.value
            flat, bounds = _features(data, offsets)
            n = len(offsets) - 1
            z = np.bincount(np.repeat(np.arange(n), np.diff(bounds)), model.weight[flat], n)
            chance = model.grade_chances(z)
            above = 1 - chance[:, 0]
            return {"doc_id": batch.column("doc_id"), "severity": chance @ np.arange(GRADES), "p_toxic": above, "grade": chance.argmax(1).astype(np.int32), "toxic": above >= TOXIC_AT}

        return work

    return map_slices(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), "text", SCORED, make)
