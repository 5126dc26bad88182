"""Count matrices as long (feature, sample, value) triples; an absent cell is a zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.aggregate import count_above
from tideline.operators.scan import quantiles, trim_bounds
from tideline.operators.smooth import per_group
from tideline.session import durable

PER_BLOCK = 1024  # samples in a block, on average


def filter_features(df: DataFrame, n: int = 3, threshold: float = 20, *, by: str | None = None) -> DataFrame:
    """Cells of the features with at least ``n`` samples strictly above ``threshold``, within each group."""
    keys = [by, "feature"] if by else ["feature"]
    passed = df.groupBy(*keys).agg(count_above(F.col("value"), threshold).alias("_k")).where(F.col("_k") >= n)
    return df.join(passed.select(*keys), keys, "left_semi")


def sample_blocks(samples: DataFrame, keys: Sequence[str], columns: Sequence[str], n: int) -> DataFrame:
    """``n`` samples gathered per key in blocks of about ``PER_BLOCK``: an array ``_members`` of structs a row."""
    hashed = samples.withColumn("_block", F.pmod(F.xxhash64("sample"), F.lit(max(1, -(-n // PER_BLOCK)))))
    return hashed.groupBy(*keys, "_block").agg(F.collect_list(F.struct(*columns)).alias("_members")).drop("_block")


def complete_cells(df: DataFrame, samples: DataFrame) -> DataFrame:
    """The dense matrix: a zero for every absent cell of a listed feature and sample.

    The dense matrix is what the models below are defined on. Samples are hashed into blocks, each
    feature meets each block through an equi-join, and one aggregation merges zeros with counts.
    """
    listed_samples = samples.select("sample").distinct()
    n = max(1, -(-listed_samples.count() // PER_BLOCK))
    blocks = (
        listed_samples.withColumn("_block", F.pmod(F.xxhash64("sample"), F.lit(n)))
        .groupBy("_block")
        .agg(F.collect_list("sample").alias("_members"))
    )
    features = df.select("feature").distinct()
    every = features.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    kind = df.schema["value"].dataType
    zeros = every.join(blocks, "_block").select(
        "feature", F.explode("_members").alias("sample"), F.lit(0).cast(kind).alias("value")
    )
    listed = df.select("feature", "sample", "value").join(listed_samples, "sample", "left_semi")
    merged = listed.unionByName(zeros).groupBy("feature", "sample").agg(F.sum("value").alias("value"))
    return merged.withColumn("value", F.col("value").cast(kind))


def library_sizes(df: DataFrame) -> DataFrame:
    """Total count per sample."""
    return df.groupBy("sample").agg(F.sum("value").cast("double").alias("lib_size"))


def tmm(df: DataFrame, *, m_trim: float = 0.3, a_trim: float = 0.05, by: str | None = None) -> DataFrame:
    """([by], sample, lib_size, factor): trimmed mean of M values against a reference sample of the group.

    The reference is the sample whose upper quartile of scaled counts is nearest the mean one; where
    half the samples have an upper quartile of zero, the one with the greatest sum of square roots. A
    sample that occurs in ``df`` but has no count above zero raises. The trims are by average rank
    within a sample; a trim is a value range, so only its bounds are looked for, and only the values next to
    them are ordered. Zero cells have no finite M or A and so never enter. ``df`` is read several times, so it should
    be a written table.
    """
    keys = [by] if by else []
    own = [*keys, "sample"]
    cells = df.select(*own, "feature", F.col("value").cast("double").alias("value"))
    above = cells.where(F.col("value") > 0)
    features = {(r[by] if by else None): r["n"] for r in above.select(*keys, "feature").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not features:
        if cells.limit(1).count():
            raise ValueError("samples without any count have no scale")
        return cells.select(*own, F.col("value").alias("lib_size"), F.col("value").alias("factor"))
    upper = quantiles(above, own, "value", {"q": 0.75}, total=per_group(by, features))
    sizes = cells.groupBy(*own).agg(F.sum("value").alias("lib_size"), F.sum(F.sqrt("value")).alias("roots"))
    per = sizes.join(upper, own, "left").withColumn("q", F.col("q") / F.nullif(F.col("lib_size"), F.lit(0.0)))
    per = durable(per)
    lacking = F.max_by("sample", F.when(F.coalesce(F.col("lib_size"), F.lit(0.0)) == 0, 1))
    summary = per.groupBy(*keys).agg(F.avg("q").alias("centre"), F.expr("percentile(q, 0.5)").alias("middle"), lacking.alias("lacking")).collect()
    for r in summary:
        if r["lacking"] is not None:
            raise ValueError(f"samples without any count have no scale: {r['lacking']!r}")
    centre = per_group(by, {(r[by] if by else None): float(r["centre"]) for r in summary})
    sparse = per_group(by, {(r[by] if by else None): r["middle"] < 1e-20 for r in summary})
    place = F.struct(F.when(sparse, -F.col("roots")).otherwise(F.abs(F.col("q") - centre)), F.col("sample"))
    nearest = per.groupBy(*keys).agg(F.min_by("sample", place).alias("ref"), F.min_by("lib_size", place).alias("lib")).collect()
    ref = per_group(by, {(r[by] if by else None): r["ref"] for r in nearest})
    ref_lib = per_group(by, {(r[by] if by else None): float(r["lib"]) for r in nearest})

    base = above.where(F.col("sample") == ref).select(*keys, "feature", F.col("value").alias("_r"))
    o, r, n_o, n_r = F.col("value"), F.col("_r"), F.col("lib_size"), ref_lib
    both = above.join(per.select(*own, "lib_size"), own).join(base, [*keys, "feature"])
    # twelve digits: values equal on paper must tie whatever the order of operations
    both = both.select(
        *own,
        F.round(F.log2(o / n_o) - F.log2(r / n_r), 12).alias("_m"),
        F.round((F.log2(o / n_o) + F.log2(r / n_r)) / 2, 12).alias("_a"),
        ((n_o - o) / n_o / o + (n_r - r) / n_r / r).alias("_v"),
    )
    both = durable(both)
    bounds = trim_bounds(both, own, {"_m": m_trim, "_a": a_trim})
    inside = F.lit(True)
    for c in ("_m", "_a"):
        low, high = F.col(f"{c}_low"), F.col(f"{c}_high")
        inside = inside & ((F.col(c) > low["x"]) | ((F.col(c) == low["x"]) & low["in"]))
        inside = inside & ((F.col(c) < high["x"]) | ((F.col(c) == high["x"]) & high["in"]))
    mean = F.sum(F.col("_m") / F.col("_v")) / F.sum(1 / F.col("_v"))
    inside = inside & (F.greatest(F.abs("_m_least"), F.abs("_m_most")) >= 1e-6)
    kept = both.join(bounds, own).where(inside).groupBy(*own).agg(mean.alias("_f"))
    raw = per.select(*own, "lib_size").join(kept, own, "left")
    raw = durable(raw.withColumn("_f", F.coalesce("_f", F.lit(0.0))))
    shift = per_group(by, {(r[by] if by else None): r["m"] for r in raw.groupBy(*keys).agg(F.avg("_f").alias("m")).collect()})
    return raw.select(*own, "lib_size", F.pow(F.lit(2.0), F.col("_f") - shift).alias("factor"))


def _prior_counts(factors: DataFrame, prior: float) -> DataFrame:
    """Per sample its effective library size ``_lib`` and the prior count ``_pad`` scaled to it."""
    sized = factors.select("sample", (F.col("lib_size") * F.col("factor")).alias("_lib"))
    mean = sized.agg(F.avg("_lib")).first()[0]
    return sized.withColumn("_pad", F.lit(prior) * F.col("_lib") / F.lit(mean))


def _per_million(count: Column) -> Column:
    return F.log2((count + F.col("_pad")) / (F.col("_lib") + 2 * F.col("_pad")) * 1e6)


def log_cpm(df: DataFrame, factors: DataFrame, prior: float = 2.0) -> DataFrame:
    """log2 counts per million of the listed cells, with a prior count scaled by the effective library size."""
    cells = df.join(_prior_counts(factors, prior), "sample")
    return cells.select("feature", "sample", _per_million(F.col("value")).alias("value"))


def log_cpm_base(factors: DataFrame, prior: float = 2.0) -> DataFrame:
    """(sample, base): the log count per million of a cell that is not listed, for :func:`pca.pca`."""
    return _prior_counts(factors, prior).select("sample", _per_million(F.lit(0.0)).alias("base"))
