"""Rank-sum, Kruskal-Wallis and Dunn tests, one row per stratum (or pair of groups).

All of them need only the rank sums per (stratum, group), which :func:`rank_sums` finds without
ever sorting a whole stratum in one task. Missing values are dropped first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.levels import level_rank
from tideline.functions.special import chi2_p_udf, norm_p_udf, ranksum_p_udf
from tideline.operators.adjust import p_adjust
from tideline.operators.columns import col
from tideline.operators.scan import CHUNK, order_chunk
from tideline.session import durable


def rank_sums(df: DataFrame, strata: Sequence[str], group: str, value: str) -> DataFrame:
    """(strata, group) -> n, rank_sum and the group's share of the tie term sum(t^3 - t)."""
    rows = df.where(col(value).isNotNull() & col(group).isNotNull())
    counts = rows.groupBy(*strata, group, value).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn(CHUNK, order_chunk(col(value)))
    chunk = Window.partitionBy(*strata, CHUNK)
    equal = F.sum("_n").over(Window.partitionBy(*strata, CHUNK, value))
    counts = counts.withColumn("_tie", equal).withColumn(
        "_rank", F.sum("_n").over(chunk.orderBy(value)) - F.col("_tie") + (F.col("_tie") + 1) / 2
    )
    local = counts.groupBy(*strata, CHUNK, group).agg(
        F.sum("_n").alias("_n"),
        F.sum(F.col("_n") * F.col("_rank")).alias("_r"),
        F.sum(F.col("_n") * (F.pow(F.col("_tie").cast("double"), F.lit(2.0)) - 1)).alias("_t"),
    )
    # ranks so far are within a chunk; add the number of values in earlier chunks
    upto = F.sum("_n").over(Window.partitionBy(*(strata or [F.lit(0)])).orderBy(CHUNK))
    local = local.withColumn("_off", upto - F.sum("_n").over(Window.partitionBy(*strata, CHUNK)))
    return local.groupBy(*strata, group).agg(
        F.sum("_n").alias("n"),
        F.sum(F.col("_r") + F.col("_n") * F.col("_off")).alias("rank_sum"),
        F.sum("_t").alias("ties"),
    )


def ranksum(
    df: DataFrame, strata: Sequence[str], group: str, value: str, levels: Sequence[str]
) -> DataFrame:
    """Two-sample rank-sum test of ``levels[0]`` against ``levels[1]`` per stratum."""
    a, b = levels
    sums = rank_sums(df.where(col(group).isin(a, b)), strata, group, value)

    def of(level: str, c: str) -> Column:
        return F.coalesce(F.sum(F.when(col(group) == level, F.col(c))), F.lit(0))

    out = sums.groupBy(*strata).agg(
        of(a, "n").alias("n1"),
        of(b, "n").alias("n2"),
        of(a, "rank_sum").cast("double").alias("_r1"),
        F.sum("ties").alias("_ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    total = n1 + n2
    out = out.where((n1 > 0) & (n2 > 0)).withColumn("w", F.col("_r1") - n1 * (n1 + 1) / 2)
    gap = F.col("w") - n1 * n2 / 2
    var = n1 * n2 / 12 * (total + 1 - F.col("_ties") / (total * (total - 1)))
    z = F.when(var > 0, (gap - F.signum(gap) * 0.5) / F.sqrt(var))
    out = out.withColumn("z", z)
    p = ranksum_p_udf("n1", "n2", "w", "z", "_ties")
    return out.withColumn("p", F.when(F.col("z").isNotNull(), p)).drop("_r1", "_ties")


def _omnibus(sums: DataFrame, strata: Sequence[str]) -> DataFrame:
    return sums.groupBy(*strata).agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("n").cast("double").alias("n"),
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("_s"),
        F.sum("ties").alias("_ties"),
    )


def kruskal(df: DataFrame, strata: Sequence[str], group: str, value: str) -> DataFrame:
    """Kruskal-Wallis test across all groups per stratum."""
    return _kruskal(rank_sums(df, strata, group, value), strata)


def _kruskal(sums: DataFrame, strata: Sequence[str]) -> DataFrame:
    out = _omnibus(sums, strata)
    n = F.col("n")
    tie = 1 - F.try_divide(F.col("_ties"), n * n * n - n)
    h = 12 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1)
    out = (
        out.where(F.col("groups") > 1)
        .withColumn("h", F.when(tie > 0, h / tie))
        .withColumn("df", F.col("groups") - 1)
    )
    p = F.when(F.col("h").isNotNull(), chi2_p_udf("h", F.col("df").cast("double")))
    return out.withColumn("p", p).select(*strata, n.cast("bigint").alias("n"), "h", "df", "p")


def dunn(
    df: DataFrame, strata: Sequence[str], group: str, value: str, levels: Sequence[str]
) -> DataFrame:
    """Dunn's test of all group pairs per stratum, z of group2 over group1, Holm within a stratum.

    Pairs are formed from one row per declared level, never from data rows.
    """
    sums = rank_sums(df.where(col(group).isin(list(levels))), strata, group, value)
    return _dunn(sums, strata, group, levels)


def _dunn(sums: DataFrame, strata: Sequence[str], group: str, levels: Sequence[str]) -> DataFrame:
    mean = F.struct(
        level_rank(col(group), levels).alias("o"), col(group).alias("g"), F.col("n"),
        (F.col("rank_sum") / F.col("n")).alias("m"),
    )
    listed = sums.groupBy(*strata).agg(
        F.array_sort(F.collect_list(mean)).alias("_g"),
        F.sum("n").cast("double").alias("_total"),
        F.sum("ties").alias("_ties"),
    )
    pairs = (
        listed.select("*", F.posexplode("_g").alias("_i", "_a"))
        .withColumn("_b", F.explode(F.slice("_g", F.col("_i") + 2, F.size("_g"))))
    )
    n = F.col("_total")
    var = n * (n + 1) / 12 - F.col("_ties") / (12 * (n - 1))
    se = F.sqrt(var * (1 / F.col("_a.n") + 1 / F.col("_b.n")))
    tested = pairs.select(
        *strata,
        F.col("_a.g").alias("group1"),
        F.col("_b.g").alias("group2"),
        F.col("_a.n").alias("n1"),
        F.col("_b.n").alias("n2"),
        F.when(se > 0, (F.col("_b.m") - F.col("_a.m")) / se).alias("z"),
    )
    tested = durable(tested.withColumn("p", F.when(F.col("z").isNotNull(), norm_p_udf("z"))))
    return p_adjust(tested, strata, "p", "holm")


def gated_dunn(
    df: DataFrame,
    strata: Sequence[str],
    group: str,
    value: str,
    levels: Sequence[str],
    baseline: str,
    *,
    alpha: float = 0.05,
) -> DataFrame:
    """Where the omnibus test is below ``alpha``: pairs against the baseline whose adjusted p is too."""
    # ranks of a stratum do not depend on other strata, so both tests share one table of rank sums
    sums = durable(rank_sums(df.where(col(group).isin(list(levels))), strata, group, value))
    passed = _kruskal(sums, strata).where(F.col("p") < alpha).select(*strata)
    pairs = _dunn(sums.join(passed, list(strata), "left_semi"), strata, group, levels)
    return pairs.where((F.col("group1") == baseline) & (F.col("padj") < alpha))
