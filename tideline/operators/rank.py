"""First, last, peak and top-n rows per group.

Each form first reduces a group to one number by an aggregate that combines on the map side (an
extreme, or the n-th largest value through a group limit before the shuffle), then keeps the rows
that reach it by an equi-join, which can be split when one group or one tie holds most rows. A missing
key is a group like any other. A ranked value is stored or exact: a mean should be written before it is
ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.levels import level_rank
from tideline.operators.columns import col
from tideline.operators.joins import match


def _at_extreme(df: DataFrame, keys: Sequence[str], value: Column, extreme) -> DataFrame:
    """Rows whose value is the group's extreme, ties kept, in the input's columns."""
    rows = df.withColumn("_v", value).where(F.col("_v").isNotNull())
    best = rows.groupBy(*keys).agg(extreme("_v").alias("_v"))
    return match(rows, best, [*keys, "_v"], "left_semi").drop("_v")


def first_by(df: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    """Earliest rows per group, ties kept."""
    return _at_extreme(df, keys, col(t), F.min)


def last_by(df: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    """Latest rows per group, ties kept."""
    return _at_extreme(df, keys, col(t), F.max)


def top_n(df: DataFrame, keys: Sequence[str], value: Column | str, n: int) -> DataFrame:
    """Rows with the n largest values per group, ties kept."""
    value = col(value) if isinstance(value, str) else value
    if n == 1:
        return _at_extreme(df, keys, value, F.max)
    rows = df.withColumn("_v", value).where(F.col("_v").isNotNull())
    w = Window.partitionBy(*keys).orderBy(F.col("_v").desc())
    leading = rows.select(*keys, "_v").withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n)
    limit = leading.groupBy(*keys).agg(F.min("_v").alias("_limit"))
    return match(rows, limit, keys).where(F.col("_v") >= F.col("_limit")).select(*df.columns)


def top_n_abs(df: DataFrame, keys: Sequence[str], value: str, n: int) -> DataFrame:
    """Rows with the n largest magnitudes per group, ties kept."""
    return top_n(df, keys, F.abs(col(value)), n)


def top_k(df: DataFrame, value: Column, k: int, tiebreak: Sequence[str]) -> DataFrame:
    """The k largest rows of the whole table, no ties."""
    return df.orderBy(value.desc_nulls_last(), *[col(c).asc() for c in tiebreak]).limit(k)


def _one_row(df: DataFrame, keys: Sequence[str], order: Column, tiebreak: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in set(keys)]
    best = F.min_by(
        F.struct(*[col(c) for c in rest]),
        F.struct(order.isNull(), order, *[col(c) for c in tiebreak]),
    )
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def peak_by(df: DataFrame, keys: Sequence[str], value: str, tiebreak: Sequence[str]) -> DataFrame:
    """The row with the largest value per group; the smallest tiebreak among equals."""
    return _one_row(df, keys, -col(value), tiebreak)


def trough_by(df: DataFrame, keys: Sequence[str], value: str, tiebreak: Sequence[str]) -> DataFrame:
    """The row with the smallest value per group; the smallest tiebreak among equals."""
    return _one_row(df, keys, col(value), tiebreak)


def dominant_class(df: DataFrame, keys: Sequence[str], label: str, levels: Sequence[str]) -> DataFrame:
    """Keep, per group, the rows of the highest level that occurs (levels run from mild to severe)."""
    return top_n(df, keys, level_rank(col(label), levels), 1)
