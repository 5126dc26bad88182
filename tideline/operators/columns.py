"""Column-level operators: choose, rename, overwrite and fill, and sample alignment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.levels import level_rank


def col(name: str) -> Column:
    """A column by its verbatim name, which may hold spaces, dots, slashes or brackets."""
    return F.col("`" + name.replace("`", "``") + "`")


def select_prefix(df: DataFrame, prefixes: Sequence[str], *, drop: bool = False) -> DataFrame:
    """Keep (or drop) the columns that start with a prefix, ignoring case."""
    starts = tuple(p.lower() for p in prefixes)
    return df.select(*[col(c) for c in df.columns if c.lower().startswith(starts) != drop])


def set_where(df: DataFrame, name: str, rules: Sequence[tuple[Column, object]]) -> DataFrame:
    """Overwrite a column where a condition holds; a later rule wins over an earlier one."""
    out = None
    for condition, value in reversed(rules):
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    if out is None:
        return df
    rest = col(name) if name in df.columns else F.lit(None)
    return df.withColumn(name, out.otherwise(rest))


def fill_missing(df: DataFrame, fills: Mapping[str, object]) -> DataFrame:
    """Replace missing values column by column."""
    return df.withColumns({c: F.coalesce(col(c), F.lit(v)) for c, v in fills.items()})


def present_levels(df: DataFrame, name: str, levels: Sequence[str]) -> DataFrame:
    """The levels that occur, each with its ordinal in the full list."""
    seen = df.select(col(name).alias("level")).where(F.col("level").isin(list(levels))).distinct()
    return seen.withColumn("ordinal", level_rank(F.col("level"), levels))


def align(meta: DataFrame, long: DataFrame, sample: str) -> tuple[DataFrame, DataFrame]:
    """Both tables cut to the samples they share."""
    return (
        meta.join(long.select(sample).distinct(), sample, "left_semi"),
        long.join(meta.select(sample).distinct(), sample, "left_semi"),
    )
