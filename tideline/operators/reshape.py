"""Wide to long, long to wide, and matrix transposition on long triples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.levels import level_rank
from tideline.operators.columns import col


def melt(
    df: DataFrame,
    ids: Sequence[str],
    values: Sequence[str] | None = None,
    variable: str = "feature",
    value: str = "value",
    *,
    ordinal: str | None = None,
) -> DataFrame:
    """Wide to long; ``ordinal`` keeps the column position, which later fixes the text order."""
    if values is None:
        values = [c for c in df.columns if c not in set(ids)]
    long = df.unpivot([col(c) for c in ids], [col(c) for c in values], variable, value)
    return long.withColumn(ordinal, level_rank(F.col(variable), list(values))) if ordinal else long


def cast_wide(
    df: DataFrame,
    ids: Sequence[str],
    variable: str,
    value: str,
    levels: Sequence[str],
    *,
    fill: float | None = None,
) -> DataFrame:
    """Long to wide over a known list of values; two values for one cell is an error."""
    x = col(value)
    clash = F.raise_error(F.lit(f"more than one {value} in one cell of the wide table"))
    one = F.when(F.count(x) > 1, clash.cast(df.schema[value].dataType)).otherwise(F.max(x))
    wide = df.groupBy(*[col(c) for c in ids]).pivot(variable, list(levels)).agg(one)
    return wide.fillna(fill, subset=list(levels)) if fill is not None else wide


def cast_composite(
    df: DataFrame, ids: Sequence[str], parts: Sequence[str], value: str, levels: Sequence[str], sep: str = "."
) -> DataFrame:
    """Long to wide with several columns joined into the new column name."""
    return cast_wide(df.withColumn("_column", F.concat_ws(sep, *parts)), ids, "_column", value, levels)


def crosstab(df: DataFrame, row: str, column: str, levels: Sequence[str]) -> DataFrame:
    """Counts of row by column, zero where a pair does not occur."""
    return df.groupBy(row).pivot(column, list(levels)).agg(F.count(F.lit(1))).fillna(0, subset=[str(x) for x in levels])


def transpose(df: DataFrame, row: str, column: str) -> DataFrame:
    """Swap the two keys of a long matrix."""
    swapped = {row: column, column: row}
    return df.select(*[col(c).alias(swapped.get(c, c)) for c in df.columns])


def with_bounds(df: DataFrame, label: str, low: float, high: float) -> DataFrame:
    """Two literal rows, Max and Min, above the rows of a wide table."""
    wide = [c for c in df.columns if c != label]
    for name, bound in (("Min", low), ("Max", high)):
        row = df.sparkSession.range(1).select(
            F.lit(name).alias(label), *[F.lit(float(bound)).alias(c) for c in wide]
        )
        df = row.unionByName(df)
    return df
