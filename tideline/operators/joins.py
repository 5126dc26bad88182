"""Equi-joins of the study. No hints: Spark broadcasts a side only below its size limit, and the
adaptive planner splits skewed partitions otherwise."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.columns import col, fill_missing


def match(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on group columns where a missing group matches a missing group."""
    renamed = right.withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = reduce(lambda a, b: a & b, [col(c).eqNullSafe(col(f"_by_{c}")) for c in by])
    return left.join(renamed, same, how).drop(*[f"_by_{c}" for c in by])


def with_baseline(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    at: Column,
    *,
    agg: Callable[[Column], Column] = F.max,
    out: str = "baseline",
    source: DataFrame | None = None,
) -> DataFrame:
    """Attach the per-key summary of ``value`` over the rows where ``at`` holds. ``source``: a table that has these
    rows and can be read more narrowly than ``df``.

    Aggregate then join, not a window: the aggregate combines on the map side and the join can be
    split when one key is hot.
    """
    base = (df if source is None else source).where(at).groupBy(*keys).agg(agg(col(value)).alias(out))
    return df.join(base, list(keys), "left")


def with_group_max(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Attach the group's largest value to every row; missing if any value of the group is."""
    x = col(value)
    top = df.groupBy(*keys).agg(F.when(F.count(x) == F.count(F.lit(1)), F.max(x)).alias(out))
    return df.join(top, list(keys), "left")


def with_control(df: DataFrame, batch: str, value: str, is_control: Column, out: str = "control") -> DataFrame:
    """Join the batch's control value to every other row; several control rows are averaged first."""
    control = df.where(is_control).groupBy(batch).agg(F.avg(value).alias(out))
    return df.where(~is_control).join(control, batch, "left")


def full_join_all(tables: Sequence[DataFrame], key: str | list[str]) -> DataFrame:
    """Chain of full outer joins on one coalesced key."""
    return reduce(lambda a, b: a.join(b, key, "full"), tables)


def shortlist(df: DataFrame, listed: DataFrame, on: str, fills: Mapping[str, object]) -> DataFrame:
    """Every listed row, with the table's values where there are any and the fills where not."""
    return fill_missing(df.join(listed, on, "right"), fills)


def keep(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is in the other table."""
    return df.join(keys, on, "left_semi")


def discard(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is not in the other table."""
    return df.join(keys, on, "left_anti")
