"""Set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_overall(df: DataFrame, group: str, label: str = "Overall") -> DataFrame:
    """Every row twice, once under its own group and once under the overall label, from one scan."""
    return df.withColumn(group, F.explode(F.array(F.col(group), F.lit(label))))


def fan_out(df: DataFrame, branches: Mapping[str, Column], out: str) -> DataFrame:
    """Each row once for every branch whose condition it meets, named in ``out``: the union of the branches, from one scan."""
    met = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in branches.items()]))
    return df.withColumn(out, F.explode(met))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of several tables, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b), parts)
