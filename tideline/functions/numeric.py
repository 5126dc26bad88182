"""Arithmetic and aggregates that keep the study's missing-value rules under ANSI mode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def r_div(num: Column, den: Column) -> Column:
    """Ratio where x/0 is signed infinity and 0/0 is missing."""
    num, den = num.cast("double"), den.cast("double")
    return (
        F.when(den != 0, num / den)
        .when((den == 0) & (num > 0), F.lit(INF))
        .when((den == 0) & (num < 0), F.lit(-INF))
    )


def r_log2(x: Column) -> Column:
    """log2 with -infinity at zero and missing below zero."""
    x = x.cast("double")
    return F.when(x > 0, F.log2(x)).when(x == 0, F.lit(-INF))


def strict(agg: Callable[[Column], Column], x: Column) -> Column:
    """An aggregate that is missing as soon as one input of the group is missing."""
    return F.when(F.count(x) == F.count(F.lit(1)), agg(x))


def clamp(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound ``x``; a missing value stays missing."""
    out = x
    if hi is not None:
        out = F.when(out > hi, F.lit(hi)).otherwise(out)
    if lo is not None:
        out = F.when(out < lo, F.lit(lo)).otherwise(out)
    return out


def magnitude(a: Column, b: Column) -> Column:
    """Length of the vector (a, b)."""
    return F.sqrt(a * a + b * b)


def neg_log10(p: Column) -> Column:
    """-log10(p); infinity at p = 0."""
    return F.when(p > 0, -F.log10(p)).when(p == 0, F.lit(INF))


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole seconds between two timestamps, as fractional days."""
    return (F.unix_timestamp(later) - F.unix_timestamp(earlier)) / F.lit(86400.0)


def floor_at_limit(x: Column, stand_in: float) -> Column:
    """Replace an exact zero (below the detection limit) by a plotting stand-in."""
    return F.when(x == 0, F.lit(float(stand_in))).otherwise(x.cast("double"))
