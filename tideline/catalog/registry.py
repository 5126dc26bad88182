"""The registry behind ``queries()`` and ``oracle_sql()``, and SQL text shared by the checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import tune

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan and, where there is one, its equivalent SQL."""

    def add(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: plan(tune(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return add


def r6(x: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison: sums of doubles may differ in the last bits between engines."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits)


def q6(x: str, digits: int = 6) -> str:
    """SQL text of :func:`r6`, without negative zeros."""
    return f"(round(CAST({x} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


def sql_norm_p(z: str) -> str:
    """SQL text of P(|Z| > |z|): Taylor series of the normal integral for |z| < 7."""
    term = f"exp((2*k+1)*ln(abs({z})) - (k+1)*ln(2.0::DOUBLE) - lgamma(k+1.5::DOUBLE) + 0.5*ln(pi()))"
    series = f"list_sum(list_transform(range(0, 160), lambda k: {term}))"
    body = f"1 - 2 * exp(-0.5*{z}*{z}) / sqrt(2*pi()) * {series}"
    return f"(CASE WHEN {z} IS NULL THEN NULL WHEN {z} = 0 THEN 1.0::DOUBLE WHEN abs({z}) > 7 THEN 0.0::DOUBLE ELSE {body} END)"


def sql_chi2_p(x: str, df: str) -> str:
    """SQL text of P(X > x), chi-squared with ``df`` degrees: series of the incomplete gamma function."""
    term = f"exp(({df}/2.0::DOUBLE + n)*ln({x}/2) - {x}/2 - lgamma({df}/2.0::DOUBLE + n + 1))"
    series = f"list_sum(list_transform(range(0, 400), lambda n: {term}))"
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= 0 THEN 1.0::DOUBLE WHEN {x} > 200 THEN 0.0::DOUBLE ELSE 1 - {series} END)"


def sql_t_p(t: str, df: str, steps: int = 2000) -> str:
    """SQL text of P(|T| > |t|), Student with ``df`` degrees: Simpson's rule over theta = atan(t/sqrt(df)),
    where the density is cos(theta)^(df-1)."""
    top = f"atan(abs({t})/sqrt({df}::DOUBLE))"
    weight = f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    series = f"list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * pow(cos({top}*i/{steps}.0::DOUBLE), {df}-1)))"
    front = f"exp(lgamma(({df}+1)/2.0::DOUBLE) - lgamma({df}/2.0::DOUBLE)) / sqrt(pi())"
    return f"(1 - 2 * {front} * {top}/{steps}/3 * {series})"


def _far(x: str) -> str:
    return f"({x} + 12.0::DOUBLE)"


def sql_digamma(x: str) -> str:
    """SQL text of digamma: twelve steps of the recurrence, then the asymptotic series."""
    y = _far(x)
    return f"(ln({y}) - 0.5/{y} - 1/(12*pow({y},2)) + 1/(120*pow({y},4)) - 1/(252*pow({y},6)) + 1/(240*pow({y},8)) - list_sum(list_transform(range(0, 12), lambda i: 1/({x}+i))))"


def sql_trigamma(x: str) -> str:
    y = _far(x)
    return f"(1/{y} + 1/(2*pow({y},2)) + 1/(6*pow({y},3)) - 1/(30*pow({y},5)) + 1/(42*pow({y},7)) - 1/(30*pow({y},9)) + list_sum(list_transform(range(0, 12), lambda i: 1/pow({x}+i, 2))))"


def sql_tetragamma(x: str) -> str:
    y = _far(x)
    return f"(-1/pow({y},2) - 1/pow({y},3) - 1/(2*pow({y},4)) + 1/(6*pow({y},6)) - 1/(6*pow({y},8)) - 2*list_sum(list_transform(range(0, 12), lambda i: 1/pow({x}+i, 3))))"
