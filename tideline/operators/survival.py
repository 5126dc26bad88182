"""Product-limit curves and the log-rank test, from counts per distinct time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tideline.functions.special import chi2_upper
from tideline.operators.columns import col
from tideline.operators.scan import prefix_sums


def km_curve(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """Number at risk, events and survival at each distinct time of each group."""
    rows = df.where(col(time).isNotNull() & col(event).isNotNull())
    at = rows.groupBy(group, time).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(col(event).cast("bigint")).alias("n_event")
    )
    at = prefix_sums(at, [group], time, {"c": F.col("_n")})
    at = at.withColumn("n_risk", F.col("c_total") - F.col("c_before"))
    gone = F.col("n_event") == F.col("n_risk")
    # a product as a sum of logs; a factor of zero is carried as a flag instead of log(0)
    kept = F.when(gone, F.lit(0.0)).otherwise(F.log1p(-F.col("n_event") / F.col("n_risk")))
    curve = prefix_sums(
        at.select(group, time, "n_risk", "n_event", kept.alias("_log"), gone.cast("int").alias("_gone")),
        [group], time, {"l": F.col("_log"), "z": F.col("_gone")},
    )
    alive = F.when(F.col("z_before") + F.col("z_tie") > 0, F.lit(0.0)).otherwise(
        F.exp(F.col("l_before") + F.col("l_tie"))
    )
    return curve.select(group, time, "n_risk", "n_event", alive.alias("survival"))


def logrank_table(df: DataFrame, time: str, event: str, group: str, arms: Sequence[str]) -> DataFrame:
    """One row: n, observed and expected events per arm, and the covariance of observed - expected."""
    rows = df.where(col(time).isNotNull() & col(event).isNotNull())
    k = range(len(arms))
    at = rows.groupBy(time).agg(
        *[F.count_if(col(group) == a).alias(f"n{i}") for i, a in enumerate(arms)],
        *[F.count_if((col(group) == a) & (col(event) == 1)).alias(f"d{i}") for i, a in enumerate(arms)],
    )
    at = prefix_sums(at, [], time, {f"s{i}": F.col(f"n{i}") for i in k})
    risk = [(F.col(f"s{i}_total") - F.col(f"s{i}_before")).cast("double") for i in k]
    at = at.select(
        *[F.col(f"n{i}") for i in k],
        *[F.col(f"d{i}") for i in k],
        *[risk[i].alias(f"r{i}") for i in k],
        sum(risk[1:], risk[0]).alias("r"),
        sum([F.col(f"d{i}") for i in k][1:], F.col("d0")).cast("double").alias("d"),
    ).where("d > 0 or r > 0")
    share = [F.col(f"r{i}") / F.col("r") for i in k]
    spread = F.when(F.col("r") > 1, F.col("d") * (F.col("r") - F.col("d")) / (F.col("r") - 1)).otherwise(0.0)
    cov = [F.sum(spread * share[i] * ((1.0 if i == j else 0.0) - share[j])) for i in k for j in k]
    return at.agg(
        F.array(*[F.sum(f"n{i}") for i in k]).alias("n"),
        F.array(*[F.sum(f"d{i}") for i in k]).alias("observed"),
        F.array(*[F.sum(F.col("d") * share[i]) for i in k]).alias("expected"),
        F.array(*cov).alias("cov"),
    )


@F.pandas_udf(DoubleType())
def _quadratic(gap: pd.Series, cov: pd.Series) -> pd.Series:
    out = []
    for u, v in zip(gap, cov):
        u = np.asarray(u, float)
        v = np.asarray(v, float).reshape(len(u), len(u))
        seen = np.diag(v) > 0
        u, v = u[seen][1:], v[np.ix_(seen, seen)][1:, 1:]
        out.append(float(u @ np.linalg.solve(v, u)) if len(u) else np.nan)
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def _chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chi2_upper(x.to_numpy(float), df.to_numpy(float)))


def logrank_arms(df: DataFrame, time: str, event: str, group: str, arms: Sequence[str]) -> DataFrame:
    """Observed and expected events per arm."""
    table = logrank_table(df, time, event, group, arms)
    zipped = F.arrays_zip(F.array(*[F.lit(a) for a in arms]).alias("g"), "n", "observed", "expected")
    return table.select(F.explode(zipped).alias("_z")).select(
        F.col("_z.g").alias(group), F.col("_z.n"), F.col("_z.observed"), F.col("_z.expected")
    )


def logrank(df: DataFrame, time: str, event: str, group: str, arms: Sequence[str]) -> DataFrame:
    """Log-rank chi-squared, its degrees of freedom and p, for all arms together."""
    table = logrank_table(df, time, event, group, arms)
    gap = F.zip_with("observed", "expected", lambda o, e: o - e)
    present = F.size(F.filter("n", lambda n: n > 0)) - 1
    out = table.select(_quadratic(gap, "cov").alias("chi2"), present.alias("df"))
    return out.withColumn("p", _chi2_p("chi2", F.col("df").cast("double")))
