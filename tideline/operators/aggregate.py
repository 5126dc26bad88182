"""Group summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tideline.functions.numeric import strict
from tideline.functions.special import t_quantile_udf
from tideline.operators.columns import col
from tideline.operators.joins import match
from tideline.operators.scan import order_chunk, quantiles_of_counts, value_counts


def summary_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Count, mean, median, least and greatest value per group, all from one count of the values."""
    x = col(value)
    counted = value_counts(df, by, value)
    moments = counted.groupBy(*by).agg(
        F.sum("_n").alias("n"), (F.sum(x * F.col("_n")) / F.sum("_n")).alias("mean"),
        F.min(x).alias("min"), F.max(x).alias("max"),
    )
    return match(moments, quantiles_of_counts(counted, by, value, {"median": 0.5}), by)


def percent_outcome(df: DataFrame, by: str, outcome: str, positive: str, negative: str) -> DataFrame:
    """Counts of both outcomes and the positive share in percent, to one decimal."""
    yes, no = (F.count_if(col(outcome) == F.lit(v)) for v in (positive, negative))
    counts = df.groupBy(by).agg(no.alias(negative), yes.alias(positive))
    share = F.try_divide(col(positive).cast("double"), col(negative) + col(positive))
    return counts.withColumn("percent", F.round(100 * share, 1))


def merge_replicates(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean over replicates; missing as soon as one replicate is."""
    return df.groupBy(*keys).agg(strict(F.avg, col(value)).alias(value))


def mean_ci(df: DataFrame, by: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    """Mean with a t interval; the bounds of a single observation are missing."""
    x = col(value)
    n, sd = F.count(x), F.stddev_samp(x)
    out = df.groupBy(*by).agg(n.alias("n"), F.avg(x).alias("mean"), (sd / F.sqrt(n)).alias("se"))
    half = t_quantile_udf(level)((F.col("n") - 1).cast("double")) * F.col("se")
    return (
        out.withColumn("_half", F.when(F.col("n") > 1, half))
        .withColumn("lower", F.col("mean") - F.col("_half"))
        .withColumn("upper", F.col("mean") + F.col("_half"))
        .drop("_half")
    )


def collapse(
    df: DataFrame, keys: Sequence[str], text: str, order: Sequence[str], sep: str = ", ", out: str | None = None
) -> DataFrame:
    """Join the texts of a group in the given order.

    The result is one cell per group by definition, but no task orders a whole group: texts are joined within chunks
    of the first order column (a number's chunk, a text's beginning), then the chunks' texts in the chunks' order.
    """
    by = ", ".join(f"`{c}`" for c in order)
    first = df.schema[order[0]].dataType
    chunk = order_chunk(col(order[0])) if isinstance(first, NumericType) else F.substring(col(order[0]).cast("string"), 1, 4)
    inside = F.expr(f"listagg(cast(`{text}` as string), '{sep}') within group (order by {by})")
    parts = df.groupBy(*keys, chunk.alias("_chunk")).agg(inside.alias("_text"))
    return parts.groupBy(*keys).agg(F.expr(f"listagg(_text, '{sep}') within group (order by _chunk)").alias(out or text))


def duration(df: DataFrame, starts: DataFrame, key: str, start: str, end: str, out: str = "duration") -> DataFrame:
    """Inclusive number of days from a given start to each subject's end."""
    ends = df.select(key, end).distinct()
    return starts.join(ends, key, "left").withColumn(out, col(end) - col(start) + 1)


def box_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Quartiles and whiskers: the extreme values within 1.5 interquartile ranges of the box."""
    x = col(value)
    # one row per distinct value is enough to find an extreme, and it shrinks before the join
    values = value_counts(df, by, value)
    hinges = quantiles_of_counts(values, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (x >= F.col("q1") - reach) & (x <= F.col("q3") + reach)
    return (
        match(values, hinges, by)
        .groupBy(*by, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, x)).alias("low"),
            F.max(F.when(inside, x)).alias("high"),
            F.sum(F.when(~inside, F.col("_n")).otherwise(0)).alias("outliers"),
        )
    )


def count_above(value: Column, threshold: float) -> Column:
    """Aggregate: how many values lie strictly above a threshold."""
    return F.count_if(value > threshold)
