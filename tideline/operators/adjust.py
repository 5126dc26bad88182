"""Multiple-test adjustment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.columns import col
from tideline.operators.scan import CHUNK, KEY, _stratum, prefix_sums


def p_adjust(df: DataFrame, by: Sequence[str], p: str, method: str, out: str = "padj") -> DataFrame:
    """Holm (``holm``) or Benjamini-Hochberg (``bh``) adjusted p per family ``by``.

    A missing p stays missing and does not count as a test. The table is reduced to distinct p
    values, scanned in chunks of p and joined back, so neither a large family nor a frequent p lands
    in one task.
    """
    if method not in ("holm", "bh"):
        raise ValueError(f"unknown adjustment {method!r}")
    counted = df.where(col(p).isNotNull()).groupBy(*by, p).agg(F.count(F.lit(1)).alias("_k"))
    levels = prefix_sums(counted, by, p, {"_m": F.col("_k")}, keep_chunks=True)
    levels = levels.withColumn("_raw", _raw(method, col(p), F.col("_m_before"), F.col("_k"), F.col("_m_total")))
    extreme, ordered = _direction(method)
    carry = levels.groupBy(KEY).agg(
        *[F.first(c).alias(c) for c in [*by, CHUNK]], extreme("_raw").alias("_best")
    )
    earlier = Window.partitionBy(*_stratum(by)).orderBy(ordered(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select(KEY, extreme("_best").over(earlier).alias("_carry"))
    running = extreme("_raw").over(Window.partitionBy(KEY).orderBy(ordered(p)))
    merged = (F.greatest if method == "holm" else F.least)(F.col("_running"), F.col("_carry"))
    levels = levels.withColumn("_running", running).join(carry, KEY)
    same = F.struct(*[F.col(c) for c in by], col(p)).alias("_same")
    levels = levels.select(same, F.least(F.lit(1.0), merged).alias(out))
    return df.withColumn("_same", same).join(levels, "_same", "left").drop("_same")


def _raw(method: str, p: Column, before: Column, tie: Column, total: Column) -> Column:
    """Equal p values share one multiplier: that of the first of them in Holm, of the last in BH."""
    return p * (total - before) if method == "holm" else p * total / (before + tie)


def _direction(method: str):
    if method == "holm":
        return F.max, lambda c: F.col(c).asc()
    return F.min, lambda c: F.col(c).desc()
