"""Ordered scans that never put a whole stratum into one task.

A running sum, rank or quantile needs its stratum in order. A plain window would sort a stratum in
one task, and one stratum may hold a third of all rows. Here every value gets a *chunk*: an integer
that grows with the value and depends on nothing but the value. Rows are windowed per
(stratum, chunk), the small per-chunk totals are windowed per stratum, and the two are added.
Values of one magnitude would share a chunk (all times of a week, say), so a chunk that holds many
distinct values is cut once more, between its least and greatest value, in as many equal ranges as
its count asks for. No sampling, no driver loop, and the same chunk whenever a task is run again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import durable

STEPS = 1024  # chunks per power of two
FULL = 20_000  # distinct values of a chunk per range that it is cut into
CHUNK = "_chunk"
KEY = "_key"


def order_chunk(v: Column) -> Column:
    """Order-preserving integer bucket of a number: its binary exponent and ten mantissa bits."""
    v = v.cast("double")
    size = F.abs(v)
    e = F.floor(F.log2(size))
    step = F.floor((size / F.pow(F.lit(2.0), e.cast("double")) - 1) * STEPS)
    # log2 may round up just below a power of two; clipping keeps the order in that case too
    k = (e + 1100) * STEPS + F.greatest(F.lit(0), F.least(F.lit(STEPS - 1), step))
    k = F.when(size == float("inf"), F.lit(3000 * STEPS)).otherwise(k)
    return F.when(v == 0, F.lit(0)).when(v > 0, k).otherwise(-k).cast("bigint")


def _stratum(by: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in by] or [F.lit(0)]


def chunked(rows: DataFrame, by: Sequence[str], order: str, full: int = FULL) -> DataFrame:
    """``rows`` (one per stratum and distinct order value) with their chunk: a struct in the values' order."""
    rough, v = order_chunk(F.col(order)), F.col(order).cast("double")
    rows = rows.withColumn("_rough", F.struct(*_stratum(by), rough.alias("_c")))
    held = rows.groupBy("_rough").agg(F.count(F.lit(1)).alias("_held"), F.min(v).alias("_least"), F.max(v).alias("_most"))
    rows = rows.join(held.where(F.col("_held") > full), "_rough", "left")  # few chunks, often none
    chunk = F.struct(F.col("_rough")["_c"].alias("c"), _part(v, full).alias("p"))
    return rows.withColumn(CHUNK, chunk).drop("_rough", "_held", "_least", "_most")


def _part(v: Column, full: int = FULL) -> Column:
    """The equal range of its chunk (``_held`` values from ``_least`` to ``_most``) that a value lies in, from 0."""
    width, ranges = F.col("_most") - F.col("_least"), F.ceil(F.col("_held") / F.lit(full))
    part = F.when((F.col("_held") > full) & (width > 0), F.least(F.floor((v - F.col("_least")) / width * ranges), ranges - 1))
    return F.coalesce(part, F.lit(0)).cast("bigint")


def running(rows: DataFrame, chunk: Sequence[str], value: str, full: int = FULL) -> DataFrame:
    """``_at``: the sum of ``_n`` over a chunk's rows up to each value, one row per value. Rows carry ``_held``,
    ``_least`` and ``_most`` of their chunk, and a chunk of more than ``full`` values is summed in parts."""
    rows = rows.withColumn("_part", _part(F.col(value).cast("double"), full))
    rows = rows.withColumn("_at", F.sum("_n").over(Window.partitionBy(*chunk, "_part").orderBy(value)))
    sizes = rows.where(F.col("_held") > full).groupBy(*chunk, "_part").agg(F.sum("_n").alias("_p"))
    earlier = Window.partitionBy(*chunk).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.sum("_p").over(earlier)).where(F.col("_before") > 0).drop("_p")
    named = before.withColumnsRenamed({c: f"_in_{c}" for c in [*chunk, "_part"]})
    same = F.lit(True)
    for c in [*chunk, "_part"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_in_{c}"))
    rows = rows.join(named, same, "left").withColumn("_at", F.col("_at") + F.coalesce("_before", F.lit(0)))
    return rows.drop("_part", "_before", *[f"_in_{c}" for c in [*chunk, "_part"]])


def prefix_sums(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    sums: Mapping[str, Column],
    *,
    descending: bool = False,
    keep_chunks: bool = False,
) -> DataFrame:
    """Per row and name: ``<name>_before`` (rows strictly earlier), ``<name>_tie`` (same order value)
    and ``<name>_total`` (whole stratum). A struct key keeps missing strata as a stratum of their own.
    ``keep_chunks`` leaves the key and the chunk in the rows, for a scan that follows.

    Callers aggregate to distinct order values first, so that ties cannot fill a chunk.
    """
    rows = chunked(df, by, order)
    for name, x in sums.items():
        rows = rows.withColumn(f"_x_{name}", x)
    rows = rows.withColumn(KEY, F.struct(*_stratum(by), F.col(CHUNK)))

    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    totals = rows.groupBy(KEY).agg(
        *[F.first(c).alias(c) for c in [*by, CHUNK]],
        *[F.sum(f"_x_{n}").alias(f"_c_{n}") for n in sums],
    )
    stratum = Window.partitionBy(*_stratum(by))
    earlier = stratum.orderBy(direction(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        KEY,
        *[F.coalesce(F.sum(f"_c_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_c_{n}").over(stratum).alias(f"{n}_total") for n in sums],
    )
    upto = Window.partitionBy(KEY).orderBy(direction(order))
    same = Window.partitionBy(KEY, order)
    for n in sums:
        rows = rows.withColumn(f"{n}_tie", F.sum(f"_x_{n}").over(same)).withColumn(
            f"_u_{n}", F.sum(f"_x_{n}").over(upto)
        )
    rows = rows.join(offsets, KEY)
    for n in sums:
        rows = rows.withColumn(f"{n}_before", F.col(f"_o_{n}") + F.col(f"_u_{n}") - F.col(f"{n}_tie"))
    return rows.drop(*([] if keep_chunks else [KEY, CHUNK]), *[f"_{p}_{n}" for n in sums for p in "xuo"])


def rank_table(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """One row per stratum and distinct value: how often it occurs and its average rank.

    Equal values are counted before anything is ordered, so a value that fills a stratum is one row.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    scanned = prefix_sums(counted, by, value, {"_n": F.col("n")})
    rank = F.col("_n_before") + (F.col("n") + 1) / 2
    return scanned.select(*by, value, "n", rank.alias("rank"), F.col("_n_total").alias("size"))


def _ordered_near(counted: DataFrame, by: Sequence[str], value: str, size: Column, spots: Mapping) -> DataFrame:
    """The distinct values of the chunks that hold a wanted position, with the position they end at."""
    counted = counted.withColumn("_c", order_chunk(F.col(value)))
    x = F.col(value).cast("double")
    stratum = Window.partitionBy(*_stratum(by))
    chunks = (
        counted.groupBy(*by, "_c")
        .agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_held"), F.min(x).alias("_least"), F.max(x).alias("_most"))
        .withColumn("_listed", F.sum("_rows").over(stratum))
        .withColumn("_size", size)
        .withColumn("_end", F.sum("_rows").over(stratum.orderBy("_c")) + F.col("_size") - F.col("_listed"))
        .withColumn("_off", F.col("_end") - F.col("_rows"))
    )
    # the first chunk is kept so that a group of implicit zeros still has a row
    wanted = F.col("_off") == F.col("_size") - F.col("_listed")
    for _, lo, hi in spots.values():
        for k in (lo, hi):
            wanted = wanted | ((F.col("_off") < k) & (k <= F.col("_end")))
    chunks = chunks.where(wanted).drop("_rows", "_listed", "_end").withColumnsRenamed({c: f"_by_{c}" for c in [*by, "_c"]})
    same = F.lit(True)
    for c in [*by, "_c"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    rows = counted.join(chunks, same).drop(*[f"_by_{c}" for c in [*by, "_c"]])
    rows = running(rows, [*by, "_c"], value)
    return rows.withColumn("_at", F.col("_off") + F.col("_at"))


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    *,
    total: int | Column | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one row per group.

    Equal values are counted first; then only the chunks that hold a wanted order statistic are
    sorted. ``total`` declares that a group has that many values (a number, or an expression of the group's
    columns), the unlisted ones being zeros below all others (a sparse count matrix).
    """
    return quantiles_of_counts(value_counts(df, by, value), by, value, probs, total=total)


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Distinct values per group and how often each occurs (``_n``)."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))


def quantiles_of_counts(
    counted: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    *,
    total: int | Column | None = None,
) -> DataFrame:
    """:func:`quantiles` of a table made by :func:`value_counts`, which other summaries may share."""
    size = F.col("_listed") if total is None else (total if isinstance(total, Column) else F.lit(total)).cast("bigint")
    spots = {}
    for name, p in probs.items():
        h = (F.col("_size") - 1) * F.lit(float(p)) + 1
        spots[name] = (h, F.floor(h), F.ceil(h))
    rows = _ordered_near(counted, by, value, size, spots)
    held = []
    for name, (_, lo, hi) in spots.items():
        for tag, k in (("lo", lo), ("hi", hi)):
            inside = (F.col("_at") - F.col("_n") < k) & (k <= F.col("_at"))
            held.append(F.max(F.when(inside, F.col(value).cast("double"))).alias(f"_{tag}_{name}"))
    out = rows.groupBy(*by).agg(F.max("_size").alias("_size"), *held)
    for name, (h, lo, _) in spots.items():
        a, b = (F.coalesce(F.col(f"_{t}_{name}"), F.lit(0.0)) for t in ("lo", "hi"))
        out = out.withColumn(name, a + (h - lo) * (b - a))
    return out.select(*by, *probs)


def trim_bounds(df: DataFrame, by: Sequence[str], trims: Mapping[str, float]) -> DataFrame:
    """Per group and measure the structs ``<measure>_low`` and ``<measure>_high``: the values ``x`` on which the cuts
    fall that take that share of the group's values off either end by average rank, and whether they stay (``in``).
    ``<measure>_least`` and ``<measure>_most`` are the ends of all values.

    Chunks of all measures are counted in one pass; the values come back only for the chunks in which a cut falls.
    """
    names = list(trims)
    chunk = F.explode(F.array(*[F.struct(F.lit(i).alias("_w"), order_chunk(F.col(m)).alias("_c"), F.col(m).alias("_x")) for i, m in enumerate(names)]))
    held = df.select(*by, chunk.alias("_h")).groupBy(*by, F.col("_h._w").alias("_w"), F.col("_h._c").alias("_c"))
    held = held.agg(F.count(F.lit(1)).alias("_held"), F.min("_h._x").alias("_least"), F.max("_h._x").alias("_most"))
    stratum = Window.partitionBy(*by, "_w")
    cut = F.floor(F.col("_size") * F.element_at(F.array(*[F.lit(float(t)) for t in trims.values()]), F.col("_w") + 1)) + 1
    held = held.withColumns({
        "_size": F.sum("_held").over(stratum), "_lo": F.min("_least").over(stratum), "_hi": F.max("_most").over(stratum),
        "_end": F.sum("_held").over(stratum.orderBy("_c")),
    })
    held = held.withColumns({"_first": cut, "_last": F.col("_size") + 1 - cut, "_off": F.col("_end") - F.col("_held")})
    falls = [(F.col("_off") < F.col(k)) & (F.col(k) <= F.col("_end")) for k in ("_first", "_last")]
    held = held.where(falls[0] | falls[1]).withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    near = []
    for i, m in enumerate(names):
        some = df.select(*by, F.col(m).alias("_x"), order_chunk(F.col(m)).alias("_key"))
        near.append(some.join(held.where(F.col("_w") == i), same & (F.col("_key") == F.col("_c"))).drop("_key", *[f"_by_{c}" for c in by]))
    rows = near[0]
    for more in near[1:]:
        rows = rows.unionByName(more)
    kept = ["_first", "_last", "_off", "_held", "_least", "_most", "_lo", "_hi"]
    rows = rows.groupBy(*by, "_w", "_c", "_x").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in kept])
    rows = running(rows, [*by, "_w", "_c"], "_x")
    at = F.col("_off") + F.col("_at")
    rank = at - F.col("_n") + (F.col("_n") + 1) / 2
    bounds = []
    for i, m in enumerate(names):
        bounds += [F.max(F.when(F.col("_w") == i, F.col(c))).alias(f"{m}_{end}") for c, end in (("_lo", "least"), ("_hi", "most"))]
        for k, side, agg in (("_first", "low", F.min), ("_last", "high", F.max)):
            here = (F.col("_w") == i) & (F.col(k) > at - F.col("_n")) & (F.col(k) <= at)
            stays = rank >= F.col(k) if side == "low" else rank <= F.col(k)
            bounds.append(agg(F.when(here, F.struct(F.col("_x").alias("x"), stays.alias("in")))).alias(f"{m}_{side}"))
    return rows.groupBy(*by).agg(*bounds)


def number_levels(df: DataFrame, key: str, order: str, out: str = "level") -> DataFrame:
    """One row per key, numbered 1.. by the key's smallest ``order`` value, then by the key itself.

    The keys are range-partitioned and written, so that the ranges stay fixed; each range is numbered
    on its own and shifted by the sizes of the ranges before it.
    """
    keys = df.groupBy(key).agg(F.min(order).alias("_first"))
    ranged = durable(keys.repartitionByRange("_first", key).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_range", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_first", key))
    return ranged.withColumn("_i", inside).join(sizes, "_range").select(
        key, (F.col("_i") + F.col("_off")).cast("int").alias(out)
    )
