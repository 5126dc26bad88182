"""Robust locally weighted regression, as a few aggregates over all points.

Fits are made at anchors about one hundredth of the range apart and interpolated between them, so
each pass sums five moments per anchor; no task ever holds all points. Where the anchors lie, and how
far each reaches, are order statistics of the points. They are found exactly: the driver knows the
points as ascending ranges with counts, and asks Spark for the inside of just those ranges in which
an answer may lie, until nothing is open. It holds at most about ``HELD`` numbers, whatever the number
of points.

All functions work on any number of groups at once (``by``), which share the jobs. Groups are levels,
like stages: what is known of each lies on the driver.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.session import durable

#: Values or ranges that one question to Spark may bring back.
HELD = 1 << 18
#: Equal steps into which the range of a curve is cut for reading it off.
STEPS = 128


def per_group(by: str | None, values: dict) -> Column:
    """The value of each row's group; without groups the single one."""
    if by is None:
        return F.lit(values[None])
    out = None
    for group, value in values.items():
        same = F.col(by).eqNullSafe(F.lit(group))
        out = F.when(same, F.lit(value)) if out is None else out.when(same, F.lit(value))
    return out if out is not None else F.lit(None).cast("double")


def _array(numbers: np.ndarray) -> Column:
    """A literal array, written as one text: a literal per number would be a call per number."""
    return F.expr("cast(split('" + ",".join(repr(float(v)) for v in numbers) + "', ',') as array<double>)")


# ---- reading a curve off ------------------------------------------------------------------------


@dataclass
class Curves:
    """A piecewise linear curve per group, constant beyond its ends."""

    by: str | None
    knots: dict = field(default_factory=dict)
    values: dict = field(default_factory=dict)

    def at(self, x: Column) -> Column:
        """The curve of each row's group at ``x``.

        The range is cut into equal steps. A step holds few knots, so the curve inside it is its value and
        slope at the step's beginning, plus a change of slope from each knot on: a few array look-ups.
        """
        tables = [_steps(k, v) for k, v in zip(self.knots.values(), self.values.values(), strict=True)]
        if not tables:
            return F.lit(None).cast("double")
        bends = max(t["knot"].shape[1] for t in tables)
        group = list(self.knots)
        low = per_group(self.by, {g: float(k[0]) for g, k in self.knots.items()})
        high = per_group(self.by, {g: float(k[-1]) for g, k in self.knots.items()})
        scale = per_group(self.by, {g: float(t["scale"]) for g, t in zip(group, tables, strict=True)})
        first = per_group(self.by, {g: i * STEPS for i, g in enumerate(group)})
        x = F.greatest(F.least(x, high), low)
        step = F.greatest(F.least(F.floor((x - low) * scale), F.lit(STEPS - 1)), F.lit(0))
        place = (first + step + 1).cast("int")

        def pick(name: str, j: int | None = None) -> Column:
            parts = [t[name] if j is None else _column(t[name], j) for t in tables]
            return F.element_at(_array(np.concatenate(parts)), place)

        out = pick("value") + pick("slope") * (x - pick("edge"))
        for j in range(bends):
            out = out + pick("bend", j) * F.greatest(x - pick("knot", j), F.lit(0.0))
        return out


def _column(table: np.ndarray, j: int) -> np.ndarray:
    return table[:, j] if j < table.shape[1] else np.zeros(len(table))


def _steps(knots: np.ndarray, values: np.ndarray) -> dict[str, np.ndarray]:
    """Per step: where it begins, value and slope there, and the knots inside with their changes of slope."""
    low, high = float(knots[0]), float(knots[-1])
    if len(knots) == 1 or not high > low:
        flat = np.zeros(STEPS)
        return {"scale": 0.0, "edge": flat + low, "value": flat + values[0], "slope": flat, "knot": np.zeros((STEPS, 0)), "bend": np.zeros((STEPS, 0))}
    edges = low + (high - low) * np.arange(STEPS) / STEPS
    slopes = np.diff(values) / np.diff(knots)
    part = np.clip(np.searchsorted(knots, edges, "right") - 1, 0, len(slopes) - 1)
    inner = knots[1:-1]
    step = np.clip(np.searchsorted(edges, inner, "left") - 1, 0, STEPS - 1)  # a knot on an edge bends the step before, by nothing
    rank = np.arange(len(inner)) - np.searchsorted(step, step) if len(inner) else step
    most = int(rank.max()) + 1 if len(inner) else 0
    knot, bend = np.full((STEPS, most), high), np.zeros((STEPS, most))
    knot[step, rank], bend[step, rank] = inner, np.diff(slopes)
    return {"scale": STEPS / (high - low), "edge": edges, "value": np.interp(edges, knots, values), "slope": slopes[part], "knot": knot, "bend": bend}


# ---- exact order statistics of points on a line ---------------------------------------------------


@dataclass
class Ranges:
    """One group's points: ascending ranges from ``a`` to ``z`` that hold ``n`` points, both ends among them.

    A range whose ends are equal is one value, and known.
    """

    a: np.ndarray
    z: np.ndarray
    n: np.ndarray
    name: np.ndarray

    @property
    def open(self) -> np.ndarray:
        return self.a < self.z

    def replaced(self, gone: np.ndarray, a: np.ndarray, z: np.ndarray, n: np.ndarray, name: np.ndarray) -> Ranges:
        stay = np.ones(len(self.a), bool)
        stay[gone] = False
        a, z, n, name = (np.concatenate([x[stay], y]) for x, y in ((self.a, a), (self.z, z), (self.n, n), (self.name, name)))
        # a range of two points is two values
        pair = (n == 2) & (a < z) & np.isfinite(a)
        a, z, n, name = np.concatenate([a, z[pair]]), np.concatenate([np.where(pair, a, z), z[pair]]), np.concatenate([np.where(pair, 1, n), n[pair] - 1]), np.concatenate([name, name[pair]])
        order = np.argsort(a, kind="stable")
        return Ranges(a[order], z[order], n[order], name[order])


class Line:
    """All groups' points, known as closely as questions have asked for."""

    def __init__(self, points: DataFrame, by: str | None, x: str, held: int = HELD, sizes: dict | None = None):
        """``sizes``: the groups' numbers of points, where they are known; then the ends are only asked for if all
        points are too many to be fetched."""
        self.by, self.held, self.asked = by, held, 0
        keys = [by] if by else []
        self.rows = points.select(*keys, F.col(x).cast("double").alias("_x"), F.lit("").alias("_in"))
        self.mean: dict = {}
        if sizes and sum(sizes.values()) <= held * len(sizes):
            ends = {g: (n, -math.inf, math.inf) for g, n in sizes.items() if n}
        else:
            found = self.rows.where(F.col("_x").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.avg("_x").alias("m")).collect()
            self.mean = {(r[by] if by else None): r["m"] for r in found}
            ends = {(r[by] if by else None): (r["n"], r["lo"], r["hi"]) for r in found if r["n"]}
        empty = Ranges(np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, object))
        gone = np.zeros(0, int)
        self.groups: dict = {g: empty.replaced(gone, np.array([lo]), np.array([hi]), np.array([n]), np.array([""], object)) for g, (n, lo, hi) in ends.items()}
        if not self.mean:
            self.look_into({g: np.flatnonzero(r.open) for g, r in self.groups.items()})
            self.mean = {g: float((r.a * r.n).sum() / r.n.sum()) for g, r in self.groups.items()}

    def look_into(self, wanted: dict) -> None:
        """Find out what lies in some open ranges: their values, or finer ranges where these are too many."""
        wanted = {g: np.unique(i) for g, i in wanted.items() if len(i)}
        places = [(g, int(i)) for g, indices in wanted.items() for i in indices]
        if not places:
            return
        total = sum(int(self.groups[g].n[i]) for g, i in places)
        parts = None if total <= self.held * len(wanted) else max(2, self.held * len(wanted) // len(places))
        kind = self.rows.schema[self.by].dataType.simpleString() if self.by else "int"
        table = []
        for g, i in places:
            r = self.groups[g]
            table.append((g if self.by else 0, r.name[i], str(self.asked), float(r.a[i]), float(r.z[i])))
            self.asked += 1
        asked = self.rows.sparkSession.createDataFrame(table, f"_g {kind}, _name string, _as string, _a double, _z double")
        same = (F.col("_in") == F.col("_name")) & F.col("_x").between(F.col("_a"), F.col("_z"))
        if self.by:
            same = same & F.col(self.by).eqNullSafe(F.col("_g"))
        part = F.floor((F.col("_x") - F.col("_a")) / (F.col("_z") - F.col("_a")) * F.lit(parts or 1))
        cut = F.least(part, F.lit((parts or 1) - 1)).cast("string")
        name = F.concat(F.col("_as"), F.lit("/"), cut)
        rows = self.rows.join(asked, same)
        seen = rows.groupBy("_g", (F.col("_x") if parts is None else name).alias("_key"))
        seen = seen.agg(F.min("_x").alias("a"), F.max("_x").alias("z"), F.count(F.lit(1)).alias("n")).toPandas()
        for g, indices in wanted.items():
            mine = seen if not self.by else seen[seen["_g"].isna() if g is None else seen["_g"] == g]
            names = np.full(len(mine), "", object) if parts is None else mine["_key"].to_numpy(object)
            self.groups[g] = self.groups[g].replaced(indices, mine["a"].to_numpy(float), mine["z"].to_numpy(float), mine["n"].to_numpy(np.int64), names)
        if parts is not None:  # the rows take the names of their new ranges
            placed = self.rows.join(asked, same, "left")
            placed = placed.withColumn("_in", F.when(F.col("_name").isNull(), F.col("_in")).otherwise(name))
            self.rows = durable(placed.select(*[F.col(c) for c in [self.by] if c], "_x", "_in"))


def _answer(line: Line, groups: list, ask: Callable[[object], tuple[object, np.ndarray]]) -> dict:
    """``ask(group)`` gives an answer and the ranges that stand in its way; repeated until none does."""
    out: dict = {}
    while len(out) < len(groups):
        wanted = {}
        for g in groups:
            if g not in out:
                answer, needed = ask(g)
                if len(needed):
                    wanted[g] = needed
                else:
                    out[g] = answer
        line.look_into(wanted)
    return out


def _walk(r: Ranges, delta: float, held: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors: each is the farthest point within ``delta`` of the last one, or else the next point.

    Gives the anchors, and the open ranges on which they depend as far as can be told: while a position
    is only known to lie between two bounds, so is the next one.
    """
    a, z, closed = r.a, r.z, ~r.open
    picked, p0, p1 = [a[0]], a[0], a[0]
    needed: list[np.ndarray] = []
    total = 0
    while True:
        c0, c1 = p0 + delta, p1 + delta
        i0, i1 = int(np.searchsorted(a, c0, "right")) - 1, int(np.searchsorted(a, c1, "right")) - 1
        doubtful = np.arange(i0, i1 + 1)
        doubtful = doubtful[~closed[i0 : i1 + 1] & (z[i0 : i1 + 1] > c0)]
        low = z[i0] if z[i0] <= c0 else a[i0]
        high = z[i1] if z[i1] <= c1 else c1
        if high <= p1:  # nothing within reach: the next point, if there is one
            if i1 + 1 >= len(a):
                break
            high = a[i1 + 1]
        if p0 == p1 and not len(doubtful):
            low = high
            picked.append(low)
        elif len(doubtful):
            total += int(r.n[doubtful].sum())
            if needed and total > held:
                break
            needed.append(doubtful)
        low = max(low, p0)
        if low == p0 and high == p1:
            break
        p0, p1 = low, high
    return np.array(picked), np.concatenate(needed) if needed else np.zeros(0, int)


def _reach(r: Ranges, anchors: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Distance from each anchor to its q-th nearest point, and the open ranges in which it may lie."""
    reach, needed = np.zeros(len(anchors)), []
    for i, at in enumerate(anchors):
        near = np.maximum(np.maximum(r.a - at, at - r.z), 0)
        far = np.maximum(np.abs(r.a - at), np.abs(r.z - at))
        least, most = _nth(near, r.n, q), _nth(far, r.n, q)
        reach[i] = most
        needed.append(np.flatnonzero(r.open & (near < most) & (far > least)))
    return reach, np.unique(np.concatenate(needed))


def middles(line: Line) -> dict:
    """The median of each group."""
    return _answer(line, list(line.groups), lambda g: _middle(line.groups[g]))


def _middle(r: Ranges) -> tuple[float, np.ndarray]:
    upto = np.cumsum(r.n)
    total, found, needed = int(upto[-1]), [], []
    for k in ((total + 1) // 2, total // 2 + 1):
        i = int(np.searchsorted(upto, k))
        least, most = k == upto[i] - r.n[i] + 1, k == upto[i]
        if r.a[i] < r.z[i] and not (least or most):
            needed.append(i)
        found.append(float(r.a[i] if least else r.z[i]))
    return (found[0] + found[1]) / 2, np.array(needed, int)


def _nth(distance: np.ndarray, n: np.ndarray, q: int) -> float:
    order = np.argsort(distance, kind="stable")
    return float(distance[order][np.searchsorted(np.cumsum(n[order]), q)])


# ---- the smoother -----------------------------------------------------------------------------------


def _anchor_table(by: str | None, knots: dict, reach: dict) -> Column:
    """An array of (i, a, h) per row: the anchors of the row's group."""
    rows = {g: [{"i": i, "a": float(a), "h": float(h)} for i, (a, h) in enumerate(zip(knots[g], reach[g], strict=True))] for g in knots}
    every = F.expr("from_json('" + json.dumps(list(rows.values())) + "', 'array<array<struct<i:int,a:double,h:double>>>')")
    return F.element_at(every, per_group(by, {g: i + 1 for i, g in enumerate(rows)}))


def lowess(df: DataFrame, *, span: float = 0.5, rounds: int = 3, by: str | None = None, held: int = HELD) -> Curves:
    """The smooth of y on x of each group, from a written table with columns x and y."""
    keys = [by] if by else []
    line = Line(df, by, "x", held)
    size = {g: int(r.n.sum()) for g, r in line.groups.items()}
    low = {g: float(r.a[0]) for g, r in line.groups.items()}
    wide = {g: float(r.z[-1] - r.a[0]) for g, r in line.groups.items()}
    curves = Curves(by)
    live = [g for g in size if size[g] > 1 and wide[g] > 0]
    if len(live) < len(size):
        means = {(r[by] if by else None): r["y"] for r in df.groupBy(*keys).agg(F.avg("y").alias("y")).collect()}
        for g in size:
            if g not in live:
                curves.knots[g], curves.values[g] = np.array([low[g]]), np.array([means[g]], float)
    if not live:
        return curves
    q = {g: max(min(int(span * size[g] + 1e-7), size[g]), 2) for g in live}
    knots = _answer(line, live, lambda g: _walk(line.groups[g], 0.01 * wide[g], held))
    reach = _answer(line, live, lambda g: _reach(line.groups[g], knots[g], q[g]))
    table = _anchor_table(by, knots, reach)
    rows = df.withColumn("rw", F.lit(1.0))
    open_groups = set(live)
    for step in range(rounds + 1):
        near = F.filter(table, lambda s: F.abs(F.col("x") - s["a"]) <= 0.999 * s["h"])
        u, h = F.col("x") - F.col("_s.a"), F.col("_s.h")
        cube = F.pow(1 - F.pow(F.abs(u) / h, F.lit(3.0)), F.lit(3.0))
        w = F.when(F.abs(u) <= 0.001 * h, F.lit(1.0)).otherwise(cube) * F.col("rw")
        local = rows.select(*keys, "x", "y", "rw", F.explode(near).alias("_s")).select(
            *keys, F.col("_s.i").alias("i"), u.alias("u"), "y", w.alias("w")
        )
        sums = local.groupBy(*keys, "i").agg(
            F.sum("w").alias("w"),
            F.sum(F.col("w") * F.col("u")).alias("u"),
            F.sum(F.col("w") * F.col("u") * F.col("u")).alias("uu"),
            F.sum(F.col("w") * F.col("y")).alias("y"),
            F.sum(F.col("w") * F.col("u") * F.col("y")).alias("uy"),
        ).toPandas()
        for g in open_groups:
            mine = sums if by is None else sums[sums[by].isna() if g is None else sums[by] == g]
            curves.knots[g] = knots[g]
            curves.values[g] = _fit(mine.set_index("i").reindex(range(len(knots[g]))), knots[g], wide[g])
        if step == rounds:
            break
        resid = df.withColumn("_e", F.abs(F.col("y") - Curves(by, {g: curves.knots[g] for g in live}, {g: curves.values[g] for g in live}).at(F.col("x"))))
        scale = _scales(resid, by, {g: size[g] for g in live})
        # where the curve meets all points as well as numbers can tell, it stays
        open_groups = {g for g in open_groups if scale[g][0] >= 1e-7 * scale[g][1] and scale[g][0] > 0}
        if not open_groups:
            break
        r = F.col("_e") / per_group(by, {g: float(scale[g][0]) if g in open_groups else 1.0 for g in live})
        bi = F.when(r <= 0.001, 1.0).when(r <= 0.999, F.pow(1 - r * r, F.lit(2.0))).otherwise(0.0)
        rows = resid.withColumn("rw", bi).drop("_e")
    return curves


def _scales(resid: DataFrame, by: str | None, sizes: dict) -> dict:
    """Per group six times the median residual, and the mean one."""
    line = Line(resid, by, "_e", sizes=sizes)
    return {g: (6 * m, line.mean[g]) for g, m in middles(line).items()}


def _fit(sums, knots: np.ndarray, wide: float) -> np.ndarray:
    """Local lines at the anchors, from their moments."""
    mass = sums["w"].to_numpy(float)
    ok = mass > 0
    safe = np.where(ok, mass, 1.0)
    a, ybar = sums["u"].to_numpy() / safe, sums["y"].to_numpy() / safe
    c = sums["uu"].to_numpy() / safe - a * a
    steep = np.sqrt(np.maximum(c, 0)) > 0.001 * wide
    slope = np.where(steep, (sums["uy"].to_numpy() / safe - a * ybar) / np.where(steep, c, 1.0), 0.0)
    fitted = ybar - a * slope
    return np.interp(knots, knots[ok], fitted[ok])
