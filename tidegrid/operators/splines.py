"""Cubic-spline resampling of grids: coefficients by a recursive filter cut into blocks, values by equi-joins with the 4^d nearest coefficients."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pole of the filter that turns samples into coefficients of cubic B-splines.
POLE = math.sqrt(3) - 2
#: Samples further away than this weigh less than 1e-16 in a coefficient.
HALO = 28
BLOCK = 64
MODES = ("zero", "nearest", "reflect")


def basis(x: Column) -> Column:
    """The cubic B-spline at x; 0 from a distance of 2."""
    a = F.abs(x)
    far = F.greatest(2 - a, F.lit(0.0))
    return F.when(a < 1, 2 / 3 - a * a + a * a * a / 2).otherwise(far * far * far / 6)


def _along(cells: DataFrame, at: Sequence[str], axis: str, n: int) -> DataFrame:
    """cells(at, c) filtered along one axis of n positions, mirrored at both ends.

    A block of positions is a group; it gets the samples of its halo, mirrored ones among them, so neither
    a task nor an array holds a whole line. The weight of a sample falls as |POLE|^distance.
    """
    if n == 1:
        return cells
    rest, period = [a for a in at if a != axis], 2 * (n - 1)
    copies = -(-(n + HALO) // period)
    x = F.col(axis).cast("long")
    images = F.flatten(F.transform(F.sequence(F.lit(-copies), F.lit(copies)), lambda m: F.array(x + m * period, m * period - x)))
    images = F.filter(F.array_distinct(images), lambda p: (p >= -HALO) & (p < n + HALO))
    last = (n - 1) // BLOCK
    blocks = F.sequence(F.greatest(F.floor((F.col("__p") - HALO) / BLOCK), F.lit(0)), F.least(F.floor((F.col("__p") + HALO) / BLOCK), F.lit(last)))
    sent = cells.select(*rest, F.explode(images).alias("__p"), "c").select(*rest, "__p", "c", F.explode(blocks).alias("__block"))
    held = sent.groupBy(*rest, "__block").agg(F.sort_array(F.collect_list(F.struct("__p", "c"))).alias("__held"))
    weights = F.array(*[F.lit(math.sqrt(3) * POLE**d) for d in range(BLOCK + 2 * HALO)])
    low = F.col("__block") * BLOCK
    places = F.sequence(low, F.least(low + BLOCK - 1, F.lit(n - 1)))
    one = lambda p: F.aggregate("__held", F.lit(0.0), lambda s, e: s + e["c"] * F.get(weights, F.abs(p - e["__p"]).cast("int")))
    made = held.select(*rest, F.explode(F.transform(places, lambda p: F.struct(p.alias("p"), one(p).alias("c")))).alias("__e"))
    return made.select(*[F.col("__e.p").alias(a) if a == axis else F.col(a) for a in at], F.col("__e.c").alias("c"))


def coefficients(cells: DataFrame, at: Sequence[str], value: str, shape: Sequence[int]) -> DataFrame:
    """(at, c): spline coefficients of the grid of positions 0 to shape - 1, with mirrored ends.

    A cell without a row, or with a null or NaN value, counts as 0, so the result is dense along each line
    that holds a value. Cells outside the shape are left out; values of one cell add up. One shuffle an axis.
    """
    inside = reduce(lambda a, b: a & b, [F.col(a).between(0, n - 1) for a, n in zip(at, shape)])
    v = F.col(value).cast("double")
    now = cells.where(inside).select(*[F.col(a).cast("long").alias(a) for a in at], F.when(v.isNotNull() & ~F.isnan(v), v).alias("c"))
    now = now.dropna(subset=["c"]).groupBy(*at).agg(F.sum("c").alias("c"))
    for axis, n in zip(at, shape):
        now = _along(now, at, axis, n)
    return now


def _bounded(x: Column, n: int, mode: str) -> tuple[Column, Column]:
    """(position, weight) of a coordinate under the rule for what lies outside; the weight is null where there is no value."""
    if mode == "nearest":
        return F.greatest(F.least(x, F.lit(float(n - 1))), F.lit(0.0)), F.lit(1.0)
    if mode == "reflect":
        return x, F.when((x >= -(n - 1)) & (x <= 2 * (n - 1)), 1.0)
    weight = F.when((x < -1) | (x > n), F.lit(None)).when(x < 0, 1 + x).when(x > n - 1, n - x).otherwise(1.0)
    return F.greatest(F.least(x, F.lit(float(n - 1))), F.lit(0.0)), weight


def _nearest(x: Column, n: int) -> Column:
    """Array of struct(q, w): the four positions nearest to x on an axis of n, mirrored into it, and the basis there."""
    mirror = lambda q: F.lit(0).cast("long") if n == 1 else (n - 1) - F.abs(F.pmod(q, F.lit(2 * (n - 1))) - (n - 1))
    return F.transform(F.sequence(F.lit(-1), F.lit(2)), lambda s: F.struct(mirror(F.floor(x) + s).alias("q"), basis(x - F.floor(x) - s).alias("w")))


def sample(coefs: DataFrame, at: Sequence[str], shape: Sequence[int], points: DataFrame, keys: Sequence[str], coordinates: Sequence[Column], modes: Sequence[str] | str = "zero") -> DataFrame:
    """(keys, value): the spline at each point's coordinates, 0 outside.

    Modes, for each axis: "zero" fades to 0 within one step of the grid, "nearest" keeps the border's value,
    "reflect" mirrors the grid once on each side. The keys name a point; repeated ones are taken once. A
    coordinate that is null or NaN gives null.
    """
    modes = [modes] * len(at) if isinstance(modes, str) else list(modes)
    if len(modes) != len(at) or any(m not in MODES for m in modes):
        raise ValueError(f"a mode is one of {MODES}, one for each axis")
    xs = [F.col(f"__x{k}") for k in range(len(at))]
    p = points.select(*keys, *[x.cast("double").alias(f"__x{k}") for k, x in enumerate(coordinates)]).dropDuplicates(list(keys))
    known = reduce(lambda a, b: a & b, [x.isNotNull() & ~F.isnan(x) for x in xs])
    p = p.withColumn("__known", known)
    near = p.where("__known")
    for k, (n, mode) in enumerate(zip(shape, modes)):
        x, w = _bounded(xs[k], n, mode)
        near = near.withColumn(f"__w{k}", w).withColumn(f"__x{k}", x)
    near = near.dropna(subset=[f"__w{k}" for k in range(len(at))])
    # one axis after the other, so the expressions stay small in any number of dimensions
    sent = near.withColumn("__w", reduce(lambda a, b: a * b, [F.col(f"__w{k}") for k in range(len(at))]))
    for k, n in enumerate(shape):
        steps = _nearest(xs[k], n)
        sent = sent.withColumn("__e", F.explode(steps)).where("__e.w != 0").withColumns({"__w": F.col("__w") * F.col("__e.w"), f"__q{k}": F.col("__e.q")})
    sent = sent.select(*keys, *[f"__q{k}" for k in range(len(at))], "__w")
    grid = coefs.select(*[F.col(a).alias(f"__q{k}") for k, a in enumerate(at)], F.col("c").alias("__c"))
    met = sent.join(grid, [f"__q{k}" for k in range(len(at))])
    # points without any coefficient keep their row beside the parts of the others
    parts = met.select(*keys, (F.col("__w") * F.col("__c")).alias("__v")).unionByName(p.select(*keys, F.when(F.col("__known"), 0.0).alias("__v")))
    return parts.groupBy(*keys).agg(F.sum("__v").alias("value"))


def resample_cubic(cells: DataFrame, at: Sequence[str], value: str, shape: Sequence[int], targets: DataFrame, matrix: Sequence[Sequence[float]], shift: Sequence[float], modes: Sequence[str] | str = "zero") -> DataFrame:
    """(at, value): the grid's spline at matrix x position + shift of each target position, in the targets' coordinates."""
    coordinates = [reduce(lambda a, b: a + b, [F.lit(float(m)) * F.col(a) for m, a in zip(row, at)]) + F.lit(float(s)) for row, s in zip(matrix, shift)]
    return sample(coefficients(cells, at, value, shape), at, shape, targets, at, coordinates, modes)
