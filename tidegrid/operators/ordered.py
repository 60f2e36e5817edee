"""Ordered operators: distributed ranks, order statistics, time differences, step functions and false discovery rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stored

#: Ranges that the values of a unit are cut into, so that no task orders a whole unit.
RANGES = 64


def ranked(df: DataFrame, by: Sequence[str], x: str, tie: Sequence[str] = (), ranges: int = RANGES) -> DataFrame:
    """df with range, rank (from 1, in ascending x, then tie) and n within each unit; rows with a null x go.

    Approximate quantiles cut a unit into ranges, which are ordered apart; the counts of the ranges
    below are added. The cuts only balance the work: ranks are exact for any cuts. Approximate quantiles
    differ from run to run, with the order in which parts arrive, so the rows are written with their
    ranges: counts and places must come from the same cuts.
    """
    by = list(by)
    df = df.where(F.col(x).isNotNull())
    at = [i / ranges for i in range(1, ranges)]
    cuts = df.groupBy(*by).agg(F.percentile_approx(x, at, 1000).alias("__cuts"), F.count("*").alias("n"))
    placed = stored(_on(df, cuts, by).withColumn("range", F.size(F.filter("__cuts", lambda c: c < F.col(x)))).drop("__cuts"), "ranges")
    counts = placed.groupBy(*by, "range").agg(F.count("*").alias("__rows"))
    below = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "range", F.coalesce(F.sum("__rows").over(below), F.lit(0)).alias("__below"))
    inside = Window.partitionBy(*by, "range").orderBy(x, *tie)
    return placed.withColumn("__at", F.row_number().over(inside)).join(offsets, [*by, "range"]).withColumn("rank", F.col("__at") + F.col("__below")).drop("__at", "__below")


def _on(df: DataFrame, small: DataFrame, by: list[str]) -> DataFrame:
    """Joins a row per unit; without units, the one row there is."""
    return df.join(small, by) if by else df.join(F.broadcast(small))


def quantile(df: DataFrame, by: Sequence[str], x: str, q: float, interpolate: bool = True, name: str = "quantile") -> DataFrame:
    """(by, name): an exact order statistic of each unit, from distributed ranks.

    Interpolated: linear at q x (n - 1). Else the element at index ceil(q x n) from 0, and infinity when that is n.
    """
    r = ranked(df.select(*by, x), by, x)
    n = F.col("n")
    if not interpolate:
        at = F.ceil(F.lit(q) * n)
        picked = r.groupBy(*by).agg(F.max(F.when(F.col("rank") == at + 1, F.col(x))).alias("__v"), F.max("n").alias("n"))
        return picked.select(*by, F.when(F.ceil(F.lit(q) * n) >= n, F.lit(float("inf"))).otherwise(F.col("__v")).alias(name))
    pos = F.lit(q) * (n - 1)
    low = F.floor(pos)
    near = r.where((F.col("rank") == low + 1) | (F.col("rank") == low + 2))
    ends = near.groupBy(*by).agg(F.min_by(x, "rank").alias("__a"), F.max_by(x, "rank").alias("__b"), F.max("n").alias("n"))
    return ends.select(*by, (F.col("__a") + (F.col("__b") - F.col("__a")) * (pos - low)).alias(name))


def ecdf(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """df with ecdf, the share of a unit's values strictly below x."""
    r = ranked(df, by, x)
    least = r.groupBy(*by, x).agg(F.min("rank").alias("__first"))
    return r.join(least, [*by, x]).withColumn("ecdf", (F.col("__first") - 1) / F.col("n")).drop("__first", "range", "rank", "n")


def bh_fdr(df: DataFrame, by: Sequence[str], p: str, tie: Sequence[str] = ()) -> DataFrame:
    """df with q, the Benjamini-Hochberg value: min(1, n p / rank), made monotone from the largest p down."""
    by = list(by)
    r = ranked(df, by, p, tie).withColumn("__raw", F.least(F.lit(1.0), F.col("n") * F.col(p) / F.col("rank")))
    lows = r.groupBy(*by, "range").agg(F.min("__raw").alias("__low"))
    after = Window.partitionBy(*by).orderBy("range").rowsBetween(1, Window.unboundedFollowing)
    lows = lows.select(*by, "range", F.min("__low").over(after).alias("__later"))
    inside = Window.partitionBy(*by, "range").orderBy("rank").rowsBetween(0, Window.unboundedFollowing)
    return r.withColumn("__here", F.min("__raw").over(inside)).join(lows, [*by, "range"]).withColumn("q", F.least("__here", "__later")).drop("__raw", "__here", "__later", "range")


def fdr_threshold(df: DataFrame, by: Sequence[str], p: str, alpha: float) -> DataFrame:
    """(by, threshold): the largest p strictly under alpha x rank / n, else alpha / n."""
    r = ranked(df, by, p)
    found = r.groupBy(*by).agg(F.max(F.when(F.col(p) < F.lit(alpha) * F.col("rank") / F.col("n"), F.col(p))).alias("__p"), F.max("n").alias("n"))
    return found.select(*by, F.coalesce("__p", F.lit(alpha) / F.col("n")).alias("threshold"))


def bonferroni(p: Column, n: Column) -> Column:
    return F.least(F.lit(1.0), p * n)


def squared_diffs(df: DataFrame, voxel: Sequence[str], t: str, y: str) -> DataFrame:
    """df with d2, the squared difference to the row before in t of the same voxel; null for its first row."""
    return df.withColumn("d2", F.pow(F.col(y) - F.lag(y).over(Window.partitionBy(*voxel).orderBy(t)), 2))


def time_slice_diffs(df: DataFrame, voxel: Sequence[str], slice_: str, t: str, y: str) -> dict[str, DataFrame]:
    """The five results of a time-difference screen over (voxel, slice, t, y).

    volume_means(t), volume_mean_diff2(t), slice_mean_diff2(t, slice), diff2_mean_vol(voxel, slice) and
    slice_diff2_max_vol(voxel, slice): the squared difference at the time when its slice's mean is largest.
    """
    d = squared_diffs(df, [*voxel, slice_], t, y)
    real = d.where(F.col("d2").isNotNull())
    slices = real.groupBy(t, slice_).agg(F.avg("d2").alias("mean_diff2"))
    peak = slices.groupBy(slice_).agg(F.max_by(t, F.struct(F.col("mean_diff2"), -F.col(t))).alias(t))
    return {
        "volume_means": df.groupBy(t).agg(F.avg(y).alias("mean")),
        "volume_mean_diff2": real.groupBy(t).agg(F.avg("d2").alias("mean_diff2")),
        "slice_mean_diff2": slices,
        "diff2_mean_vol": real.groupBy(*voxel, slice_).agg(F.avg("d2").alias("mean_diff2")),
        "slice_diff2_max_vol": real.join(peak, [slice_, t]).select(*voxel, slice_, F.col("d2").alias("max_diff2")),
    }


def step_function(points: DataFrame, knots: DataFrame, by: Sequence[str], t: str, value: str, fill: float | None = None, strict: bool = False, bucket: int | None = None) -> DataFrame:
    """points with the value of the last knot at or before t (strict: before), else fill: an as-of join.

    Both sides are put in one order per unit, and the last knot is carried forward. With bucket, time is
    cut into ranges of that width, ordered apart, and each range starts from the last knot of those before it.
    """
    by = list(by)
    width = F.floor(F.col(t).cast("double") / bucket) if bucket else F.lit(0)
    side = lambda df, knot: df.withColumn("__knot", F.lit(knot)).withColumn("__range", width)
    a = side(points, 1 if not strict else 0)
    own = side(knots.select(*by, t, F.struct(F.col(value).alias("v")).alias("__v")), 0 if not strict else 1)
    last = own.groupBy(*by, "__range").agg(F.max_by("__v", t).alias("__last"))
    ranges = a.select(*by, "__range").distinct().withColumn("__last", F.lit(None).cast(last.schema["__last"].dataType))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.unionByName(ranges).groupBy(*by, "__range").agg(F.first("__last", ignorenulls=True).alias("__last"))
    carried = carried.select(*by, "__range", F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    both = a.withColumn("__v", F.lit(None).cast(own.schema["__v"].dataType)).withColumn("__point", F.lit(True)).unionByName(own.withColumn("__point", F.lit(False)), allowMissingColumns=True)
    upto = Window.partitionBy(*by, "__range").orderBy(t, "__knot").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("__held", F.last("__v", ignorenulls=True).over(upto)).where("__point").join(carried, [*by, "__range"], "left")
    found = F.coalesce(F.col("__held"), F.col("__carried"))["v"]
    kept = F.when(F.coalesce(F.col("__held"), F.col("__carried")).isNull(), F.lit(fill)).otherwise(found)
    return held.withColumn(value, kept).select(*points.columns, value)


def linear_interp(points: DataFrame, knots: DataFrame, by: Sequence[str], t: str, value: str, fill: float | None = None) -> DataFrame:
    """points with value, interpolated between the knots around t; fill outside their span."""
    by = list(by)
    lo = step_function(points, knots.withColumn("__lo", F.struct(t, value)), by, t, "__lo")
    knots_back = knots.withColumn("__hi", F.struct(t, value)).withColumn(t, -F.col(t))
    hi = step_function(lo.withColumn(t, -F.col(t)), knots_back, by, t, "__hi").withColumn(t, -F.col(t))
    x0, y0, x1, y1 = F.col("__lo")[t], F.col("__lo")[value], F.col("__hi")[t], F.col("__hi")[value]
    line = F.when(x0 == x1, y0).otherwise(y0 + (y1 - y0) * (F.col(t) - x0) / (x1 - x0))
    return hi.withColumn(value, F.when(x0.isNull() | x1.isNull(), F.lit(fill)).otherwise(line)).drop("__lo", "__hi")


def boxcar(events: DataFrame, grid: DataFrame, by: Sequence[str], onset: str, offset: str, amplitude: str, t: str) -> DataFrame:
    """grid(by, t) with level: amplitudes switched on at onset and off at offset, summed cumulatively.

    Of several events of a unit that switch at one time the one of largest amplitude counts.
    """
    by = list(by)
    on = events.groupBy(*by, F.col(onset).alias(t)).agg(F.max(amplitude).alias("__d"))
    off = events.groupBy(*by, F.col(offset).alias(t)).agg(F.max(amplitude).alias("__d")).withColumn("__d", -F.col("__d"))
    changes = on.union(off).groupBy(*by, t).agg(F.sum("__d").alias("__d"))
    # a switch at a time that the grid lacks still counts at the grid's later times
    both = changes.withColumn("__on_grid", F.lit(False)).unionByName(grid.select(*by, t).withColumn("__d", F.lit(0.0)).withColumn("__on_grid", F.lit(True)))
    w = Window.partitionBy(*by).orderBy(t)
    return both.withColumn("level", F.sum("__d").over(w)).where("__on_grid").select(*by, t, "level")


def whiten(df: DataFrame, by: Sequence[str], t: str, y: str, rho: str) -> DataFrame:
    """df with white: y minus rho times the y before; the first row of a unit stays."""
    return df.withColumn("white", F.col(y) - F.col(rho) * F.coalesce(F.lag(y).over(Window.partitionBy(*by).orderBy(t)), F.lit(0.0)))
