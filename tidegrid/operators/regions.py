"""Regions and stencils: smoothing, features of regions, intrinsic volumes, resampling, and small aggregations over grids."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stored
from .components import connected_components
from .grid import neighbours
from .ordered import quantile, ranked


def smooth(cells: DataFrame, at: Sequence[str], value: str, sigma: float, reach: int | None = None) -> DataFrame:
    """cells(at, value) smoothed by a Gaussian, cut off at `reach` cells (4 sigma); weights are renormalised over the cells that exist and aren't null or NaN.

    One axis after the other, so a cell is copied 2 x reach + 1 times an axis, not by their product; weights and weighted sums are carried apart.
    """
    r = math.ceil(4 * sigma) if reach is None else reach
    x = F.col(value).cast("double")
    good = x.isNotNull() & ~F.isnan(x)
    now = cells.select(*at, F.when(good, x).otherwise(0.0).alias("__s"), F.when(good, 1.0).otherwise(0.0).alias("__w"))
    for axis in at:
        steps = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(math.exp(-(d**2) / (2 * sigma**2))).alias("k")) for d in range(-r, r + 1)])
        moved = now.withColumn("__step", F.explode(steps)).select(*[(F.col(c) + F.col("__step.d") if c == axis else F.col(c)).alias(c) for c in at], (F.col("__s") * F.col("__step.k")).alias("__s"), (F.col("__w") * F.col("__step.k")).alias("__w"))
        now = moved.groupBy(*at).agg(F.sum("__s").alias("__s"), F.sum("__w").alias("__w"))
    return cells.select(*at).join(now, list(at)).select(*at, F.try_divide("__s", "__w").alias(value))


def chains(dims: int) -> list[list[tuple[int, ...]]]:
    """The simplices of a grid cut into triangles, by their least corner: chains of corners of the unit cube from its origin, each above the one before."""
    corners = sorted(itertools.product((0, 1), repeat=dims), key=sum)
    above = lambda a, b: a != b and all(x <= y for x, y in zip(a, b))
    out, front = [], [[corners[0]]]
    while front:
        out += front
        front = [[*c, v] for c in front for v in corners if above(c[-1], v)]
    return out


def simplex_counts(cells: DataFrame, at: Sequence[str]) -> DataFrame:
    """(simplex, n): how often each simplex of chains() has all its corners in the mask."""
    shapes = chains(len(at))
    c = cells.select(*at).distinct()
    spots = F.array(*[F.struct(F.lit(k).alias("simplex"), *[(F.col(x) - d).alias(x) for x, d in zip(at, v)]) for k, s in enumerate(shapes) for v in s])
    size = F.element_at(F.array(*[F.lit(len(s)) for s in shapes]), F.col("simplex") + 1)
    whole = c.select(F.inline(spots)).groupBy("simplex", *at).agg(F.count("*").alias("n")).where(F.col("n") == size)
    return whole.groupBy("simplex").agg(F.count("*").alias("n"))


def euler(cells: DataFrame, at: Sequence[str]) -> DataFrame:
    """(ec): the Euler characteristic of the mask, in any number of dimensions."""
    signs = F.array(*[F.lit((-1) ** (len(s) - 1)) for s in chains(len(at))])
    return simplex_counts(cells, at).agg(F.coalesce(F.sum(F.col("n") * F.element_at(signs, F.col("simplex") + 1)), F.lit(0)).alias("ec"))


def _mu(points: np.ndarray) -> list[float]:
    """Intrinsic volumes of one simplex of up to four corners, from 0 on."""
    n = len(points) - 1
    length = lambda a, b: float(np.linalg.norm(points[a] - points[b]))
    if n == 0:
        return [1.0]
    if n == 1:
        return [1.0, length(0, 1)]
    area = lambda a, b, c: float(np.sqrt(max(0.0, np.linalg.det(m @ m.T))) / 2) if (m := np.array([points[b] - points[a], points[c] - points[a]])) is not None else 0.0
    if n == 2:
        return [1.0, (length(0, 1) + length(0, 2) + length(1, 2)) / 2, area(0, 1, 2)]
    edges = np.array([p - points[0] for p in points[1:]])
    one = 0.0
    for a, b in itertools.combinations(range(4), 2):
        c, d = (k for k in range(4) if k not in (a, b))
        axis = (points[b] - points[a]) / length(a, b)
        u, v = (w - (w @ axis) * axis for w in (points[c] - points[a], points[d] - points[a]))
        # the outer angle at the edge
        one += length(a, b) * (math.pi - math.acos(max(-1.0, min(1.0, float(u @ v / np.linalg.norm(u) / np.linalg.norm(v)))))) / (2 * math.pi)
    return [1.0, one, sum(area(*t) for t in itertools.combinations(range(4), 3)) / 2, abs(float(np.linalg.det(edges))) / 6]


def intrinsic_volumes(cells: DataFrame, at: Sequence[str], spacing: Sequence[float] | None = None) -> DataFrame:
    """(mu0, mu1, ...): intrinsic volumes of the mask on a grid with these spacings. On a regular grid each simplex has constant volumes, so counts are all that is aggregated."""
    dims = len(at)
    if dims > 3:
        raise ValueError("up to three dimensions")
    step = np.array(spacing or [1.0] * dims)
    table = [_mu(np.array(s) * step) + [0.0] * dims for s in chains(dims)]
    sign = [(-1) ** (len(s) - 1) for s in chains(dims)]
    weight = lambda k: F.element_at(F.array(*[F.lit(float(g * t[k] * (-1) ** k)) for g, t in zip(sign, table)]), F.col("simplex") + 1)
    return simplex_counts(cells, at).agg(*[F.coalesce(F.sum(F.col("n") * weight(k)), F.lit(0.0)).alias(f"mu{k}") for k in range(dims + 1)])


def region_features(df: DataFrame, by: Sequence[str], x: str, weight: str | None = None) -> DataFrame:
    """(by, n, mean, weighted, min, max, median, quality) of each region, null and NaN left out; quality is the share of rows that count."""
    by = list(by)
    v = F.col(x).cast("double")
    v = F.when(~F.isnan(v), v)
    w = F.col(weight) if weight else F.lit(1.0)
    rows = df.withColumn("__v", v)
    sums = rows.groupBy(*by).agg(F.count("__v").alias("n"), F.avg("__v").alias("mean"), F.try_divide(F.sum(w * F.col("__v")), F.sum(F.when(F.col("__v").isNotNull(), w))).alias("weighted"), F.min("__v").alias("min"), F.max("__v").alias("max"), (F.count("__v") / F.count("*")).alias("quality"))
    return sums.join(quantile(rows, by, "__v", 0.5, name="median"), by, "left") if by else sums.join(F.broadcast(quantile(rows, by, "__v", 0.5, name="median")))


def dense_histogram(df: DataFrame, x: str) -> DataFrame:
    """(bin, n) of whole numbers from 0 to their maximum, empty bins too."""
    n = df.where(F.col(x) >= 0).groupBy(F.col(x).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    n = stored(n, "bins")
    top = n.agg(F.max("bin")).first()[0]
    every = df.sparkSession.range(0 if top is None else top + 1).select(F.col("id").alias("bin"))
    return every.join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_reproducibility(hist: DataFrame, bin_: str = "bin", n: str = "n") -> DataFrame:
    """(score) of counts by how many of k groups found a cell, k the last bin: sum of n b (b - 1) over k (k - 1) times those found once at least; 0 without any."""
    h = hist.agg(F.max(bin_).alias("k"), F.sum(F.when(F.col(bin_) > 0, F.col(n) * F.col(bin_) * (F.col(bin_) - 1))).alias("s"), F.sum(F.when(F.col(bin_) > 0, F.col(n) * F.col(bin_))).alias("b"))
    return h.select(F.coalesce(F.try_divide(F.col("s"), F.col("b") * (F.col("k") - 1)), F.lit(0.0)).alias("score"))


def l1_moments(hist: DataFrame, bin_: str, n: str) -> DataFrame:
    """(n, median, dev) of a histogram: the first bin at which half of the counts are reached, and the mean distance to it. Bins are few, as of an image."""
    c = hist.select(bin_, n, F.sum(n).over(Window.orderBy(bin_)).alias("__c"), F.sum(n).over(Window.partitionBy()).alias("__n"))
    m = c.agg(F.min(F.when(F.col("__c") >= F.col("__n") / 2, F.col(bin_))).alias("median"), F.max("__n").alias("n"))
    return hist.join(F.broadcast(m.withColumnRenamed("n", "__n"))).groupBy(F.col("__n").alias("n"), "median").agg((F.sum(F.col(n) * F.abs(F.col(bin_) - F.col("median"))) / F.first("__n")).alias("dev"))


def mass_threshold(df: DataFrame, x: str, share: float, tie: Sequence[str] = ()) -> DataFrame:
    """The largest rows that together carry the share of the sum of x; the row that reaches it counts."""
    d = df.withColumn("__x", -F.col(x).cast("double"))
    r = ranked(d, [], "__x", tie)
    sums = r.groupBy("range").agg(F.sum(x).alias("__s"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("range", F.coalesce(F.sum("__s").over(before), F.lit(0.0)).alias("__before"), F.sum("__s").over(Window.partitionBy()).alias("__all"))
    inside = Window.partitionBy("range").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    upto = r.withColumn("__here", F.coalesce(F.sum(x).over(inside), F.lit(0.0))).join(sums, "range")
    return upto.where(F.col("__here") + F.col("__before") < share * F.col("__all")).select(*df.columns)


def abs_percentile(df: DataFrame, x: str, share: float = 0.8) -> DataFrame:
    """(threshold): the order statistic of |x| at ceil(share x n) from 0; infinite at the end."""
    return quantile(df.select(F.abs(F.col(x).cast("double")).alias("__a")), [], "__a", share, interpolate=False, name="threshold")


def centre_of_mass(df: DataFrame, at: Sequence[str], x: str) -> DataFrame:
    return df.agg(*[F.try_divide(F.sum(F.abs(x) * F.col(c)), F.sum(F.abs(x))).alias(c) for c in at])


def pooled_covariance(df: DataFrame, unit: str, t: str, r: str) -> DataFrame:
    """(t1, t2, cov): the mean over units of the products of residuals at two times.

    A unit's times come together in one row and are multiplied there; the products are added up in the
    tasks, so only one number for each pair of times leaves a task. Rows without a residual are left out.
    """
    rows = df.where(F.col(r).isNotNull()).groupBy(unit).agg(F.collect_list(F.struct(F.col(t).alias("t"), F.col(r).alias("r"))).alias("__a"))
    pairs = rows.select(F.explode("__a").alias("__x"), "__a").select("__x", F.explode("__a").alias("__y"))
    sums = pairs.groupBy(F.col("__x.t").alias("t1"), F.col("__y.t").alias("t2")).agg(F.sum(F.col("__x.r") * F.col("__y.r")).alias("__s"))
    n = df.agg(F.countDistinct(unit).alias("__n"))
    return sums.join(F.broadcast(n)).select("t1", "t2", (F.col("__s") / F.col("__n")).alias("cov"))


def pca(df: DataFrame, unit: str, t: str, y: str, components: int) -> tuple[list[float], list[list[float]], DataFrame]:
    """(shares of variance, vectors over the times in order, rows (unit, component, score)).

    The covariance of the times comes from one row a unit; it is as large as the
    square of the times, which a design has few of, and its eigenvectors are taken on the driver.
    Scores are sums of products in the executors.
    """
    means = df.groupBy(t).agg(F.avg(y).alias("__m"))
    centred = df.join(F.broadcast(means), t).select(unit, t, (F.col(y) - F.col("__m")).alias("__c"))
    got = pooled_covariance(centred, unit, t, "__c").collect()
    times = sorted({r.t1 for r in got})
    place = {x: k for k, x in enumerate(times)}
    c = np.zeros((len(times), len(times)))
    for r in got:
        c[place[r.t1], place[r.t2]] = r.cov
    values, vectors = np.linalg.eigh(c)
    order = np.argsort(-values)[:components]
    loads = [[float(x) for x in vectors[:, k] * (1 if vectors[np.argmax(np.abs(vectors[:, k])), k] > 0 else -1)] for k in order]
    weights = df.sparkSession.createDataFrame([(x, k, v[place[x]]) for k, v in enumerate(loads) for x in times], f"{t} {df.schema[t].dataType.simpleString()}, component int, __v double")
    scores = centred.join(F.broadcast(weights), t).groupBy(unit, "component").agg(F.sum(F.col("__c") * F.col("__v")).alias("score"))
    return [float(v) for v in values[order] / max(values.sum(), 1e-300)], loads, scores


def resample_linear(cells: DataFrame, at: Sequence[str], value: str, targets: DataFrame, matrix: Sequence[Sequence[float]], shift: Sequence[float]) -> DataFrame:
    """targets(at) with value, interpolated linearly at matrix x cell + shift in the grid of cells; corners off the grid count as 0.

    A target meets the corners around its point by an equi-join.
    """
    point = [sum((F.lit(float(m)) * F.col(c) for m, c in zip(row, at)), F.lit(float(s))) for row, s in zip(matrix, shift)]
    t = targets.select(*at, *[p.alias(f"__p{k}") for k, p in enumerate(point)])
    corner = lambda o: F.struct(*[(F.floor(f"__p{k}") + d).alias(f"__c{k}") for k, d in enumerate(o)], _product([1 - F.abs(F.col(f"__p{k}") - F.floor(f"__p{k}") - d) for k, d in enumerate(o)]).alias("__w"))
    met = t.select(*at, F.inline(F.array(*[corner(o) for o in itertools.product((0, 1), repeat=len(at))]))).where("__w > 0")
    held = cells.select(*[F.col(c).cast("long").alias(f"__c{k}") for k, c in enumerate(at)], F.col(value).alias("__v"))
    found = met.join(held, [f"__c{k}" for k in range(len(at))], "left")
    return found.groupBy(*at).agg(F.sum(F.col("__w") * F.coalesce("__v", F.lit(0.0))).alias(value))


def _product(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out * p
    return out


def convolve(series: DataFrame, by: Sequence[str], t: str, x: str, kernel: Sequence[float]) -> DataFrame:
    """series(by, t, x) with convolved: the sum over lags k of kernel k times x at t - k; t counts whole steps, and missing steps are 0."""
    lags = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(h)).alias("h")) for k, h in enumerate(kernel)])
    moved = series.where(F.col(x) != 0).select(*by, F.col(t), F.col(x), F.inline(lags)).select(*by, (F.col(t) + F.col("k")).alias(t), (F.col(x) * F.col("h")).alias("__c"))
    return series.join(moved.groupBy(*by, t).agg(F.sum("__c").alias("convolved")), [*by, t], "left").withColumn("convolved", F.coalesce("convolved", F.lit(0.0)))


def co_labelling(df: DataFrame, item: str, label: str) -> DataFrame:
    """(item, class, links): the least item with an item's label, and how many other rows have it.

    As many rows as df has, not as pairs: two items are co-labelled if their classes are equal. Items
    without a label are one class; repeated rows stay repeated and count.
    """
    d = df.select(F.col(item).alias("item"), F.col(label).alias("__l"))
    classes = d.groupBy(F.col("__l").alias("__c")).agg(F.min("item").alias("class"), (F.count("*") - 1).alias("links"))
    return d.join(classes, F.col("__l").eqNullSafe(F.col("__c"))).select("item", "class", "links")


def sign_flip_cluster_sizes(df: DataFrame, at: Sequence[str], subject: str, y: str, flips: Sequence[int], threshold: float) -> DataFrame:
    """(flip, size): the largest cluster of cells with t over the threshold, after each flip of the subjects' signs; 0 if there is none."""
    every = df.sparkSession.createDataFrame([(int(f),) for f in flips], "flip long")
    each = df.withColumn("flip", F.explode(F.array(*[F.lit(f).cast("long") for f in flips])))
    sign = F.when(F.call_function("shiftright", F.col("flip"), F.col(subject).cast("int")).bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0)
    t = each.groupBy("flip", *at).agg(F.try_divide(F.avg(sign * F.col(y)) * F.sqrt(F.count("*") - 1), F.stddev_pop(sign * F.col(y))).alias("t")).where(F.col("t") > threshold)
    # flips lie apart along an axis of their own, which has no neighbours
    here = F.struct("flip", *at)
    edges = neighbours(t.withColumn("flip", F.col("flip") * 2).withColumn("__here", here), ["flip", *at], "__here").select(here.alias("src"), F.col("neighbour").alias("dst"))
    found = connected_components(edges, "src", "dst")
    cells = t.select(F.struct((F.col("flip") * 2).alias("flip"), *at).alias("node"))
    sizes = cells.join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("c")).agg(F.count("*").alias("n")).groupBy((F.col("c.flip") / 2).cast("long").alias("flip")).agg(F.max("n").alias("size"))
    return every.join(sizes, "flip", "left").select("flip", F.coalesce("size", F.lit(0)).alias("size"))
