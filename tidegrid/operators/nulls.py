"""Empirical null distributions: a normal fitted to the middle of each unit's values, and false discovery rates under it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tails import norm_isf, norm_sf
from ..storage import drop_tables, stored
from . import models
from .ordered import ranked

#: A fitted variance stays at or above this.
LEAST_VARIANCE = 1e-6
#: Bins of a unit's histogram at least, and at most.
BINS, MOST_BINS = 10, 100_000


def learn(df: DataFrame, by: Sequence[str], x: str, left: float = 0.2, right: float = 0.8) -> DataFrame:
    """(by, n, mu, sigma, p0): a normal that fits the histogram of each unit's values between two shares of their order, and the share of all values that it stands for, at most 1.

    Bins are as wide as 3.5 standard deviations over the cube root of n would make them on the whole
    range, at least BINS of them, over the middle values. The logarithms of the counts that aren't 0 are
    fitted by a parabola. Ranks are distributed, the histogram is aggregated before the shuffle, and a
    unit's bins are at most MOST_BINS rows. Null and NaN values are left out; a unit whose middle does not
    vary, or fills fewer than three bins, has nulls.
    """
    by = list(by)
    rows = df.select(*by, F.col(x).cast("double").alias("__x")).where("__x is not null and not isnan(__x)")
    # the order is used for the bins and for the histogram, the histogram for means and for sums about them
    r = stored(ranked(rows, by, "__x").select(*by, "__x", "n", "rank"), "null-order")
    index = F.col("rank") - 1
    inside = (index >= F.floor(F.col("n") * F.lit(left))) & (index < F.floor(F.col("n") * F.lit(right)))
    mid = F.when(inside, F.col("__x"))
    about = r.groupBy(*by).agg(F.first("n").alias("n"), F.stddev_pop("__x").alias("__sd"), (F.max("__x") - F.min("__x")).alias("__range"), F.min(mid).alias("__lo"), F.max(mid).alias("__hi"), F.avg(mid).alias("__mid"))
    wide = F.lit(3.5) * F.col("__sd") / F.pow(F.col("n").cast("double"), F.lit(1 / 3))
    about = about.withColumn("__bins", F.least(F.greatest(F.lit(BINS), F.floor(F.try_divide("__range", wide))), F.lit(MOST_BINS)))
    about = stored(about.withColumn("__step", F.nullif((F.col("__hi") - F.col("__lo")) / F.col("__bins"), F.lit(0.0))).drop("__sd", "__range"), "null-bins")
    placed = r.where(inside).drop("n").join(about, by)
    # the last bin holds its upper end
    bin_ = F.least(F.floor((F.col("__x") - F.col("__lo")) / F.col("__step")), F.col("__bins") - 1)
    hist = stored(placed.withColumn("__bin", bin_).groupBy(*by, "__bin").agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in ("__lo", "__mid", "__step")]), "null-histogram")
    drop_tables(r)
    at = F.col("__lo") + (F.col("__bin") + 0.5) * F.col("__step") - F.col("__mid")
    points = hist.where("__bin is not null").select(*by, F.lit(1.0).alias("__one"), at.alias("__at"), (at * at).alias("__square"), F.log("__n").alias("__log"))
    fits = models.fit(points, by, ["__one", "__at", "__square"], "__log").select(*by, "beta")
    b = [F.col("beta")[k] for k in range(3)]
    out = about.join(fits, by, "left").withColumn("__v", F.greatest(F.try_divide(F.lit(-1.0), 2 * b[2]), F.lit(LEAST_VARIANCE)))
    out = out.withColumn("__v", F.when(b[2].isNotNull(), F.col("__v"))).withColumn("__mu", b[1] * F.col("__v"))
    share = b[0] - F.log(F.col("__step") * F.col("n")) + F.log(2 * math.pi * F.col("__v")) / 2 + F.col("__mu") * F.col("__mu") / (2 * F.col("__v"))
    return out.select(*by, "n", (F.col("__mid") + F.col("__mu")).alias("mu"), F.sqrt("__v").alias("sigma"), F.when(share.isNotNull(), F.least(F.lit(1.0), F.exp(share))).alias("p0"))


def fdr_curve(df: DataFrame, by: Sequence[str], x: str, null: DataFrame | None = None, **cuts: float) -> DataFrame:
    """df, without null and NaN values, with fdr: the share of the values from x up that the null explains, at most 1, made to rise as x falls.

    null is from learn(), which gets cuts if it isn't given. The running maximum is taken range by range
    of the distributed order, from the top, and the ranges' maxima above are added.
    """
    by = list(by)
    df = stored(df, "null-values") if null is None else df
    null = learn(df, by, x, **cuts) if null is None else null
    held = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")))
    r = ranked(held, by, x).join(null.select(*by, F.col("mu").alias("__mu"), F.col("sigma").alias("__sigma"), F.col("p0").alias("__p0")), by)
    tail = norm_sf((F.col(x) - F.col("__mu")) / F.col("__sigma"))
    raw = F.least(F.lit(1.0), F.col("__p0") * tail * F.col("n") / (F.col("n") - F.col("rank") + 1))
    r = stored(r.select(*df.columns, "range", "rank", raw.alias("__raw")), "null-rates")
    tops = r.groupBy(*by, "range").agg(F.max("__raw").alias("__top"))
    above = Window.partitionBy(*by).orderBy("range").rowsBetween(1, Window.unboundedFollowing)
    tops = tops.select(*by, "range", F.max("__top").over(above).alias("__above"))
    # from the top, as a frame that runs to the end is gone through again for each row
    inside = Window.partitionBy(*by, "range").orderBy(F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = r.withColumn("__here", F.max("__raw").over(inside)).join(tops, [*by, "range"])
    return out.withColumn("fdr", F.greatest("__here", "__above")).select(*df.columns, "fdr")


def threshold(curve: DataFrame, by: Sequence[str], x: str, alpha: float = 0.05) -> DataFrame:
    """(by, threshold) of fdr_curve(): half-way between the largest x whose fdr is not under alpha and the next one; infinite if the largest x's isn't, the least x if all are."""
    found = curve.groupBy(*by).agg(F.max(F.when(F.col("fdr") >= alpha, F.col(x))).alias("__in"), F.min(F.when(F.col("fdr") < alpha, F.col(x))).alias("__out"))
    value = F.when(F.col("__out").isNull(), F.lit(float("inf"))).when(F.col("__in").isNull(), F.col("__out")).otherwise((F.col("__in") + F.col("__out")) / 2)
    return found.select(*by, value.alias("threshold"))


def fdr_at(curve: DataFrame, null: DataFrame, by: Sequence[str], x: str, theta: float) -> DataFrame:
    """(by, fdr) of the values from theta up: the larger of the curve at the first of them and what the null explains of them; 0 if there are none."""
    by = list(by)
    up = F.col(x) >= theta
    seen = curve.groupBy(*by).agg(F.count_if(up).alias("__up"), F.max(F.when(up, F.col("fdr"))).alias("__fdr"))
    j = seen.join(null, by)
    raw = F.col("p0") * norm_sf((F.lit(float(theta)) - F.col("mu")) / F.col("sigma")) * F.try_divide("n", "__up")
    return j.select(*by, F.when(F.col("__up") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest("__fdr", raw))).alias("fdr"))


def uncorrected_threshold(null: DataFrame, by: Sequence[str], alpha: float = 0.001) -> DataFrame:
    """(by, threshold): the value above which the null has a share of alpha."""
    return null.select(*by, (F.col("mu") + F.col("sigma") * norm_isf(F.lit(float(alpha)))).alias("threshold"))
