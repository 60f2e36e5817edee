"""One- and two-sample statistics of every unit, over long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import quantile, ranked


def moments(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """(by, n, mean, std, min, max); std is the population's."""
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))


def student(df: DataFrame, by: Sequence[str], x: str, base: float = 0.0) -> DataFrame:
    """(by, t): sqrt(n - 1) (mean - base) / population std; 0 where the mean is base, infinite where the std is 0."""
    m, s = F.col("mean") - base, F.col("std")
    t = F.when(m == 0, 0.0).when(s == 0, F.signum(m) * F.lit(float("inf"))).otherwise(F.sqrt(F.col("n") - 1) * m / s)
    return moments(df, by, x).select(*by, t.alias("t"))


def _deviance(sign: Column, n: Column, s0: Column, s: Column) -> Column:
    ratio = F.sqrt(2 * n * F.log(F.try_divide(F.greatest(s0, s), s)))
    return F.when(sign == 0, 0.0).when(s == 0, F.signum(sign) * F.lit(float("inf"))).otherwise(F.signum(sign) * ratio)


def laplace(df: DataFrame, by: Sequence[str], x: str, base: float = 0.0) -> DataFrame:
    """(by, laplace): signed root of the deviance between the mean absolute deviations about base and about the median."""
    med = quantile(df, by, x, 0.5, name="__med")
    d = df.join(med, list(by)).groupBy(*by).agg(F.count(x).alias("n"), F.avg(F.abs(F.col(x) - F.col("__med"))).alias("s"), F.avg(F.abs(F.col(x) - base)).alias("s0"), F.first("__med").alias("med"))
    return d.select(*by, _deviance(F.col("med") - base, F.col("n"), F.col("s0"), F.col("s")).alias("laplace"))


def tukey(df: DataFrame, by: Sequence[str], x: str, base: float = 0.0) -> DataFrame:
    """(by, tukey): as laplace, with medians of the absolute deviations."""
    by = list(by)
    med = quantile(df, by, x, 0.5, name="__med")
    dev = df.join(med, by).withColumn("__s", F.abs(F.col(x) - F.col("__med"))).withColumn("__s0", F.abs(F.col(x) - base))
    n = df.groupBy(*by).agg(F.count(x).alias("n"))
    d = n.join(med, by).join(quantile(dev, by, "__s", 0.5, name="s"), by).join(quantile(dev, by, "__s0", 0.5, name="s0"), by)
    return d.select(*by, _deviance(F.col("__med") - base, F.col("n"), F.col("s0"), F.col("s")).alias("tukey"))


def sign_stat(df: DataFrame, by: Sequence[str], x: str, base: float = 0.0) -> DataFrame:
    """(by, sign): (values above base - values below) / n; ties split."""
    return df.groupBy(*by).agg(F.avg(F.signum(F.col(x) - base)).alias("sign"))


def wilcoxon(df: DataFrame, by: Sequence[str], x: str, base: float = 0.0, tie: Sequence[str] = ()) -> DataFrame:
    """(by, wilcoxon): signed ranks of |x - base|, summed and divided by n squared; ties are ordered, not averaged."""
    d = df.withColumn("__d", F.col(x) - base).withColumn("__a", F.abs("__d"))
    return ranked(d, by, "__a", tie).groupBy(*by).agg((F.sum(F.col("rank") * F.signum("__d")) / F.max("n") / F.max("n")).alias("wilcoxon"))


def grubb(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """(by, grubb): largest |x - mean| over the population std, from the extremes alone; 0 for a constant unit."""
    far = F.greatest(F.col("max") - F.col("mean"), F.col("mean") - F.col("min"))
    return moments(df, by, x).select(*by, F.when(F.col("std") == 0, 0.0).otherwise(F.try_divide(far, F.col("std"))).alias("grubb"))


def mad(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """(by, mad): median absolute deviation / 0.6745."""
    by = list(by)
    med = quantile(df, by, x, 0.5, name="__med")
    joined = df.join(med, by) if by else df.join(F.broadcast(med))
    return quantile(joined.withColumn("__s", F.abs(F.col(x) - F.col("__med"))), by, "__s", 0.5, name="__mad").select(*by, (F.col("__mad") / 0.6745).alias("mad"))


def weighted_mean(df: DataFrame, by: Sequence[str], y: str, sd: str) -> DataFrame:
    """(by, mean, scale, sd, t): inverse-variance weighted mean; scale is the mean squared weighted residual over n - 1.

    A row without variance has no weight, as in pos_recipr; a unit without weights, or of one row, has nulls.
    """
    w = F.when(F.col(sd) > 0, F.try_divide(F.lit(1.0), F.pow(sd, 2))).otherwise(0.0)
    s = df.groupBy(*by).agg(F.count(y).alias("n"), F.sum(w).alias("sw"), F.sum(w * F.col(y)).alias("swy"), F.sum(w * F.pow(y, 2)).alias("swyy"))
    s = s.withColumn("mean", F.try_divide("swy", "sw"))
    s = s.withColumn("scale", F.try_divide(F.col("swyy") - F.col("mean") * F.col("swy"), F.col("n") - 1)).withColumn("sd", F.sqrt(F.try_divide("scale", "sw")))
    return s.select(*by, "mean", "scale", "sd", F.try_divide("mean", "sd").alias("t"))


def two_sample(df: DataFrame, by: Sequence[str], x: str, first: Column, scaled: bool = False) -> DataFrame:
    """(by, t): difference of the means over the pooled sd; scaled also divides by sqrt(1/n1 + 1/n2).

    Without spread t is 0 for equal means and infinite otherwise; with a sample missing it is null.
    """
    a, b = F.when(first, F.col(x)), F.when(~first, F.col(x))
    s = df.groupBy(*by).agg(*[f(v).alias(f"{k}{i}") for i, v in ((1, a), (2, b)) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))])
    n1, n2 = F.col("n1"), F.col("n2")
    pooled = F.sqrt(F.try_divide(n1 * F.col("v1") + n2 * F.col("v2"), n1 + n2 - 2))
    gap = F.col("m1") - F.col("m2")
    t = F.when(gap == 0, 0.0).when(pooled == 0, F.signum(gap) * F.lit(float("inf"))).otherwise(F.try_divide(gap, pooled))
    return s.select(*by, (t / F.sqrt(F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)) if scaled else t).alias("t"))


def two_sample_wilcoxon(df: DataFrame, by: Sequence[str], x: str, first: Column) -> DataFrame:
    """(by, wilcoxon): over the first sample, values of the second below less values above, divided by the second's count."""
    marked = df.where(F.col(x).isNotNull()).withColumn("__g", F.when(first, 1).otherwise(0))
    r = ranked(marked, by, x)
    ties = r.groupBy(*by, x).agg(F.count_if(F.col("__g") == 1).alias("a"), F.count_if(F.col("__g") == 0).alias("b"), F.max("rank").alias("upto"), F.max("n").alias("n"))
    sizes = ties.groupBy(*by).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    # mid-ranks of the first sample give the count of the second's values below it, ties half
    mid = F.col("upto") - (F.col("a") + F.col("b") - 1) / 2
    total = ties.groupBy(*by).agg(F.sum(F.col("a") * mid).alias("rs")).join(sizes, list(by)) if by else ties.agg(F.sum(F.col("a") * mid).alias("rs")).join(F.broadcast(sizes))
    u = F.col("rs") - F.col("na") * (F.col("na") + 1) / 2
    return total.select(*by, F.try_divide(2 * u - F.col("na") * F.col("nb"), F.col("nb")).alias("wilcoxon"))


def smoothed_histogram(df: DataFrame, x: str, low: float, high: float, bins: int, sd_bins: float) -> DataFrame:
    """(bin, count, density): counts of equal bins and their Gaussian smoothing, cut off at 4 sd."""
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(x) - low) / ((high - low) / bins)))).cast("int")
    counts = df.groupBy(at.alias("bin")).agg(F.count("*").alias("count"))
    reach = int(4 * sd_bins)
    near = counts.select(F.explode(F.sequence(F.greatest(F.lit(0), F.col("bin") - reach), F.least(F.lit(bins - 1), F.col("bin") + reach))).alias("to"), "bin", "count")
    mass = F.exp(-F.pow(F.col("to") - F.col("bin"), 2) / (2 * sd_bins**2))
    smooth = near.groupBy(F.col("to").alias("bin")).agg(F.sum(F.col("count") * mass).alias("density"))
    return smooth.join(counts, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"), "density")


def mixed_effects(df: DataFrame, by: Sequence[str], y: str, v: str, rounds: int = 5) -> DataFrame:
    """(by, mean, s2): EM for y = mean + N(0, s2 + v), a fixed number of rounds from the mean and population variance.

    A round aggregates each unit once: posterior means (v mean + s2 y) / (s2 + v) and variances s2 v / (s2 + v).
    """
    by = list(by)
    now = df.groupBy(*by).agg(F.avg(y).alias("mean"), F.var_pop(y).alias("s2"))
    for _ in range(rounds):
        e = df.select(*by, y, v).join(now, by)
        # without any variance the posterior is the value itself
        post = F.coalesce(F.try_divide(F.col(v) * F.col("mean") + F.col("s2") * F.col(y), F.col("s2") + F.col(v)), F.col(y))
        var = F.coalesce(F.try_divide(F.col("s2") * F.col(v), F.col("s2") + F.col(v)), F.lit(0.0))
        sums = e.groupBy(*by).agg(F.avg(post).alias("mean"), F.avg(post * post + var).alias("__m2"))
        now = sums.select(*by, "mean", (F.col("__m2") - F.pow("mean", 2)).alias("s2"))
    return now
