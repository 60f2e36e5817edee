"""Mass-univariate linear models over long tables: one fit per unit, from sums that Spark pre-aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .grid import cut


def simple_ols(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, n, slope, intercept, s2, sxx, t_slope) of y on [1, x] for every unit, in one aggregation; null where a unit has too few rows or a constant x."""
    sums = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy")
    )
    s2 = F.try_divide(F.greatest(F.col("syy") - F.col("slope") ** 2 * F.col("sxx"), F.lit(0.0)), F.col("n") - 2)
    return sums.withColumn("s2", s2).select(*by, "n", "slope", "intercept", "s2", "sxx", F.try_divide(F.col("slope"), F.sqrt(F.try_divide("s2", "sxx"))).alias("t_slope"))


def solve_symmetric(a: Sequence[Sequence[Column]], b: Sequence[Column]) -> Column:
    """The solution, an array, of the normal equations a x = b of columns, by elimination; null if a predictor is collinear.

    The equations are an array of rows that an aggregate eliminates pivot by pivot, so the expression is as
    large as its input. Only the upper half of a is read; a is positive definite. A pivot that elimination
    has brought below 1e-11 of its diagonal shows a collinear predictor.
    """
    n = len(b)
    rows = F.array(*[F.array(*[a[min(i, j)][max(i, j)].cast("double") for j in range(n)], b[i].cast("double")) for i in range(n)])

    def eliminated(m: Column, k: Column) -> Column:
        pivot = F.get(m, k)
        scaled = F.transform(pivot, lambda x: x / F.get(pivot, k))
        bad = ~(F.get(pivot, k) > 1e-11 * F.get(F.get(rows, k), k)) | F.get(pivot, k).isNull()
        # x - f y of every row but the pivot's
        return F.when(~bad, F.transform(m, lambda row, i: F.when(i == k, scaled).otherwise(F.zip_with(row, scaled, lambda x, y: x - F.get(row, k) * y))))

    return F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), rows, eliminated), lambda row: F.get(row, F.lit(n)))


def ols(df: DataFrame, by: Sequence[str], xs: Sequence[str], y: str, weight: str | None = None) -> DataFrame:
    """(by, n, intercept, b_<x>..., sse): (weighted) least squares of y on an intercept and xs, in two aggregations.

    The first takes means, the second sums of centred products, so that large offsets cost no digits.
    """
    by, names = list(by), [*xs, y]
    w = F.col(weight) if weight else F.lit(1.0)
    means = df.groupBy(*by).agg(F.count("*").alias("n"), *[F.try_divide(F.sum(w * F.col(c)), F.sum(w)).alias(f"__m_{c}") for c in names])
    centred = df.join(means, by) if by else df.join(F.broadcast(means))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    d = lambda c: F.col(c) - F.col(f"__m_{c}")
    sums = centred.groupBy(*by).agg(*[F.first(c).alias(c) for c in means.columns if c not in by], *[F.sum(w * d(a) * d(b)).alias(f"__s_{a}_{b}") for a, b in pairs])
    s = lambda a, b: F.col(f"__s_{a}_{b}" if (a, b) in pairs else f"__s_{b}_{a}")
    beta = solve_symmetric([[s(a, b) for b in xs] for a in xs], [s(a, y) for a in xs])
    fitted = sums.withColumn("__beta", beta).select("*", *[F.col("__beta")[k].alias(f"b_{x}") for k, x in enumerate(xs)])
    intercept, sse = F.col(f"__m_{y}"), s(y, y)
    for x in xs:
        intercept, sse = intercept - F.col(f"b_{x}") * F.col(f"__m_{x}"), sse - F.col(f"b_{x}") * s(x, y)
    return fitted.select(*by, "n", intercept.alias("intercept"), *[f"b_{x}" for x in xs], sse.alias("sse"))


def residuals(df: DataFrame, by: Sequence[str], fit: DataFrame, xs: Sequence[str], y: str) -> DataFrame:
    """df with resid, from the coefficients of ols()."""
    out = F.col(y) - F.col("intercept")
    for x in xs:
        out = out - F.col(f"b_{x}") * F.col(x)
    return df.join(fit.select(*by, "intercept", *[f"b_{x}" for x in xs]), list(by)).withColumn("resid", out).drop("intercept", *[f"b_{x}" for x in xs])


def ar1(df: DataFrame, by: Sequence[str], t: str, r: str) -> DataFrame:
    """(by, rho): lag-one autocorrelation of residuals, sum r(t) r(t-1) / sum r(t)^2."""
    lagged = df.withColumn("__lag", F.lag(r).over(Window.partitionBy(*by).orderBy(t)))
    return lagged.groupBy(*by).agg(F.try_divide(F.sum(F.col(r) * F.col("__lag")), F.sum(F.pow(r, 2))).alias("rho"))


def ar1_bin(rho: Column, steps: int = 100) -> Column:
    """rho truncated toward zero to a multiple of 1/steps: units of one bin share a whitened design."""
    return (rho * steps).cast("int") / steps


def yule_walker(df: DataFrame, by: Sequence[str], t: str, x: str, order: int = 2) -> DataFrame:
    """(by, rho1..., sigma2): AR coefficients from biased autocovariances of the centred series."""
    w = Window.partitionBy(*by)
    centred = df.withColumn("__c", F.col(x) - F.avg(x).over(w))
    lags = centred.select(*by, "__c", *[F.lag("__c", k).over(w.orderBy(t)).alias(f"__l{k}") for k in range(1, order + 1)])
    cov = lags.groupBy(*by).agg((F.sum(F.col("__c") ** 2) / F.count("*")).alias("__r0"), *[(F.sum(F.col("__c") * F.col(f"__l{k}")) / F.count("*")).alias(f"__r{k}") for k in range(1, order + 1)])
    r = lambda k: F.col(f"__r{abs(k)}")
    cov = cov.withColumn("__rho", solve_symmetric([[r(i - j) for j in range(order)] for i in range(order)], [r(k) for k in range(1, order + 1)]))
    rho, sigma2 = [F.col("__rho")[k] for k in range(order)], F.col("__r0")
    for k, v in enumerate(rho, 1):
        sigma2 = sigma2 - v * r(k)
    return cov.select(*by, *[v.alias(f"rho{k}") for k, v in enumerate(rho, 1)], sigma2.alias("sigma2"))


def t_contrast(effect: Column, variance: Column, floor: float = 1e-50) -> Column:
    """Effect over the root of its variance, which is floored."""
    return effect / F.sqrt(F.greatest(variance, F.lit(floor)))


def fixed_effects(sessions: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, effect, variance, dof, t) of sessions(by, effect, variance, dof): all three add."""
    s = sessions.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("effect", "variance", "dof")])
    return s.withColumn("t", t_contrast(F.col("effect"), F.col("variance")))


def conjunction(df: DataFrame, by: Sequence[str], t: str, k: int) -> DataFrame:
    """(by, conjunction): sum of the k smallest t of each unit; k is small, so a bounded array holds them."""
    order = Window.partitionBy(*by).orderBy(t)
    return df.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= k).groupBy(*by).agg(F.sum(t).alias("conjunction"))


def irls(df: DataFrame, by: Sequence[str], xs: Sequence[str], y: str, family: str, rounds: int) -> DataFrame:
    """(by, intercept, b_<x>...): a generalised linear model with the canonical link, family binomial (y from 0 to 1) or poisson.

    Each round is one aggregation of weighted sums; the coefficients, one row a unit, are joined to the
    rows and their lineage is cut. It starts from the link of the unit's mean. Rows with a null are left
    out; where the mean has no finite link the coefficients are null.
    """
    by, names = list(by), ["intercept", *[f"b_{x}" for x in xs]]
    rows = df.select(*by, *xs, y).dropna(subset=[*xs, y])
    mean = F.avg(y)
    start = F.when((mean > 0) & (mean < 1), F.log(mean / (1 - mean))) if family == "binomial" else F.when(mean > 0, F.log(mean))
    now = rows.groupBy(*by).agg(start.alias("intercept"), *[F.lit(0.0).alias(c) for c in names[1:]])
    value = [F.lit(1.0), *map(F.col, xs)]
    for _ in range(rounds):
        eta = F.col("intercept")
        for c, x in zip(names[1:], value[1:]):
            eta = eta + F.col(c) * x
        mu = 1 / (1 + F.exp(-eta)) if family == "binomial" else F.exp(eta)
        held = rows.join(now, by).select("*", eta.alias("__eta"), mu.alias("__mu"))
        held = held.withColumn("__w", F.col("__mu") * (1 - F.col("__mu")) if family == "binomial" else F.col("__mu"))
        z, size = F.col("__eta") + F.try_divide(F.col(y) - F.col("__mu"), F.col("__w")), range(len(names))
        sums = held.groupBy(*by).agg(
            *[F.sum(F.col("__w") * value[i] * value[j]).alias(f"__s{i}_{j}") for i in size for j in size if i <= j], *[F.sum(F.col("__w") * value[i] * z).alias(f"__z{i}") for i in size]
        )
        beta = solve_symmetric([[F.col(f"__s{min(i, j)}_{max(i, j)}") for j in size] for i in size], [F.col(f"__z{i}") for i in size])
        now = cut(sums.withColumn("__beta", beta).select(*by, *[F.col("__beta")[k].alias(c) for k, c in enumerate(names)]))
    return now
