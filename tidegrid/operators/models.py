"""Linear models of every unit with explicit design columns: fits, contrasts, results and autoregressive refits."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.tails import f_sf, t_sf
from .glm import ar1, ar1_bin, solve_symmetric


def _solved(n: int, m: np.ndarray, s: np.ndarray, constant: np.ndarray) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(beta, cov, sse) from means m and centred sums of products s of the columns and, last, y; constant holds the value of a column that does not vary, else NaN."""
    p = len(m) - 1
    fixed = np.flatnonzero(~np.isnan(constant) & (constant != 0))
    free = np.delete(np.arange(p), fixed[0]) if len(fixed) else np.arange(p)
    # with a constant among the columns the others are fitted about their means, else about 0
    a = s[np.ix_(free, free)] + (0 if len(fixed) else n * np.outer(m[free], m[free]))
    scale = np.sqrt(np.diag(a))
    if not (scale > 0).all():
        return None
    try:
        root = np.linalg.cholesky(a / np.outer(scale, scale))
    except np.linalg.LinAlgError:
        return None
    if len(free) and np.diag(root).min() ** 2 < 1e-11:
        return None
    half = np.linalg.inv(root) / scale
    inverse, sy = half.T @ half, s[free, p]
    beta = inverse @ sy
    sse = max(0.0, float(s[p, p] - beta @ sy))
    if len(fixed):
        c, k = constant[fixed[0]], fixed[0]
        out, cov = np.empty(p), np.empty((p, p))
        out[free], out[k] = beta, (m[p] - beta @ m[free]) / c
        cov[np.ix_(free, free)] = inverse
        cov[k, free] = cov[free, k] = -(inverse @ m[free]) / c
        cov[k, k] = (1 / n + m[free] @ inverse @ m[free]) / c**2
        return out, cov, sse
    # y is its mean times a 1 beside what varies; the part of that 1 which the columns leave over is a residual too
    ones = n * m[free]
    gamma = inverse @ ones
    left = n - ones @ gamma
    if left > 1e-10 * n:
        sse = max(0.0, sse - 2 * m[p] * (ones @ beta) + m[p] ** 2 * left)
    return beta + m[p] * gamma, inverse, sse


def fit(df: DataFrame, by: Sequence[str], xs: Sequence[str], y: str) -> DataFrame:
    """(by, n, beta, cov, sse, sst, ssu): least squares of y on the columns xs, which hold the constant if there is to be one.

    beta is an array; cov the inverse of the normal equations, an array of rows; sst the sum of squares
    about the mean, ssu about 0. Two aggregations: means, then centred sums of products, so that large
    offsets of y, and of the columns if one of them is constant, cost no digits. The equations of a unit
    are one row, which numpy solves. Rows with a null are left out. Collinear columns give null
    coefficients.
    """
    by, p, names = list(by), len(xs), [*xs, y]
    rows = df.select(*by, F.array(*[F.col(c).cast("double") for c in names]).alias("__v")).where(~F.exists("__v", lambda v: v.isNull()))
    v = [F.col("__v")[i] for i in range(p + 1)]
    means = rows.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.avg(x) for x in v]).alias("__m"), F.array(*[F.when(F.min(x) == F.max(x), F.min(x)) for x in v[:p]]).alias("__c"))
    centred = rows.join(means, by) if by else rows.join(F.broadcast(means))
    d = centred.select(*by, "n", "__m", "__c", F.zip_with("__v", "__m", lambda a, b: a - b).alias("__d"))
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    sums = d.groupBy(*by).agg(*[F.first(c).alias(c) for c in ("n", "__m", "__c")], F.array(*[F.sum(F.col("__d")[i] * F.col("__d")[j]) for i, j in pairs]).alias("__s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.triu_indices(p + 1)
        for batch in batches:
            out = []
            for n, m, c, s in zip(*(batch.column(len(by) + k).to_pylist() for k in range(4))):
                full = np.zeros((p + 1, p + 1))
                full[upper] = s
                full = full + np.triu(full, 1).T
                found = _solved(n, np.array(m), full, np.array(c, dtype=float))
                ends = (full[p, p], full[p, p] + n * m[p] ** 2)
                out.append((n, found[0].tolist(), found[1].tolist(), found[2], *ends) if found else (n, [None] * p, [[None] * p] * p, None, *ends))
            columns = zip(*out) if out else [[]] * 6
            kinds = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.list_(pa.float64())), *[pa.float64()] * 3]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], *[pa.array(x, t) for x, t in zip(columns, kinds)]], [*by, "n", "beta", "cov", "sse", "sst", "ssu"])

    made = [("n", LongType()), ("beta", ArrayType(DoubleType())), ("cov", ArrayType(ArrayType(DoubleType()))), *[(c, DoubleType()) for c in ("sse", "sst", "ssu")]]
    schema = StructType([*[sums.schema[c] for c in by], *[StructField(c, t) for c, t in made]])
    return sums.select(*by, "n", "__m", "__c", "__s").mapInArrow(run, schema)


def dispersion(p: int) -> Column:
    return F.try_divide(F.col("sse"), F.col("n") - p)


def _dot(c: Sequence[float], v: Column) -> Column:
    return sum((F.lit(float(x)) * v[i] for i, x in enumerate(c) if x), F.lit(0.0))


def _between(c: Sequence[float], d: Sequence[float]) -> Column:
    """c cov d'."""
    return sum((F.lit(float(x * z)) * F.col("cov")[i][j] for i, x in enumerate(c) for j, z in enumerate(d) if x and z), F.lit(0.0))


def t_contrast(fits: DataFrame, by: Sequence[str], c: Sequence[float]) -> DataFrame:
    """(by, effect, sd, t, dof, p) of one contrast; p is the upper tail."""
    p = len(c)
    out = fits.select(*by, _dot(c, F.col("beta")).alias("effect"), F.sqrt(_between(c, c) * dispersion(p)).alias("sd"), (F.col("n") - p).alias("dof"))
    out = out.withColumn("t", F.try_divide("effect", "sd"))
    return out.withColumn("p", t_sf(F.col("t"), F.col("dof")))


def f_contrast(fits: DataFrame, by: Sequence[str], rows: Sequence[Sequence[float]]) -> DataFrame:
    """(by, f, dfn, dfd, p) of a matrix of contrasts of full rank."""
    q, p = len(rows), len(rows[0])
    effect = [_dot(r, F.col("beta")) for r in rows]
    fits = fits.withColumn("__e", F.array(*effect)).withColumn("__w", solve_symmetric([[_between(a, b) for b in rows] for a in rows], effect))
    quad = F.aggregate(F.zip_with("__e", "__w", lambda e, w: e * w), F.lit(0.0), lambda a, x: a + x)
    out = fits.select(*by, F.try_divide(quad / q, dispersion(p)).alias("f"), F.lit(q).alias("dfn"), (F.col("n") - p).alias("dfd"))
    return out.withColumn("p", f_sf(F.col("f"), F.col("dfn"), F.col("dfd")))


def tmin_contrast(fits: DataFrame, by: Sequence[str], rows: Sequence[Sequence[float]]) -> DataFrame:
    """(by, tmin): the least t of several contrasts."""
    p = len(rows[0])
    each = [F.try_divide(_dot(r, F.col("beta")), F.sqrt(_between(r, r) * dispersion(p))) for r in rows]
    return fits.select(*by, (F.least(*each) if len(each) > 1 else each[0]).alias("tmin"))


def results(fits: DataFrame, by: Sequence[str], p: int) -> DataFrame:
    """(by, sse, sst, ssr, mse, msr, mst, r2, r2_adj, f_overall, log_likelihood, aic, bic) of fits with p columns, the constant among them."""
    n, sse, sst = F.col("n"), F.col("sse"), F.col("sst")
    out = fits.select(*by, "n", "sse", "sst", (sst - sse).alias("ssr"), F.try_divide(sse, n - p).alias("mse"), F.try_divide(sst - sse, F.lit(p - 1)).alias("msr"), F.try_divide(sst, n - 1).alias("mst"))
    ll = -n / 2 * (math.log(2 * math.pi) + F.log(F.try_divide(sse, n)) + 1)
    out = out.select("*", (1 - F.try_divide("sse", "sst")).alias("r2"), (1 - F.try_divide("mse", "mst")).alias("r2_adj"), F.try_divide("msr", "mse").alias("f_overall"), ll.alias("log_likelihood"))
    return out.select("*", (-2 * F.col("log_likelihood") + 2 * p).alias("aic"), (-2 * F.col("log_likelihood") + F.log("n") * p).alias("bic"))


def conf_int(fits: DataFrame, by: Sequence[str], k: int, p: int, quantile: float) -> DataFrame:
    """(by, low, high): beta k and a multiple of its standard deviation to both sides; quantile is that of the distribution used."""
    sd = F.sqrt(F.col("cov")[k][k] * dispersion(p))
    return fits.select(*by, (F.col("beta")[k] - quantile * sd).alias("low"), (F.col("beta")[k] + quantile * sd).alias("high"))


def residual_rows(df: DataFrame, by: Sequence[str], fits: DataFrame, xs: Sequence[str], y: str) -> DataFrame:
    """df with predicted and resid."""
    j = df.join(fits.select(*by, "beta"), list(by))
    predicted = sum((F.col("beta")[i] * F.col(x) for i, x in enumerate(xs)), F.lit(0.0))
    return j.withColumn("predicted", predicted).withColumn("resid", F.col(y) - F.col("predicted")).drop("beta")


def ar1_refit(df: DataFrame, by: Sequence[str], t: str, xs: Sequence[str], y: str, steps: int = 100) -> DataFrame:
    """(by, bin, n, beta, cov, sse, sst, ssu): least squares, the residuals' lag-one correlation cut toward 0 to 1/steps, and least squares again of whitened rows.

    A row is whitened by the one before it in t; a unit's first row stays. The windows order one unit at a time.
    """
    by = list(by)
    r = residual_rows(df, by, fit(df, by, xs, y), xs, y)
    rho = ar1(r, by, t, "resid").select(*by, ar1_bin(F.coalesce("rho", F.lit(0.0)), steps).alias("bin"))
    w = Window.partitionBy(*by).orderBy(t)
    white = [(F.col(c) - F.col("bin") * F.coalesce(F.lag(c).over(w), F.lit(0.0))).alias(c) for c in [*xs, y]]
    return fit(df.join(rho, by).select(*by, *white), by, xs, y).join(rho, by).select(*by, "bin", "n", "beta", "cov", "sse", "sst", "ssu")


def gaussian_mfx(df: DataFrame, by: Sequence[str], y: str, v: str, rounds: int = 5, constrained: bool = False) -> DataFrame:
    """(by, mean, s2, nll) of y = mean + N(0, s2 + v) by so many rounds of EM; constrained: the mean is 0. nll is half the sum of log(s2 + v) + (y - mean)^2 / (s2 + v)."""
    by, keep = list(by), F.lit(0.0 if constrained else 1.0)
    now = df.groupBy(*by).agg((F.avg(y) * keep).alias("mean"), (F.var_pop(y) if not constrained else F.avg(F.col(y) * F.col(y))).alias("s2"))
    all_v = F.col("s2") + F.col(v)
    for _ in range(rounds):
        e = df.select(*by, y, v).join(now, by)
        post = F.coalesce(F.try_divide(F.col(v) * F.col("mean") + F.col("s2") * F.col(y), all_v), F.col(y))
        var = F.coalesce(F.try_divide(F.col("s2") * F.col(v), all_v), F.lit(0.0))
        sums = e.groupBy(*by).agg(F.avg(post).alias("__m"), F.avg(post * post + var).alias("__m2"))
        now = sums.select(*by, (F.col("__m") * keep).alias("mean"), "__m2", "__m").select(*by, "mean", (F.col("__m2") - 2 * F.col("mean") * F.col("__m") + F.col("mean") * F.col("mean")).alias("s2"))
    e = df.select(*by, y, v).join(now, by)
    return e.groupBy(*by).agg(F.first("mean").alias("mean"), F.first("s2").alias("s2"), (F.sum(F.log(all_v) + F.try_divide(F.pow(F.col(y) - F.col("mean"), 2), all_v)) / 2).alias("nll"))


def gaussian_mfx_lr(df: DataFrame, by: Sequence[str], y: str, v: str, rounds: int = 5) -> DataFrame:
    """(by, lr): the mean's sign times the root of twice the gain in log likelihood over a mean of 0."""
    by = list(by)
    free = gaussian_mfx(df, by, y, v, rounds)
    null = gaussian_mfx(df, by, y, v, rounds, constrained=True).select(*by, F.col("nll").alias("__null"))
    return free.join(null, by).select(*by, (F.signum("mean") * F.sqrt(F.greatest(F.lit(0.0), 2 * (F.col("__null") - F.col("nll"))))).alias("lr"))
