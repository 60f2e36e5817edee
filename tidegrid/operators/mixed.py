"""Two-level models: effects with known variances and a design, by expectation maximisation over all units at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..storage import stored
from .models import fit

Contrast = Sequence[Sequence[float]] | None


def _constrained(fits: DataFrame, by: Sequence[str], contrasts: Sequence[Contrast]) -> DataFrame:
    """(by, n, beta0, sse0, g0, beta1, ...): for each contrast C the least-squares fit with C beta = 0, and the matrix that takes X'e to the change of beta under it."""
    k = len(contrasts)
    names = [f"{c}{m}" for m in range(k) for c in ("beta", "sse", "g")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("beta", "cov", "sse")}
            out: list[list] = [[] for _ in names]
            for beta, cov, sse in zip(*cols.values()):
                for m, rows in enumerate(contrasts):
                    found = (None, None, None)
                    if beta[0] is not None:
                        b, a, s = np.array(beta), np.array(cov), sse
                        if rows is not None:
                            c = np.array(rows, dtype=float)
                            inner = np.linalg.inv(c @ a @ c.T)
                            s = s + float((c @ b) @ inner @ (c @ b))
                            b, a = b - a @ c.T @ inner @ (c @ b), a - a @ c.T @ inner @ c @ a
                        found = (b.tolist(), s, a.tolist())
                    for at, value in enumerate(found):
                        out[3 * m + at].append(value)
            kinds = [pa.list_(pa.float64()), pa.float64(), pa.list_(pa.list_(pa.float64()))] * k
            keep = [*by, "n"]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], *[pa.array(x, t) for x, t in zip(out, kinds)]], [*keep, *names])

    vector = ArrayType(DoubleType())
    schema = StructType([*[fits.schema[c] for c in [*by, "n"]], *[StructField(c, t) for c, t in zip(names, [vector, DoubleType(), ArrayType(vector)] * k)]])
    return fits.mapInArrow(run, schema)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def two_level(df: DataFrame, by: Sequence[str], xs: Sequence[str], y: str, v: str, rounds: int = 5, contrasts: Sequence[Contrast] = (None,), flat: bool = False) -> DataFrame:
    """(by, n, beta0, s20, ll0, beta1, ...) of y = xs beta + N(0, s2) + N(0, v), v known, by so many rounds of EM; for each entry of contrasts the model in which C beta = 0.

    It starts from least squares and their mean squared residual, or, flat, from an infinite s2, so that
    the first round (there has to be one) takes y as it is: least squares again, with the mean v added. ll is the log likelihood without its constant,
    -1/2 sum(log(s2 + v) + r^2 / (s2 + v)). All models go together: a round is one join to the units' rows
    and one aggregate, of what the residuals add (so offsets cost no digits); both sides are stored.
    Rows with a null, or a negative v, are left out. Collinear columns give nulls.
    """
    by, p = list(by), len(xs)
    names = [*xs, y, v]
    rows = df.select(*by, F.array(*[F.col(c).cast("double") for c in xs]).alias("__x"), F.col(y).cast("double").alias("__y"), F.col(v).cast("double").alias("__v"), *[F.col(c).isNull().alias(f"__null{k}") for k, c in enumerate(names)])
    for k in range(len(names)):
        rows = rows.where(~F.col(f"__null{k}")).drop(f"__null{k}")
    rows = stored(rows.where("__v >= 0"), "two-level-rows")
    plain = rows.select(*by, "__y", *[F.col("__x")[k].alias(f"__x{k}") for k in range(p)])
    start = _constrained(fit(plain, by, [f"__x{k}" for k in range(p)], "__y"), by, contrasts)
    models = range(len(contrasts))
    if flat and rounds < 1:
        raise ValueError("a flat start needs a round")
    if flat:
        start, rounds = start.join(rows.groupBy(*by).agg(F.avg("__v").alias("__mv")), by), rounds - 1
    s2 = lambda m: F.col(f"sse{m}") / F.col("n") + (F.col("__mv") if flat else F.lit(0.0))
    state = stored(start.select(*by, "n", *[x for m in models for x in (f"beta{m}", s2(m).alias(f"s2{m}"), f"g{m}")]), "two-level")
    residual = lambda m: F.col("__y") - _dot(F.col("__x"), F.col(f"beta{m}"))
    change = lambda m: F.transform(f"g{m}", lambda row: _dot(row, F.col(f"__xe{m}")))
    for _ in range(rounds):
        j = rows.join(state, by)
        for m in models:
            # without any variance the residual stays
            share = F.coalesce(F.try_divide(F.col(f"s2{m}"), F.col(f"s2{m}") + F.col("__v")), F.when(F.col(f"s2{m}").isNotNull(), 1.0))
            j = j.withColumn(f"__w{m}", share).withColumn(f"__e{m}", share * residual(m))
        sums = j.groupBy(*by).agg(F.first("n").alias("n"), *[x for m in models for x in (
            F.first(f"beta{m}").alias(f"beta{m}"), F.first(f"g{m}").alias(f"g{m}"), F.array(*[F.sum(F.col("__x")[i] * F.col(f"__e{m}")) for i in range(p)]).alias(f"__xe{m}"),
            F.sum(F.col(f"__e{m}") * F.col(f"__e{m}")).alias(f"__ee{m}"), F.sum(F.col(f"__w{m}") * F.col("__v")).alias(f"__vz{m}"))])
        for m in models:
            sums = sums.withColumn(f"__d{m}", change(m))
        state = stored(sums.select(*by, "n", *[x for m in models for x in (
            F.zip_with(f"beta{m}", f"__d{m}", lambda b, d: b + d).alias(f"beta{m}"), ((F.greatest(F.col(f"__ee{m}") - _dot(F.col(f"__d{m}"), F.col(f"__xe{m}")), F.lit(0.0)) + F.col(f"__vz{m}")) / F.col("n")).alias(f"s2{m}"), f"g{m}")]), "two-level")
    whole = lambda m: F.col(f"s2{m}") + F.col("__v")
    ends = rows.join(state, by).groupBy(*by).agg(F.first("n").alias("n"), *[x for m in models for x in (
        F.first(f"beta{m}").alias(f"beta{m}"), F.first(f"s2{m}").alias(f"s2{m}"), (-F.sum(F.log(whole(m)) + F.try_divide(F.pow(residual(m), 2), whole(m))) / 2).alias(f"ll{m}"))])
    return ends


def mfx_stat(df: DataFrame, by: Sequence[str], xs: Sequence[str], y: str, v: str, column: int, rounds: int = 5) -> DataFrame:
    """(by, effect, s2, f, t): the likelihood ratio test of one column of a two-level design. f is twice the gain in log likelihood, at least 0; t its root with the effect's sign."""
    if not 0 <= column < len(xs):
        raise ValueError(f"the design has no column {column}")
    null = [[1.0 if k == column else 0.0 for k in range(len(xs))]]
    made = two_level(df, by, xs, y, v, rounds, (None, null))
    f = F.greatest(F.lit(0.0), 2 * (F.col("ll0") - F.col("ll1")))
    out = made.select(*by, F.col("beta0")[column].alias("effect"), F.col("s20").alias("s2"), F.when(F.col("ll0").isNotNull(), f).alias("f"))
    return out.withColumn("t", F.signum("effect") * F.sqrt("f"))


def one_sample(df: DataFrame, by: Sequence[str], y: str, v: str, rounds: int = 5) -> DataFrame:
    """mfx_stat() of the mean."""
    return mfx_stat(df.withColumn("__one", F.lit(1.0)), by, ["__one"], y, v, 0, rounds)


def two_sample(df: DataFrame, by: Sequence[str], group: str, y: str, v: str, rounds: int = 5) -> DataFrame:
    """mfx_stat() of the difference of group 1 to group 0."""
    return mfx_stat(df.withColumn("__one", F.lit(1.0)), by, ["__one", group], y, v, 1, rounds)


def two_level_lr(df: DataFrame, by: Sequence[str], xs: Sequence[str], y: str, v: str, contrast: Sequence[Sequence[float]], rounds: int = 2) -> DataFrame:
    """(by, lr): twice the gain in log likelihood over the model in which the contrasts are 0, both from a flat start; at least 0."""
    made = two_level(df, by, xs, y, v, rounds, (None, contrast), flat=True)
    return made.select(*by, F.when(F.col("ll0").isNotNull(), F.greatest(F.lit(0.0), 2 * (F.col("ll0") - F.col("ll1")))).alias("lr"))


def estimate_mean(df: DataFrame, by: Sequence[str], y: str, sd: str) -> DataFrame:
    """(by, effect, scale, sd, t) of y whose standard deviations are known up to a scale: the mean weighted by 1 / sd^2. Rows without a positive sd have no weight but count; a unit of one row has a null scale."""
    by = list(by)
    w = F.when(F.col(sd) > 0, 1 / (F.col(sd) * F.col(sd))).otherwise(0.0)
    rows = df.select(*by, F.col(y).alias("__y"), w.alias("__w")).where("__y is not null")
    means = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("__w").alias("__sw"), F.try_divide(F.sum(F.col("__w") * F.col("__y")), F.sum("__w")).alias("effect"))
    both = rows.join(means, by).groupBy(*by).agg(*[F.first(c).alias(c) for c in ("n", "__sw", "effect")], F.sum(F.col("__w") * F.pow(F.col("__y") - F.col("effect"), 2)).alias("__ss"))
    scale = F.try_divide(F.col("__ss"), F.col("n") - 1)
    out = both.select(*by, "effect", F.sqrt(scale).alias("scale"), F.sqrt(F.try_divide(scale, F.col("__sw"))).alias("sd"))
    return out.withColumn("t", F.coalesce(F.try_divide("effect", "sd"), F.lit(0.0)))


def estimate_varatio(df: DataFrame, by: Sequence[str], y: str, sd: str, dof: str | None = None, rounds: int = 10) -> DataFrame:
    """(by, fixed, random, ratio): the mean variance within (weighted by dof, if given), the variance between by EM, and their ratio.

    Rows without a y or a positive sd are left out; a unit of one row has nulls. A round is one join to
    the units' rows and one aggregate.
    """
    by = list(by)
    rows = df.select(*by, F.col(y).cast("double").alias("__y"), (F.col(sd) * F.col(sd)).alias("__s"), (F.col(dof) if dof else F.lit(1.0)).alias("__d")).where("__y is not null and __s > 0")
    means = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("__y").alias("__m"), F.min("__s").alias("__least"), F.var_samp("__y").alias("s2"), F.try_divide(F.sum(F.col("__d") * F.col("__s")), F.sum("__d")).alias("fixed"))
    means = stored(means.withColumn("__least", F.col("__least") * 0.99), "variances")
    rows = stored(rows.join(means.select(*by, "__m", "__least"), by).select(*by, (F.col("__y") - F.col("__m")).alias("__c"), (F.col("__s") - F.col("__least")).alias("__above")), "variance-rows")
    state = means.select(*by, "n", "s2")
    for _ in range(rounds):
        total = F.col("__above") + F.col("s2")
        j = rows.join(state, by).withColumn("__w", F.when(total > 0, 1 / total).otherwise(0.0))
        w, c = F.col("__w"), F.col("__c")
        sums = j.groupBy(*by).agg(F.first("n").alias("n"), F.first("s2").alias("s2"), *[F.sum(x).alias(k) for k, x in (("__sw", w), ("__swc", w * c), ("__sww", w * w), ("__swwc", w * w * c), ("__swwcc", w * w * c * c), ("__saw", F.col("__above") * w), ("__saww", F.col("__above") * w * w))])
        inv = F.when(F.col("__sw") > 0, 1 / F.col("__sw")).otherwise(0.0)
        mu = inv * F.col("__swc")
        spread = F.col("__swwcc") - 2 * mu * F.col("__swwc") + mu * mu * F.col("__sww")
        trace = 1 + F.col("__saw") - F.col("__saww") * inv
        state = stored(sums.select(*by, "n", ((F.col("s2") * trace + F.col("s2") * F.col("s2") * spread) / F.col("n")).alias("s2")), "variances")
    out = means.drop("s2", "n").join(state, by).withColumn("random", F.col("s2") - F.col("__least"))
    return out.select(*by, "fixed", "random", F.coalesce(F.try_divide("random", "fixed"), F.lit(0.0)).alias("ratio"))
