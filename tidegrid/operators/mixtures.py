"""Mixtures of normal densities, fitted by expectation and maximisation with one aggregation a round."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import cut

#: Variances stay above this.
LEAST_VARIANCE = 1e-12


def densities(x: Column, k: int) -> list[Column]:
    """Weighted densities of x under the components whose w, m and v columns are beside it."""
    part = lambda i: F.col(f"w{i}") * F.exp(-F.pow(x - F.col(f"m{i}"), 2) / 2 / F.col(f"v{i}")) / F.sqrt(F.col(f"v{i}"))
    return [part(i) for i in range(1, k + 1)]


def gaussian_mixture(df: DataFrame, by: Sequence[str], x: str, k: int, rounds: int) -> DataFrame:
    """(by, w1.., m1.., v1..) of each unit after some rounds.

    The means start spread evenly over the unit's range, with its variance and equal weights. A round
    joins the parameters, one row a unit, and takes sums that are aggregated before the shuffle. Null
    values are left out; a component without members keeps null parameters.
    """
    by, rows = list(by), df.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("__x"))
    lo, hi, n = F.min("__x"), F.max("__x"), range(1, k + 1)
    now = rows.groupBy(*by).agg(
        *[F.lit(1.0 / k).alias(f"w{i}") for i in n], *[(lo + (i - 0.5) / k * (hi - lo)).alias(f"m{i}") for i in n], *[F.greatest(F.var_pop("__x"), F.lit(LEAST_VARIANCE)).alias(f"v{i}") for i in n]
    )
    for _ in range(rounds):
        held = rows.join(now, by).select(*by, "__x", F.array(*densities(F.col("__x"), k)).alias("__d"))
        total = F.aggregate("__d", F.lit(0.0), lambda a, d: a + d)
        held = held.withColumn("__t", total).select(*by, "__x", *[(F.col("__d")[i - 1] / F.nullif("__t", F.lit(0.0))).alias(f"__r{i}") for i in n])
        s = lambda i, p=0: F.sum(F.col(f"__r{i}") * F.pow("__x", F.lit(p)))
        mean = lambda i: s(i, 1) / F.nullif(s(i), F.lit(0.0))
        now = cut(held.groupBy(*by).agg(
            *[(s(i) / F.count("*")).alias(f"w{i}") for i in n], *[mean(i).alias(f"m{i}") for i in n], *[F.greatest(s(i, 2) / F.nullif(s(i), F.lit(0.0)) - F.pow(mean(i), 2), F.lit(LEAST_VARIANCE)).alias(f"v{i}") for i in n]
        ))
    return now
