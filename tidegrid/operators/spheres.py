"""Mixtures of von Mises densities on the unit sphere in three dimensions, with a fixed precision and perhaps a uniform class."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored


@dataclass(frozen=True)
class Sphere:
    """Components' directions and weights; with a null class its weight comes first and its density is uniform."""

    precision: float
    means: tuple[tuple[float, ...], ...]
    weights: tuple[float, ...]
    null_class: bool = False

    def densities(self, v: Column) -> list[Column]:
        """Each class's density at a unit vector, without its weight."""
        scale = self.precision / (2 * math.pi * (1 - math.exp(-2 * self.precision)))
        dot = lambda m: sum((v[i] * x for i, x in enumerate(m)), F.lit(0.0))
        each = [F.lit(scale) * F.exp((dot(m) - 1) * self.precision) for m in self.means]
        return ([F.lit(1 / (4 * math.pi))] if self.null_class else []) + each


def unit(v: Column, dims: int = 3) -> Column:
    """The first coordinates of a vector, scaled to length 1; null where they are 0 or null."""
    x = [v[i].cast("double") for i in range(dims)]
    size = F.sqrt(sum((c * c for c in x), F.lit(0.0)))
    return F.when(size > 0, F.array(*[c / size for c in x]))


def shares(points: DataFrame, vector: str, model: Sphere, bias: str | None = None) -> DataFrame:
    """points with shares, of the classes in a point, and density, of the mixture; both null for a null vector. Where all densities are too small for doubles the shares are null.

    bias, a column, is the prior probability that a point isn't of the null class.
    """
    if bias and not model.null_class:
        raise ValueError("a bias needs a null class")
    weighted = F.array(*[w * d for w, d in zip(model.weights, model.densities(F.col(vector)))])
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    out = points.withColumn("__d", F.when(F.col(vector).isNotNull(), weighted)).withColumn("density", total(F.col("__d")))
    out = out.withColumn("shares", F.transform("__d", lambda x: F.try_divide(x, F.col("density"))))
    if bias:
        turned = F.transform("shares", lambda x, i: x * F.when(i == 0, 1 - F.col(bias)).otherwise(F.col(bias)))
        out = out.withColumn("shares", turned).withColumn("__s", total(F.col("shares"))).withColumn("shares", F.transform("shares", lambda x: F.try_divide(x, F.col("__s")))).drop("__s")
    return out.drop("__d")


def fit(points: DataFrame, vector: str, precision: float, means: Sequence[Sequence[float]], null_class: bool = False, rounds: int = 100, least: int = 1, delta: float = 1e-6, bias: str | None = None) -> tuple[Sphere, float]:
    """(model, mean log density before the last round) from starting directions and equal weights.

    A round is one aggregate of 4 sums a class, which come to the driver. It ends after `rounds`, or when
    after more than least + 1 of them the mean log density has risen by less than delta. Null vectors are
    left out; without points it is refused. A class without points keeps its direction.
    """
    names = [vector] + ([bias] if bias else [])
    rows = stored(points.select(*names).where(F.col(vector).isNotNull()), "sphere")
    k, shift = len(means), int(null_class)
    now = Sphere(precision, tuple(tuple(map(float, m)) for m in means), (1.0 / (k + shift),) * (k + shift), null_class)
    before = last = -math.inf
    for turn in range(rounds):
        s = shares(rows, vector, now, bias)
        z = F.col("shares")
        sums = [F.sum(z[c]).alias(f"n{c}") for c in range(k + shift)] + [F.sum(z[c + shift] * F.col(vector)[i]).alias(f"m{c}_{i}") for c in range(k) for i in range(3)]
        row = s.agg(F.avg(F.log("density")).alias("ll"), *sums).first()
        if row.ll is None:
            raise ValueError("a mixture needs points")
        last = row.ll
        n = [row[f"n{c}"] or 0.0 for c in range(k + shift)]
        moved = []
        for c in range(k):
            m = [row[f"m{c}_{i}"] or 0.0 for i in range(3)]
            size = math.sqrt(sum(x * x for x in m))
            moved.append(tuple(x / size for x in m) if size > 0 else now.means[c])
        now = Sphere(precision, tuple(moved), tuple(x / sum(n) for x in n), null_class)
        if turn > least and last < before + delta:
            break
        before = last
    return now, last


def fit_best(points: DataFrame, vector: str, precision: float, starts: Sequence[Sequence[Sequence[float]]], null_class: bool = False, **more: object) -> tuple[Sphere, float]:
    """The fit of the largest mean log density from several sets of starting directions."""
    return max((fit(points, vector, precision, means, null_class, **more) for means in starts), key=lambda x: x[1])


def select(points: DataFrame, vector: str, precision: float, starts: Sequence[Sequence[Sequence[float]]], null_class: bool = False, **more: object) -> tuple[Sphere, float]:
    """(model, score) of the number of classes with the best BIC; starts has one set of directions for each number tried."""
    n = points.where(F.col(vector).isNotNull()).count()
    made = []
    for means in starts:
        model, ll = fit(points, vector, precision, means, null_class, **more)
        # directions have two angles, weights sum to one
        made.append((model, ll * n - math.log(n) * (len(model.weights) - 1 + 2 * len(means)) / 2))
    return max(made, key=lambda x: x[1])
