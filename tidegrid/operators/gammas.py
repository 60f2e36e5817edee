"""Mixtures of a normal with gamma tails on one or both sides, fitted by sums over all values."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Densities and weights are kept from 0 by this.
TINY = 1e-15
#: Where all values are equal the shape would be infinite; it is this instead.
STEEP_SHAPE, STEEP = 10.0, 1e-7


def digamma(c: float) -> float:
    """The derivative of the log gamma function at c > 0: steps up to 10, then the asymptotic series."""
    down = 0.0
    while c < 10:
        down, c = down - 1 / c, c + 1
    v = 1 / (c * c)
    return down + math.log(c) - 0.5 / c - v * (1 / 12 - v * (1 / 120 - v * (1 / 252 - v * (1 / 240 - v / 132))))


def trigamma(c: float) -> float:
    up = 0.0
    while c < 10:
        up, c = up + 1 / (c * c), c + 1
    v = 1 / (c * c)
    return up + 1 / c + v / 2 + v / c * (1 / 6 - v * (1 / 30 - v * (1 / 42 - v / 30)))


def shape_of(gap: float) -> float:
    """The shape c with digamma(c) - log(c) = gap, the mean log less the log of the mean; Newton's steps on 1/c."""
    if gap > -STEEP:
        return STEEP_SHAPE
    s = -gap
    c = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(50):
        step = (math.log(c) - digamma(c) - s) / (1 / c - trigamma(c))
        new = c - step if c - step > 0 else c / 2
        if abs(new - c) <= 1e-14 * c:
            return new
        c = new
    return c


@dataclass(frozen=True)
class Gamma:
    """Density of positive numbers."""

    shape: float = 1.0
    scale: float = 1.0

    def log_density(self, x: Column) -> Column:
        """Null for x <= 0."""
        constant = -self.shape * math.log(self.scale) - math.lgamma(self.shape)
        return F.when(x > 0, constant + (self.shape - 1) * F.log(x) - x / self.scale)


@dataclass(frozen=True)
class Tailed:
    """A normal and gamma tails of -x (negative) and x (positive), with their weights: negative, normal, positive. A tail that isn't there weighs 0."""

    mean: float = 0.0
    var: float = 1.0
    negative: Gamma = Gamma()
    positive: Gamma = Gamma()
    weights: tuple[float, float, float] = (1 / 3, 1 / 3, 1 / 3)

    def parts(self, x: Column) -> list[Column]:
        """Each component's density at x times its weight."""
        normal = F.exp(-F.pow(x - F.lit(self.mean), F.lit(2)) / (2 * self.var)) / math.sqrt(2 * math.pi * self.var)
        tail = lambda g, y: F.coalesce(F.exp(g.log_density(y)), F.lit(0.0))
        return [w * p if w else F.lit(0.0) for w, p in zip(self.weights, (tail(self.negative, -x), normal, tail(self.positive, x)))]

    def shares(self, x: Column) -> list[Column]:
        """Each component's probability given x; where no density is above 1e-15 they add up to less than 1."""
        parts = self.parts(x)
        return [p / F.greatest(sum(parts, F.lit(0.0)), F.lit(TINY)) for p in parts]


def _rows(df: DataFrame, x: str) -> DataFrame:
    v = F.col(x).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).select(v.alias("x"))


def start(df: DataFrame, x: str, both: bool = True) -> Tailed:
    """Moments of all values, and of those below and above 0; equal weights, but none for a side without values that vary."""
    c = F.col("x")
    sides = {"n": F.when(c < 0, -c), "p": F.when(c > 0, c)}
    r = _rows(df, x).agg(F.avg(c).alias("m"), F.var_pop(c).alias("v"), *[f(s).alias(k + n) for k, s in sides.items() for n, f in (("m", F.avg), ("v", F.var_pop))]).first()
    tail = {k: Gamma(r[k + "m"] ** 2 / r[k + "v"], r[k + "v"] / r[k + "m"]) if r[k + "v"] else None for k in sides}
    held = [float(bool(tail["n"]) and both), 1.0, float(bool(tail["p"]))]
    return Tailed(r.m or 0.0, r.v or 1.0, tail["n"] or Gamma(), tail["p"] or Gamma(), tuple(h / sum(held) for h in held))


def _sums(rows: DataFrame, model: Tailed) -> Row:
    """All that a round needs, in one aggregate: shares, their sums of x and log x or squares, and the log likelihood."""
    c, (n, g, p) = F.col("x"), model.shares(F.col("x"))
    d, log = c - F.lit(model.mean), F.log(F.abs(c))
    asked = {"size": F.lit(1), "like": F.log(F.greatest(sum(model.parts(c), F.lit(0.0)), F.lit(TINY))), "g": g, "gd": g * d, "gdd": g * d * d, "n": n, "p": p}
    for k, z, side in (("n", n, c < 0), ("p", p, c > 0)):
        asked |= {k + "z": F.when(side, z), k + "x": F.when(side, z * F.abs(c)), k + "l": F.when(side, z * log)}
    return rows.agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(k) for k, v in asked.items()]).first()


def _gamma(r: Row, k: str) -> Gamma:
    if r[k + "z"] <= 0 or r[k + "x"] <= 0:
        return Gamma()
    shape = shape_of(r[k + "l"] / r[k + "z"] - math.log(r[k + "x"] / r[k + "z"]))
    return Gamma(shape, r[k + "x"] / (r[k + "z"] * shape))


def fitted(model: Tailed, r: Row, least_variance: float = 0.0, least_normal: float = 0.0) -> Tailed:
    """The model of greatest likelihood under the shares summed in r; a weightless normal stays as it was."""
    total = max(r.n + r.g + r.p, TINY)
    weights = [r.n / total, r.g / total, r.p / total]
    if weights[1] < least_normal:
        tails = max(weights[0] + weights[2], TINY)
        weights = [weights[0] / tails * (1 - least_normal), least_normal, weights[2] / tails * (1 - least_normal)]
    if r.g > TINY:
        shift = r.gd / r.g
        model = replace(model, mean=model.mean + shift, var=max(r.gdd / r.g - shift * shift, least_variance, TINY))
    return replace(model, negative=_gamma(r, "n"), positive=_gamma(r, "p"), weights=tuple(weights))


def fit(df: DataFrame, x: str, model: Tailed | None = None, rounds: int = 100, tolerance: float = 1e-4, least_variance: float = 0.0, least_normal: float = 0.0) -> tuple[Tailed, float]:
    """(model, mean log likelihood) after rounds of shares and sums, until the likelihood gains less than tolerance.

    It starts from the model given, or from start(). Each round is one aggregate of a dozen sums. Null and
    NaN are left out; without any value the model stays and its likelihood is NaN. Zeros belong to the normal.
    """
    model = model or start(df, x)
    rows = _rows(df, x)
    r = _sums(rows, model)
    if not r.size:
        return model, math.nan
    like = r.like / r.size
    for _ in range(rounds):
        model = fitted(model, r, least_variance, least_normal)
        r = _sums(rows, model)
        before, like = like, r.like / r.size
        if like < before + tolerance:
            break
    return model, like


def posterior(df: DataFrame, x: str, model: Tailed) -> DataFrame:
    """df with negative, normal and positive: each value's probabilities of the components; null for a null or NaN value."""
    v = F.col(x).cast("double")
    return df.withColumns({k: F.when(v.isNotNull() & ~F.isnan(v), s) for k, s in zip(("negative", "normal", "positive"), model.shares(v))})
