"""Markov random field segmentation of grids: mean-field labels by neighbour joins, with class means and variances."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .grid import neighbours

#: Probabilities and variances are kept from 0 by this.
TINY = 1e-50


@dataclass(frozen=True)
class Classes:
    """Means and variances of the classes, what it costs two neighbours to be in two of them, and the weight of these costs."""

    mu: tuple[float, ...]
    var: tuple[float, ...]
    beta: float
    costs: tuple[tuple[float, ...], ...]

    def field(self, value: Column) -> Column:
        """The logarithms of a value's densities under the classes, without their constant."""
        return F.array(*[-F.pow(value - m, F.lit(2)) / (2 * max(v, TINY)) - F.log(F.lit(max(v, TINY))) / 2 for m, v in zip(self.mu, self.var)])


def potts(k: int) -> tuple[tuple[float, ...], ...]:
    """Neighbours in different classes cost 1."""
    return tuple(tuple(float(i != j) for j in range(k)) for i in range(k))


def _energy(cells: DataFrame, at: Sequence[str], costs: Sequence[Sequence[float]], reach: int) -> DataFrame:
    """cells with energy: for each class the sum over the neighbours of the expected cost."""
    k = len(costs)
    held = neighbours(cells, at, "q", reach).groupBy(*at).agg(*[F.sum(F.col("neighbour")[c]).alias(f"__s{c}") for c in range(k)])
    sums = [F.coalesce(F.col(f"__s{c}"), F.lit(0.0)) for c in range(k)]
    cost = [sum((w * s for w, s in zip(row, sums) if w), F.lit(0.0)) for row in costs]
    return cells.join(held, list(at), "left").withColumn("energy", F.array(*cost)).drop(*[f"__s{c}" for c in range(k)])


def expected(cells: DataFrame, at: Sequence[str], model: Classes, reach: int = 1) -> DataFrame:
    """cells(at, value, q, prior) with q updated once: each cell's class probabilities given those of its neighbours.

    Cells of one colour are never neighbours, so a colour is updated at once, after the ones before it:
    two colours where neighbours differ in one coordinate, else one for each parity of the coordinates. So
    every update lowers the free energy, as updates cell by cell do. A colour is one neighbour join and one
    aggregate.
    """
    parities = [F.pmod(F.col(c), F.lit(2)).cast("int") for c in at]
    colours = 2 if reach == 1 else 1 << len(at)
    colour = F.pmod(sum(parities, F.lit(0)), F.lit(2)) if reach == 1 else sum((p * (1 << i) for i, p in enumerate(parities)), F.lit(0))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    for turn in range(1 if model.beta == 0 else colours):
        near = _energy(cells, at, model.costs, reach) if model.beta else cells.withColumn("energy", F.array(*[F.lit(0.0)] * len(model.mu)))
        logs = F.zip_with(F.zip_with(model.field(F.col("value")), F.col("prior"), lambda a, b: a + F.log(F.greatest(b, F.lit(TINY)))), F.col("energy"), lambda a, e: a - 2 * model.beta * e)
        near = near.withColumn("__l", logs).withColumn("__l", F.transform("__l", lambda x: F.exp(x - F.array_max("__l"))))
        fresh = F.transform("__l", lambda x: x / add(F.col("__l")))
        mine = F.lit(True) if model.beta == 0 else colour == turn
        cells = stored(near.withColumn("q", F.when(mine, fresh).otherwise(F.col("q"))).select(*at, "value", "q", "prior"), "segments")
    return cells


def fitted(cells: DataFrame, model: Classes, freeze: Sequence[int] = ()) -> Classes:
    """The classes' means and variances under the probabilities q; frozen ones stay. One aggregate, of deviations from the old means."""
    k = range(len(model.mu))
    d = lambda c: F.col("value") - F.lit(model.mu[c])
    row = cells.agg(*[F.sum(x).alias(f"{n}{c}") for c in k for n, x in (("n", F.col("q")[c]), ("s", F.col("q")[c] * d(c)), ("t", F.col("q")[c] * d(c) * d(c)))]).first()
    mu, var = list(model.mu), list(model.var)
    for c in k:
        if c not in freeze and row[f"n{c}"]:
            shift = row[f"s{c}"] / row[f"n{c}"]
            mu[c], var[c] = model.mu[c] + shift, max(row[f"t{c}"] / row[f"n{c}"] - shift * shift, 0.0)
    return replace(model, mu=tuple(mu), var=tuple(var))


def free_energy(cells: DataFrame, at: Sequence[str], model: Classes, reach: int = 1) -> float:
    """Sum of q (log q - log density - log prior) and of beta q'Uq over the neighbours: what the rounds lower."""
    near = _energy(cells, at, model.costs, reach) if model.beta else cells.withColumn("energy", F.array(*[F.lit(0.0)] * len(model.mu)))
    field = model.field(F.col("value"))
    own = [F.col("q")[c] * (F.log(F.greatest(F.col("q")[c], F.lit(TINY))) - field[c] - F.log(F.greatest(F.col("prior")[c], F.lit(TINY))) + model.beta * F.col("energy")[c]) for c in range(len(model.mu))]
    return near.agg(F.sum(sum(own, F.lit(0.0)))).first()[0] or 0.0


def segment(cells: DataFrame, at: Sequence[str], value: str, mu: Sequence[float], var: Sequence[float], beta: float = 0.5, rounds: int = 10, costs: Sequence[Sequence[float]] | None = None, prior: str | None = None, freeze: Sequence[int] = (), reach: int = 1, tolerance: float | None = None) -> tuple[DataFrame, Classes, list[float]]:
    """(cells, classes, energies) after rounds of expected() and fitted(): cells(at, value, q, prior, label), label being the most probable class, of equal ones the first.

    It starts from equal probabilities and the classes given. prior is an array column of probabilities of a
    cell's classes, equal ones by default. With a tolerance the free energy is taken after each round, and
    rounds end once it falls by less; else energies holds the last one alone. Cells with a null or NaN
    value, or without a coordinate, are left out; a repeated cell is refused.
    """
    k = len(mu)
    model = Classes(tuple(map(float, mu)), tuple(map(float, var)), float(beta), tuple(map(tuple, costs)) if costs is not None else potts(k))
    even = F.array(*[F.lit(1.0 / k)] * k)
    rows = cells.select(*at, F.col(value).cast("double").alias("value"), even.alias("q"), (F.col(prior) if prior else F.array(*[F.lit(1.0)] * k)).alias("prior"))
    now = stored(rows.dropna(subset=[*at, "value"]).where(~F.isnan("value")), "segments")
    if not now.groupBy(*at).count().where("count > 1").isEmpty():
        raise ValueError("a cell is repeated")
    energies: list[float] = []
    for _ in range(rounds):
        now = expected(now, at, model, reach)
        model = fitted(now, model, freeze)
        if tolerance is not None:
            energies.append(free_energy(now, at, model, reach))
            if len(energies) > 1 and energies[-2] - energies[-1] < tolerance:
                break
    if tolerance is None:
        energies.append(free_energy(now, at, model, reach))
    return now.withColumn("label", (F.array_position("q", F.array_max("q")) - 1).cast("int")), model, energies
