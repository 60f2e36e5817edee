"""Mixtures of normal densities in several dimensions, regularised or variational: rounds of one aggregate each."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

TINY = 1e-15
#: Weight of the prior mean, in points.
SHRINKAGE = 0.01


def digamma(x: np.ndarray | float) -> np.ndarray:
    """The logarithmic derivative of the gamma function for positive x: moved up by 8, then its asymptotic series."""
    x = np.asarray(x, dtype=float)
    y = x + 8
    tail = np.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8) - 1 / (132 * y**10)
    return tail - sum(1 / (x + i) for i in range(8))


@dataclass(frozen=True)
class Prior:
    """A weak prior from the data: its mean, and its variances shrunk by the number of components to the power 2/d."""

    mean: np.ndarray
    inverse_scale: np.ndarray  # a diagonal
    weight: float
    dof: float
    shrinkage: float = SHRINKAGE


@dataclass(frozen=True)
class Mixture:
    """k components. precisions are inverse covariances, k x d x d; of a variational mixture they are Wishart scales, and weights are Dirichlet counts."""

    weights: np.ndarray
    means: np.ndarray
    precisions: np.ndarray
    prior: Prior
    variational: bool = False
    diagonal: bool = False
    shrinkage: np.ndarray | None = None
    dof: np.ndarray | None = None

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Logarithms of the weighted densities: a row a point, a column a component."""
        k, d = self.means.shape
        diff = x[:, None, :] - self.means
        quad = np.einsum("nki,kij,nkj->nk", diff, self.precisions, diff)
        half = np.linalg.slogdet(self.precisions)[1] / 2 - d / 2 * math.log(2 * math.pi)
        if not self.variational:
            return np.log(np.maximum(self.weights, 1e-300)) + half - quad / 2
        rest = digamma(self.weights) - digamma(self.weights.sum()) - d / 2 / self.shrinkage + d / 2 * math.log(2) + sum(digamma((self.dof - i) / 2) for i in range(d)) / 2
        return rest + half - quad * self.dof / 2

    def moved(self, n: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> Mixture:
        """The parameters that fit shares: their sums n, of x - mean, and of the products of x - mean."""
        p, d = self.prior, self.means.shape[1]
        at = np.maximum(n, TINY)[:, None]
        offset = s1 / at
        empirical = np.where(n[:, None] > 0, self.means + offset, 0.0)
        spread = s2 - np.einsum("ki,kj->kij", s1, offset)
        shrinkage = p.shrinkage + n
        means = (empirical * n[:, None] + p.mean * p.shrinkage) / shrinkage[:, None]
        away = empirical - p.mean
        inner = np.diag(p.inverse_scale) + spread + np.einsum("ki,kj->kij", away, away) * (p.shrinkage * n / shrinkage)[:, None, None]
        if self.diagonal:
            inner = inner * np.eye(d)
        dof, weights = p.dof + n, p.weight + n
        if self.variational:
            return Mixture(weights, means, np.linalg.inv(inner), p, True, self.diagonal, shrinkage, dof)
        return Mixture(weights / weights.sum(), means, np.linalg.inv(inner / (dof + d + 2)[:, None, None]), p, False, self.diagonal)


def _points(df: DataFrame, vector: str) -> DataFrame:
    v = F.transform(vector, lambda x: x.cast("double"))
    return df.select(v.alias("x")).where(F.col("x").isNotNull() & ~F.exists("x", lambda x: x.isNull()))


def _arrays(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def sums(rows: DataFrame, model: Mixture, hard: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, float, np.ndarray]:
    """(number of points, n, s1, s2, log likelihood, shares' entropies) for Mixture.moved().

    A task adds up its points and gives one row a number; these are added by position before they come
    to the driver, which gets k (2 + d + d^2) + 2 numbers however many points there are. hard centres
    give each point to its nearest one instead.
    """
    k, d = model.means.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + k * (2 + d + d * d))
        for batch in batches:
            x = _arrays(batch.column(0), d)
            if hard is not None:
                near = ((x[:, None, :] - hard) ** 2).sum(2).argmin(1)
                share, ll = np.eye(k)[near], np.zeros(len(x))
            else:
                logs = model.logs(x)
                top = logs.max(1)
                like = np.exp(logs - top[:, None])
                all_ = like.sum(1)
                share, ll = like / all_[:, None], np.log(np.maximum(np.exp(top) * all_, TINY))
            diff = x[:, None, :] - model.means
            parts = [[len(x), ll.sum()], share.sum(0), -(share * np.log(np.maximum(share, TINY))).sum(0), np.einsum("nk,nki->ki", share, diff).ravel(), np.einsum("nk,nki,nkj->kij", share, diff, diff).ravel()]
            total += np.concatenate(parts)
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(total)), pa.int32()), "value": pa.array(total)})

    made = rows.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(2 + k * (2 + d + d * d))
    for at, value in made:
        out[at] = value
    n, ent, rest = out[2 : 2 + k], out[2 + k : 2 + 2 * k], out[2 + 2 * k :]
    return out[0], n, rest[: k * d].reshape(k, d), rest[k * d :].reshape(k, d, d), out[1], ent


def fit(points: DataFrame, vector: str, centres: Sequence[Sequence[float]], rounds: int = 100, delta: float = 1e-4, variational: bool = False, diagonal: bool = False) -> Mixture:
    """A mixture of as many components as centres: points start with their nearest centre, then at most so many rounds, until the mean log likelihood rises by less than delta.

    The fit is regularised by a Prior: a component without points stays at it. Variational: Dirichlet, normal
    and Wishart posteriors. Points with a null, in whole or in a coordinate, are left out. No points, or a
    coordinate that does not vary, are refused.
    """
    rows, at = _points(points, vector), np.array(centres, dtype=float)
    k, d = at.shape
    x = [F.col("x")[i] for i in range(d)]
    held = rows.agg(*[F.avg(v) for v in x], *[F.var_pop(v) for v in x]).first()
    if held[0] is None or min(held[d:]) <= 0:
        raise ValueError("a mixture needs points that vary in each coordinate")
    mean, var = np.array(held[:d]), np.array(held[d:])
    prior = Prior(mean, var / k ** (2 / d), 1.0 if variational else 1.0 / k, d + 2.0)
    start = Mixture(np.full(k, 1.0 / k), np.tile(mean, (k, 1)), np.tile(np.diag(1 / var), (k, 1, 1)), prior, variational, diagonal)
    _, n, s1, s2, _, _ = sums(rows, start, at)
    now, before = start.moved(n, s1, s2), -math.inf
    for _ in range(rounds):
        count, n, s1, s2, ll, _ = sums(rows, now)
        if ll / count < before + delta:
            break
        now, before = now.moved(n, s1, s2), ll / count
    return now


def likelihood(points: DataFrame, id_col: str, vector: str, model: Mixture) -> DataFrame:
    """(id, like, total, label): each point's weighted densities under the components, their sum, and the component of the largest, from 0; null where the point has a null."""
    k, d = model.means.shape
    v = F.transform(vector, lambda x: x.cast("double"))
    good = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    rows = points.select(F.col(id_col).alias("id"), F.when(good, v).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1)
            at = np.flatnonzero(held.is_valid().to_numpy(zero_copy_only=False))
            like = np.exp(model.logs(_arrays(held.drop_null(), d)))
            rows: list = [None] * batch.num_rows
            total, label = list(rows), list(rows)
            for i, value in zip(at, like):
                rows[i], total[i], label[i] = value.tolist(), float(value.sum()), int(value.argmax())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64())), pa.array(total, pa.float64()), pa.array(label, pa.int64())], ["id", "like", "total", "label"])

    schema = StructType([rows.schema["id"], StructField("like", ArrayType(DoubleType())), StructField("total", DoubleType()), StructField("label", LongType())])
    return rows.mapInArrow(run, schema)


def average_log_likelihood(points: DataFrame, vector: str, model: Mixture) -> float:
    count, _, _, _, ll, _ = sums(_points(points, vector), model)
    return ll / count


def bic(points: DataFrame, vector: str, model: Mixture) -> float:
    """The log likelihood less the logarithm of the points for each parameter."""
    count, _, _, _, ll, _ = sums(_points(points, vector), model)
    k, d = model.means.shape
    return ll - math.log(count) * (k * (1 + 2 * d) - 1 if model.diagonal else k * (1 + d + (d * d + 1) / 2) - 1)


def _log_wishart(dof: float, inverse_scale: np.ndarray) -> tuple[float, float]:
    """(log normaliser, mean of the log determinant) of a Wishart density."""
    d, i = len(inverse_scale), np.arange(len(inverse_scale))
    logdet = np.linalg.slogdet(inverse_scale)[1]
    gammas = sum(math.lgamma((dof - k) / 2) for k in range(d))
    return d * (d - 1) * math.log(math.pi) / 4 + gammas + dof * d * math.log(2) / 2 - dof * logdet / 2, float(digamma((dof - i) / 2).sum() + d * math.log(2) - logdet)


def evidence(points: DataFrame, vector: str, model: Mixture) -> float:
    """The lower bound of the log evidence of a variational mixture (its free energy): one pass over the points.

    What the points are expected to say under the posterior, with the entropy of their shares, less the
    divergences of the posteriors from the prior.
    """
    if not model.variational:
        raise ValueError("the evidence bound is of variational mixtures; see bic()")
    _, n, s1, s2, _, ent = sums(_points(points, vector), model)
    k, d = model.means.shape
    p, w = model.prior, model.weights
    offset = s1 / np.maximum(n, TINY)[:, None]
    # about the mean of the component's points
    spread = s2 - np.einsum("ki,kj->kij", s1, offset)
    # each component's points, and what its mean and precision cost
    inverse_prior, out = np.diag(p.inverse_scale), 0.0
    logs = digamma(w) - digamma(w.sum())
    for c in range(k):
        scale, dof = model.precisions[c], model.dof[c]
        z1, mean_log = _log_wishart(dof, np.linalg.inv(scale))
        out += n[c] * (logs[c] + (mean_log - d * math.log(2 * math.pi) - d / model.shrinkage[c]) / 2) + ent[c] - dof * np.trace(spread[c] @ scale) / 2
        z0, _ = _log_wishart(p.dof, inverse_prior)
        out -= (dof - p.dof) / 2 * mean_log - dof * d / 2 + dof * np.trace(inverse_prior @ scale) / 2 - z1 + z0
        away, ratio = model.means[c] - p.mean, p.shrinkage / model.shrinkage[c]
        out -= (d * (ratio - 1 - math.log(ratio)) + p.shrinkage * dof * away @ scale @ away) / 2
    dirichlet = math.lgamma(w.sum()) - sum(map(math.lgamma, w)) - math.lgamma(k * p.weight) + k * math.lgamma(p.weight)
    return float(out - dirichlet - ((w - p.weight) * logs).sum())
