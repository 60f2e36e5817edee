"""Registration of grids by their joint histogram: many transforms in one job, similarities of a few thousand bins, a search over few parameters."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: Most bins of one grid: a histogram of both comes to the driver.
MOST_BINS = 1024
TINY = float(np.finfo(float).tiny)
Matrix = Sequence[Sequence[float]]


def clamp(cells: DataFrame, at: Sequence[str], value: str, bins: int) -> DataFrame:
    """(at, bin): values as whole bins from 0: their distance from the least where whole values fit into the bins, else scaled to bins - 1 and rounded. Null and NaN are left out."""
    if not 1 <= bins <= MOST_BINS:
        raise ValueError(f"bins are 1 to {MOST_BINS}")
    v = F.col(value).cast("double")
    rows = cells.where(v.isNotNull() & ~F.isnan(v)).select(*at, v.alias("__v"))
    low, high, whole = rows.agg(F.min("__v"), F.max("__v"), F.bool_and(F.col("__v") == F.floor("__v"))).first()
    if low is None or high == low:
        return rows.select(*at, F.lit(0).alias("bin"))
    scale = 1.0 if whole and high - low < bins else (bins - 1) / (high - low)
    return rows.select(*at, F.round((F.col("__v") - low) * scale).cast("int").alias("bin"))


def rotation(r: Sequence[float]) -> np.ndarray:
    """The rotation about the vector r by its length."""
    angle = math.sqrt(sum(x * x for x in r))
    if angle == 0:
        return np.eye(3)
    x, y, z = np.asarray(r, float) / angle
    s = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + math.sin(angle) * s + (1 - math.cos(angle)) * s @ s


def affine(params: Sequence[float]) -> tuple[list[list[float]], list[float]]:
    """(matrix, shift) in three dimensions of 6 parameters (shift, rotation vector), 7 (and a factor) or 12 (and three log scales and a rotation before them)."""
    p = np.asarray(params, float)
    if len(p) not in (6, 7, 12):
        raise ValueError("an affine map has 6, 7 or 12 parameters")
    m = rotation(p[3:6])
    if len(p) == 7:
        m = p[6] * m
    elif len(p) == 12:
        m = m @ np.diag(np.exp(p[6:9])) @ rotation(p[9:12])
    return m.tolist(), p[:3].tolist()


def shifts(params: Sequence[float]) -> tuple[list[list[float]], list[float]]:
    """(matrix, shift) of a translation in as many dimensions as parameters."""
    return np.eye(len(params)).tolist(), list(map(float, params))


def histograms(source: DataFrame, target: DataFrame, at: Sequence[str], transforms: Sequence[tuple[Matrix, Sequence[float]]], bin_: str = "bin", interpolate: str = "pv") -> DataFrame:
    """(k, a, b, n): joint histogram of source and target bins under the k-th transform of source positions into the target.

    With "pv" a source cell spreads its weight over the bins of the 2^d target cells about its place, with
    "tri" it falls whole into their weighted mean bin, rounded. Corners without a target cell don't count.
    All transforms are one job: the source is exploded by transform and corner and meets the target in an
    equi-join on the corner; the histogram is aggregated before its shuffle.
    """
    if interpolate not in ("pv", "tri"):
        raise ValueError("interpolate is pv or tri")
    # a constant of the plan: each transform's rows of factors, the shift last
    each = [F.struct(F.lit(k).alias("k"), F.array(*[F.array(*[F.lit(float(m)) for m in (*row, s)]) for row, s in zip(matrix, shift)]).alias("m")) for k, (matrix, shift) in enumerate(transforms)]
    dims = range(len(at))
    keep = [] if interpolate == "pv" else [F.struct(*at).alias("__cell")]
    moved = source.where(F.col(bin_).isNotNull()).select(*at, *keep, F.col(bin_).alias("a"), F.explode(F.array(*each)).alias("__t"))
    place = [reduce(lambda a, b: a + b, [F.col("__t.m")[d][e] * F.col(c) for e, c in enumerate(at)]) + F.col("__t.m")[d][len(at)] for d in dims]
    moved = moved.select(*[c for c in moved.columns if c == "__cell"], "a", F.col("__t.k").alias("k"), *[x.alias(f"__x{d}") for d, x in enumerate(place)])
    x = [F.col(f"__x{d}") for d in dims]
    corners = []
    for step in itertools.product((0, 1), repeat=len(at)):
        weight = reduce(lambda a, b: a * b, [(x[d] - F.floor(x[d])) if s else (1 - x[d] + F.floor(x[d])) for d, s in enumerate(step)])
        corners.append(F.struct(*[(F.floor(x[d]) + s).alias(f"q{d}") for d, s in enumerate(step)], weight.alias("w")))
    names = ["__cell"] if keep else []
    sent = moved.select(*names, "a", "k", F.explode(F.array(*corners)).alias("__e")).where("__e.w > 0")
    sent = sent.select(*names, "a", "k", *[F.col(f"__e.q{d}").alias(f"__q{d}") for d in dims], F.col("__e.w").alias("w"))
    grid = target.where(F.col(bin_).isNotNull()).select(*[F.col(a).cast("long").alias(f"__q{d}") for d, a in enumerate(at)], F.col(bin_).alias("b"))
    met = sent.join(grid, [f"__q{d}" for d in dims])
    if interpolate == "tri":
        met = met.groupBy("__cell", "a", "k").agg(F.round(F.sum(F.col("w") * F.col("b")) / F.sum("w")).cast("int").alias("b")).withColumn("w", F.lit(1.0))
    return met.groupBy("k", "a", "b").agg(F.sum("w").alias("n"))


def _moments(h: np.ndarray, values: np.ndarray) -> tuple[float, float, float]:
    """Weight, mean and variance of values under h."""
    n = max(h.sum(), TINY)
    mean = (h * values).sum() / n
    return h.sum(), mean, (h * (values - mean) ** 2).sum() / n


def _absolute(h: np.ndarray) -> tuple[float, float]:
    """Weight and mean absolute deviation from the median of a histogram of the bins 0, 1, ..."""
    n = h.sum()
    if n <= 0:
        return 0.0, 0.0
    median = int(np.searchsorted(np.cumsum(h), n / 2 * (1 - 1e-12)))
    return n, (h * np.abs(np.arange(len(h)) - median)).sum() / n


def _ratio(whole: float, parts: float) -> float:
    return 1 - parts / max(whole, TINY)


def _cc(h: np.ndarray) -> float:
    i, j = np.indices(h.shape)
    n, mi, vi = _moments(h, i)
    _, mj, vj = _moments(h, j)
    cov = (h * (i - mi) * (j - mj)).sum() / max(n, TINY)
    return cov * cov / (vi * vj) if vi * vj > 0 else 0.0


def _cr(h: np.ndarray) -> float:
    """How much of the target's variance the source's bin explains."""
    bins = np.arange(h.shape[1])
    within = sum(_moments(c, bins)[2] * c.sum() for c in h)
    return _ratio(_moments(h.sum(0), bins)[2], within / max(h.sum(), TINY))


def _crl1(h: np.ndarray) -> float:
    parts = [_absolute(c) for c in h]
    return _ratio(_absolute(h.sum(0))[1], sum(n * s for n, s in parts) / max(h.sum(), TINY))


def _entropy(p: np.ndarray) -> float:
    p = p[p > 0]
    return float(-(p * np.log(p)).sum())


def _entropies(h: np.ndarray) -> tuple[float, float, float]:
    p = h / max(h.sum(), TINY)
    return _entropy(p.sum(1)), _entropy(p.sum(0)), _entropy(p)


def _mi(h: np.ndarray) -> float:
    a, b, both = _entropies(h)
    return a + b - both


def _nmi(h: np.ndarray) -> float:
    a, b, both = _entropies(h)
    return 2 * (1 - both / (a + b)) if a + b > 0 else 0.0


#: Squared correlation, correlation ratios of squares and of absolute deviations, mutual information and its share of the entropies.
MEASURES: dict[str, Callable[[np.ndarray], float]] = {"cc": _cc, "cr": _cr, "crl1": _crl1, "mi": _mi, "nmi": _nmi}


def supervised(model: np.ndarray) -> Callable[[np.ndarray], float]:
    """The mean log ratio of a given joint distribution to the product of its margins, as a measure."""
    q = np.maximum(model / model.sum(), TINY)
    ratio = np.log(q) - np.log(q.sum(1))[:, None] - np.log(q.sum(0))
    return lambda h: float((h * ratio[: h.shape[0], : h.shape[1]]).sum() / max(h.sum(), TINY))


@dataclass(frozen=True)
class Registration:
    """Two binned grids, stored once, and the measure of their likeness under a transform.

    to_map turns parameters into (matrix, shift). With renormalize, cc, cr and crl1 become log likelihoods,
    -n/2 log(1 - measure), so a larger overlap counts for more; mi and supervised ones are multiplied by n.
    """

    source: DataFrame
    target: DataFrame
    at: tuple[str, ...]
    measure: str | Callable[[np.ndarray], float] = "crl1"
    to_map: Callable[[Sequence[float]], tuple[Matrix, Sequence[float]]] = affine
    interpolate: str = "pv"
    renormalize: bool = False

    def evaluate(self, candidates: Sequence[Sequence[float]]) -> list[float]:
        """The likeness under each candidate's parameters, by one job; 0 without any overlap."""
        rows = histograms(self.source, self.target, self.at, [self.to_map(c) for c in candidates], "bin", self.interpolate).collect()
        size = max([max(r.a, r.b) for r in rows], default=0) + 1
        h = np.zeros((len(candidates), size, size))
        for r in sorted(rows, key=lambda r: (r.k, r.a, r.b)):
            h[r.k, r.a, r.b] = r.n
        return [self._of(x) if x.sum() > 0 else 0.0 for x in h]

    def _of(self, h: np.ndarray) -> float:
        found = float((MEASURES[self.measure] if isinstance(self.measure, str) else self.measure)(h))
        if not self.renormalize or self.measure == "nmi":
            return found
        if self.measure in ("cc", "cr", "crl1"):
            return -h.sum() / 2 * math.log(max(1 - found, TINY))
        return found * h.sum()

    def gradient(self, params: Sequence[float], step: float = 0.1) -> list[float]:
        """Central differences in each parameter, by one job."""
        f = self.evaluate([_moved(params, {k: s}) for k in range(len(params)) for s in (step, -step)])
        return [(f[2 * k] - f[2 * k + 1]) / (2 * step) for k in range(len(params))]

    def hessian(self, params: Sequence[float], step: float = 0.1) -> list[list[float]]:
        """Second central differences in each pair of parameters, by one job."""
        p = len(params)
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        asked = [_moved(params, {i: 2 * s} if i == j else {i: s, j: t}) for i, j in pairs for s, t in itertools.product((step, -step), repeat=2)]
        same = self.evaluate([list(params)] + asked)
        out = [[0.0] * p for _ in range(p)]
        for n, (i, j) in enumerate(pairs):
            pp, pm, mp, mm = same[1 + 4 * n : 5 + 4 * n]
            out[i][j] = out[j][i] = (pp - 2 * same[0] + mm) / (4 * step * step) if i == j else (pp - pm - mp + mm) / (4 * step * step)
        return out

    def explore(self, params: Sequence[float], *ranges: tuple[int, Sequence[float]]) -> list[tuple[list[float], float]]:
        """(parameters, likeness) where each range's parameter is moved by each of its values, in every combination, by one job."""
        tried = [_moved(params, dict(zip([k for k, _ in ranges], moves))) for moves in itertools.product(*[v for _, v in ranges])]
        return list(zip(tried, self.evaluate(tried)))

    def optimize(self, params: Sequence[float], steps: Sequence[float], tolerance: float = 0.01, rounds: int = 100) -> tuple[list[float], float]:
        """(parameters, likeness) at a maximum near params, by a pattern search: no derivatives, as the likeness has kinks.

        A round tries each parameter's step to both sides and, of up to six parameters, the moves of two at
        once, in one job. Without a gain all steps are halved, until they are below tolerance of those given.
        """
        now, size = list(map(float, params)), 1.0
        best = self.evaluate([now])[0]
        for _ in range(rounds):
            if size < tolerance:
                break
            moves = [{k: s * size} for k, t in enumerate(steps) for s in (t, -t) if t]
            pairs = [{**a, **b} for a, b in itertools.combinations(moves, 2) if a.keys() != b.keys()] if len(moves) <= 12 else []
            tried = [_moved(now, m) for m in moves + pairs]
            found = self.evaluate(tried)
            top = max(range(len(tried)), key=lambda k: (found[k], -k))
            if found[top] > best:
                now, best = tried[top], found[top]
            else:
                size /= 2
        return now, best


def _moved(params: Sequence[float], moves: dict[int, float]) -> list[float]:
    return [float(p) + moves.get(k, 0.0) for k, p in enumerate(params)]


def register(source: DataFrame, target: DataFrame, at: Sequence[str], value: str, bins: int = 256, **more: object) -> Registration:
    """A Registration of two grids' values in so many bins; more are its other fields. Rows of a repeated cell count apart."""
    return Registration(*[stored(clamp(x, at, value, bins), "binned") for x in (source, target)], tuple(at), **more)
