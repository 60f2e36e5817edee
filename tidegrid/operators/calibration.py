"""Permutation tests of many units at once: p values by unit, by largest statistic, by region and by cluster, and thresholds."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .components import connected_components
from .grid import neighbours

#: Statistics within this share of each other count as equal, as rounding differs between permutations.
EQUAL = 1e-9
#: Numbers that a task holds at a time: units x subjects x permutations.
HELD = 4_000_000
BUCKETS = 256
Masks = list[tuple[bool, ...]]


def sign_flips(n: int, most: int | None = None, seed: int = 0) -> Masks:
    """All 2^n choices of subjects whose sign changes, none first, or `most` drawn ones if there are more."""
    if most is None or most >= 2**n:
        return [tuple(bool(k >> s & 1) for s in range(n)) for k in range(2**n)]
    draw = random.Random(seed)
    return [tuple(bool(draw.getrandbits(1)) for _ in range(n)) for _ in range(most)]


def exchanges(n1: int, n2: int, most: int | None = None, seed: int = 0) -> Masks:
    """All choices of n1 subjects of n1 + n2 for the first sample, or `most` drawn ones if there are more."""
    n = n1 + n2
    if most is None or most >= math.comb(n, n1):
        chosen = itertools.combinations(range(n), n1)
    else:
        draw = random.Random(seed)
        chosen = (draw.sample(range(n), n1) for _ in range(most))
    return [tuple(np.isin(np.arange(n), c).tolist()) for c in map(list, chosen)]


def _over(gap: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """gap / spread; without spread 0 for no gap, else infinite."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(gap == 0, 0.0, gap / np.where(spread > 0, spread, 0.0))


def _mean(x: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, means and squared deviations over the subjects (the second axis) where held."""
    n = held.sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        m = np.where(held, x, 0.0).sum(1) / n
    return n, m, np.where(held, (x - m[:, None]) ** 2, 0.0).sum(1)


def one_sample(x: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """t of each row's mean (units x permutations) with the signs of the masked subjects changed; NaN for fewer than two."""
    d = np.where(masks.T[None], -x[:, :, None], x[:, :, None])
    n, m, s = _mean(d, ~np.isnan(d))
    return np.where(n > 1, _over(m * np.sqrt(np.maximum(n - 1, 0)), np.sqrt(s / np.maximum(n, 1))), np.nan)


def two_sample(x: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Difference of the means of masked and other subjects over the pooled deviation; NaN where a sample is missing."""
    d = np.broadcast_to(x[:, :, None], (*x.shape, len(masks)))
    known, first = ~np.isnan(d), np.broadcast_to(masks.T[None], d.shape)
    n1, m1, s1 = _mean(d, known & first)
    n2, m2, s2 = _mean(d, known & ~first)
    return np.where((n1 > 0) & (n2 > 0) & (n1 + n2 > 2), _over(m1 - m2, np.sqrt((s1 + s2) / np.maximum(n1 + n2 - 2, 1))), np.nan)


STATISTICS = {"one": one_sample, "two": two_sample}


def _least(t: np.ndarray) -> np.ndarray:
    """The least value that counts as no smaller than t."""
    return t - EQUAL * np.maximum(1.0, np.abs(np.where(np.isfinite(t), t, 0.0)))


def _tails(t: np.ndarray) -> np.ndarray:
    """For each row and permutation the share of the row's permutations with as large a statistic."""
    ordered = np.sort(t, axis=1)
    return np.stack([1 - np.searchsorted(o, _least(r), "left") / len(o) for o, r in zip(ordered, t)]) if len(t) else t


@dataclass(frozen=True)
class _Plan:
    """What tasks need to permute: no frame among it."""

    masks: np.ndarray
    observed: np.ndarray
    kind: str

    def batches(self, frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
        """(rows, t, permuted t), some units at a time; units without a statistic are left out."""
        f, step = STATISTICS[self.kind], max(1, HELD // self.masks.size)
        for frame in frames:
            for k in range(0, len(frame), step):
                part = frame.iloc[k : k + step]
                x = np.stack(part["x"].to_numpy()).astype(float)
                t = f(x, self.observed[None])[:, 0]
                known = ~np.isnan(t)
                if known.any():
                    yield part[known], t[known], np.nan_to_num(f(x[known], self.masks), nan=-np.inf, posinf=np.inf, neginf=-np.inf)


@dataclass(frozen=True)
class Calibration:
    """Units with one value a subject, stored once as arrays, and the permutations of the subjects.

    Permuted statistics are made anew in each job, from the arrays: kept, they would be as many times the
    input as there are permutations. Tasks give back maxima, counts or sums, so what is shuffled does not
    grow with the permutations times the units.
    """

    table: DataFrame
    unit: tuple[str, ...]
    masks: np.ndarray
    observed: np.ndarray
    kind: str

    @property
    def _batches(self):
        return _Plan(self.masks, self.observed, self.kind).batches

    def maxima(self) -> list[float]:
        """Each permutation's largest statistic over the units: -infinity without any."""

        batches = self._batches

        def largest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = None
            for _, _, p in batches(frames):
                top = p.max(0)
                best = top if best is None else np.maximum(best, top)
            if best is not None:
                yield pd.DataFrame({"k": np.arange(len(best)), "t": best})

        rows = self.table.select("x").mapInPandas(largest, "k long, t double").groupBy("k").agg(F.max("t").alias("t")).collect()
        found = {r.k: r.t for r in rows}
        return [found.get(k, -math.inf) for k in range(len(self.masks))]

    def units(self, maxima: Sequence[float] | None = None) -> DataFrame:
        """(unit, t, p, corrected): the share of permutations in which the unit's own, and the largest of all units', statistic is at least t."""
        tops = np.sort(np.array(self.maxima() if maxima is None else maxima))

        batches, unit = self._batches, list(self.unit)

        def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows, t, p in batches(frames):
                least = _least(t)
                yield rows[unit].assign(t=t, p=(p >= least[:, None]).mean(1), corrected=1 - np.searchsorted(tops, least, "left") / len(tops))

        return self.table.mapInPandas(made, self._schema("t double, p double, corrected double"))

    def _schema(self, more: str) -> str:
        return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in self.table.schema if f.name in self.unit] + [more])

    def height(self, p: float) -> float:
        """The least statistic of all units and permutations that at most the share p of them reach; infinite if none does.

        Found by counts in 256 bands a round, within the band where the share is passed: exact, and nothing is ordered.
        """

        batches = self._batches

        def spread(low: float, high: float):
            def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for _, _, t in batches(frames):
                    v = t[np.isfinite(t) & (t >= low) & (t <= high)]
                    place = np.zeros(len(v), int) if not math.isfinite(high - low) or high == low else np.minimum(((v - low) / (high - low) * BUCKETS).astype(int), BUCKETS - 1)
                    yield pd.DataFrame({"b": place, "v": v}).groupby("b")["v"].agg(["size", "min", "max"]).reset_index().set_axis(["b", "n", "low", "high"], axis=1)
                    if not math.isfinite(low):
                        yield pd.DataFrame({"b": [-1, -2], "n": [np.isinf(t).sum() - np.isneginf(t).sum(), np.isneginf(t).sum()], "low": [0.0, 0.0], "high": [0.0, 0.0]})

            return made

        low, high, above, answer, total = -math.inf, math.inf, 0, math.inf, None
        while True:
            rows = self.table.select("x").mapInPandas(spread(low, high), "b long, n long, low double, high double").groupBy("b").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
            if total is None:
                total, above = sum(r.n for r in rows), sum(r.n for r in rows if r.b == -1)
                if above > p * total:
                    return math.inf
            crossed = None
            for r in sorted((r for r in rows if r.b >= 0 and r.n), key=lambda r: -r.b):
                if above + r.n > p * total:
                    crossed = r
                    break
                above, answer = above + r.n, r.low
            if crossed is None or crossed.low == crossed.high:
                return answer
            low, high = crossed.low, crossed.high

    def regions(self, labels: DataFrame, label: str) -> DataFrame:
        """(label, fisher, p, corrected): the sum of -log p of a region's units, the share of permutations in which it is as large, and that in which some region's p is as small.

        labels holds the units' columns and label; a unit may have several. The sums of a region are one
        row of a number for each permutation, joined from the tasks' own sums.
        """
        n, batches = len(self.masks), self._batches
        held = self.table.join(labels.select(*self.unit, F.col(label).alias("__label")).dropna().distinct(), list(self.unit)).select("__label", "x")
        kind = held.schema["__label"].dataType.simpleString()

        def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows, t, p in batches(frames):
                both = -np.log(np.column_stack([(p >= _least(t)[:, None]).mean(1).clip(1 / (n + 1)), _tails(p)]))
                for name, at in rows.reset_index(drop=True).groupby("__label").groups.items():
                    yield pd.DataFrame({"__label": [name] * (n + 1), "k": np.arange(n + 1), "s": both[at].sum(0)})

        each = held.mapInPandas(sums, f"__label {kind}, k long, s double").groupBy("__label", "k").agg(F.sum("s").alias("s"))
        one = each.groupBy("__label").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "s"))), lambda e: e["s"]).alias("s"))

        def tails(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    s = np.stack(frame["s"].to_numpy())
                    p = (s[:, 1:] >= _least(s[:, :1])).mean(1)
                    yield pd.DataFrame({"__label": frame["__label"], "fisher": s[:, 0], "p": p, "tails": list(_tails(s[:, 1:]))})

        table = stored(one.mapInPandas(tails, f"__label {kind}, fisher double, p double, tails array<double>"), "regions")
        least = sorted(r.t for r in table.select(F.posexplode("tails").alias("k", "t")).groupBy("k").agg(F.min("t").alias("t")).collect())
        return table.select(F.col("__label").alias(label), "fisher", "p", _share(F.lit(1e-12) + F.col("p"), least, below=True).alias("corrected"))

    def clusters(self, threshold: float, reach: int = 1) -> DataFrame:
        """(cluster, size, p, corrected): clusters of units, as cells of a grid, with a statistic above threshold.

        cluster is the struct of the cluster's least cell; p is the share of all permutations' clusters that
        are at least as large, corrected that of permutations whose largest is. Permutations lie apart along
        an axis of their own, so the components of all are found at once.
        """
        n, batches, unit = len(self.masks), self._batches, list(self.unit)

        def above(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows, t, p in batches(frames):
                at, k = np.nonzero(np.column_stack([t, p]) > threshold)
                yield rows[unit].iloc[at].assign(k=2 * k)

        cells = stored(self.table.mapInPandas(above, self._schema("k long")), "above")
        here = F.struct("k", *self.unit)
        edges = neighbours(cells.withColumn("__here", here), ["k", *self.unit], "__here", reach)
        found = connected_components(edges.select(here.alias("src"), F.col("neighbour").alias("dst")), "src", "dst")
        sizes = stored(cells.select(here.alias("node")).join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("c")).agg(F.count("*").alias("size")), "sizes")
        counts = sizes.where("c.k > 0").groupBy("size").agg(F.count("*").alias("n")).collect()
        tops = sorted(r.m for r in sizes.where("c.k > 0").groupBy("c.k").agg(F.max("size").alias("m")).collect())
        total = sum(r.n for r in counts)
        reached = F.try_divide(sum([F.when(F.col("size") <= r["size"], r.n).otherwise(0) for r in counts], F.lit(0)), F.lit(total))
        kept = sizes.where("c.k = 0").select(F.struct(*[F.col(f"c.{u}").alias(u) for u in self.unit]).alias("cluster"), "size", reached.alias("p"))
        return kept.withColumn("corrected", _share(F.col("size").cast("double"), [0.0] * (n - len(tops)) + [float(x) for x in tops]))


def _share(x: Column, values: Sequence[float], below: bool = False) -> Column:
    """Share of a few values that are at least x, or at most x."""
    held = F.array(*[F.lit(float(v)) for v in values])
    return F.size(F.filter(held, lambda v: (v <= x) if below else (v >= x))) / F.lit(float(len(values)))


def calibration(df: DataFrame, unit: Sequence[str], subject: str, y: str, masks: Masks, first: Sequence[int] | None = None, base: float = 0.0) -> Calibration:
    """The permutation test of df(unit, subject, y), subjects counting from 0 to less than the masks' length.

    With `first`, the subjects of the first of two samples, it compares two samples; else it tests means
    against base by changes of sign. Null and NaN values, and rows without a subject, are left out; several
    rows of a subject in a unit are averaged. The number of permutations bounds what comes to the driver.
    """
    made = np.array(masks, dtype=bool)
    n = made.shape[1]
    s, v = F.col(subject).cast("int"), F.col(y).cast("double")
    rows = df.where(s.between(0, n - 1) & v.isNotNull() & ~F.isnan(v)).groupBy(*unit, s.alias("__s")).agg(F.avg(v - F.lit(float(base))).alias("__v"))
    held = rows.groupBy(*unit).agg(F.map_from_entries(F.collect_list(F.struct("__s", "__v"))).alias("__m"))
    x = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.try_element_at("__m", k), F.lit(float("nan"))))
    observed = np.isin(np.arange(n), list(first)) if first is not None else np.zeros(n, bool)
    return Calibration(stored(held.select(*unit, x.alias("x")), "calibration"), tuple(unit), made, observed, "two" if first is not None else "one")
