"""Affine maps between named coordinates, and slices of grids that keep their places."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AffineMap:
    """From coordinates of the domain to those of the range: rows of factors, the shift last. Applied as plain expressions of a plan."""

    domain: tuple[str, ...]
    range: tuple[str, ...]
    rows: tuple[tuple[float, ...], ...]

    def __post_init__(self) -> None:
        if len(set(self.domain)) < len(self.domain) or len(set(self.range)) < len(self.range):
            raise ValueError("a coordinate is named twice")
        if len(self.rows) != len(self.range) or any(len(r) != len(self.domain) + 1 for r in self.rows):
            raise ValueError("the matrix doesn't fit the coordinates")

    @staticmethod
    def of(domain: Sequence[str], range_: Sequence[str], matrix: np.ndarray | Sequence[Sequence[float]]) -> AffineMap:
        """From a matrix of range x (domain + 1), or a square one whose last row is 0, ..., 0, 1."""
        m = np.asarray(matrix, float)
        if m.shape[0] == len(range_) + 1:
            if not np.array_equal(m[-1], np.eye(m.shape[1])[-1]):
                raise ValueError("the last row of an affine matrix is 0, ..., 0, 1")
            m = m[:-1]
        return AffineMap(tuple(domain), tuple(range_), tuple(map(tuple, m.tolist())))

    @staticmethod
    def start_step(domain: Sequence[str], range_: Sequence[str], start: Sequence[float], step: Sequence[float]) -> AffineMap:
        return AffineMap.of(domain, range_, np.column_stack([np.diag(step), start]))

    @property
    def matrix(self) -> np.ndarray:
        """With the last row 0, ..., 0, 1."""
        return np.vstack([np.array(self.rows, float).reshape(len(self.range), len(self.domain) + 1), np.eye(len(self.domain) + 1)[-1]])

    def columns(self) -> list[Column]:
        terms = [[F.col(d) * F.lit(float(f)) for d, f in zip(self.domain, r) if f] for r in self.rows]
        return [reduce(lambda a, b: a + b, t, F.lit(float(r[-1]))).alias(n) for t, r, n in zip(terms, self.rows, self.range)]

    def apply(self, df: DataFrame) -> DataFrame:
        """df with the coordinates of the range; a null coordinate with a factor gives null."""
        return df.withColumns(dict(zip(self.range, self.columns())))

    def inverse(self) -> AffineMap:
        """The map back; a ValueError if there is none."""
        if len(self.domain) != len(self.range) or np.linalg.matrix_rank(self.matrix) <= len(self.domain):
            raise ValueError("the map has no inverse")
        return AffineMap.of(self.range, self.domain, np.linalg.inv(self.matrix)[:-1])

    def after(self, first: AffineMap) -> AffineMap:
        """This map of what the first gives."""
        if self.domain != first.range:
            raise ValueError(f"{first.range} isn't {self.domain}")
        return AffineMap.of(first.domain, self.range, (self.matrix @ first.matrix)[:-1])

    def product(self, other: AffineMap) -> AffineMap:
        """Both side by side."""
        a, b = self.matrix[:-1], other.matrix[:-1]
        left = np.vstack([a[:, :-1], np.zeros((len(b), a.shape[1] - 1))])
        right = np.vstack([np.zeros((len(a), b.shape[1] - 1)), b[:, :-1]])
        return AffineMap.of(self.domain + other.domain, self.range + other.range, np.column_stack([left, right, np.concatenate([a[:, -1], b[:, -1]])]))

    def reordered(self, domain: Sequence[str] | None = None, range_: Sequence[str] | None = None) -> AffineMap:
        """The same map with its coordinates in another order; equal rows and columns of a plan, as those have names."""
        d, r = tuple(domain or self.domain), tuple(range_ or self.range)
        if sorted(d) != sorted(self.domain) or sorted(r) != sorted(self.range):
            raise ValueError("an order names each coordinate once")
        cols = [self.domain.index(n) for n in d] + [-1]
        return AffineMap.of(d, r, np.array(self.rows)[[self.range.index(n) for n in r]][:, cols])

    def renamed(self, names: dict[str, str]) -> AffineMap:
        return AffineMap(tuple(names.get(n, n) for n in self.domain), tuple(names.get(n, n) for n in self.range), self.rows)

    def shifted_domain(self, by: Sequence[float]) -> AffineMap:
        """Of coordinates whose origin lies at `by` in this map's domain."""
        m = self.matrix
        m[:-1, -1] += m[:-1, :-1] @ np.asarray(by, float)
        return AffineMap.of(self.domain, self.range, m[:-1])

    def dropped(self, name: str) -> AffineMap:
        """Without a domain coordinate, and without the one range coordinate that it alone decides; a ValueError if it takes part in others."""
        k = self.domain.index(name)
        m = np.array(self.rows)
        hit = np.nonzero(m[:, k])[0]
        if len(hit) > 1 or any(np.delete(m[h, :-1], k).any() for h in hit):
            raise ValueError(f"{name} takes part in several range coordinates")
        keep = [r for r in range(len(m)) if r not in hit]
        return AffineMap.of([d for d in self.domain if d != name], [self.range[r] for r in keep], np.delete(m[keep], k, axis=1))

    def same(self, other: AffineMap, tolerance: float = 1e-9) -> bool:
        """Whether both are one map but for the order of coordinates."""
        if sorted(self.domain) != sorted(other.domain) or sorted(self.range) != sorted(other.range):
            return False
        return bool(np.allclose(other.reordered(self.domain, self.range).matrix, self.matrix, atol=tolerance))


def sliced(cells: DataFrame, place: AffineMap, slices: dict[str, int | tuple[int, int | None, int]]) -> tuple[DataFrame, AffineMap]:
    """(cells, map) of part of a grid: a number keeps one position of an axis and drops the axis, (start, stop, step) every step-th from start to before stop.

    Positions are numbered anew from 0, or from start down if step is negative; the map gives each kept cell
    the place it had. A filter and a projection, so it reaches the scan of the table.
    """
    m, names = place.matrix[:-1], list(place.domain)
    for axis, s in slices.items():
        k, at = names.index(axis), F.col(axis)
        if isinstance(s, int):
            cells = cells.where(at == s).drop(axis)
            m[:, -1] += m[:, k] * s
            m = np.delete(m, k, axis=1)
            names.remove(axis)
            continue
        start, stop, step = s
        if step == 0:
            raise ValueError("a step isn't 0")
        kept = (at >= start if step > 0 else at <= start) & ((at - start) % step == 0)
        if stop is not None:
            kept &= at < stop if step > 0 else at > stop
        cells = cells.where(kept).withColumn(axis, ((at - start) / step).cast("long"))
        m[:, -1] += m[:, k] * start
        m[:, k] *= step
    return cells, AffineMap.of(names, place.range, m)
