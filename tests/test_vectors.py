"""Pairs of vectors against all pairs, with copies, ties, repeated nodes and rows without distances."""

import math

import numpy as np
import pytest

from tidegrid.operators import graphs, grid, vectors


def folded(a, b):
    if a is None or b is None or len(a) != len(b) or any(v is None for v in (*a, *b)):
        return None
    s = 0.0
    for p, q in zip(a, b):
        s += (p - q) * (p - q)
    return s


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(2)
    rows = [(int(i), [float(np.float32(v)) for v in r.integers(0, 3, 6) + (r.normal(size=6) if i % 3 else 0)]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)] + [(5, rows[9][1]), (5, rows[9][1]), (900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [math.nan] * 6), (903, [1e200] * 6)]
    return rows, spark.createDataFrame(rows, "id long, v array<double>").repartition(5)


@pytest.fixture(params=[1, 4])
def blocks(request, monkeypatch):
    monkeypatch.setattr(vectors, "LEAST_ROWS", 512 if request.param == 1 else 100)


def key(d, node):
    return (d is None, d is not None and math.isnan(d), 0 if d is None or math.isnan(d) else d, node)


def wanted(x, y, k, apart):
    found = {}
    for a, u in x:
        found.setdefault(a, []).extend((folded(u, v), b) for b, v in y if not (apart and a == b))
    return sorted((a, b, str(d)) for a, all_ in found.items() for d, b in sorted(all_, key=lambda p: key(*p))[:k])


def got(df):
    return sorted((r.src, r.dst, str(r.d2)) for r in df.collect())


def test_nearest(points, blocks):
    rows, table = points
    assert got(vectors.nearest(table, None, 3, "id", "v")) == wanted(rows, rows, 3, True)
    x, y = [p for p in rows if p[0] % 10 == 0], [p for p in rows if p[0] % 10]
    assert got(vectors.nearest(table.where("id % 10 = 0"), table.where("id % 10 <> 0"), 2, "id", "v")) == wanted(x, y, 2, False)
    few = [p for p in rows if p[0] in (0, 900, 902)]
    assert got(vectors.nearest(table, table.where("id in (0, 900, 902)"), 4, "id", "v")) == wanted(rows, few, 4, False)
    assert vectors.nearest(table, table.limit(0), 2, "id", "v").count() == 0


def test_within_and_gaussians(points, blocks):
    rows, table = points
    near = [(a, b, d) for a, u in rows for b, v in rows if (d := folded(u, v)) is not None]
    half = lambda r: r.src % 10 == 0 and r.dst % 10
    cross = graphs.cross_eps(table.where("id % 10 = 0"), table.where("id % 10 <> 0"), 2.5)
    assert sorted(map(tuple, cross.collect())) == sorted((a, b, d) for a, b, d in near if a % 10 == 0 and b % 10 and d < 2.5)
    for eps in (1.5, 1e-3):
        graph = grid.eps_graph(table, eps, "id", "v")
        assert sorted(map(tuple, graph.collect())) == sorted((a, b, math.sqrt(d)) for a, b, d in near if a < b and math.sqrt(d) < eps)
    sums, seen = {}, {a for a, _ in rows if a % 10 == 0}
    for a, b, d in near:
        if a % 10 == 0 and b % 10:
            sums[a] = sums.get(a, 0.0) + (math.exp(-d / 8) if not math.isnan(d) else d)
    made = {r.id: r.density for r in graphs.kernel_density(table.where("id % 10 = 0"), table.where("id % 10 <> 0"), 2.0).collect()}
    assert set(made) == seen
    for a, density in made.items():
        assert density is None if a not in sums else np.isclose(density, sums[a], rtol=1e-12, equal_nan=True)
