"""Cubic splines against dense linear algebra."""

import math

import numpy as np
import pytest

from tidegrid.operators import splines


def b3(x):
    x = abs(x)
    return 2 / 3 - x * x + x**3 / 2 if x < 1 else max(2 - x, 0) ** 3 / 6


def mirror(q, n):
    return 0 if n == 1 else (n - 1) - abs(q % (2 * (n - 1)) - (n - 1))


def solved(s, axis):
    """Coefficients along an axis from the equations that the spline meets every sample."""
    n = s.shape[axis]
    a = np.zeros((n, n))
    for p in range(n):
        for d in (-1, 0, 1):
            a[p, mirror(p + d, n)] += b3(d)
    return np.moveaxis(np.tensordot(np.linalg.inv(a), np.moveaxis(s, axis, 0), 1), 0, axis)


def value(c, x, modes):
    w = 1.0
    x = list(x)
    for k, (n, mode) in enumerate(zip(c.shape, modes)):
        if mode == "nearest":
            x[k] = min(max(x[k], 0), n - 1)
        elif mode == "reflect":
            w *= -(n - 1) <= x[k] <= 2 * (n - 1)
        else:
            w *= 0 if x[k] < -1 or x[k] > n else 1 + x[k] if x[k] < 0 else n - x[k] if x[k] > n - 1 else 1
            x[k] = min(max(x[k], 0), n - 1)
    total = 0.0
    for step in np.ndindex(*[4] * c.ndim):
        q = [math.floor(t) + s - 1 for t, s in zip(x, step)]
        total += c[tuple(mirror(p, n) for p, n in zip(q, c.shape))] * math.prod(b3(t - p) for t, p in zip(x, q))
    return w * total


@pytest.mark.parametrize("shape", [(150, 3), (1, 2, 70), (5, 6, 7)])
def test_coefficients_and_samples(spark, shape):
    r = np.random.default_rng(len(shape))
    s = r.normal(size=shape)
    s[r.random(shape) < 0.2] = 0
    at = ["i", "j", "k"][: len(shape)]
    rows = [(*map(int, p), float(s[p])) for p in np.ndindex(*shape) if s[p]] + [(*[0] * len(shape), None), (*[0] * len(shape), float("nan")), (*[999] * len(shape), 5.0)]
    cells = spark.createDataFrame(rows, ", ".join(f"{a} int" for a in at) + ", y double").repartition(3)
    coefs = splines.coefficients(cells, at, "y", shape)
    want = s
    for axis in range(len(shape)):
        want = solved(want, axis)
    got = np.zeros(shape)
    for row in coefs.collect():
        got[row[:-1]] = row.c
    assert np.allclose(got, want, atol=1e-12)
    for modes in (["zero"] * 3, ["nearest", "reflect", "zero"], ["reflect", "zero", "nearest"]):
        points = [tuple(float(x) for x in r.uniform(-1.5, 1.5, len(shape)) + r.uniform(0, 1, len(shape)) * np.array(shape)) for _ in range(40)] + [tuple(float(n - 1) for n in shape)]
        table = spark.createDataFrame([(k, *p) for k, p in enumerate(points)] + [(99, *[None] * len(shape))], "id int, " + ", ".join(f"x{a} double" for a in at))
        made = {x.id: x.value for x in splines.sample(coefs, at, shape, table, ["id"], [table[f"x{a}"] for a in at], modes[: len(shape)]).collect()}
        assert made.pop(99) is None and len(made) == len(points)
        assert all(abs(made[k] - value(want, p, modes)) < 1e-11 for k, p in enumerate(points))


def test_identity_and_empty(spark):
    rows = [(i, j, float(i * i - 3 * j)) for i in range(6) for j in range(5)]
    cells = spark.createDataFrame(rows, "i int, j int, y double")
    eye = [[1.0, 0.0], [0.0, 1.0]]
    same = splines.resample_cubic(cells, ["i", "j"], "y", (6, 5), cells, eye, [0.0, 0.0])
    assert all(abs(x.value - (x.i**2 - 3 * x.j)) < 1e-12 for x in same.collect()) and same.count() == 30
    none = splines.resample_cubic(cells.limit(0), ["i", "j"], "y", (6, 5), cells, eye, [0.0, 0.0])
    assert {x.value for x in none.collect()} == {0.0}
    with pytest.raises(ValueError):
        splines.resample_cubic(cells, ["i", "j"], "y", (6, 5), cells, eye, [0.0, 0.0], "wrap")
