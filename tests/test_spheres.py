"""Von Mises mixtures on the sphere against an array version."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import spheres

STARTS = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]


@pytest.fixture(scope="module")
def cloud(spark):
    r = np.random.default_rng(5)
    made = [r.normal(size=(80, 3)) * 0.2 + c for c in ([1, 0.2, 0], [0, 0.7, 0.7])] + [r.normal(size=(60, 3))]
    x = np.vstack(made)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(k, v.tolist(), 0.2 + 0.6 * (k % 2)) for k, v in enumerate(x)] + [(900, None, 0.5)]
    return x, spark.createDataFrame(rows, "id long, v array<double>, b double").repartition(3)


def by_hand(x, kappa, null, rounds, bias=None):
    means, weights, lls = np.array(STARTS), np.full(2 + null, 1 / (2 + null)), []
    for _ in range(rounds):
        d = kappa / (2 * math.pi * (1 - math.exp(-2 * kappa))) * np.exp(kappa * (x @ means.T - 1))
        d = np.hstack([np.full((len(x), 1), 1 / (4 * math.pi)), d]) if null else d
        wd = d * weights
        lls.append(np.log(wd.sum(1)).mean())
        z = wd / wd.sum(1, keepdims=True)
        if bias is not None:
            z = z * np.column_stack([1 - bias, bias, bias])
            z /= z.sum(1, keepdims=True)
        weights = z.sum(0) / z.sum()
        means = z[:, int(null) :].T @ x
        means /= np.linalg.norm(means, axis=1, keepdims=True)
    return means, weights, lls


@pytest.mark.parametrize("null, biased", [(False, False), (True, False), (True, True)])
def test_fit(cloud, null, biased):
    x, table = cloud
    bias = np.array([0.2 + 0.6 * (k % 2) for k in range(len(x))]) if biased else None
    model, ll = spheres.fit(table, "v", 8.0, STARTS, null, rounds=5, least=5, bias="b" if biased else None)
    means, weights, lls = by_hand(x, 8.0, null, 5, bias)
    assert np.allclose(model.means, means, atol=1e-9) and np.allclose(model.weights, weights) and math.isclose(ll, lls[-1], rel_tol=1e-10)
    if not biased:
        assert all(a <= b + 1e-9 for a, b in zip(lls, lls[1:]))


def test_shares_and_selection(cloud):
    x, table = cloud
    model, _ = spheres.fit(table, "v", 8.0, STARTS, True)
    rows = spheres.shares(table, "v", model).orderBy("id").collect()
    assert rows[-1].shares is rows[-1].density is None
    assert all(math.isclose(sum(r.shares), 1, rel_tol=1e-9) for r in rows[:-1])
    label = [int(np.argmax(r.shares)) for r in rows[:-1]]
    assert np.mean(np.array(label[:160]) == np.repeat([1, 2], 80)) > 0.9
    best, _ = spheres.fit_best(table, "v", 8.0, [STARTS, [[0.0, 0.0, -1.0], [0.0, 0.0, 1.0]]], True, rounds=6)
    assert len(best.means) == 2
    chosen, _ = spheres.select(table, "v", 8.0, [STARTS[:1], STARTS], True, rounds=8)
    assert len(chosen.means) == 2


def test_edges(spark, cloud):
    _, table = cloud
    units = spark.createDataFrame([([3.0, 0.0, 4.0, 9.0],), ([0.0, 0.0, 0.0],), (None,)], "v array<double>").select(spheres.unit(F.col("v")).alias("u")).collect()
    assert [r.u for r in units] == [[0.6, 0.0, 0.8], None, None]
    for bad in (lambda: spheres.fit(table.limit(0), "v", 8.0, STARTS), lambda: spheres.shares(table, "v", spheres.Sphere(1.0, ((1.0, 0.0, 0.0),), (1.0,)), "b")):
        with pytest.raises(ValueError):
            bad()
