"""Mixtures of normal densities in several dimensions against array versions and exact results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import normals


@pytest.fixture(scope="module")
def cloud(spark):
    r = np.random.default_rng(2)
    x = np.vstack([r.normal(size=(150, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0], [0, 0, 2]]) + 1e4, r.normal(size=(100, 3)) * 0.5 + np.array([1e4 + 4, 1e4 - 3, 1e4])])
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [1.0, None, 2.0])]
    return x, spark.createDataFrame(rows, "id long, v array<double>").repartition(4)


CENTRES = [[1e4, 1e4, 1e4], [1e4 + 4, 1e4 - 3, 1e4]]


def by_hand(x, rounds, diagonal=False):
    """Regularised fit, written out point by point."""
    n, d = x.shape
    k, mean, var = 2, x.mean(0), x.var(0)
    share = np.eye(2)[((x[:, None] - np.array(CENTRES)) ** 2).sum(2).argmin(1)]
    for step in range(rounds + 1):
        weights, means, precisions = [], [], []
        for c in range(k):
            pop = share[:, c].sum()
            own = (share[:, c, None] * x).sum(0) / pop
            cov = np.diag(var / k ** (2 / d)) + sum(s * np.outer(v - own, v - own) for s, v in zip(share[:, c], x)) + np.outer(own - mean, own - mean) * 0.01 * pop / (pop + 0.01)
            cov = cov / (d + 2 + pop + d + 2)
            weights.append((1 / k + pop) / (n + 1))
            means.append((own * pop + mean * 0.01) / (pop + 0.01))
            precisions.append(np.linalg.inv(np.diag(np.diag(cov)) if diagonal else cov))
        like = np.array([[w * math.sqrt(np.linalg.det(p) / (2 * math.pi) ** d) * math.exp(-(v - m) @ p @ (v - m) / 2) for w, m, p in zip(weights, means, precisions)] for v in x])
        share = like / like.sum(1, keepdims=True)
    return np.array(weights), np.array(means), np.array(precisions), like


@pytest.mark.parametrize("diagonal", [False, True])
def test_mixture(cloud, diagonal):
    x, table = cloud
    model = normals.fit(table, "v", CENTRES, 3, -1e300, diagonal=diagonal)
    weights, means, precisions, like = by_hand(x, 3, diagonal)
    assert np.allclose(model.weights, weights) and np.allclose(model.means, means, rtol=1e-9) and np.allclose(model.precisions, precisions, rtol=1e-6, atol=1e-8)
    got = {r.id: r for r in normals.likelihood(table, "id", "v", model).collect()}
    assert np.allclose([got[k].like for k in range(len(x))], like, rtol=1e-6) and [got[k].label for k in range(len(x))] == like.argmax(1).tolist()
    assert got[900].like is got[901].total is got[900].label is None
    total = np.log(like.sum(1)).sum()
    assert math.isclose(normals.average_log_likelihood(table, "v", model), total / len(x), rel_tol=1e-9)
    size = 2 * (1 + 2 * 3) - 1 if diagonal else 2 * (1 + 3 + 5) - 1
    assert math.isclose(normals.bic(table, "v", model), total - math.log(len(x)) * size, rel_tol=1e-9)
    with pytest.raises(ValueError):
        normals.evidence(table, "v", model)


def test_it_converges(cloud):
    x, table = cloud
    model = normals.fit(table, "v", CENTRES)
    labels = [r.label for r in normals.likelihood(table.where("id < 900"), "id", "v", model).orderBy("id").collect()]
    assert np.mean(np.array(labels) == np.repeat([0, 1], [150, 100])) > 0.97 and abs(model.weights[0] - 0.6) < 0.03


def test_evidence_of_one_component_is_exact(cloud):
    """With one component the posterior is conjugate, so the bound is the log evidence itself."""
    x, table = cloud
    model = normals.fit(table, "v", CENTRES[:1], 2, -1e300, variational=True)
    n, d = x.shape
    k0, v0 = 0.01, d + 2
    away = x.mean(0) - model.prior.mean
    before = np.diag(model.prior.inverse_scale)
    after = before + (x - x.mean(0)).T @ (x - x.mean(0)) + k0 * n / (k0 + n) * np.outer(away, away)
    gammas = lambda v: sum(math.lgamma((v - i) / 2) for i in range(d))
    want = -n * d / 2 * math.log(math.pi) + gammas(v0 + n) - gammas(v0) + v0 / 2 * np.linalg.slogdet(before)[1] - (v0 + n) / 2 * np.linalg.slogdet(after)[1] + d / 2 * math.log(k0 / (k0 + n))
    assert math.isclose(normals.evidence(table, "v", model), want, rel_tol=1e-9)


def test_evidence_rises_and_chooses(cloud):
    _, table = cloud
    bounds = [normals.evidence(table, "v", normals.fit(table, "v", CENTRES, k, -1e300, variational=True)) for k in (0, 1, 4)]
    assert bounds[0] <= bounds[1] + 1e-6 and bounds[1] <= bounds[2] + 1e-6
    assert bounds[2] > normals.evidence(table, "v", normals.fit(table, "v", CENTRES[:1], 1, variational=True))


def test_digamma():
    # At 1 less Euler's constant, at 1/2 less twice the logarithm of 2 besides.
    euler = 0.5772156649015329
    assert np.allclose(normals.digamma([1.0, 0.5, 2.0]), [-euler, -euler - 2 * math.log(2), 1 - euler], rtol=1e-11)
    x = np.linspace(0.1, 30, 50)
    assert np.allclose(normals.digamma(x + 1) - normals.digamma(x), 1 / x, rtol=1e-9)


def test_refused(spark, cloud):
    _, table = cloud
    for bad in (table.limit(0), table.withColumn("v", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))):
        with pytest.raises(ValueError):
            normals.fit(bad, "v", CENTRES)
