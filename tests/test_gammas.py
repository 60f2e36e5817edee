"""Gamma tails against an array version and draws of known parameters."""

import math

import numpy as np
import pytest

from tidegrid.operators import gammas
from tidegrid.operators.gammas import Gamma, Tailed


def density(g, x):
    return np.where(x > 0, np.exp(-g.shape * np.log(g.scale) - math.lgamma(g.shape) + (g.shape - 1) * np.log(np.where(x > 0, x, 1)) - x / g.scale), 0)


def by_hand(x, m, rounds):
    for _ in range(rounds):
        z = np.array([density(m.negative, -x), np.exp(-((x - m.mean) ** 2) / 2 / m.var) / np.sqrt(2 * np.pi * m.var), density(m.positive, x)]) * np.array(m.weights)[:, None]
        z /= z.sum(0)
        mean = (z[1] * x).sum() / z[1].sum()
        tails = []
        for w, y in ((z[0], -x), (z[2], x)):
            w, y = w[y > 0], y[y > 0]
            gap = (w * np.log(y)).sum() / w.sum() - np.log((w * y).sum() / w.sum())
            low, high = 1e-6, 1e6
            for _ in range(200):
                c = math.sqrt(low * high)
                low, high = (c, high) if gammas.digamma(c) - math.log(c) < gap else (low, c)
            tails.append(Gamma(c, (w * y).sum() / w.sum() / c))
        m = Tailed(mean, (z[1] * (x - mean) ** 2).sum() / z[1].sum(), *tails, tuple(z.sum(1) / len(x)))
    return m


def flat(m):
    return [m.mean, m.var, m.negative.shape, m.negative.scale, m.positive.shape, m.positive.scale, *m.weights]


def test_digamma():
    assert math.isclose(gammas.digamma(1), -0.5772156649015329, rel_tol=1e-12) and math.isclose(gammas.trigamma(1), math.pi**2 / 6, rel_tol=1e-11)
    for c in (0.01, 0.3, 1.0, 7.5, 4000.0):
        assert math.isclose(gammas.digamma(c), (math.lgamma(c * (1 + 1e-6)) - math.lgamma(c * (1 - 1e-6))) / (2e-6 * c), rel_tol=1e-4, abs_tol=1e-6)
        assert math.isclose(gammas.shape_of(gammas.digamma(c) - math.log(c)), c, rel_tol=1e-6)
    assert gammas.shape_of(0.0) == 10.0


def test_rounds_and_known_parameters(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(0, 1, 4000), r.gamma(9, 0.7, 1500), -r.gamma(6, 0.8, 1000)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    first = gammas.start(df, "x")
    assert math.isclose(first.positive.shape * first.positive.scale, x[x > 0].mean())
    model, _ = gammas.fit(df, "x", first, rounds=2, tolerance=-math.inf)
    assert np.allclose(flat(model), flat(by_hand(x, first, 2)), rtol=1e-8)
    good, like = gammas.fit(df, "x", Tailed(0, 1, Gamma(6, 1), Gamma(6, 1)), rounds=15)
    assert abs(good.positive.shape * good.positive.scale - 6.3) < 0.4 and abs(good.negative.shape * good.negative.scale - 4.8) < 0.6 and abs(good.weights[1] - 4000 / 6500) < 0.08
    got = gammas.posterior(df, "x", good).collect()
    assert all(math.isclose(g.negative + g.normal + g.positive, 1, rel_tol=1e-6) for g in got[: len(x)]) and got[-1].normal is None
    held, _ = gammas.fit(df, "x", rounds=2, tolerance=-math.inf, least_normal=0.9, least_variance=2.0)
    assert math.isclose(held.weights[1], 0.9) and held.var >= 2.0 and math.isclose(sum(held.weights), 1)


def test_one_side_and_nothing(spark):
    up = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 5, 0)], "x double")
    model = gammas.start(up, "x", both=False)
    assert model.weights == (0.0, 0.5, 0.5) and gammas.fit(up, "x", model, rounds=2)[0].weights[0] == 0.0
    empty, like = gammas.fit(up.limit(0), "x")
    assert math.isnan(like) and empty.weights == (0.0, 1.0, 0.0)
    flat_, _ = gammas.fit(spark.createDataFrame([(2.0,)] * 4, "x double"), "x", rounds=2)
    assert flat_.mean == pytest.approx(2.0)
