"""Markov segmentation against an array version."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import segmentation


def by_hand(y, mu, var, beta, rounds, costs, reach, prior=None, freeze=()):
    """Cell by cell, in the order of colours; y is a dict of coordinates."""
    k, mu, var = len(mu), np.array(mu, float), np.array(var, float)
    d = len(next(iter(y)))
    steps = [s for s in itertools.product((-1, 0, 1), repeat=d) if 0 < sum(map(abs, s)) <= reach]
    near = {c: [n for s in steps if (n := tuple(a + b for a, b in zip(c, s))) in y] for c in y}
    colour = (lambda c: sum(c) % 2) if reach == 1 else (lambda c: sum((a % 2) << i for i, a in enumerate(c)))
    q = {c: np.full(k, 1 / k) for c in y}
    prior = prior or {c: np.ones(k) for c in y}
    log = lambda c: -((y[c] - mu) ** 2) / (2 * var) - np.log(var) / 2 + np.log(prior[c])
    energy = lambda: sum(q[c] @ (np.log(np.maximum(q[c], 1e-50)) - log(c) + beta * sum((costs @ q[n] for n in near[c]), np.zeros(k))) for c in y)
    energies = []
    for _ in range(rounds):
        for c in sorted(y, key=colour):
            w = log(c) - 2 * beta * sum((costs @ q[n] for n in near[c]), np.zeros(k))
            w = np.exp(w - w.max())
            q[c] = w / w.sum()
        all_q, all_y = np.array([q[c] for c in y]), np.array([y[c] for c in y])
        for i in set(range(k)) - set(freeze):
            mu[i] = (all_q[:, i] * all_y).sum() / all_q[:, i].sum()
            var[i] = (all_q[:, i] * (all_y - mu[i]) ** 2).sum() / all_q[:, i].sum()
        energies.append(energy())
    return q, mu, var, energies


@pytest.mark.parametrize("reach, beta, given", [(1, 0.7, False), (2, 0.3, True), (1, 0.0, True)])
def test_segmentation(spark, reach, beta, given):
    r = np.random.default_rng(reach)
    y = {(i, j): float((i > 4) * 2 + r.normal() * 0.7) for i in range(10) for j in range(-3, 6) if r.random() < 0.9}
    prior = {c: np.array([0.5, 0.3, 0.2]) + 0.1 * np.array([c[0] % 2, 0, -(c[0] % 2)]) for c in y} if given else None
    costs = np.array([[0, 1, 2], [1, 0, 1], [2, 1, 0]]) if given else 1 - np.eye(3)
    rows = [(*c, v, prior[c].tolist() if given else None) for c, v in y.items()] + [(50, 50, None, None), (51, 50, float("nan"), None), (None, 1, 1.0, None)]
    table = spark.createDataFrame(rows, "i long, j long, y double, p array<double>").repartition(3)
    more = {"costs": costs.tolist(), "prior": "p", "freeze": [1]} if given else {}
    start = [0.0, 1.0, 2.0], [0.5, 0.4, 0.5]
    cells, model, energies = segmentation.segment(table, ["i", "j"], "y", *start, beta, 4, reach=reach, tolerance=-1.0, **more)
    q, mu, var, want = by_hand(y, *start, beta, 4, costs, reach, prior, [1] if given else [])
    got = {(c.i, c.j): c for c in cells.collect()}
    assert set(got) == set(y) and all(np.allclose(got[c].q, q[c], atol=1e-9) and got[c].label == int(np.argmax(q[c])) for c in y)
    assert np.allclose(model.mu, mu) and np.allclose(model.var, var) and np.allclose(energies, want, rtol=1e-9)
    assert all(b <= a + 1e-9 for a, b in zip(energies, energies[1:]))


def test_smoother_with_beta_and_stopping(spark):
    r = np.random.default_rng(9)
    table = spark.createDataFrame([(i, j, float((j > 5) + r.normal() * 0.8)) for i in range(12) for j in range(12)], "i long, j long, y double")
    wrong = {}
    for beta in (0.0, 1.0):
        cells, _, energies = segmentation.segment(table, ["i", "j"], "y", [0.0, 1.0], [0.6, 0.6], beta, 6, freeze=[0, 1], tolerance=1e-3)
        wrong[beta] = cells.where(F.col("label") != (F.col("j") > 5).cast("int")).count()
        assert beta or len(energies) == 2
    assert wrong[1.0] < wrong[0.0] / 3
    with pytest.raises(ValueError):
        segmentation.segment(table.union(table.limit(1)), ["i", "j"], "y", [0.0, 1.0], [1.0, 1.0])
    assert segmentation.segment(table.limit(0), ["i", "j"], "y", [0.0, 1.0], [1.0, 1.0], rounds=1)[0].count() == 0
