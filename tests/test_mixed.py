"""Two-level models against array versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import mixed


def em(x, y, v, rounds, flat=False):
    """(beta, s2, ll) of one unit."""
    pinv = np.linalg.pinv(x)
    beta = pinv @ y
    s2 = np.mean((y - x @ beta) ** 2) + (v.mean() if flat else 0)
    for _ in range(rounds - 1 if flat else rounds):
        z = (s2 * y + v * (x @ beta)) / (s2 + v)
        vz = s2 * v / (s2 + v)
        beta = pinv @ z
        s2 = np.mean((z - x @ beta) ** 2) + vz.mean()
    return beta, s2, -0.5 * np.sum(np.log(s2 + v) + (y - x @ beta) ** 2 / (s2 + v))


@pytest.fixture(scope="module")
def units(spark):
    r = np.random.default_rng(4)
    made = {}
    for u, n in (("a", 12), ("b", 30), ("c", 7)):
        x = np.column_stack([np.ones(n), r.normal(size=n), r.integers(0, 2, n)])
        v = r.random(n) * 2
        v[0] = 0.0
        made[u] = x, x @ [1.0, 0.5, -1.0] + r.normal(size=n) * np.sqrt(0.5 + v) + 1e6, v
    rows = [(u, *map(float, (*x[i], y[i], v[i]))) for u, (x, y, v) in made.items() for i in range(len(y))]
    rows += [("a", 1.0, 2.0, None, 3.0, 1.0), ("a", 1.0, 2.0, 0.0, 3.0, -1.0), ("d", 1.0, 1.0, 1.0, 5.0, 1.0), ("d", 1.0, 1.0, 1.0, 6.0, 1.0)]
    return made, spark.createDataFrame(rows, "u string, x0 double, x1 double, x2 double, y double, v double")


@pytest.mark.parametrize("rounds, flat", [(5, False), (1, False), (1, True), (2, True), (6, True)])
def test_two_level(units, rounds, flat):
    made, table = units
    got = {r.u: r for r in mixed.two_level(table, ["u"], ["x0", "x1", "x2"], "y", "v", rounds, (None, [[0, 1, 0]], [[0, 1, 0], [0, 0, 1]]), flat).collect()}
    for u, (x, y, v) in made.items():
        for m, columns in enumerate(([0, 1, 2], [0, 2], [0])):
            beta, s2, ll = em(x[:, columns], y, v, rounds, flat)
            held = np.array(got[u][f"beta{m}"])
            assert np.allclose(held[columns], beta, rtol=1e-9, atol=1e-8) and np.allclose(np.delete(held, columns), 0, atol=1e-8)
            assert np.isclose(got[u][f"s2{m}"], s2, rtol=1e-6) and np.isclose(got[u][f"ll{m}"], ll, rtol=1e-6)
    # the columns of unit d are collinear
    assert got["d"].beta0 is None and got["d"].s20 is None and got["d"].ll0 is None


def test_likelihood_rises(units):
    table = units[1].where("u <> 'd'").withColumn("y", F.col("y") - 1e6)
    lls = [{r.u: r.ll0 for r in mixed.two_level(table, ["u"], ["x0", "x1"], "y", "v", k).collect()} for k in (0, 1, 4)]
    assert all(lls[0][u] <= lls[1][u] + 1e-6 and lls[1][u] <= lls[2][u] + 1e-6 for u in lls[0])


def test_mfx_statistics(units):
    made, table = units
    two = {r.u: r for r in mixed.two_sample(table, ["u"], "x2", "y", "v").collect()}
    one = {r.u: r for r in mixed.one_sample(table.withColumn("y", F.col("y") - 1e6), ["u"], "y", "v").collect()}
    ratio = {r.u: r.lr for r in mixed.two_level_lr(table, ["u"], ["x0", "x1", "x2"], "y", "v", [[0, 1, 0], [0, 0, 1]], rounds=3).collect()}
    for u, (x, y, v) in made.items():
        if u == "a":  # two_sample and one_sample read fewer columns, so the row without x1 or x2 may count
            continue
        full, null = em(x[:, [0, 2]], y, v, 5), em(x[:, [0]], y, v, 5)
        assert np.isclose(two[u].f, max(0, 2 * (full[2] - null[2])), rtol=1e-5, atol=1e-7) and np.isclose(two[u].effect, full[0][1], atol=1e-7)
        assert np.isclose(two[u].t, np.sign(full[0][1]) * np.sqrt(two[u].f)) and np.isclose(two[u].s2, full[1], rtol=1e-6)
        full, null = em(x[:, [0]], y - 1e6, v, 5), em(np.zeros((len(y), 1)), y - 1e6, v, 5)
        assert np.isclose(one[u].f, 2 * (full[2] - null[2]), rtol=1e-5)
        full, null = em(x, y, v, 3, True), em(x[:, [0]], y, v, 3, True)
        assert np.isclose(ratio[u], max(0, 2 * (full[2] - null[2])), rtol=1e-5, atol=1e-7)
    with pytest.raises(ValueError):
        mixed.mfx_stat(table, ["u"], ["x0"], "y", "v", 1)


def test_variance_ratio(units):
    made, table = units
    table = table.where("v > 0 and x2 is not null").withColumn("sd", F.sqrt("v"))
    got = {r.u: r for r in mixed.estimate_varatio(table, ["u"], "y", "sd", dof="x1").collect()}
    mean = {r.u: r for r in mixed.estimate_mean(table, ["u"], "y", "sd").collect()}
    for u, (x, y, v) in made.items():
        x, y, s = x[1:], y[1:], v[1:]
        s2, least = y.var(ddof=1), 0.99 * s.min()
        above = s - least
        for _ in range(10):
            w = 1 / (above + s2)
            mu = (w * y).sum() / w.sum()
            s2 = (s2 * (1 + (above * w).sum() - (above * w**2).sum() / w.sum()) + s2**2 * ((w * (y - mu)) ** 2).sum()) / len(y)
        fixed = (x[:, 1] * s).sum() / x[:, 1].sum()
        assert np.allclose([got[u].fixed, got[u].random, got[u].ratio], [fixed, s2 - least, (s2 - least) / fixed], rtol=1e-6)
        w = 1 / s
        effect = (w * y).sum() / w.sum()
        scale = (w * (y - effect) ** 2).sum() / (len(y) - 1)
        assert np.allclose([mean[u].effect, mean[u].scale, mean[u].sd], [effect, np.sqrt(scale), np.sqrt(scale / w.sum())], rtol=1e-7)
