"""Permutation calibration against loops over all permutations."""

import math

import numpy as np
import pytest

from tidegrid.operators import calibration as cal


def student(x):
    return 0.0 if x.mean() == 0 else x.mean() * math.sqrt(len(x) - 1) / x.std()


def pooled(x, first):
    a, b = x[first], x[~first]
    return (a.mean() - b.mean()) / math.sqrt((a.var() * len(a) + b.var() * len(b)) / (len(x) - 2))


def frame(spark, x):
    rows = [(*map(int, p[:-1]), int(p[-1]), float(x[p])) for p in np.ndindex(*x.shape) if not np.isnan(x[p])]
    return spark.createDataFrame(rows + [(0, 0, 1, None), (0, 0, None, 5.0), (0, 0, 99, 5.0)], "i int, j int, s int, y double").repartition(3)


def tails(v):
    return np.array([np.mean(v >= t - 1e-9 * max(1, abs(t))) for t in v])


@pytest.mark.parametrize("kind", ["one", "two"])
def test_units_and_heights(spark, kind):
    r = np.random.default_rng(4)
    x = r.normal(size=(4, 3, 6)) + 1e6 * (kind == "two") + 0.5
    x[1, 1, 4] = np.nan
    first = (0, 1, 2) if kind == "two" else None
    masks = cal.exchanges(3, 3) if first else cal.sign_flips(6)
    assert len(set(masks)) == len(masks) == (20 if first else 64)
    held = cal.calibration(frame(spark, x), ["i", "j"], "s", "y", masks, first)
    def t(v, m):
        m, known = np.array(m), ~np.isnan(v)
        return pooled(v[known], m[known]) if first else student((v * np.where(m, -1, 1))[known])

    seen = np.isin(range(6), first) if first else np.zeros(6, bool)
    perms = {u: np.array([t(x[u], m) for m in masks]) for u in np.ndindex(4, 3)}
    tops = np.max(list(perms.values()), axis=0)
    assert np.allclose(held.maxima(), tops, rtol=1e-6)
    got = held.units().collect()
    assert len(got) == 12
    for row in got:
        want = t(x[row.i, row.j], seen)
        assert math.isclose(row.t, want, rel_tol=1e-6)
        least = want - 1e-7 * max(1, abs(want))
        assert math.isclose(row.p, np.mean(perms[row.i, row.j] >= least)) and math.isclose(row.corrected, np.mean(tops >= least))
    every = np.sort(np.concatenate(list(perms.values())))
    for p in (0.3, 0.05, 0.0):
        fit = [v for v in every if np.sum(every >= v) <= p * len(every)]
        assert math.isclose(held.height(p), min(fit, default=math.inf), rel_tol=1e-6)


def test_regions_and_clusters(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(6, 5, 5))
    x[1:4, 1:3] += 1.5
    masks = cal.sign_flips(5)
    held = cal.calibration(frame(spark, x), ["i", "j"], "s", "y", masks)
    perms = {u: np.array([student(x[u] * np.where(m, -1, 1)) for m in masks]) for u in np.ndindex(6, 5)}
    labels = {u: "a" if u[0] < 2 else "b" if u[1] < 2 else "c" for u in perms}
    table = spark.createDataFrame([(*u, k) for u, k in labels.items()] + [(0, 0, None)], "i int, j int, name string")
    sums = {k: sum(-np.log(tails(perms[u])) for u in perms if labels[u] == k) for k in "abc"}
    ps = {k: tails(s) for k, s in sums.items()}
    least = np.min(list(ps.values()), axis=0)
    got = {row["name"]: row for row in held.regions(table, "name").collect()}
    assert set(got) == set("abc")
    for k, row in got.items():
        assert math.isclose(row.fisher, sums[k][0], rel_tol=1e-9) and math.isclose(row.p, ps[k][0]) and math.isclose(row.corrected, np.mean(least <= ps[k][0] + 1e-12))

    def sizes(k):
        over, seen, out = {u for u in perms if perms[u][k] > 1.5}, set(), []
        for u in sorted(over):
            n, todo = 0, [u]
            while todo:
                c = todo.pop()
                if c in over and c not in seen:
                    seen.add(c)
                    n += 1
                    todo += [(c[0] + a, c[1] + b) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]
            out += [n] * (n > 0)
        return out

    every = [sizes(k) for k in range(32)]
    flat = np.array(sum(every, []))
    found = held.clusters(1.5).collect()
    assert sorted(c["size"] for c in found) == sorted(every[0])
    for c in found:
        assert math.isclose(c.p, np.mean(flat >= c["size"])) and math.isclose(c.corrected, np.mean([max(s, default=0) >= c["size"] for s in every]))


def test_draws_and_nothing(spark):
    assert len(cal.sign_flips(40, 50)) == len(cal.exchanges(20, 20, 50)) == 50 and all(sum(m) == 20 for m in cal.exchanges(20, 20, 50))
    none = spark.createDataFrame([], "i int, j int, s int, y double")
    held = cal.calibration(none, ["i", "j"], "s", "y", cal.sign_flips(3))
    assert held.units().count() == 0 and held.height(0.5) == math.inf and set(held.maxima()) == {-math.inf}
    assert held.clusters(1.0).count() == 0
    flat = spark.createDataFrame([(0, 0, s, 2.0) for s in range(3)] + [(1, 1, 0, 3.0)], "i int, j int, s int, y double")
    got = cal.calibration(flat, ["i", "j"], "s", "y", cal.sign_flips(3)).units().collect()
    assert [(g.i, g.t, g.p) for g in got] == [(0, math.inf, 1 / 8)]
