"""Registration against array versions, and shifts and rotations that are known."""

import math

import numpy as np
import pytest

from tidegrid.operators import registration


def blobs(shape, seed=1, more=6):
    r = np.random.default_rng(seed)
    grid = np.indices(shape)
    out = np.zeros(shape)
    for _ in range(more):
        c = [r.uniform(0.2, 0.8) * n for n in shape]
        out += r.uniform(1, 3) * np.exp(-sum((g - x) ** 2 for g, x in zip(grid, c)) / r.uniform(6, 16))
    return out


def table(spark, values, at):
    return spark.createDataFrame([(*map(int, p), float(values[p])) for p in np.ndindex(*values.shape)], ", ".join(f"{a} int" for a in at) + ", y double").repartition(3)


def by_hand(a, b, matrix, shift, tri):
    h = {}
    for p, i in a.items():
        x = np.array(matrix) @ p + shift
        low = np.floor(x)
        met = []
        for step in np.ndindex(*[2] * len(p)):
            w = math.prod((t - f) if s else 1 - t + f for t, f, s in zip(x, low, step))
            q = tuple(int(f) + s for f, s in zip(low, step))
            if w > 0 and q in b:
                met.append((w, b[q]))
        if tri and met:
            met = [(1.0, int(math.floor(sum(w * j for w, j in met) / sum(w for w, _ in met) + 0.5)))]
        for w, j in met:
            h[i, j] = h.get((i, j), 0.0) + w
    return h


@pytest.mark.parametrize("way", ["pv", "tri"])
def test_histograms(spark, way):
    r = np.random.default_rng(3)
    draw = lambda: {(i, j): int(r.integers(0, 4)) for i in range(7) for j in range(6) if r.random() < 0.9}
    a, b = draw(), draw()
    frame = lambda d: spark.createDataFrame([(*p, v) for p, v in d.items()] + [(50, 50, None)], "i int, j int, bin int")
    maps = [([[1.0, 0.0], [0.0, 1.0]], [0.0, 0.0]), ([[0.9, 0.13], [-0.21, 1.07]], [0.37, -0.58])]
    got = registration.histograms(frame(a), frame(b), ["i", "j"], maps, interpolate=way).collect()
    for k, (m, s) in enumerate(maps):
        want = by_hand(a, b, m, s, way == "tri")
        found = {(x.a, x.b): x.n for x in got if x.k == k}
        assert found.keys() == want.keys() and all(math.isclose(found[c], want[c], rel_tol=1e-9) for c in want)


def test_measures():
    r = np.random.default_rng(5)
    h = r.random((5, 5))
    i, j = np.indices(h.shape)
    p = h / h.sum()
    cov = np.cov(np.vstack([i.ravel(), j.ravel()]), aweights=h.ravel(), ddof=0)
    assert math.isclose(registration.MEASURES["cc"](h), cov[0, 1] ** 2 / cov[0, 0] / cov[1, 1])
    given = sum(p[a].sum() * np.cov(j[a], aweights=h[a], ddof=0) for a in range(5))
    assert math.isclose(registration.MEASURES["cr"](h), 1 - given / cov[1, 1])
    mi = (p * np.log(p / p.sum(1)[:, None] / p.sum(0))).sum()
    assert math.isclose(registration.MEASURES["mi"](h), mi) and math.isclose(registration.supervised(h)(h), mi)
    assert all(math.isclose(f(np.diag([3.0, 1.0, 2.0])), math.log(6) - (3 * math.log(3) + 2 * math.log(2)) / 6 if n == "mi" else 1.0) for n, f in registration.MEASURES.items())
    assert all(abs(f(np.ones((4, 4)))) < 1e-12 for f in registration.MEASURES.values())
    assert all(f(np.array([[4.0]])) in (0.0, 1.0) for f in registration.MEASURES.values())


def test_affine_maps():
    m, s = registration.affine([1, 2, 3, 0, 0, math.pi / 2])
    assert np.allclose(m, [[0, -1, 0], [1, 0, 0], [0, 0, 1]]) and s == [1, 2, 3]
    assert np.allclose(registration.affine([0] * 6 + [2.0])[0], 2 * np.eye(3))
    assert np.allclose(registration.affine([0] * 6 + [math.log(2), 0, 0] + [0] * 3)[0], np.diag([2, 1, 1]))
    with pytest.raises(ValueError):
        registration.affine([1, 2])


def test_known_shift_is_found(spark):
    big = blobs((26, 24))
    moved, still = big[3:23, 2:20], big[1:21, 3:21]  # still at p is moved at p + (-2, 1)
    held = registration.register(table(spark, still, "ij"), table(spark, moved, "ij"), ["i", "j"], "y", 32, measure="cc", to_map=registration.shifts)
    found, likeness = held.optimize([0.0, 0.0], [1.0, 1.0], tolerance=0.3)
    assert np.allclose(found, [-2, 1], atol=0.26) and likeness > 0.98
    top = max(held.explore([0.0, 0.0], (0, [-2, -1, 0]), (1, [0, 1])), key=lambda x: x[1])
    assert top[0] == [-2.0, 1.0]
    f = lambda x, y: held.evaluate([[x, y]])[0]
    g, h = held.gradient([0.3, 0.4]), held.hessian([0.3, 0.4])
    assert math.isclose(g[0], (f(0.4, 0.4) - f(0.2, 0.4)) / 0.2, rel_tol=1e-6)
    assert math.isclose(h[0][1], (f(0.4, 0.5) - f(0.4, 0.3) - f(0.2, 0.5) + f(0.2, 0.3)) / 0.04, rel_tol=1e-6) and h[0][1] == h[1][0]


def test_clamp_and_empty(spark):
    whole = spark.createDataFrame([(k, float(v)) for k, v in enumerate([5, 7, 9])] + [(9, None), (8, float("nan"))], "i int, y double")
    assert sorted(x.bin for x in registration.clamp(whole, ["i"], "y", 16).collect()) == [0, 2, 4]
    assert sorted(x.bin for x in registration.clamp(whole, ["i"], "y", 3).collect()) == [0, 1, 2]
    none = registration.register(whole.limit(0), whole, ["i"], "y", 4, measure="cc", to_map=registration.shifts)
    assert none.evaluate([[0.0], [1.0]]) == [0.0, 0.0]
    with pytest.raises(ValueError):
        registration.clamp(whole, ["i"], "y", 10**6)
