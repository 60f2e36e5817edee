"""Event designs against a boxcar that is laid out and convolved point by point."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions.design import gamma_difference_kernel
from tidegrid.operators import events
from tidegrid.sources.paradigms import paradigm


def laid_out(rows, n, tr, held, oversampling, min_onset):
    """A row a scan, a column a kernel, of (onset, duration, amplitude) rows."""
    points = int((n * tr - min_onset) / tr * oversampling + 1 + 1e-9)
    grid = np.linspace(min_onset, n * tr, points)
    on, off = {}, {}
    for at, long, size in sorted(rows):
        first = min(int(np.searchsorted(grid, at - 1e-10)), points - 1)
        last = min(int(np.searchsorted(grid, at + long - 1e-10)), points - 1)
        on[first] = size
        off[last + 1 if last == first and last < points - 1 else last] = size
    level, box = 0.0, []
    for k in range(points):
        level += on.get(k, 0.0) - off.get(k, 0.0)
        box.append(level)
    return np.column_stack([np.interp(np.arange(n) * tr, grid, np.convolve(box, h)[:points]) for h in held])


def gram_schmidt(x):
    x = x.copy()
    for i in range(1, x.shape[1]):
        for j in range(i):
            x[:, i] -= (x[:, i] @ x[:, j]) / (x[:, j] @ x[:, j]) * x[:, j]
    return x


def random_events(seed):
    r = np.random.default_rng(seed)
    rows = [(str(r.choice(["s", "t"])), str(r.choice(["a", "b"])), float(np.round(r.uniform(-30, 130), 2)), float(r.choice([0, 0, 1.5, 40])), float(r.normal())) for _ in range(60)]
    # equal steps, the grid's ends, switches on it
    return rows + [("s", "a", 10.0, 0.0, 5.0), ("s", "a", 10.0, 0.0, 7.0), ("s", "a", 9.99, 3.0, 2.0), ("t", "b", -100.0, 0.0, 1.0), ("t", "b", 500.0, 2.0, 1.0), ("s", "b", 0.0, 0.0, 1.0)]


@pytest.mark.parametrize("model, tr, min_onset", [("canonical", 2.0, -24.0), ("canonical with derivative", 1.3, -24.0), ("spm", 2.5, -7.0), ("spm_time_dispersion", 3.0, -24.0), ("fir", 2.0, -10.0)])
def test_regressors(spark, model, tr, min_onset):
    rows = random_events(1)
    table = spark.createDataFrame([*rows, (None, "a", 1.0, 0.0, 1.0), ("s", None, 1.0, 0.0, 1.0), ("s", "a", None, 0.0, 1.0)], "session string, condition string, onset double, duration double, amplitude double")
    n = {"s": 50, "t": 31}
    sessions = spark.createDataFrame([*n.items(), ("quiet", 20)], "session string, n int")
    delays, ov = (0, 2, 5), 1 if model == "fir" else 16
    got = {}
    for x in events.regressors(table, sessions, tr, model, delays, min_onset, duration="duration", amplitude="amplitude").collect():
        got[x.session, x.name, x.scan] = x.value
    held, names = events.kernels(model, tr, ov, delays), events.suffixes(model, delays)
    assert len(got) == sum(n.values()) * 2 * len(names)
    for s in n:
        for c in "ab":
            want = laid_out([x[2:] for x in rows if x[:2] == (s, c)], n[s], tr, held, ov, min_onset)
            want = want if model == "fir" else gram_schmidt(want)
            for k, name in enumerate(names):
                assert np.allclose([got[s, c + name, i] for i in range(n[s])], want[:, k], atol=1e-8, rtol=1e-7), (s, c, name)


def test_kernels():
    h = gamma_difference_kernel(2.0)
    t = np.linspace(0, 32, 256)
    g = lambda a: np.where(t > 0.125, np.exp((a - 1) * np.log(np.maximum(t - 0.125, 1e-300)) - (t - 0.125) - math.lgamma(a)), 0)
    want = g(6) - 0.167 * g(16)
    assert len(h) == 256 and np.allclose(h, want / want.sum()) and 4.5 < t[h.argmax()] < 5.5
    assert [len(events.kernels(m, 2.0)) for m in ("canonical", "canonical with derivative", "spm", "spm_time", "spm_time_dispersion")] == [1, 2, 1, 2, 3]
    assert [k.tolist() for k in events.kernels("fir", 2.0, 1, (0, 2))] == [[1], [0, 0, 1]]
    with pytest.raises(ValueError):
        events.kernels("other", 2.0)


@pytest.mark.parametrize("drift, n_drifts", [("cosine", 3), ("polynomial", 4), ("blank", 1)])
def test_design_matrix(spark, drift, n_drifts):
    rows = random_events(2)
    table = spark.createDataFrame([(s, c, t) for s, c, t, _, _ in rows if (s, c) != ("t", "b")], "u string, kind string, at double").repartition(3)
    extra = spark.createDataFrame([(s, k, float(k * k)) for s in "st" for k in range(40)], "u string, scan long, motion double")
    x = events.design_matrix(table, table, 2.0, 40, ["b", "a"], "canonical with derivative", drift, 3, 50.0, session="u", extra=extra, condition="kind", onset="at")
    assert x.columns == ["u", "scan", "b", "b_derivative", "a", "a_derivative", "motion", *[f"drift_{k}" for k in range(1, n_drifts)], "constant"]
    held = {s: np.array([r[2:] for r in x.where(F.col("u") == s).orderBy("scan").collect()]) for s in "st"}
    assert held["s"].shape == (40, 5 + n_drifts) and not held["t"][:, :2].any()
    for s in "st":
        want = gram_schmidt(laid_out([(t, 0.0, 1.0) for u, c, t, _, _ in rows if (u, c) == (s, "a")], 40, 2.0, events.kernels("canonical with derivative", 2.0), 16, -24.0))
        assert np.allclose(held[s][:, 2:4], want, atol=1e-8) and np.allclose(held[s][:, 4], np.arange(40) ** 2)
        last = held[s][:, 5:]
        assert np.allclose(last[:, -1], 1)
        if drift != "blank":
            gram = last.T @ last
            assert np.allclose(gram, np.diag(np.diag(gram)), atol=1e-8)
        if drift == "polynomial":
            powers = gram_schmidt(np.column_stack([(np.arange(40) / 39) ** k for k in range(4)]))
            assert np.allclose(last[:, :-1], powers[:, 1:], atol=1e-9)


def test_no_events(spark):
    none = spark.createDataFrame([], "session string, condition string, onset double")
    sessions = spark.createDataFrame([("s", 5)], "session string, n int")
    assert events.regressors(none, sessions, 2.0).count() == 0
    x = events.design_matrix(none, sessions, 2.0, 5, ["a"], drift="blank").collect()
    assert [(r.a, r.constant) for r in x] == [(0.0, 1.0)] * 5


def test_paradigm_files(spark, tmp_path):
    (tmp_path / "one.csv").write_text("s1, left, 0.5\ns1,right,4\n")
    (tmp_path / "two.csv").write_text("s2,left,1.5,2.0\ns2,left,9,0,3.5\n")
    got = sorted(map(tuple, paradigm(spark, str(tmp_path)).collect()))
    assert got == [("s1", "left", 0.5, 0.0, 1.0), ("s1", "right", 4.0, 0.0, 1.0), ("s2", "left", 1.5, 2.0, 1.0), ("s2", "left", 9.0, 0.0, 3.5)]
