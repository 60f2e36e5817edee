"""Empirical nulls against array versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import nulls, ordered, samples as statistics

tail = np.vectorize(lambda z: math.erfc(z / math.sqrt(2)) / 2)


def learned(x, left=0.2, right=0.8):
    x, n = np.sort(x), len(x)
    mid = x[int(n * left) : int(n * right)]
    bins = max(10, int((x[-1] - x[0]) // (3.5 * x.std() / n ** (1 / 3))))
    counts, edges = np.histogram(mid, bins=bins)
    at = ((edges[1:] + edges[:-1]) / 2)[counts > 0]
    c, b, a = np.polyfit(at - at.mean(), np.log(counts[counts > 0]), 2)[[2, 1, 0]]
    v = max(-1 / (2 * a), 1e-6)
    share = math.exp(c - math.log((edges[1] - edges[0]) * n) + math.log(2 * math.pi * v) / 2 + (b * v) ** 2 / (2 * v))
    return at.mean() + b * v, math.sqrt(v), min(1.0, share)


def curve_of(x, mu, sigma, p0):
    x = np.sort(x)
    raw = np.minimum(1, p0 * tail((x - mu) / sigma) * len(x) / np.arange(len(x), 0, -1))
    return np.maximum.accumulate(raw[::-1])[::-1]


@pytest.fixture(scope="module")
def samples(spark):
    r = np.random.default_rng(7)
    made = {"shifted": np.concatenate([r.normal(size=3000) + 3, r.normal(size=17000)]), "plain": r.normal(size=3000) * 2 + 1e3, "few": r.normal(size=60)}
    rows = [(u, float(v)) for u, x in made.items() for v in x] + [("plain", None), ("plain", float("nan")), ("flat", 1.0), ("flat", 1.0), ("one", 2.0)]
    return made, spark.createDataFrame(rows, "u string, x double").repartition(6).cache()


def test_learn(samples):
    made, table = samples
    got = {r.u: r for r in nulls.learn(table, ["u"], "x").collect()}
    for u, x in made.items():
        assert np.allclose([got[u].mu, got[u].sigma, got[u].p0], learned(x), rtol=1e-6) and got[u].n == len(x)
    assert got["flat"].mu is got["flat"].sigma is got["flat"].p0 is got["one"].mu is None
    assert abs(got["plain"].mu - 1e3) < 0.3 and abs(got["plain"].sigma - 2) < 0.5


def test_curve_and_thresholds(samples):
    made, table = samples
    null = nulls.learn(table, ["u"], "x").cache()
    curve = nulls.fdr_curve(table, ["u"], "x", null).cache()
    cut = {r.u: r.threshold for r in nulls.threshold(curve, ["u"], "x").collect()}
    at = {r.u: r.fdr for r in nulls.fdr_at(curve, null, ["u"], "x", 3.0).collect()}
    up = {r.u: r.threshold for r in nulls.uncorrected_threshold(null, ["u"]).collect()}
    for u, x in made.items():
        parameters = learned(x)
        want = curve_of(x, *parameters)
        got = curve.where(F.col("u") == u).orderBy("x").collect()
        assert np.allclose([r.x for r in got], np.sort(x)) and np.allclose([r.fdr for r in got], want, rtol=1e-5, atol=1e-9)
        low = np.flatnonzero(want < 0.05)
        assert (cut[u] == math.inf) if not len(low) else math.isclose(cut[u], (np.sort(x)[low[0]] + np.sort(x)[low[0] - 1]) / 2, rel_tol=1e-9)
        first = int(np.searchsorted(np.sort(x), 3.0))
        assert at[u] == 0.0 if first == len(x) else math.isclose(at[u], min(1, max(want[first], parameters[2] * tail((3 - parameters[0]) / parameters[1]) * len(x) / (len(x) - first))), rel_tol=1e-5)
        assert math.isclose(tail((up[u] - parameters[0]) / parameters[1]), 0.001, rel_tol=1e-5)
    # a shifted seventh of the values
    assert at["shifted"] < 0.2 and cut["shifted"] > 1.5
    assert curve.where("u = 'flat'").count() == 2 and nulls.learn(table.limit(0), ["u"], "x").count() == 0


@pytest.fixture
def other_cuts_each_time(monkeypatch):
    """Approximate quantiles that differ whenever they are taken, as on a cluster."""
    drawn = F.udf(lambda low, high, n: sorted(np.random.uniform(low, high, n).tolist()), "array<double>").asNondeterministic()
    monkeypatch.setattr(ordered.F, "percentile_approx", lambda x, at, accuracy: drawn(F.min(x), F.max(x), F.lit(len(at))))


def test_ranks_hold_for_any_cuts(spark, other_cuts_each_time):
    r = np.random.default_rng(11)
    x = {u: r.normal(size=800) for u in ("a", "b")}
    table = spark.createDataFrame([(u, float(v)) for u in x for v in x[u]], "u string, x double")
    for u, rows in table.transform(ordered.ranked, ["u"], "x").toPandas().groupby("u"):
        assert rows.sort_values("x")["rank"].tolist() == list(range(1, 801)) and set(rows["n"]) == {800}
    curve = nulls.fdr_curve(table, ["u"], "x").toPandas()
    for u, rows in curve.groupby("u"):
        assert np.allclose(rows.sort_values("x")["fdr"], curve_of(x[u], *learned(x[u])), rtol=1e-5, atol=1e-9)
    median = lambda v: float(np.median(v))
    for row in statistics.tukey(table, ["u"], "x", 0.1).collect():
        m = median(x[row.u])
        s, s0 = median(abs(x[row.u] - m)), median(abs(x[row.u] - 0.1))
        assert math.isclose(row.tukey, np.sign(m - 0.1) * math.sqrt(2 * 800 * math.log(max(s0, s) / s)), rel_tol=1e-6, abs_tol=1e-6)
