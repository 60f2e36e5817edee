"""Formulas, contrasts and analysis of variance."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions.formula import Formula, I, factor, factor_of, from_frame, natural_spline, term
from tidegrid.operators import formulas, models

# Days in hospital by duration of dialysis (two halves), weight (three tens in each) and patient.
DAYS = (
    (0, 2, 1, 3, 0, 2, 0, 5, 6, 8), (2, 4, 7, 12, 15, 4, 3, 1, 5, 20), (15, 10, 8, 5, 25, 16, 7, 30, 3, 27),
    (0, 1, 1, 0, 4, 2, 7, 4, 0, 3), (5, 3, 2, 0, 1, 1, 3, 6, 7, 9), (10, 8, 12, 3, 7, 15, 4, 9, 6, 1),
)
# Effect, degrees of freedom, sum of squares, F, p.
PRINTED = (("Duration", 1, 209.07, 7.2147, 0.009587), ("Weight", 2, 760.43, 13.1210, 2.269e-05), ("Duration:Weight", 2, 109.03, 1.8813, 0.162240))


@pytest.fixture(scope="module")
def kidney(spark):
    rows = [(float(d), 1 + k // 3, 1 + k % 3) for k, ten in enumerate(DAYS) for d in ten]
    return spark.createDataFrame([*rows, (None, 1, 1)], "days double, duration int, weight int")


def test_factorial_table(kidney):
    d, w = factor_of(kidney, "duration"), factor_of(kidney, "weight")
    effects = {"Duration": d.main_effect, "Weight": w.main_effect, "Duration:Weight": d.main_effect * w.main_effect}
    # cells alone; before a constant and factors that they alias; a constant and main effects
    for design in (d * w, d * w + I + d + w, I + d.main_effect + w.main_effect + d.main_effect * w.main_effect):
        got = {r.effect: r for r in formulas.anova(kidney, design, "days", effects).collect()}
        for name, dof, ss, f, p in PRINTED:
            r = got[name]
            assert r.df == dof and round(r.ss, 2) == ss and abs(r.f - f) < 6e-5 and math.isclose(r.p, p, rel_tol=3e-4)
        assert got["residual"].df == 54 and round(got["residual"].ss, 2) == 1564.80


def test_algebra():
    x, y, z = (term(c) for c in "xyz")
    f, g = x + y + z, y + I
    assert (f + g).names == ["x", "y", "z", "y#3", "1"]
    assert (g - f).names == ["1"] and (f - g).names == ["x", "z"] and (f - f).names == []
    assert ((x + y) * (x + y)).names == ["x**2", "x*y", "y**2"]
    a, b = factor("a", ["p", "q"]), factor("b", [1, 2])
    assert (a * a).names == a.names == ["a_p", "a_q"]
    assert (a * b).names == ["a_p*b_1", "a_p*b_2", "a_q*b_1", "a_q*b_2"]
    assert a.main_effect.names == ["a_p-a_q"] and a.stratify("x").names == ["a_p*x", "a_q*x"]
    assert (a.main_effect * b.main_effect).names == ["a_p*b_1-a_p*b_2-a_q*b_1+a_q*b_2"]
    assert (x * x * y).subs("x", z).names == (z * z * y).names
    assert (x * y).subs("x", a.main_effect).names == ["a_p*y-a_q*y"]
    assert a * I == Formula(a.terms) and a.level("q").names == ["a_q"]
    for wrong in (lambda: a.level("r"), lambda: factor("a", [1, 1])):
        with pytest.raises(ValueError):
            wrong()


def test_columns(spark):
    df = spark.createDataFrame([(1.0, "u", True), (3.0, "v", False), (5.0, None, None)], "x double, s string, t boolean")
    made = natural_spline("x", [2.0], order=2, intercept=True) + factor_of(df, "s") + term("root", lambda: F.sqrt("x"))
    assert made.names == ["1", "x", "x**2", "x_2_2", "s_u", "s_v", "root"]
    got = [tuple(r) for r in df.select(*made.columns()).collect()]
    assert got == [(1, 1, 1, 0, 1, 0, 1), (1, 3, 9, 1, 0, 1, math.sqrt(3)), (1, 5, 25, 9, 0, 0, math.sqrt(5))]
    assert from_frame(df).names == ["x", "s_u", "s_v", "t_False", "t_True"] and from_frame(df, drop=["s"], keep=["x", "s"]).names == ["x"]
    with pytest.raises(ValueError):
        factor_of(df, "s", most=1)


def test_contrasts_and_aliases(spark):
    r = np.random.default_rng(0)
    rows = [(float(v), str(r.choice(["a", "b", "c"])), float(w)) for v, w in r.normal(size=(80, 2))]
    df = spark.createDataFrame(rows, "x double, s string, y double").cache()
    s = factor_of(df, "s")
    design = I + s + term("x") + term("twice", lambda: 2 * F.col("x"))
    assert formulas.estimable(df, design).names == ["1", "s_a", "s_b", "x"]
    full = np.array([tuple(v) for v in df.select(*design.columns()).collect()])
    held = np.array([tuple(v) for v in df.select(*s.main_effect.columns()).collect()])
    want = np.linalg.pinv(full) @ held
    assert np.allclose(formulas.contrast(df, design, s.main_effect), want.T, atol=1e-9)
    # a column that another is the sum of is one contrast
    assert formulas.contrast(df, design, s.main_effect + s.main_effect).shape == (2, 6)
    fits = formulas.fit(df, [], formulas.estimable(df, design), "y").first()
    x = np.array([tuple(v) for v in df.select(*formulas.estimable(df, design).columns()).collect()])
    y = np.array([v[2] for v in rows])
    assert np.allclose(fits.beta, np.linalg.lstsq(x, y)[0])
    by = models.t_contrast(formulas.fit(df, ["s"], I + term("x"), "y"), ["s"], [0.0, 1.0]).collect()
    assert len(by) == 3
    with pytest.raises(ValueError):
        formulas.anova(df, I, "y", {"none": s.main_effect - s.main_effect}).collect()
