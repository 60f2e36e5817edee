"""Designs by formula over a table: aliased columns, contrasts, fits and analysis of variance."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formula import Formula
from ..functions.tails import f_sf
from . import models


def gram(df: DataFrame, *formulas: Formula) -> np.ndarray:
    """The products of all columns of the formulas, side by side, summed over the rows without a null in one: one aggregate, whose few numbers come to the driver."""
    cols = [c for f in formulas for c in f.columns()]
    p = len(cols)
    rows = df.select(F.array(*cols).alias("x")).where(~F.exists("x", lambda v: v.isNull()))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    held = rows.agg(F.array(*[F.coalesce(F.sum(F.col("x")[i] * F.col("x")[j]), F.lit(0.0)) for i, j in pairs])).first()[0]
    full = np.zeros((p, p))
    full[np.triu_indices(p)] = held
    return full + np.triu(full, 1).T


def independent(g: np.ndarray, least: float = 1e-11) -> list[int]:
    """The columns, by their products, that are no sum of those before them."""
    kept: list[int] = []
    for k in range(len(g)):
        rest = g[k, k]
        if kept:
            inner = g[np.ix_(kept, kept)]
            rest = g[k, k] - g[k, kept] @ np.linalg.solve(inner, g[kept, k])
        if g[k, k] > 0 and rest > least * g[k, k]:
            kept.append(k)
    return kept


def estimable(df: DataFrame, formula: Formula) -> Formula:
    """The formula without the columns that are aliased with earlier ones in this table."""
    kept = independent(gram(df, formula))
    return Formula(tuple(formula.terms[k] for k in kept))


def contrast(df: DataFrame, formula: Formula, effect: Formula) -> np.ndarray:
    """Rows of contrasts of the formula's coefficients that stand for the columns of effect: the coefficients that make those columns of the design, without rows that are sums of others.

    They weigh the coefficients as the formula has them: of a design of cells, the product of its factors,
    the rows of a main effect compare unweighted means of cells.
    """
    p = len(formula.terms)
    g = gram(df, formula, effect)
    rows = (np.linalg.pinv(g[:p, :p], rcond=1e-12) @ g[:p, p:]).T
    # two contrasts are alike if the columns that they make are
    made = rows @ g[:p, :p] @ rows.T
    return rows[independent(made)]


def fit(df: DataFrame, by: list[str], formula: Formula, y: str) -> DataFrame:
    """models.fit() of y on the columns of a formula. Collinear columns give null coefficients; see estimable()."""
    names = [f"x{k}" for k in range(len(formula.terms))]
    rows = df.select(*by, *[t.column().alias(c) for t, c in zip(formula.terms, names)], F.col(y).alias("y"))
    return models.fit(rows, by, names, "y")


def anova(df: DataFrame, formula: Formula, y: str, effects: Mapping[str, Formula]) -> DataFrame:
    """(effect, df, ss, f, p): an F test of the columns of each effect in the design, and the residual's row.

    The design is the formula without aliased columns, the earlier ones staying; see contrast() for what an
    effect is in it. ss is what the effect's contrasts take from the
    residual sum of squares. The coefficients stay a table of one row.
    """
    df = df.where(F.col(y).isNotNull())
    design = estimable(df, formula)
    fits = fit(df, [], design, y)
    mse, out = models.dispersion(len(design.terms)), None
    for name, effect in effects.items():
        rows = contrast(df, design, effect)
        if not len(rows):
            raise ValueError(f"no part of {name} can be estimated")
        tested = models.f_contrast(fits, [], rows.tolist()).crossJoin(F.broadcast(fits.select(mse.alias("mse"))))  # one row each
        row = tested.select(F.lit(name).alias("effect"), F.col("dfn").cast("long").alias("df"), (F.col("f") * F.col("dfn") * F.col("mse")).alias("ss"), "f", f_sf(F.col("f"), F.col("dfn"), F.col("dfd")).alias("p"))
        out = row if out is None else out.unionByName(row)
    none = F.lit(None).cast("double")
    rest = fits.select(F.lit("residual").alias("effect"), (F.col("n") - len(design.terms)).alias("df"), F.col("sse").alias("ss"), none.alias("f"), none.alias("p"))
    return rest if out is None else out.unionByName(rest)
