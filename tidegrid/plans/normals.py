"""Queries: mixtures of normal densities over parts, by price and size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import normals
from ..sources.tables import table
from .registry import query

#: Where the two components start, and the rounds of both fits.
CENTRES, ROUNDS = [[1.2, 1.0], [1.6, 4.0]], 4
DATA = "d as (select p_partkey as id, p_retailprice / 1000::double as x, p_size / 10.0::double as y from part), z as (select avg(x) as mx, avg(y) as my, var_pop(x) / 2 as vx, var_pop(y) / 2 as vy from d)"


def _psi(x: str) -> str:
    y = f"({x} + 8)"
    return f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y} ** 2) + 1 / (120 * {y} ** 4) - 1 / (252 * {y} ** 6) + 1 / (240 * {y} ** 8) - 1 / (132 * {y} ** 10) - {' - '.join(f'1 / ({x} + {i})' for i in range(8))})"


def _rounds(variational: bool) -> str:
    """CTEs m0, m1, ...: the parameters of both components after each round; s holds the shares of the points."""
    near = "case when (x - 1.2) ** 2 + (y - 1.0) ** 2 <= (x - 1.6) ** 2 + (y - 4.0) ** 2 then 0 else 1 end"
    parts, weight = [f"s0 as (select id, x, y, k, (k = {near})::int::double as r from d, range(2) t(k))"], 1.0 if variational else 0.5
    for i in range(ROUNDS + 1):
        parts.append(f"""n{i} as (select k, sum(r) as n, sum(r * x) / sum(r) as ex, sum(r * y) / sum(r) as ey from s{i} group by 1),
        c{i} as (select k, any_value(n) as n, any_value(ex) as ex, any_value(ey) as ey, sum(r * (x - ex) ** 2) as cxx, sum(r * (x - ex) * (y - ey)) as cxy, sum(r * (y - ey) ** 2) as cyy from s{i} join n{i} using (k) group by 1),
        i{i} as (select k, n, n + 0.01 as shrink, n + 4 as dof, (n * ex + 0.01 * mx) / (n + 0.01) as ux, (n * ey + 0.01 * my) / (n + 0.01) as uy, vx + cxx + (ex - mx) ** 2 * 0.01 * n / (n + 0.01) as a, cxy + (ex - mx) * (ey - my) * 0.01 * n / (n + 0.01) as b, vy + cyy + (ey - my) ** 2 * 0.01 * n / (n + 0.01) as c from c{i}, z)""")  # fmt: skip
        divided = "1" if variational else "(dof + 4)"
        parts.append(f"m{i} as (select k, {weight} + n as w, sum({weight} + n) over () as ws, shrink, dof, ux, uy, {divided} * c / (a * c - b * b) as pxx, -{divided} * b / (a * c - b * b) as pxy, {divided} * a / (a * c - b * b) as pyy from i{i})")
        quad = "(pxx * (x - ux) ** 2 + 2 * pxy * (x - ux) * (y - uy) + pyy * (y - uy) ** 2)"
        half = "ln(pxx * pyy - pxy * pxy) / 2 - ln(2 * pi())"
        log = f"{_psi('w')} - {_psi('ws')} - 1 / shrink + ln(2) + ({_psi('(dof / 2)')} + {_psi('((dof - 1) / 2)')}) / 2 + {half} - dof * {quad} / 2" if variational else f"ln(w / ws) + {half} - {quad} / 2"
        parts.append(f"l{i} as (select id, x, y, k, exp({log}) as l from d, m{i}), s{i + 1} as (select *, l / sum(l) over (partition by id) as r from l{i})")
    return f"with {DATA}, " + ", ".join(parts)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array((F.col("p_retailprice") / 1000).cast("double"), (F.col("p_size") / 10).cast("double")).alias("v"))


def _parameters(spark: SparkSession, model: normals.Mixture) -> DataFrame:
    rows = [(k, *(round(float(x), 6) for x in (model.weights[k], *model.means[k], model.precisions[k][0, 0], model.precisions[k][0, 1], model.precisions[k][1, 1]))) for k in range(len(model.means))]
    return spark.createDataFrame(rows, "k long, w double, x double, y double, pxx double, pxy double, pyy double")


@query("normal_mixture", f"{_rounds(False)} select k, round(w / ws, 6) as w, round(ux, 6) as x, round(uy, 6) as y, round(pxx, 6) as pxx, round(pxy, 6) as pxy, round(pyy, 6) as pyy from m{ROUNDS}")
def normal_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parameters(spark, normals.fit(parts(spark, sf_dir), "v", CENTRES, ROUNDS, -1e300))


@query("normal_mixture_likelihood", f"{_rounds(False)} select id, round(max(l) filter (k = 0), 7) as like0, round(max(l) filter (k = 1), 7) as like1, arg_max(k, l) as label from l{ROUNDS} group by 1")
def normal_mixture_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = parts(spark, sf_dir)
    made = normals.likelihood(d, "id", "v", normals.fit(d, "v", CENTRES, ROUNDS, -1e300))
    return made.select("id", F.round(F.col("like")[0], 7).alias("like0"), F.round(F.col("like")[1], 7).alias("like1"), "label")


@query("variational_mixture", f"{_rounds(True)} select k, round(w, 6) as w, round(ux, 6) as x, round(uy, 6) as y, round(pxx, 6) as pxx, round(pxy, 6) as pxy, round(pyy, 6) as pyy from m{ROUNDS}")
def variational_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parameters(spark, normals.fit(parts(spark, sf_dir), "v", CENTRES, ROUNDS, -1e300, variational=True))


@query("variational_mixture_likelihood", f"{_rounds(True)} select id, round(max(l) filter (k = 0), 7) as like0, round(max(l) filter (k = 1), 7) as like1, arg_max(k, l) as label from l{ROUNDS} group by 1")
def variational_mixture_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = parts(spark, sf_dir)
    made = normals.likelihood(d, "id", "v", normals.fit(d, "v", CENTRES, ROUNDS, -1e300, variational=True))
    return made.select("id", F.round(F.col("like")[0], 7).alias("like0"), F.round(F.col("like")[1], 7).alias("like1"), "label")
