"""Queries: cubic splines through the grid of nations and months."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splines
from .registry import query
from .space import CELLS, cells

SHAPE = (25, 12)
MATRIX, SHIFT = ((0.95, 0.05), (-0.04, 1.02)), (0.4, -0.3)


def _weight(p: str, x: str, n: int) -> str:
    """The mirrored filter in closed form: the weight of the sample at x in the coefficient at p of n positions."""
    period, z = 2 * (n - 1), f"({splines.POLE!r}::double)"
    ring = lambda d: f"(pow({z}, abs({d})) + pow({z}, {period} - abs({d})))"
    return f"sqrt(3) * ({ring(f'{p} - {x}')} + case when {x} in (0, {n - 1}) then 0 else {ring(f'{p} + {x}')} end) / (1 - pow({z}, {period}))"


COEFS = f"""{CELLS}, s as (select i::bigint as i, (j - 1)::bigint as j, v from g), pi as (select unnest(range({SHAPE[0]})) as p), pj as (select unnest(range({SHAPE[1]})) as p),
    a as (select pi.p as i, s.j, sum(v * {_weight("pi.p", "s.i", SHAPE[0])}) as c from s, pi group by 1, 2), k as (select a.i, pj.p as j, sum(c * {_weight("pj.p", "a.j", SHAPE[1])}) as c from a, pj group by 1, 2)"""
_BASIS = lambda x: f"(case when abs({x}) < 1 then 2.0::double / 3 - abs({x}) ** 2 + abs({x}) ** 3 / 2 else greatest(2 - abs({x}), 0) ** 3 / 6 end)"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select(F.col("i").cast("long").alias("i"), (F.col("j") - 1).cast("long").alias("j"), "v")


@query("spline_coefficients", f"with {COEFS} select i, j, round(c, 5) as c from k")
def spline_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splines.coefficients(_grid(spark, sf_dir), ["i", "j"], "v", SHAPE).withColumn("c", F.round("c", 5))


def _axis(k: str, n: int, mode: str) -> str:
    """Position and weight of coordinate k under a mode."""
    if mode == "reflect":
        return f"{k} as {k}q, case when {k} between {-(n - 1)} and {2 * (n - 1)} then 1.0 else 0.0 end as {k}w"
    return f"greatest(least({k}, {n - 1}), 0) as {k}q, case when {k} < -1 or {k} > {n} then 0.0 when {k} < 0 then 1 + {k} when {k} > {n - 1} then {n} - {k} else 1.0 end as {k}w"


@query("resample_cubic", f"""with {COEFS}, t as (select i, j, {MATRIX[0][0]}::double * i + {MATRIX[0][1]}::double * j + {SHIFT[0]}::double as x, {MATRIX[1][0]}::double * i + {MATRIX[1][1]}::double * j + {SHIFT[1]}::double as y from s),
    u as (select i, j, {_axis("x", SHAPE[0], "zero")}, {_axis("y", SHAPE[1], "reflect")} from t), o as (select unnest(range(-1, 3)) as d),
    e as (select u.i, u.j, floor(xq)::bigint + a.d as p, floor(yq)::bigint + b.d as q, xw * yw * {_BASIS("(xq - floor(xq) - a.d)")} * {_BASIS("(yq - floor(yq) - b.d)")} as w from u, o a, o b),
    m as (select i, j, w, {SHAPE[0] - 1} - abs(((p % {2 * SHAPE[0] - 2}) + {2 * SHAPE[0] - 2}) % {2 * SHAPE[0] - 2} - {SHAPE[0] - 1}) as p, {SHAPE[1] - 1} - abs(((q % {2 * SHAPE[1] - 2}) + {2 * SHAPE[1] - 2}) % {2 * SHAPE[1] - 2} - {SHAPE[1] - 1}) as q from e)
    select m.i, m.j, round(sum(w * coalesce(c, 0)), 5) as value from m left join k on k.i = p and k.j = q group by 1, 2""")  # fmt: skip
def resample_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid under an affine map: faded to 0 over the nations' ends, mirrored over the months'."""
    g = _grid(spark, sf_dir)
    return splines.resample_cubic(g, ["i", "j"], "v", SHAPE, g, MATRIX, SHIFT, ["zero", "reflect"]).withColumn("value", F.round("value", 5))
