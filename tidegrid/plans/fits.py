"""Queries: fits in rounds, and spanning forests. The SQL unrolls the rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import glm, grid, mixtures
from ..sources.tables import table
from .registry import query
from .sampling import rounded

ROUNDS = 4


def _mixture_sql() -> str:
    parts = [
        "h as (select l_returnflag as unit, l_quantity as x from lineitem)",
        f"p0 as (select unit, 0.5 as w1, 0.5 as w2, min(x) + 0.25 * (max(x) - min(x)) as m1, min(x) + 0.75 * (max(x) - min(x)) as m2, greatest(var_pop(x), {mixtures.LEAST_VARIANCE}) as v1, greatest(var_pop(x), {mixtures.LEAST_VARIANCE}) as v2 from h group by 1)",
    ]
    for r in range(1, ROUNDS + 1):
        parts.append(f"d{r} as (select unit, x, w1 * exp(-pow(x - m1, 2) / 2 / v1) / sqrt(v1) as a, w2 * exp(-pow(x - m2, 2) / 2 / v2) / sqrt(v2) as b from h join p{r - 1} using (unit))")
        parts.append(f"e{r} as (select unit, x, a / (a + b) as a, b / (a + b) as b from d{r})")
        parts.append(f"p{r} as (select unit, sum(a) / count(*) as w1, sum(b) / count(*) as w2, sum(a * x) / sum(a) as m1, sum(b * x) / sum(b) as m2, sum(a * x * x) / sum(a) - pow(sum(a * x) / sum(a), 2) as v1, sum(b * x * x) / sum(b) - pow(sum(b * x) / sum(b), 2) as v2 from e{r} group by 1)")
    return f"with {', '.join(parts)} select unit, {', '.join(f'round({c}{i}, 4) as {c}{i}' for c in 'wmv' for i in (1, 2))} from p{ROUNDS}"


@query("gaussian_mixture", _mixture_sql())
def gaussian_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("unit"), "l_quantity")
    return rounded(mixtures.gaussian_mixture(rows, ["unit"], "l_quantity", 2, ROUNDS), *[f"{c}{i}" for c in "wmv" for i in (1, 2)])


def _irls_sql(y: str, link: str, mu: str, w: str) -> str:
    parts = [f"h as (select l_linenumber as unit, {y} as y, (l_quantity - 25) / 10 as x from lineitem)", f"p0 as (select unit, {link.format('avg(y)')} as a, 0.0::double as b from h group by 1)"]
    for r in range(1, ROUNDS + 1):
        parts.append(f"l{r} as (select unit, x, y, a + b * x as eta, {mu.format('(a + b * x)')} as mu from h join p{r - 1} using (unit))")
        parts.append(f"z{r} as (select unit, x, {w} as w, eta + (y - mu) / ({w}) as z from l{r})")
        parts.append(f"s{r} as (select unit, sum(w) as sw, sum(w * x) as sx, sum(w * x * x) as sxx, sum(w * z) as sz, sum(w * x * z) as sxz from z{r} group by 1)")
        parts.append(f"p{r} as (select unit, (sxx * sz - sx * sxz) / (sw * sxx - sx * sx) as a, (sw * sxz - sx * sz) / (sw * sxx - sx * sx) as b from s{r})")
    return f"with {', '.join(parts)} select unit, round(a, 5) as intercept, round(b, 5) as slope from p{ROUNDS}"


def _irls(spark: SparkSession, sf_dir: str, y, family: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("unit"), ((F.col("l_quantity") - 25) / 10).alias("x"), y.cast("double").alias("y"))
    return rounded(glm.irls(rows, ["unit"], ["x"], "y", family, ROUNDS).withColumnRenamed("b_x", "slope"), "intercept", "slope", places=5)


@query("irls_binomial", _irls_sql("(l_returnflag = 'R')::int::double", "ln({0} / (1 - {0}))", "1 / (1 + exp(-{0}))", "mu * (1 - mu)"))
def irls_binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _irls(spark, sf_dir, F.col("l_returnflag") == "R", "binomial")


@query("irls_poisson", _irls_sql("round(l_discount * 100)", "ln({0})", "exp({0})", "mu"))
def irls_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _irls(spark, sf_dir, F.round(F.col("l_discount") * 100), "poisson")


#: An edge is in the forest unless edges before it in the order already join its ends.
@query(
    "spanning_forest",
    """with recursive e as (select row_number() over (order by w, src, dst) as k, * from (select a.vec_id as src, b.vec_id as dst, list_distance(a.embedding::double[], b.embedding::double[]) as w from embeddings a join embeddings b on a.vec_id < b.vec_id) where w < 1.2),
    b as (select k, src, dst from e union all select k, dst, src from e), r as (select k, src as at from e union select r.k, b.dst from r join b on b.src = r.at and b.k < r.k)
    select src, dst, round(w, 5) as w from e where not exists (select 1 from r where r.k = e.k and r.at = e.dst)""",
)
def spanning_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rounded(grid.spanning_forest(grid.eps_graph(points, 1.2, "vec_id", "embedding")), "w", places=5)
