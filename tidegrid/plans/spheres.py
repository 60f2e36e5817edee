"""Queries: von Mises mixtures of the embeddings' first three coordinates as directions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spheres
from ..sources.tables import table
from .registry import query

KAPPA, ROUNDS = 6.0, 4
STARTS = [[1.0, 0.0, 0.0], [0.0, 0.6, 0.8]]


def _rounds() -> str:
    """CTEs p0, p1, ...: direction and weight of the null class (k = 0) and both others after each round."""
    start = ", ".join(f"({k}, {x}::double, {y}::double, {z}::double, 1.0::double / 3)" for k, (x, y, z) in enumerate([[0, 0, 0], *STARTS]))
    parts = [f"r as (select vec_id as id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings), d as (select id, x / s as x, y / s as y, z / s as z from (select *, sqrt(x * x + y * y + z * z) as s from r)), p0 as (select * from (values {start}) t(k, mx, my, mz, w))"]
    for i in range(ROUNDS + 1):
        parts.append(f"l{i} as (select id, k, x, y, z, w * case when k = 0 then 1 / (4 * pi()) else {KAPPA} / (2 * pi() * (1 - exp(-2 * {KAPPA}))) * exp({KAPPA} * (mx * x + my * y + mz * z - 1)) end as l from d, p{i}), s{i} as (select *, l / sum(l) over (partition by id) as r from l{i})")
        parts.append(f"u{i} as (select k, sum(r) as n, sum(r * x) as sx, sum(r * y) as sy, sum(r * z) as sz from s{i} group by 1), p{i + 1} as (select k, sx / sqrt(sx * sx + sy * sy + sz * sz) as mx, sy / sqrt(sx * sx + sy * sy + sz * sz) as my, sz / sqrt(sx * sx + sy * sy + sz * sz) as mz, n / sum(n) over () as w from u{i})")
    return f"with {', '.join(parts)}"


def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), spheres.unit(F.col("embedding")).alias("v"))


@query("von_mises_mixture", f"{_rounds()} select k, round(w, 6) as w, case when k > 0 then round(mx, 6) end as x, case when k > 0 then round(my, 6) end as y, case when k > 0 then round(mz, 6) end as z from p{ROUNDS}")
def von_mises_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = spheres.fit(directions(spark, sf_dir), "v", KAPPA, STARTS, null_class=True, rounds=ROUNDS, least=ROUNDS)
    rows = [(k, round(w, 6), *([round(x, 6) for x in model.means[k - 1]] if k else [None] * 3)) for k, w in enumerate(model.weights)]
    return spark.createDataFrame(rows, "k long, w double, x double, y double, z double")


@query("von_mises_shares", f"{_rounds()} select id, round(max(r) filter (k = 0), 7) as share0, round(max(r) filter (k = 1), 7) as share1, round(max(r) filter (k = 2), 7) as share2, round(sum(l), 7) as density from s{ROUNDS} group by 1")
def von_mises_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = directions(spark, sf_dir)
    model, _ = spheres.fit(d, "v", KAPPA, STARTS, null_class=True, rounds=ROUNDS, least=ROUNDS)
    made = spheres.shares(d, "v", model)
    return made.select("id", *[F.round(F.col("shares")[k], 7).alias(f"share{k}") for k in range(3)], F.round("density", 7).alias("density"))
