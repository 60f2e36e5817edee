"""Queries: two-level models with a design over the customers of each nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mixed
from ..sources.tables import table
from .registry import query
from .sampling import rounded

#: Balances with the variance that each is known with, and two groups of customers.
DATA = "d as (select c_nationkey as unit, c_acctbal / 7000::double as y, 1.0 + c_custkey % 5 as v, (c_custkey % 2)::double as g from customer), c as (select unit, count(*) as n, sum(g) as s from d group by 1)"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_nationkey").alias("unit"), (F.col("c_acctbal") / 7000).alias("y"), (1.0 + F.col("c_custkey") % 5).alias("v"), (F.col("c_custkey") % 2).cast("double").alias("g"), F.lit(1.0).alias("a"))


def _solution(group: bool, z: str) -> str:
    """Least squares of z on a constant, and the group where it is in the model."""
    if not group:
        return f"avg({z}) as p, 0.0 as q"
    det = "nullif(any_value(n) * any_value(s) - any_value(s) ** 2, 0)"
    return f"(any_value(s) * sum({z}) - any_value(s) * sum(g * {z})) / {det} as p, (any_value(n) * sum(g * {z}) - any_value(s) * sum({z})) / {det} as q"


def _em(tag: str, group: bool, rounds: int, flat: bool) -> str:
    """CTEs {tag}b0, {tag}s0, ...: coefficients and variance of each unit after each round, written out from the definitions."""
    first = f"{tag}b0 as (select unit, {_solution(group, 'y')} from d join c using (unit) group by unit), {tag}s0 as (select unit, any_value(p) as p, any_value(q) as q, sum((y - p - q * g) ** 2) / count(*) {'+ avg(v)' if flat else ''} as s2 from d join {tag}b0 using (unit) group by unit)"
    parts = [first]
    for k in range(1, rounds if flat else rounds + 1):
        z = f"{tag}z{k} as (select unit, g, (s2 * y + v * (p + q * g)) / (s2 + v) as z, s2 * v / (s2 + v) as vz from d join {tag}s{k - 1} using (unit))"
        parts += [z, f"{tag}b{k} as (select unit, {_solution(group, 'z')} from {tag}z{k} join c using (unit) group by unit)"]
        parts.append(f"{tag}s{k} as (select unit, any_value(p) as p, any_value(q) as q, avg((z - p - q * g) ** 2) + avg(vz) as s2 from {tag}z{k} join {tag}b{k} using (unit) group by unit)")
    last = f"{tag}s{rounds - 1 if flat else rounds}"
    parts.append(f"{tag}l as (select unit, any_value(p) as p, any_value(q) as q, any_value(s2) as s2, -sum(ln(s2 + v) + (y - p - q * g) ** 2 / (s2 + v)) / 2 as ll from d join {last} using (unit) group by unit)")
    return ", ".join(parts)


BOTH = f"with {DATA}, {_em('f', True, 5, False)}, {_em('n', False, 5, False)}"
FLAT = f"with {DATA}, {_em('f', True, 2, True)}, {_em('n', False, 2, True)}"
#: The model of the mean alone has no model of the group to be compared with, but of 0.
ZERO = ", ".join([f"o{k} as (select unit, avg(z * z) + avg(vz) as s2 from (select unit, s2 * y / (s2 + v) as z, s2 * v / (s2 + v) as vz from d join o{k - 1} using (unit)) group by 1)" for k in range(1, 6)])
ONE = f"with {DATA}, {_em('n', False, 5, False)}, o0 as (select unit, avg(y * y) as s2 from d group by 1), {ZERO}, ol as (select unit, -sum(ln(s2 + v) + y * y / (s2 + v)) / 2 as ll from d join o5 using (unit) group by unit)"


@query("mfx_two_sample", f"{BOTH} select f.unit, round(f.q, 6) as effect, round(f.s2, 6) as s2, case when f.ll is not null then round(greatest(0, 2 * (f.ll - n.ll)), 6) end as f, round(sign(f.q) * sqrt(greatest(0, 2 * (f.ll - n.ll))), 5) as t from fl f join nl n using (unit)")
def mfx_two_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(mixed.two_sample(customers(spark, sf_dir), ["unit"], "g", "y", "v"), "effect", "s2", "f", places=6), "t", places=5)


@query("mfx_one_sample", f"{ONE} select n.unit, round(n.p, 6) as effect, round(n.s2, 6) as s2, round(greatest(0, 2 * (n.ll - o.ll)), 6) as f, round(sign(n.p) * sqrt(greatest(0, 2 * (n.ll - o.ll))), 5) as t from nl n join ol o using (unit)")
def mfx_one_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(mixed.one_sample(customers(spark, sf_dir), ["unit"], "y", "v"), "effect", "s2", "f", places=6), "t", places=5)


@query("mfx_model", f"{BOTH} select unit, round(p, 6) as b0, round(q, 6) as b1, round(s2, 6) as s2, round(ll, 5) as ll from fl")
def mfx_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixed.two_level(customers(spark, sf_dir), ["unit"], ["a", "g"], "y", "v")
    return rounded(rounded(made.select("unit", F.col("beta0")[0].alias("b0"), F.col("beta0")[1].alias("b1"), F.col("s20").alias("s2"), F.col("ll0").alias("ll")), "b0", "b1", "s2", places=6), "ll", places=5)


@query("two_level_em", f"{FLAT} select unit, round(p, 6) as b0, round(q, 6) as b1, round(s2, 6) as s2 from fl")
def two_level_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixed.two_level(customers(spark, sf_dir), ["unit"], ["a", "g"], "y", "v", rounds=2, flat=True)
    return rounded(made.select("unit", F.col("beta0")[0].alias("b0"), F.col("beta0")[1].alias("b1"), F.col("s20").alias("s2")), "b0", "b1", "s2", places=6)


@query("two_level_lr", f"{FLAT} select unit, case when f.ll is not null then round(greatest(0, 2 * (f.ll - n.ll)), 6) end as lr from fl f join nl n using (unit)")
def two_level_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mixed.two_level_lr(customers(spark, sf_dir), ["unit"], ["a", "g"], "y", "v", [[0, 1]]), "lr", places=6)


@query("estimate_mean", f"with {DATA}, e as (select unit, sum(y / v) / sum(1 / v) as effect, sum(1 / v) as w, count(*) as n from d group by 1), f as (select unit, any_value(effect) as effect, sum((y - effect) ** 2 / v) / (any_value(n) - 1) as s, any_value(w) as w from d join e using (unit) group by 1) select unit, round(effect, 6) as effect, round(sqrt(s), 6) as scale, round(sqrt(s / w), 6) as sd, round(effect / sqrt(s / w), 5) as t from f")
def estimate_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixed.estimate_mean(customers(spark, sf_dir).withColumn("sd", F.sqrt("v")), ["unit"], "y", "sd")
    return rounded(rounded(made, "effect", "scale", "sd", places=6), "t", places=5)


_RATIO = ", ".join(
    f"m{k} as (select unit, sum(y / (a + s2)) / sum(1 / (a + s2)) as mu, sum(1 / (a + s2)) as w from r join r{k - 1} using (unit) group by 1), r{k} as (select unit, (any_value(s2) * (1 + sum(a / (a + s2)) - sum(a / (a + s2) ** 2) / any_value(w)) + any_value(s2) ** 2 * sum(((y - mu) / (a + s2)) ** 2)) / count(*) as s2 from r join r{k - 1} using (unit) join m{k} using (unit) group by 1)"
    for k in range(1, 11)
)


@query("estimate_varatio", f"with {DATA}, l as (select unit, 0.99 * min(v) as least, avg(v) as fixed from d group by 1), r as (select unit, y, v - least as a from d join l using (unit)), r0 as (select unit, var_samp(y) as s2 from d group by 1), {_RATIO} select unit, round(fixed, 6) as fixed, round(s2 - least, 6) as random, round((s2 - least) / fixed, 6) as ratio from r10 join l using (unit)")
def estimate_varatio(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixed.estimate_varatio(customers(spark, sf_dir).withColumn("sd", F.sqrt("v")), ["unit"], "y", "sd")
    return rounded(made, "fixed", "random", "ratio", places=6)
