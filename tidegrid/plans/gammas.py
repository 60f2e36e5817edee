"""Queries: normal and gamma tails of the customers' balances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gammas
from ..sources.tables import table
from .registry import query

ROUNDS, NEWTON = 3, 6


def _digamma(c: str) -> str:
    """Steps up to c + 10, then the series."""
    return f"(ln({c} + 10) - 0.5 / ({c} + 10) - 1 / (12 * ({c} + 10) ** 2) + 1 / (120 * ({c} + 10) ** 4) - 1 / (252 * ({c} + 10) ** 6) - {' - '.join(f'1 / ({c} + {k})' for k in range(10))})"


def _trigamma(c: str) -> str:
    return f"(1 / ({c} + 10) + 1 / (2 * ({c} + 10) ** 2) + 1 / (6 * ({c} + 10) ** 3) - 1 / (30 * ({c} + 10) ** 5) + 1 / (42 * ({c} + 10) ** 7) + {' + '.join(f'1 / ({c} + {k}) ** 2' for k in range(10))})"


def _round(r: int) -> list[str]:
    """Densities under the parameters m{r}, their sums, the shapes by Newton's steps, and m{r + 1}."""
    tail = lambda s, x, w: f"case when {x} > 0 then {w} * exp(-a{s} * ln(b{s}) - lgamma(a{s}) + (a{s} - 1) * ln({x}) - {x} / b{s}) else 0 end"
    parts = [
        f"d{r} as (select x, mu, {tail('n', '-x', 'w0')} as zn, w1 * exp(-((x - mu) ** 2) / (2 * va)) / sqrt(2 * pi() * va) as zg, {tail('p', 'x', 'w2')} as zp from v, m{r})",
        f"e{r} as (select x, zn / (zn + zg + zp) as zn, zg / (zn + zg + zp) as zg, zp / (zn + zg + zp) as zp from d{r})",
        f"""s{r} as (select sum(zg * x) / sum(zg) as mu, sum(zg * x * x) / sum(zg) - (sum(zg * x) / sum(zg)) ** 2 as va, avg(zn) as w0, avg(zg) as w1, avg(zp) as w2, sum(zn * -x) / sum(zn) as xn, sum(zp * x) / sum(zp) as xp,
        ln(xn) - sum(zn * ln(-x)) filter (x < 0) / sum(zn) as gn, ln(xp) - sum(zp * ln(x)) filter (x > 0) / sum(zp) as gp from e{r})""",
        f"c{r}_0 as (select *, {', '.join(f'(3 - g{s} + sqrt((g{s} - 3) ** 2 + 24 * g{s})) / (12 * g{s}) as a{s}' for s in 'np')} from s{r})",
    ]
    for k in range(NEWTON):
        step = ", ".join(f"a{s} - (ln(a{s}) - {_digamma(f'a{s}')} - g{s}) / (1 / a{s} - {_trigamma(f'a{s}')}) as a{s}" for s in "np")
        parts.append(f"c{r}_{k + 1} as (select * exclude (an, ap), {step} from c{r}_{k})")
    return parts + [f"m{r + 1} as (select mu, va, an, xn / an as bn, ap, xp / ap as bp, w0, w1, w2 from c{r}_{NEWTON})"]


FIT = f"""v as (select c_custkey as id, c_acctbal / 1000 - 4 as x from customer where c_acctbal <> 4000), m0 as (select avg(x) as mu, var_pop(x) as va, pow(avg(-x) filter (x < 0), 2) / var_pop(x) filter (x < 0) as an, var_pop(x) filter (x < 0) / avg(-x) filter (x < 0) as bn,
    pow(avg(x) filter (x > 0), 2) / var_pop(x) filter (x > 0) as ap, var_pop(x) filter (x > 0) / avg(x) filter (x > 0) as bp, 1.0::double / 3 as w0, 1.0::double / 3 as w1, 1.0::double / 3 as w2 from v), {", ".join(p for r in range(ROUNDS) for p in _round(r))}"""  # fmt: skip
LAST = f"m{ROUNDS}"


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances in thousands over 4,000; those at it, a zero, have no logarithm in the SQL."""
    return table(spark, sf_dir, "customer").where("c_acctbal <> 4000").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000 - 4).alias("x"))


def tails(spark: SparkSession, sf_dir: str) -> gammas.Tailed:
    return gammas.fit(balances(spark, sf_dir), "x", rounds=ROUNDS, tolerance=float("-inf"))[0]


@query("gamma_tails", f"with {FIT} select round(mu, 5) as mean, round(va, 5) as var, round(an, 4) as shape_n, round(bn, 5) as scale_n, round(ap, 4) as shape_p, round(bp, 5) as scale_p, round(w0, 6) as w0, round(w1, 6) as w1, round(w2, 6) as w2 from {LAST}")
def gamma_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tails(spark, sf_dir)
    row = (round(m.mean, 5), round(m.var, 5), round(m.negative.shape, 4), round(m.negative.scale, 5), round(m.positive.shape, 4), round(m.positive.scale, 5), *[round(w, 6) for w in m.weights])
    return spark.createDataFrame([row], "mean double, var double, shape_n double, scale_n double, shape_p double, scale_p double, w0 double, w1 double, w2 double")


@query("gamma_posterior", f"with {FIT}, {_round(ROUNDS)[0].replace('select x,', 'select id, x,')} select id, round(zn / (zn + zg + zp), 6) as negative, round(zg / (zn + zg + zp), 6) as normal, round(zp / (zn + zg + zp), 6) as positive from d{ROUNDS}")
def gamma_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = gammas.posterior(balances(spark, sf_dir), "x", tails(spark, sf_dir))
    return made.select("id", *[F.round(k, 6).alias(k) for k in ("negative", "normal", "positive")])
