"""Queries: contrasts, regression results, autoregressive refits, tails and false discovery rates of normal scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tails
from ..functions.fields import box_volumes, ec_density, expected_ec
from ..operators import models, ordered
from ..sources.tables import table
from .registry import query
from .sampling import rounded
from .trends import HOURLY, hourly

#: Price on a constant, quantity and discount by flag: sums, the determinant's minors over it, coefficients.
FIT = """d as (select l_returnflag as unit, 1.0::double as a, l_quantity / 10 as b, l_discount * 10 as c, l_extendedprice / 1000 as y from lineitem),
    s as (select unit, count(*) as n, sum(a) as aa, sum(b) as ab, sum(c) as ac, sum(b * b) as bb, sum(b * c) as bc, sum(c * c) as cc, sum(y) as ay, sum(b * y) as by_, sum(c * y) as cy, sum(y * y) as yy from d group by 1),
    k as (select *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) as det from s),
    i as (select *, (bb * cc - bc * bc) / det as v11, (ac * bc - ab * cc) / det as v12, (ab * bc - ac * bb) / det as v13, (aa * cc - ac * ac) / det as v22, (ab * ac - aa * bc) / det as v23, (aa * bb - ab * ab) / det as v33 from k),
    f as (select *, v11 * ay + v12 * by_ + v13 * cy as b1, v12 * ay + v22 * by_ + v23 * cy as b2, v13 * ay + v23 * by_ + v33 * cy as b3 from i),
    g as (select *, yy - b1 * ay - b2 * by_ - b3 * cy as sse, yy - ay * ay / n as sst from f)"""
XS = ["a", "b", "c"]
#: The tail of a density beyond t by Simpson's rule over 2,000 steps.
SIMPSON = "(select sum((case when k in (0, 2000) then 1 when k % 2 = 1 then 4 else 2 end) * {f}) * ({t}) / 2000 / 3 from range(2001) r(k))"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("unit"), F.lit(1.0).alias("a"), (F.col("l_quantity") / 10).alias("b"), (F.col("l_discount") * 10).alias("c"), (F.col("l_extendedprice") / 1000).alias("y"))


def fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.fit(rows(spark, sf_dir), ["unit"], XS, "y")


@query("contrast_t", f"with {FIT} select unit, round(b2 - b3, 6) as effect, round(sqrt((v22 + v33 - 2 * v23) * sse / (n - 3)), 6) as sd, round((b2 - b3) / sqrt((v22 + v33 - 2 * v23) * sse / (n - 3)), 3) as t from g")
def contrast_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(models.t_contrast(fits(spark, sf_dir), ["unit"], [0, 1, -1]), "effect", "sd", places=6), "t", places=3).select("unit", "effect", "sd", "t")


@query("contrast_f", f"with {FIT}, w as (select *, v22 * v33 - v23 * v23 as dd from g) select unit, round((b2 * b2 * v33 - 2 * b2 * b3 * v23 + b3 * b3 * v22) / dd / 2 / (sse / (n - 3)), 2) as f, 2 as dfn, n - 3 as dfd from w")
def contrast_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.f_contrast(fits(spark, sf_dir), ["unit"], [[0, 1, 0], [0, 0, 1]]), "f", places=2).drop("p")


@query("contrast_tmin", f"with {FIT} select unit, round(least(b2 / sqrt(v22 * sse / (n - 3)), b3 / sqrt(v33 * sse / (n - 3))), 4) as tmin from g")
def contrast_tmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.tmin_contrast(fits(spark, sf_dir), ["unit"], [[0, 1, 0], [0, 0, 1]]), "tmin")


@query(
    "regression_results",
    f"with {FIT}, l as (select *, -n / 2 * (ln(2 * pi()) + ln(sse / n) + 1) as ll from g) select unit, round(1 - sse / sst, 8) as r2, round(1 - sse / (n - 3) / (sst / (n - 1)), 8) as r2_adj, round((sst - sse) / 2 / (sse / (n - 3)), 2) as f_overall, round(ll, 3) as log_likelihood, round(-2 * ll + 6, 3) as aic, round(-2 * ll + 3 * ln(n), 3) as bic, round(sse / (n - 3), 6) as mse, round((sst - sse) / 2, 4) as msr, round(sst / (n - 1), 6) as mst from l",
)
def regression_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = models.results(fits(spark, sf_dir), ["unit"], 3)
    r = rounded(rounded(rounded(r, "r2", "r2_adj", places=8), "log_likelihood", "aic", "bic", places=3), "mse", "mst", places=6)
    return rounded(rounded(r, "f_overall", places=2), "msr").select("unit", "r2", "r2_adj", "f_overall", "log_likelihood", "aic", "bic", "mse", "msr", "mst")


@query("coefficient_covariance", f"with {FIT} select unit, round(v11 * sse / (n - 3), 8) as c11, round(v12 * sse / (n - 3), 8) as c12, round(v23 * sse / (n - 3), 8) as c23, round(v33 * sse / (n - 3), 8) as c33 from g")
def coefficient_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda i, j: F.round(F.col("cov")[i][j] * models.dispersion(3), 8)
    return fits(spark, sf_dir).select("unit", c(0, 0).alias("c11"), c(0, 1).alias("c12"), c(1, 2).alias("c23"), c(2, 2).alias("c33"))


@query("confidence_intervals", f"with {FIT} select unit, round(b2 - 1.96 * sqrt(v22 * sse / (n - 3)), 6) as low, round(b2 + 1.96 * sqrt(v22 * sse / (n - 3)), 6) as high from g")
def confidence_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.conf_int(fits(spark, sf_dir), ["unit"], 1, 3, 1.96), "low", "high", places=6)


@query("residual_sums", f"with {FIT} select d.unit, round(sum(abs(y - b1 * a - b2 * b - b3 * c)), 3) as resid, round(sum(b1 * a + b2 * b + b3 * c), 3) as predicted from d join g on d.unit = g.unit group by 1")
def residual_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = models.residual_rows(rows(spark, sf_dir), ["unit"], fits(spark, sf_dir), XS, "y")
    return r.groupBy("unit").agg(F.round(F.sum(F.abs("resid")), 3).alias("resid"), F.round(F.sum("predicted"), 3).alias("predicted"))


@query(
    "ar1_refit",
    f"""with {HOURLY}, x as (select unit, t, 1.0::double as a, (t - 400000) / 10000 as b, y from h), f0 as (select unit, regr_slope(y, b) as q, regr_intercept(y, b) as p from x group by 1), r as (select x.*, y - p - q * b as r from x join f0 using (unit)),
    l as (select *, lag(r) over w as rp, lag(a) over w as ap, lag(b) over w as bp, lag(y) over w as yp from r window w as (partition by unit order by t)), c as (select unit, trunc(sum(r * rp) / sum(r * r) * 100) / 100 as bin from l group by 1),
    w as (select unit, bin, a - bin * coalesce(ap, 0) as a, b - bin * coalesce(bp, 0) as b, y - bin * coalesce(yp, 0) as y from l join c using (unit)), s as (select unit, any_value(bin) as bin, sum(a * a) as aa, sum(a * b) as ab, sum(b * b) as bb, sum(a * y) as ay, sum(b * y) as by_ from w group by 1)
    select unit, bin, round((bb * ay - ab * by_) / (aa * bb - ab * ab), 4) as intercept, round((aa * by_ - ab * ay) / (aa * bb - ab * ab), 4) as slope from s""",
)
def ar1_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly(spark, sf_dir).select("unit", "t", F.lit(1.0).alias("a"), ((F.col("t") - 400000) / 10000).alias("b"), "y")
    return models.ar1_refit(h, ["unit"], "t", ["a", "b"], "y").select("unit", "bin", F.round(F.col("beta")[0], 4).alias("intercept"), F.round(F.col("beta")[1], 4).alias("slope"))


def _em_sql(rounds: int = 5) -> str:
    parts = ["c as (select c_nationkey as unit, c_acctbal / 1000 as y, (1 + c_custkey % 5)::double as v from customer)", "a0 as (select unit, avg(y) as m, var_pop(y) as s from c group by 1)", "n0 as (select unit, 0.0::double as m, avg(y * y) as s from c group by 1)"]
    for r in range(1, rounds + 1):
        parts.append(f"a{r} as (select unit, avg((v * m + s * y) / (s + v)) as m, avg(pow((v * m + s * y) / (s + v), 2) + s * v / (s + v)) - pow(avg((v * m + s * y) / (s + v)), 2) as s from c join a{r - 1} using (unit) group by 1)")
        parts.append(f"n{r} as (select unit, 0.0::double as m, avg(pow(s * y / (s + v), 2) + s * v / (s + v)) as s from c join n{r - 1} using (unit) group by 1)")
    nll = "(select unit, sum(ln(s + v) + pow(y - m, 2) / (s + v)) / 2 as l, any_value(m) as m from c join {t} using (unit) group by 1)"
    return f"with {', '.join(parts)} select f.unit, round(sign(f.m) * sqrt(greatest(0, 2 * (n.l - f.l))), 5) as lr from {nll.format(t=f'a{rounds}')} f join {nll.format(t=f'n{rounds}')} n on f.unit = n.unit"


@query("gaussian_mfx_lr", _em_sql())
def gaussian_mfx_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("unit"), (F.col("c_acctbal") / 1000).alias("y"), (1 + F.col("c_custkey") % 5).cast("double").alias("v"))
    return rounded(models.gaussian_mfx_lr(c, ["unit"], "y", "v"), "lr", places=5)


#: Normal scores of the parts, and their tails by Simpson's rule.
Z = f"z as (select p_partkey as id, (p_retailprice - 1400) / 300 as z from part), q as (select id, z, 0.5 - {SIMPSON.format(f='exp(-pow(k * z / 2000, 2) / 2) / sqrt(2 * pi())', t='z')} as p from z)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_retailprice") - 1400) / 300).alias("z"))


@query("normal_tail", f"with {Z} select id, round(p, 8) as p from q")
def normal_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("id", F.round(tails.norm_sf(F.col("z")), 8).alias("p"))


@query("z_score", f"with {Z} select id, round(z, 6) as z from q")
def z_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From z to its tail and back."""
    return scores(spark, sf_dir).select("id", F.round(tails.z_score(tails.norm_sf(F.col("z"))), 6).alias("z"))


@query("student_tail", f"with t as (select p_partkey as id, (p_retailprice - 1400) / 300 as t, 2 + p_size % 7 as n from part) select id, round(0.5 - exp(lgamma((n + 1) / 2.0) - lgamma(n / 2.0)) / sqrt(n * pi()) * {SIMPSON.format(f='pow(1 + pow(k * t / 2000, 2) / n, -(n + 1) / 2.0)', t='t')}, 8) as p from t")
def student_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_retailprice") - 1400) / 300).alias("t"), (2 + F.col("p_size") % 7).alias("n"))
    return t.select("id", F.round(tails.t_sf(F.col("t"), F.col("n")), 8).alias("p"))


@query("f_tail", "select p_partkey as id, round(pow(1 + 2 * x / d, -d / 2.0), 8) as p from (select p_partkey, p_retailprice / 500 as x, 3 + p_size % 9 as d from part)")
def f_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With two numerator degrees of freedom the tail has a closed form."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.round(tails.f_sf(F.col("p_retailprice") / 500, F.lit(2), 3 + F.col("p_size") % 9), 8).alias("p"))


@query("gaussian_fdr", f"with {Z}, r as (select id, p, row_number() over (order by p, id) as k, count(*) over () as n from q) select id, round(min(least(1, n * p / k)) over (order by k rows between current row and unbounded following), 7) as q from r")
def gaussian_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scores(spark, sf_dir).select("id", tails.norm_sf(F.col("z")).alias("p"))
    return ordered.bh_fdr(p, [], "p", ["id"]).select("id", F.round("q", 7).alias("q"))


@query("gaussian_fdr_threshold", f"with {Z}, r as (select p, row_number() over (order by p) as k, count(*) over () as n from q) select round(coalesce(max(p) filter (p < 0.4 * k / n), 0.4 / max(n)), 7) as threshold from r")
def gaussian_fdr_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scores(spark, sf_dir).select(tails.norm_sf(F.col("z")).alias("p"))
    return rounded(ordered.fdr_threshold(p, [], "p", 0.4), "threshold", places=7)


@query("chi2_tail", "select p_partkey as id, round(exp(-x / 2) * (1 + x / 2 + x * x / 8), 10) as p from (select p_partkey, p_retailprice / 200 as x from part)")
def chi2_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(tails.chi2_sf_even(F.col("p_retailprice") / 200, 6), 10).alias("p"))


#: Euler characteristic densities of a Gaussian field in dimensions 0 to 3, at full width at half maximum 1.
@query("ec_densities_gaussian", f"with {Z}, c as (select id, z, p, exp(-z * z / 2) as e, 4 * ln(2) as l from q) select id, round(p, 8) as d0, round(sqrt(l) / (2 * pi()) * e, 8) as d1, round(l / pow(2 * pi(), 1.5) * z * e, 8) as d2, round(pow(l, 1.5) / pow(2 * pi(), 2) * (z * z - 1) * e, 8) as d3 from c")
def ec_densities_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("id", *[F.round(ec_density(F.col("z"), k), 8).alias(f"d{k}") for k in range(4)])


@query("ec_p_value", f"with {Z}, c as (select id, z, p, exp(-z * z / 2) as e, 4 * ln(2) as l from q) select id, round(1.0 * p + 6.0 * sqrt(l) / (2 * pi()) * e + 12.0 * l / pow(2 * pi(), 1.5) * z * e + 8.0 * pow(l, 1.5) / pow(2 * pi(), 2) * (z * z - 1) * e, 7) as p from c")
def ec_p_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected Euler characteristic over a box of 2 x 2 x 2 resels."""
    return scores(spark, sf_dir).select("id", F.round(expected_ec(F.col("z"), box_volumes([2.0, 2.0, 2.0])), 7).alias("p"))

