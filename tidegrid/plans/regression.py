"""Queries: linear models, autoregression, contrasts and designs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import design
from ..operators import glm, ordered
from ..sources.tables import epoch_s, table
from .registry import query
from .sampling import rounded
from .trends import HOURLY, hourly


@query("ols_simple", "select l_returnflag as unit, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 2) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem group by 1")
def ols_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("unit"))
    y, x = "l_extendedprice", "l_quantity"
    return d.agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 2).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


def _two_predictors(weight: str) -> str:
    return f"""with m as (select l_returnflag as unit, sum({weight} * l_quantity) / sum({weight}) as a, sum({weight} * l_discount) / sum({weight}) as b, sum({weight} * l_extendedprice) / sum({weight}) as c from lineitem group by 1),
    s as (select unit, any_value(a) as a, any_value(b) as b, any_value(c) as c, sum({weight} * (l_quantity - a) * (l_quantity - a)) as aa, sum({weight} * (l_quantity - a) * (l_discount - b)) as ab, sum({weight} * (l_discount - b) * (l_discount - b)) as bb,
      sum({weight} * (l_quantity - a) * (l_extendedprice - c)) as ac, sum({weight} * (l_discount - b) * (l_extendedprice - c)) as bc from lineitem join m on l_returnflag = unit group by 1),
    r as (select *, (ac * bb - ab * bc) / (aa * bb - ab * ab) as p, (aa * bc - ab * ac) / (aa * bb - ab * ab) as q from s)
    select unit, round(p, 3) as b_l_quantity, round(q, 1) as b_l_discount, round(c - p * a - q * b, 1) as intercept from r"""


def _rounded_fit(df: DataFrame) -> DataFrame:
    return df.select(F.col("l_returnflag").alias("unit"), F.round("b_l_quantity", 3).alias("b_l_quantity"), F.round("b_l_discount", 1).alias("b_l_discount"), F.round("intercept", 1).alias("intercept"))


@query("ols_multi", _two_predictors("1"))
def ols_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_fit(glm.ols(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_quantity", "l_discount"], "l_extendedprice"))


@query("wls", _two_predictors("(1 + l_tax)"))
def wls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_fit(glm.ols(table(spark, sf_dir, "lineitem").withColumn("w", 1 + F.col("l_tax")), ["l_returnflag"], ["l_quantity", "l_discount"], "l_extendedprice", "w"))


USERS = "h as (select user_id as unit, cast(floor(epoch(ts) / 3600) as bigint) - 400000 as t, avg(value) as y from events group by 1, 2)"


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.floor(epoch_s("ts") / 3600).cast("long") - 400000
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("unit"), t.alias("t")).agg(F.avg("value").alias("y"))


@query("mass_univariate_ols", f"with {USERS} select unit, count(*) as n, round(regr_slope(y, t), 5) as slope from h group by 1 having count(*) > 2 and regr_sxx(y, t) > 0")
def mass_univariate_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glm.simple_ols(users(spark, sf_dir), ["unit"], "t", "y").where((F.col("n") > 2) & (F.col("sxx") > 0)).select("unit", "n", F.round("slope", 5).alias("slope"))


RESID = f"{HOURLY}, f as (select unit, regr_slope(y, t - 400000) as b, regr_intercept(y, t - 400000) as a from h group by 1), r as (select unit, t, y, y - a - b * (t - 400000) as r from h join f using (unit)), l as (select *, lag(r) over (partition by unit order by t) as p from r), c as (select unit, sum(r * p) / sum(r * r) as rho from l group by 1)"


def _resid(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly(spark, sf_dir).withColumn("x", F.col("t") - 400000)
    return glm.residuals(h, ["unit"], glm.ols(h, ["unit"], ["x"], "y"), ["x"], "y")


@query("ar1_coef", f"with {RESID} select unit, round(rho, 6) as rho from c")
def ar1_coef(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(glm.ar1(_resid(spark, sf_dir), ["unit"], "t", "resid"), "rho", places=6)


@query("ar1_bin", f"with {RESID} select unit, trunc(rho * 100) / 100 as bin from c")
def ar1_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glm.ar1(_resid(spark, sf_dir), ["unit"], "t", "resid").select("unit", glm.ar1_bin(F.col("rho")).alias("bin"))


@query("ar1_whiten", f"with {RESID} select unit, t, round(r - rho * coalesce(p, 0), 5) as white from l join c using (unit)")
def ar1_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _resid(spark, sf_dir)
    joined = r.join(glm.ar1(r, ["unit"], "t", "resid"), "unit")
    return ordered.whiten(joined, ["unit"], "t", "resid", "rho").select("unit", "t", F.round("white", 5).alias("white"))


@query(
    "yule_walker",
    f"""with {HOURLY}, c as (select unit, t, y - avg(y) over (partition by unit) as c from h), l as (select unit, c, lag(c) over w as c1, lag(c, 2) over w as c2 from c window w as (partition by unit order by t)),
    r as (select unit, sum(c * c) / count(*) as r0, sum(c * c1) / count(*) as r1, sum(c * c2) / count(*) as r2 from l group by 1)
    select unit, round(r1 * (r0 - r2) / (r0 * r0 - r1 * r1), 6) as rho1, round((r0 * r2 - r1 * r1) / (r0 * r0 - r1 * r1), 6) as rho2 from r""",
)
def yule_walker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(glm.yule_walker(hourly(spark, sf_dir), ["unit"], "t", "y", 2), "rho1", "rho2", places=6).drop("sigma2")


YEARS = """s as (select p_brand as unit, year(l_shipdate) as session, count(*) as n, regr_slope(l_extendedprice, l_quantity) as b, regr_sxx(l_extendedprice, l_quantity) as sxx, regr_syy(l_extendedprice, l_quantity) as syy from lineitem join part on l_partkey = p_partkey group by 1, 2 having count(*) > 3),
    c as (select unit, session, b as effect, greatest(syy - b * b * sxx, 0) / (n - 2) / sxx as variance, n - 2 as dof from s)"""


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, session, effect, variance, dof, t): slope of price on quantity by brand and year."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity", F.year("l_shipdate").alias("session"))
    joined = items.join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("unit")), F.col("l_partkey") == F.col("p_partkey"))
    fit = glm.simple_ols(joined, ["unit", "session"], "l_quantity", "l_extendedprice").where("n > 3")
    c = fit.select("unit", "session", F.col("slope").alias("effect"), (F.col("s2") / F.col("sxx")).alias("variance"), (F.col("n") - 2).alias("dof"))
    return c.withColumn("t", glm.t_contrast(F.col("effect"), F.col("variance")))


@query("t_contrast", f"with {YEARS} select unit, session, round(effect / sqrt(variance), 4) as t from c")
def t_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(yearly(spark, sf_dir), "t").select("unit", "session", "t")


@query("fixed_effects", f"with {YEARS} select unit, round(sum(effect), 3) as effect, cast(sum(dof) as bigint) as dof, round(sum(effect) / sqrt(sum(variance)), 4) as t from c group by 1")
def fixed_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(glm.fixed_effects(yearly(spark, sf_dir), ["unit"]), "effect", places=3), "t").select("unit", "effect", "dof", "t")


@query("tmin_conjunction", f"with {YEARS} select unit, round(min(effect / sqrt(variance)), 4) as t_min from c group by 1")
def tmin_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yearly(spark, sf_dir).groupBy("unit").agg(F.round(F.min("t"), 4).alias("t_min"))


@query("conjunction_k", f"with {YEARS}, k as (select unit, effect / sqrt(variance) as t, row_number() over (partition by unit order by effect / sqrt(variance)) as k from c) select unit, round(sum(t), 4) as conjunction from k where k <= 3 group by 1")
def conjunction_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(glm.conjunction(yearly(spark, sf_dir), ["unit"], "t", 3), "conjunction")


def _columns(df: DataFrame, key: str, cols: list, prefix: str, places: int = 8) -> DataFrame:
    return df.select(key, *[F.round(c.cast("double"), places).alias(f"{prefix}{k}") for k, c in enumerate(cols, 1)])


N = 64


@query("cosine_drift", f"select cast(i as int) as scan, {', '.join(f'round(sqrt(2.0 / {N}) * cos(pi() / {N} * (i + 0.5) * {k}), 8) as drift{k}' for k in range(1, 4))}, 1.0::double as drift4 from range({N}) t(i)")
def cosine_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _columns(design.frames(spark, N), "scan", design.cosine_drift(F.col("scan"), N, 4), "drift")


@query("dct_basis", f"select cast(i as int) as scan, {', '.join(f'round(sqrt({1 if k == 0 else 2}.0 / {N}) * cos(pi() / {N} * (i + 0.5) * {k}), 8) as dct{k + 1}' for k in range(5))} from range({N}) t(i)")
def dct_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _columns(design.frames(spark, N), "scan", design.dct_basis(F.col("scan"), N, 5, normed=True), "dct")


@query("poly_drift", f"select cast(i as int) as scan, {', '.join(f'round(pow(i / {N - 1}.0::double, {k}), 8) as poly{k}' for k in range(1, 4))}, 1.0::double as poly4 from range({N}) t(i)")
def poly_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _columns(design.frames(spark, N), "scan", design.poly_drift(F.col("frametime"), N - 1.0, 3), "poly")


@query("fourier_basis", f"select cast(i as int) as scan, round(cos(2 * pi() * 0.05 * i), 8) as wave1, round(sin(2 * pi() * 0.05 * i), 8) as wave2, round(cos(2 * pi() * 0.1 * i), 8) as wave3, round(sin(2 * pi() * 0.1 * i), 8) as wave4 from range({N}) t(i)")
def fourier_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _columns(design.frames(spark, N), "scan", design.fourier_basis(F.col("frametime"), [0.05, 0.1]), "wave")


@query("spline_basis", f"select cast(i as int) as scan, 1.0::double as spline1, i::double as spline2, pow(i, 2)::double as spline3, pow(i, 3)::double as spline4, case when i > 20 then pow(i - 20, 3) else 0 end::double as spline5, case when i > 40 then pow(i - 40, 3) else 0 end::double as spline6 from range({N}) t(i)")
def spline_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _columns(design.frames(spark, N), "scan", design.natural_spline(F.col("frametime"), [20.0, 40.0]), "spline")


#: The rank of slice i of n = 11 in each order, as SQL.
SLICE_SQL = {
    "01234": "i",
    "43210": "10 - i",
    "02413": "case when i % 2 = 1 then i // 2 + 6 else i // 2 end",
    "13024": "case when i % 2 = 1 then i // 2 else i // 2 + 5 end",
    "42031": "case when (10 - i) % 2 = 1 then (10 - i) // 2 + 6 else (10 - i) // 2 end",
    "odd0_even1": "case when i % 2 = 1 then i // 2 + 6 else i // 2 end",
    "03142": "case when i < 6 then 2 * i else 2 * (i - 6) + 1 end",
    "41302": "case when 10 - i < 6 then 2 * (10 - i) else 2 * (10 - i - 6) + 1 end",
}


def _slice_query(order: str):
    @query(f"slice_times_{order}", f"select cast(i as int) as slice, round(({SLICE_SQL[order]}) * 2.0 / 11, 8) as t from range(11) t(i)")
    def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
        return design.frames(spark, 11).select(F.col("scan").alias("slice"), F.round(design.slice_time(order, F.col("scan"), 11, 2.0), 8).alias("t"))

    return slices


for _order in design.SLICE_ORDERS:
    _slice_query(_order)

FLAGS, STATES = ["A", "N", "R"], ["F", "O"]


def _factor_sql(cols: list[str], names: list[str]) -> str:
    return "select " + ", ".join(f"cast(sum({c}) as bigint) as {n}" for c, n in zip(cols, names)) + ", l_linenumber as line from lineitem group by l_linenumber"


def _ind(col: str, v: str) -> str:
    return f"(case when {col} = '{v}' then 1 else 0 end)"


def _summed(spark: SparkSession, sf_dir: str, cols: list, names: list[str]) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("line")).agg(*[F.sum(c).alias(n) for c, n in zip(cols, names)])


@query("factor_indicator", _factor_sql([_ind("l_returnflag", v) for v in FLAGS], FLAGS))
def factor_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(spark, sf_dir, design.factor(F.col("l_returnflag"), FLAGS), FLAGS)


PAIRS = [a + b for a in FLAGS for b in STATES]


@query("factor_interaction", _factor_sql([f"{_ind('l_returnflag', a)} * {_ind('l_linestatus', b)}" for a in FLAGS for b in STATES], PAIRS))
def factor_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(spark, sf_dir, design.interaction(design.factor(F.col("l_returnflag"), FLAGS), design.factor(F.col("l_linestatus"), STATES)), PAIRS)


@query("main_effect", _factor_sql([f"{_ind('l_returnflag', v)} - {_ind('l_returnflag', 'R')}" for v in FLAGS[:2]], ["A_R", "N_R"]))
def main_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(spark, sf_dir, design.main_effect(design.factor(F.col("l_returnflag"), FLAGS)), ["A_R", "N_R"])


@query("percent_signal_change", "with m as (select l_returnflag as unit, avg(l_extendedprice) as m from lineitem group by 1) select l_orderkey, l_linenumber, round(100 * (l_extendedprice / m - 1), 6) as change from lineitem join m on l_returnflag = unit")
def percent_signal_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    means = items.groupBy("l_returnflag").agg(F.avg("l_extendedprice").alias("m"))
    return items.join(means, "l_returnflag").select("l_orderkey", "l_linenumber", F.round(design.percent_change(F.col("l_extendedprice"), F.col("m")), 6).alias("change"))


def _gamma(t: str, shape: float) -> str:
    return f"(case when {t} > 0 then exp({shape - 1} * ln({t}) - {t} - {math.lgamma(shape)!r}) else 0 end)"


@query("gamma_difference_hrf", f"with g as (select cast(i as int) as scan, {_gamma('(i / 8.0::double)', 6.0)} - 0.167 * {_gamma('(i / 8.0::double)', 16.0)} as h from range(256) t(i)) select scan, round(h / (select sum(h) from g), 8) as h from g")
def gamma_difference_hrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = design.frames(spark, 256, 0.125).select("scan", design.gamma_difference_hrf(F.col("frametime"), 0.0).alias("h"))
    return g.join(F.broadcast(g.agg(F.sum("h").alias("all")))).select("scan", F.round(F.col("h") / F.col("all"), 8).alias("h"))
