"""Queries: empirical nulls of orders' mean prices, in four groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nulls
from ..sources.tables import table
from ..storage import stored
from .models import SIMPSON
from .registry import query
from .sampling import rounded

#: The middle of each unit's order, its histogram, the parabola through its logarithms, and the rates under the null.
NULL = f"""with d as (select l_orderkey % 4 as unit, l_orderkey as id, round(avg(l_extendedprice / 10000 + l_quantity / 10 + l_tax * 30), 9) as x from lineitem group by 1, 2), r as (select *, row_number() over (partition by unit order by x, id) - 1 as i, count(*) over (partition by unit) as n from d),
    c as (select * from r where i >= floor(n * 0.2::double) and i < floor(n * 0.8::double)), s as (select unit, count(*) as n, greatest(10, floor((max(x) - min(x)) / (3.5 * stddev_pop(x) / pow(count(*), 1.0::double / 3)))) as bins from d group by 1),
    g as (select unit, min(x) as lo, max(x) as hi, avg(x) as m from c group by 1), w as (select unit, s.n, lo, m, bins, (hi - lo) / bins as step from s join g using (unit)),
    h as (select unit, least(floor((x - lo) / step), bins - 1) as b, count(*) as k, any_value(lo) as lo, any_value(m) as m, any_value(step) as step from c join w using (unit) group by 1, 2),
    p as (select unit, lo + (b + 0.5) * step - m as t, ln(k) as y from h), a as (select unit, avg(t) as mt, avg(t * t) as mq, avg(y) as my from p group by 1),
    q as (select unit, any_value(mt) as mt, any_value(mq) as mq, any_value(my) as my, sum((t - mt) ** 2) as tt, sum((t * t - mq) ** 2) as qq, sum((t - mt) * (t * t - mq)) as tq, sum((t - mt) * (y - my)) as ty, sum((t * t - mq) * (y - my)) as qy from p join a using (unit) group by 1),
    b as (select unit, (qq * ty - tq * qy) / (tt * qq - tq * tq) as b1, (tt * qy - tq * ty) / (tt * qq - tq * tq) as b2, mt, mq, my from q), v as (select *, my - b1 * mt - b2 * mq as b0, greatest(-1 / (2 * b2), 1e-6) as v from b),
    e as (select v.unit, n, m + b1 * v as mu, sqrt(v) as sigma, least(1, exp(b0 - ln(step * n) + ln(2 * pi() * v) / 2 + (b1 * v) ** 2 / (2 * v))) as p0 from v join w using (unit)),
    z as (select d.unit, id, x, (x - mu) / sigma as z, p0, i, r.n from d join r using (unit, id, x) join e using (unit)), t as (select *, 0.5 - {SIMPSON.format(f='exp(-pow(k * z / 2000, 2) / 2) / sqrt(2 * pi())', t='z')} as sf from z),
    f as (select unit, id, x, max(least(1, p0 * sf * n / (n - i))) over (partition by unit order by i desc) as fdr from t)"""


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.col("l_extendedprice") / 10000 + F.col("l_quantity") / 10 + F.col("l_tax") * 30
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 4).alias("unit"), F.col("l_orderkey").alias("id")).agg(F.round(F.avg(each), 9).alias("x"))


@query("empirical_null", f"{NULL} select unit, n, round(mu, 6) as mu, round(sigma, 6) as sigma, round(p0, 6) as p0 from e")
def empirical_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nulls.learn(totals(spark, sf_dir), ["unit"], "x"), "mu", "sigma", "p0", places=6)


@query("empirical_fdr", f"{NULL} select unit, id, round(max(fdr) over (partition by unit, x), 5) as fdr from f")
def empirical_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = stored(nulls.fdr_curve(totals(spark, sf_dir), ["unit"], "x"), "null-curve")
    # equal totals, whose order is open, take the larger rate
    tied = curve.groupBy("unit", "x").agg(F.max("fdr").alias("fdr"))
    return rounded(curve.drop("fdr").join(tied, ["unit", "x"]).select("unit", "id", "fdr"), "fdr", places=5)


@query("empirical_fdr_threshold", f"{NULL} select unit, case when min(x) filter (fdr < 0.25) is null then 'infinity'::double else (max(x) filter (fdr >= 0.25) + min(x) filter (fdr < 0.25)) / 2 end as threshold from f group by 1")
def empirical_fdr_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = nulls.fdr_curve(totals(spark, sf_dir), ["unit"], "x")
    return nulls.threshold(curve, ["unit"], "x", 0.25)
