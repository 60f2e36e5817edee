"""Queries: one- and two-sample statistics, quantiles and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered, samples
from ..sources.tables import table
from .registry import query

BASE = 35000.0
#: Line prices by part brand.
PRICES = "p as (select p_brand as unit, l_extendedprice as x, l_orderkey as o, l_linenumber as l from lineitem join part on l_partkey = p_partkey)"


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_extendedprice").alias("x"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"))
    return items.join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("unit")), F.col("l_partkey") == F.col("p_partkey")).select("unit", "x", "o", "l")


def rounded(df: DataFrame, *names: str, places: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


@query("screen_moments", "select event_type as unit, user_id % 10 as bucket, count(value) as n, round(avg(value), 4) as mean, round(stddev_pop(value), 4) as std, min(value) as min, max(value) as max from events group by 1, 2")
def screen_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("unit"), (F.col("user_id") % 10).alias("bucket"), "value")
    return rounded(samples.moments(e, ["unit", "bucket"], "value"), "mean", "std")


@query("onesample_student", f"with {PRICES} select unit, round(sqrt(count(*) - 1) * (avg(x) - {BASE}) / stddev_pop(x), 4) as t from p group by 1")
def onesample_student(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(samples.student(prices(spark, sf_dir), ["unit"], "x", BASE), "t")


@query("onesample_sign", f"with {PRICES} select unit, round(avg(sign(x - {BASE})), 6) as sign from p group by 1")
def onesample_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(samples.sign_stat(prices(spark, sf_dir), ["unit"], "x", BASE), "sign", places=6)


@query(
    "onesample_laplace",
    f"""with {PRICES}, m as (select unit, median(x) as med from p group by 1),
    s as (select unit, any_value(med) as med, count(*) as n, avg(abs(x - med)) as s, avg(abs(x - {BASE})) as s0 from p join m using (unit) group by 1)
    select unit, round(sign(med - {BASE}) * sqrt(2 * n * ln(greatest(s0, s) / s)), 4) as laplace from s""",
)
def onesample_laplace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(samples.laplace(prices(spark, sf_dir), ["unit"], "x", BASE), "laplace")


@query(
    "onesample_tukey",
    f"""with {PRICES}, m as (select unit, median(x) as med from p group by 1),
    s as (select unit, any_value(med) as med, count(*) as n, median(abs(x - med)) as s, median(abs(x - {BASE})) as s0 from p join m using (unit) group by 1)
    select unit, round(sign(med - {BASE}) * sqrt(2 * n * ln(greatest(s0, s) / s)), 4) as tukey from s""",
)
def onesample_tukey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(samples.tukey(prices(spark, sf_dir), ["unit"], "x", BASE), "tukey")


@query(
    "onesample_wilcoxon",
    f"""with {PRICES}, r as (select unit, x, row_number() over (partition by unit order by abs(x - {BASE}), o, l) as k, count(*) over (partition by unit) as n from p)
    select unit, round(sum(k * sign(x - {BASE})) / max(n) / max(n), 6) as wilcoxon from r group by 1""",
)
def onesample_wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(samples.wilcoxon(prices(spark, sf_dir), ["unit"], "x", BASE, ["o", "l"]), "wilcoxon", places=6)


@query("onesample_grubb", f"with {PRICES}, m as (select unit, avg(x) as a, stddev_pop(x) as s from p group by 1) select unit, round(max(abs(x - a)) / any_value(s), 4) as grubb from p join m using (unit) group by 1")
def onesample_grubb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(samples.grubb(prices(spark, sf_dir), ["unit"], "x"), "grubb")


STATUS = "o as (select c_nationkey as unit, o_totalprice as x, o_orderstatus = 'F' as f from orders join customer on o_custkey = c_custkey where o_orderstatus in ('F', 'O'))"


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O")).select("o_custkey", F.col("o_totalprice").alias("x"), (F.col("o_orderstatus") == "F").alias("f"))
    return o.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("unit")), F.col("o_custkey") == F.col("c_custkey")).select("unit", "x", "f")


@query(
    "twosample_student",
    f"""with {STATUS}, s as (select unit, count(*) filter (f) as n1, count(*) filter (not f) as n2, avg(x) filter (f) as m1, avg(x) filter (not f) as m2, var_pop(x) filter (f) as v1, var_pop(x) filter (not f) as v2 from o group by 1)
    select unit, round((m1 - m2) / sqrt((n1 * v1 + n2 * v2) / (n1 + n2 - 2)), 6) as t from s""",
)
def twosample_student(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(samples.two_sample(statuses(spark, sf_dir), ["unit"], "x", F.col("f")), "t", places=6)


@query(
    "twosample_wilcoxon",
    f"with {STATUS}, n as (select unit, count(*) as n2 from o where not f group by 1) select a.unit, round(sum(sign(a.x - b.x)) / any_value(n2), 4) as wilcoxon from o a join o b on a.unit = b.unit and a.f and not b.f join n on n.unit = a.unit group by 1",
)
def twosample_wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(samples.two_sample_wilcoxon(statuses(spark, sf_dir), ["unit"], "x", F.col("f")), "wilcoxon")


@query(
    "weighted_mean",
    """with s as (select l_returnflag as unit, count(*) as n, sum(1 / pow(l_quantity, 2)) as sw, sum(l_extendedprice / pow(l_quantity, 2)) as swy, sum(pow(l_extendedprice / l_quantity, 2)) as swyy from lineitem group by 1)
    select unit, round(swy / sw, 4) as mean, round((swyy - swy * swy / sw) / (n - 1), 3) as scale, round(sqrt((swyy - swy * swy / sw) / (n - 1) / sw), 4) as sd from s""",
)
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = samples.weighted_mean(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "unit"), ["unit"], "l_extendedprice", "l_quantity")
    return rounded(rounded(made, "mean", "sd"), "scale", places=3).drop("t")


ROUND = "e{k} as (select unit, avg((v * m + s2 * y) / (s2 + v)) as m, avg(pow((v * m + s2 * y) / (s2 + v), 2) + s2 * v / (s2 + v)) - pow(avg((v * m + s2 * y) / (s2 + v)), 2) as s2 from c join e{j} using (unit) group by 1)"


@query(
    "mixed_effects_em5",
    "with c as (select c_nationkey as unit, c_acctbal as y, 1e6 * (1 + c_custkey % 5) as v from customer), e0 as (select unit, avg(y) as m, var_pop(y) as s2 from c group by 1), "
    + ", ".join(ROUND.format(k=k, j=k - 1) for k in range(1, 6))
    + " select unit, round(m, 3) as mean, round(s2, 0) as s2 from e5",
)
def mixed_effects_em5(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("unit"), F.col("c_acctbal").alias("y"), (F.lit(1e6) * (1 + F.col("c_custkey") % 5)).alias("v"))
    return rounded(rounded(samples.mixed_effects(c, ["unit"], "y", "v", 5), "mean", places=3), "s2", places=0)


@query("quantile_interp", "select p_brand as unit, round(quantile_cont(p_retailprice, 0.3), 4) as quantile from part group by 1")
def quantile_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ordered.quantile(table(spark, sf_dir, "part").withColumnRenamed("p_brand", "unit"), ["unit"], "p_retailprice", 0.3), "quantile")


@query("quantile_noninterp", "select p_brand as unit, coalesce(list_sort(list(p_retailprice))[cast(ceil(0.3 * count(*)) as bigint) + 1], 'inf'::double) as quantile from part group by 1")
def quantile_noninterp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.quantile(table(spark, sf_dir, "part").withColumnRenamed("p_brand", "unit"), ["unit"], "p_retailprice", 0.3, interpolate=False)


@query("mad", "with m as (select median(p_retailprice) as m from part) select round(median(abs(p_retailprice - m)) / 0.6745, 4) as mad from part, m")
def mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(samples.mad(table(spark, sf_dir, "part"), [], "p_retailprice"), "mad")


@query("ecdf", "select p_partkey, round((rank() over (order by p_retailprice) - 1) / count(*) over (), 8) as ecdf from part")
def ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ordered.ecdf(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), [], "p_retailprice"), "ecdf", places=8).select("p_partkey", "ecdf")


@query(
    "smoothed_hist",
    """with c as (select cast(least(63, greatest(0, floor((p_retailprice - 800) / (1400.0 / 64)))) as int) as bin, count(*) as n from part group by 1),
    s as (select t.i as bin, sum(n * exp(-pow(t.i - c.bin, 2) / 18.0)) as density from c join range(64) t(i) on abs(t.i - c.bin) <= 12 group by 1)
    select cast(s.bin as int) as bin, coalesce(n, 0) as count, round(density, 6) as density from s left join c on c.bin = s.bin""",
)
def smoothed_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(samples.smoothed_histogram(table(spark, sf_dir, "part"), "p_retailprice", 800.0, 2200.0, 64, 3.0), "density", places=6)
