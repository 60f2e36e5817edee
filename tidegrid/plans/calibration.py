"""Queries: permutation tests of brands over years, and of the cells of nations and months."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration
from ..sources.tables import table
from .registry import query
from .sampling import rounded

#: The tables' first year, their years, and the years of the first sample.
YEAR, SUBJECTS, FIRST = 1995, 7, (0, 1, 2)
YEARS = f"y as (select p_brand as unit, year(l_shipdate) - {YEAR} as s, round(avg(l_extendedprice) - 38000, 4) as y from lineitem join part on l_partkey = p_partkey where year(l_shipdate) between {YEAR} and {YEAR + SUBJECTS - 1} group by 1, 2)"
SIGNS = f"f as (select unnest(range({2**SUBJECTS})) as f), p as (select f, unit, avg(y * (1 - 2 * ((f >> s) & 1))) / stddev_pop(y * (1 - 2 * ((f >> s) & 1))) * sqrt(count(*) - 1) as t from y, f group by 1, 2)"
SPLITS = f"""f as (select f from (select unnest(range({2**SUBJECTS})) as f) where bit_count(f::int) = {len(FIRST)}), g as (select f, unit, (f >> s) & 1 as k, y from y, f),
    p as (select f, unit, (avg(y) filter (k = 1) - avg(y) filter (k = 0)) / sqrt((coalesce(var_pop(y) filter (k = 1) * count(*) filter (k = 1), 0) + coalesce(var_pop(y) filter (k = 0) * count(*) filter (k = 0), 0)) / (count(*) - 2)) as t from g group by 1, 2)"""
#: Rounding apart, statistics of mirrored permutations are equal.
LEAST = f"t - {calibration.EQUAL!r}::double * greatest(1, abs(t))"


def _units(perms: str, observed: int) -> str:
    return f"with {YEARS}, {perms}, m as (select f, max(t) as m from p group by 1), o as (select unit, t, {LEAST} as least from p where f = {observed}), a as (select unit, avg((p.t >= least)::int) as p from p join o using (unit) group by 1), b as (select unit, avg((m >= least)::int) as corrected from m, o group by 1) select unit, round(t, 5) as t, round(p, 6) as p, round(corrected, 6) as corrected from o join a using (unit) join b using (unit)"


def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_partkey", (F.year("l_shipdate") - YEAR).alias("s"), "l_extendedprice").where(F.col("s").between(0, SUBJECTS - 1))
    brands = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("unit"))
    return items.join(brands, F.col("l_partkey") == F.col("p_partkey")).groupBy("unit", "s").agg(F.round(F.avg("l_extendedprice") - 38000, 4).alias("y"))


def signs(spark: SparkSession, sf_dir: str) -> calibration.Calibration:
    return calibration.calibration(years(spark, sf_dir), ["unit"], "s", "y", calibration.sign_flips(SUBJECTS))


def splits(spark: SparkSession, sf_dir: str) -> calibration.Calibration:
    return calibration.calibration(years(spark, sf_dir), ["unit"], "s", "y", calibration.exchanges(len(FIRST), SUBJECTS - len(FIRST)), FIRST)


@query("calibrated_signs", _units(SIGNS, 0))
def calibrated_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(signs(spark, sf_dir).units(), "t", places=5), "p", "corrected", places=6)


@query("calibrated_exchanges", _units(SPLITS, sum(1 << s for s in FIRST)))
def calibrated_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(splits(spark, sf_dir).units(), "t", places=5), "p", "corrected", places=6)


LEVELS = (0.2, 0.05, 0.01)


@query("height_thresholds", f"with {YEARS}, {SIGNS}, l(level) as (values {', '.join(f'({x}::double)' for x in LEVELS)}), r as (select t, count(*) over (order by t desc range between unbounded preceding and current row) as above, count(*) over () as n from p) select level, round(min(t) filter (above <= level * n), 5) as height from r, l group by 1")
def height_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncorrected thresholds of the statistic over all brands and changes of sign."""
    held = signs(spark, sf_dir)
    return spark.createDataFrame([(x, round(held.height(x), 5)) for x in LEVELS], "level double, height double")


@query("calibrated_regions", f"""with {YEARS}, {SIGNS}, q as (select a.f, a.unit, (select avg((b.t >= a.t - {calibration.EQUAL!r}::double * greatest(1, abs(a.t)))::int) from p b where b.unit = a.unit) as q from p a),
    s as (select f, unit[1:7] as region, sum(-ln(q)) as s from q group by 1, 2), u as (select a.f, a.region, a.s, avg((b.s >= a.s - {calibration.EQUAL!r}::double * greatest(1, abs(a.s)))::int) as u from s a join s b on a.region = b.region group by 1, 2, 3),
    m as (select f, min(u) as m from u group by 1) select region, round(s, 5) as fisher, round(u, 6) as p, round((select avg((m <= u + 1e-12)::int) from m), 6) as corrected from u where f = 0""")  # fmt: skip
def calibrated_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of one manufacturer as a region: the first seven letters of the brand."""
    held = signs(spark, sf_dir)
    found = held.regions(held.table.select("unit", F.substring("unit", 1, 7).alias("region")), "region")
    return rounded(rounded(found, "fisher", places=5), "p", "corrected", places=6)
