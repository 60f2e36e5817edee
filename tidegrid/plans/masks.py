"""Queries: masks and their components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import masks
from ..sources.tables import table
from .registry import query
from .space import CELLS, cells

AT = ["i", "j"]
#: Values in order, the gaps between the shares, the threshold, the mask, its components.
GAP = f"{CELLS}, o as (select v, row_number() over (order by v) as k, count(*) over () as n, lead(v) over (order by v) as w from g), t as (select arg_max((v + w) / 2, struct_pack(d := w - v, k := -k)) as t from o where k > floor(0.2 * n) and k <= floor(0.9 * n)), h as (select i, j, v from g, t where v >= t)"
PART = "e as (select a.i, a.j, b.i as i2, b.j as j2 from h a join h b on abs(a.i - b.i) + abs(a.j - b.j) = 1), r as (select i, j, i * 100 + j as l from h union select e.i2, e.j2, r.l from r join e on r.i = e.i and r.j = e.j), c as (select i, j, min(l) as label from r group by 1, 2), z as (select label, count(*) as size from c group by 1)"


def high(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    return c.join(F.broadcast(masks.gap_threshold(c, "v"))).where("v >= threshold").select("i", "j", "v")


@query("gap_threshold", f"with {GAP} select round(t, 5) as threshold from t")
def gap_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.gap_threshold(cells(spark, sf_dir), "v").select(F.round("threshold", 5).alias("threshold"))


@query("largest_component", f"with recursive {GAP}, {PART} select i, j from c where label = (select label from z order by size desc, label limit 1)")
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.largest_component(high(spark, sf_dir), AT).select("i", "j")


@query("small_components", f"with recursive {GAP}, {PART} select i, j, label, size from c join z using (label) where size >= 3")
def small_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.drop_small_components(high(spark, sf_dir), AT, 3).select("i", "j", (F.col("label.i") * 100 + F.col("label.j")).alias("label"), "size")


OPEN = "m as (select i, j from c where label = (select label from z order by size desc, label limit 1)), s as (select i, j from m where (select count(*) from m b where abs(m.i - b.i) + abs(m.j - b.j) = 1) = 4)"


@query("compute_mask", f"with recursive {GAP}, {PART}, {OPEN} select distinct s.i + d.a as i, s.j + d.b as j from s, (values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) d(a, b)")
def compute_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.compute_mask(cells(spark, sf_dir), AT, "v", opening=1)


YEARS = "y as (select c_nationkey as i, month(o_orderdate) as j, year(o_orderdate) as s, sum(o_totalprice) as v from orders join customer on o_custkey = c_custkey group by 1, 2, 3), b as (select i, j, s from y where v > (select avg(v) from y))"


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.month("o_orderdate").alias("j"), F.year("o_orderdate").alias("s"), "o_totalprice")
    return o.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("i")), F.col("o_custkey") == F.col("c_custkey")).groupBy("i", "j", "s").agg(F.sum("o_totalprice").alias("v"))


@query("intersect_masks", f"with {YEARS} select i, j from b group by 1, 2 having count(*) > 0.5 * (select count(distinct s) from b)")
def intersect_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = yearly(spark, sf_dir)
    b = y.join(F.broadcast(y.agg(F.avg("v").alias("m")))).where("v > m").select("i", "j", "s")
    return masks.sessions_mask(b, AT, "s", 0.5, largest=False)


@query("masked_series", f"with {YEARS} select y.i, y.j, y.s, round(v, 2) as v from y where exists (select 1 from b where b.i = y.i and b.j = y.j and b.s = 1996)")
def masked_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = yearly(spark, sf_dir)
    m = y.join(F.broadcast(y.agg(F.avg("v").alias("m")))).where("v > m and s = 1996")
    return masks.masked_series(y, m, AT, "v").select("i", "j", "s", F.round("v", 2).alias("v"))


@query("parcel_groups", "with p as (select * from (values ('even', 2), ('even', 4), ('low', 1), ('low', 2)) t(parcel, label)) select parcel, count(*) as n, sum(l_quantity)::double as q from lineitem join p on l_linenumber = label group by 1")
def parcel_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = spark.createDataFrame([("even", 2), ("even", 4), ("low", 1), ("low", 2)], "parcel string, label int")
    return masks.parcels(table(spark, sf_dir, "lineitem"), "l_linenumber", groups).groupBy("parcel").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


@query("clamp_bins", "with m as (select min(p_retailprice) as lo, max(p_retailprice) as hi from part) select cast(round_even(15 / (hi - lo) * (p_retailprice - lo), 0) as int) as bin, count(*) as n from part, m group by 1")
def clamp_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.clamp(table(spark, sf_dir, "part"), "p_retailprice", 16).groupBy("bin").agg(F.count("*").alias("n"))


@query("clamp_whole", "select cast(p_size - (select min(p_size) from part) as int) as bin, count(*) as n from part group by 1")
def clamp_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.clamp(table(spark, sf_dir, "part"), "p_size", 64).groupBy("bin").agg(F.count("*").alias("n"))


@query("bounding_box", f"with {GAP} select min(i) as i_min, max(i) + 1 as i_end, min(j) as j_min, max(j) + 1 as j_end from h")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.bounding_box(high(spark, sf_dir), AT)


@query("p_values_ok", "select bool_and(l_discount >= 0 and l_discount <= 1) as ok from lineitem")
def p_values_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.p_values_ok(table(spark, sf_dir, "lineitem"), "l_discount")


@query("cluster_table", f"with recursive {GAP}, {PART} select label, any_value(size) as size, round(avg(c.i), 6) as ci, round(avg(c.j), 6) as cj, max(h.v) as peak, arg_max(h.i * 100 + h.j, h.v) as at from c join z using (label) join h on h.i = c.i and h.j = c.j group by label having any_value(size) >= 2")
def cluster_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with their size, barycentre and highest cell."""
    l = masks.drop_small_components(high(spark, sf_dir), AT, 2)
    label = (F.col("label.i") * 100 + F.col("label.j")).alias("label")
    return l.groupBy(label).agg(F.first("size").alias("size"), F.round(F.avg("i"), 6).alias("ci"), F.round(F.avg("j"), 6).alias("cj"), F.max("v").alias("peak"), F.max_by(F.col("i") * 100 + F.col("j"), "v").alias("at"))
