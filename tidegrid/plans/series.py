"""Queries: time differences, false discovery rates and step functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered
from ..sources.tables import epoch_s, epoch_us, table
from .registry import query
from .sampling import rounded

#: Voxel: user bucket; slice: event type; time: day.
VOXELS = "v as (select user_id % 5 as voxel, event_type as slice, cast(floor(epoch(ts) / 86400) as bigint) as t, avg(value) as y from events group by 1, 2, 3), d as (select *, pow(y - lag(y) over (partition by voxel, slice order by t), 2) as d2 from v), s as (select t, slice, avg(d2) as m from d where d2 is not null group by 1, 2)"


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 5).alias("voxel"), F.col("event_type").alias("slice"), F.floor(epoch_s("ts") / 86400).cast("long").alias("t")).agg(F.avg("value").alias("y"))


def _diffs(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ordered.time_slice_diffs(voxels(spark, sf_dir), ["voxel"], "slice", "t", "y")[name]


@query("time_slice_diffs", f"with {VOXELS} select t, slice, round(m, 4) as mean_diff2 from s")
def time_slice_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_diffs(spark, sf_dir, "slice_mean_diff2"), "mean_diff2")


@query("volume_mean_diff2", f"with {VOXELS} select t, round(avg(d2), 4) as mean_diff2 from d where d2 is not null group by 1")
def volume_mean_diff2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_diffs(spark, sf_dir, "volume_mean_diff2"), "mean_diff2")


@query("voxel_mean_diff2", f"with {VOXELS} select voxel, slice, round(avg(d2), 4) as mean_diff2 from d where d2 is not null group by 1, 2")
def voxel_mean_diff2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_diffs(spark, sf_dir, "diff2_mean_vol"), "mean_diff2")


@query("slice_diff_peak", f"with {VOXELS}, k as (select slice, arg_max(t, m) as t from s group by 1) select voxel, d.slice, round(d2, 4) as max_diff2 from d join k on d.slice = k.slice and d.t = k.t where d2 is not null")
def slice_diff_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_diffs(spark, sf_dir, "slice_diff2_max_vol"), "max_diff2")


#: A deterministic p value of every part.
P = "p as (select p_partkey as id, p_size as g, pow((p_partkey * 7919 % 10007) / 10007.0::double, 2) + 1e-6 as p from part)"


def pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.pow((F.col("p_partkey") * 7919 % 10007) / F.lit(10007.0), 2) + 1e-6
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("g"), p.alias("p"))


@query("bh_fdr", f"with {P}, r as (select id, p, row_number() over (order by p, id) as k, count(*) over () as n from p) select id, round(min(least(1, n * p / k)) over (order by k rows between current row and unbounded following), 8) as q from r")
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.bh_fdr(pvalues(spark, sf_dir), [], "p", ["id"]).select("id", F.round("q", 8).alias("q"))


@query("fdr_threshold", f"with {P}, r as (select g, p, row_number() over (partition by g order by p, id) as k, count(*) over (partition by g) as n from p) select g, round(coalesce(max(p) filter (p < 0.2 * k / n), 0.2 / max(n)), 8) as threshold from r group by 1")
def fdr_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ordered.fdr_threshold(pvalues(spark, sf_dir), ["g"], "p", 0.2), "threshold", places=8)


@query("bonferroni", f"with {P} select id, round(least(1.0, p * (select count(*) from part)), 8) as p from p")
def bonferroni(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pvalues(spark, sf_dir)
    return p.join(F.broadcast(p.agg(F.count("*").alias("n")))).select("id", F.round(ordered.bonferroni(F.col("p"), F.col("n")), 8).alias("p"))


#: Knots: the first event of each user and day.
KNOTS = "k as (select user_id as unit, min(epoch_us(ts)) as t, arg_min(value, struct_pack(t := epoch_us(ts), e := event_id)) as v from events group by user_id, cast(floor(epoch(ts) / 86400) as bigint)), e as (select event_id, user_id as unit, epoch_us(ts) as t from events)"


def _knots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("unit"), epoch_us("ts").alias("t"), "value")
    first = e.groupBy("unit", F.floor(F.col("t") / 86_400_000_000).alias("day")).agg(F.min("t").alias("t"), F.min_by("value", F.struct("t", "event_id")).alias("v"))
    return e.drop("value"), first.drop("day")


@query("step_asof", f"with {KNOTS} select event_id, (select k.v from k where k.unit = e.unit and k.t < e.t order by k.t desc limit 1) as v from e")
def step_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = _knots(spark, sf_dir)
    return ordered.step_function(e, k, ["unit"], "t", "v", strict=True).select("event_id", "v")


@query("step_inclusive", f"with {KNOTS} select event_id, coalesce(k.v, -1) as v from e asof left join k on e.unit = k.unit and e.t >= k.t")
def step_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = _knots(spark, sf_dir)
    return ordered.step_function(e, k, ["unit"], "t", "v", fill=-1.0, bucket=7 * 86_400_000_000).select("event_id", "v")


@query(
    "linear_interp",
    f"""with {KNOTS}, a as (select e.event_id, e.unit, e.t, k.t as x0, k.v as y0 from e asof left join k on e.unit = k.unit and e.t >= k.t),
    b as (select a.*, k.t as x1, k.v as y1 from a asof left join k on a.unit = k.unit and a.t <= k.t)
    select event_id, round(case when x0 is null or x1 is null then null when x0 = x1 then y0 else y0 + (y1 - y0) * (t - x0) / (x1 - x0) end, 6) as v from b""",
)
def linear_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = _knots(spark, sf_dir)
    return ordered.linear_interp(e, k, ["unit"], "t", "v").select("event_id", F.round("v", 6).alias("v"))


#: Blocks: one a day and event type, for six hours from the first event on.
BLOCKS = "b as (select event_type as unit, min(epoch(ts)) as lo, min(epoch(ts)) + 21600 as hi, max(value) as a from events group by event_type, cast(floor(epoch(ts) / 86400) as bigint))"


@query("block_interval", f"with {BLOCKS} select event_id, round(sum(a), 6) as level from events e join b on b.unit = e.event_type and epoch(ts) >= lo and epoch(ts) < hi group by 1")
def block_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("unit"), epoch_s("ts").alias("s"), "value")
    b = e.groupBy("unit", F.floor(F.col("s") / 86400).alias("day")).agg(F.min("s").alias("lo"), F.max("value").alias("a")).withColumn("hi", F.col("lo") + 21600)
    # a block of six hours lies in two days at most, so the day is a key of the range join
    b = b.withColumn("day", F.explode(F.sequence(F.floor(F.col("lo") / 86400), F.floor(F.col("hi") / 86400))))
    met = e.withColumn("day", F.floor(F.col("s") / 86400)).join(b, ["unit", "day"]).where("s >= lo and s < hi")
    return met.groupBy("event_id").agg(F.round(F.sum("a"), 6).alias("level"))


@query(
    "boxcar_cumsum",
    """with e as (select user_id % 20 as unit, cast(floor(epoch(ts) / 3600) as bigint) as t, value from events),
    c as (select unit, t, max(value) as d from e group by 1, 2 union all select unit, t + 3, -max(value) from e group by 1, 2), s as (select unit, t, sum(d) as d from c group by 1, 2),
    g as (select distinct unit, t from e) select g.unit, g.t, round((select sum(d) from s where s.unit = g.unit and s.t <= g.t), 4) as level from g""",
)
def boxcar_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("unit"), F.floor(epoch_s("ts") / 3600).cast("long").alias("t"), "value").withColumn("end", F.col("t") + 3)
    made = ordered.boxcar(e, e.select("unit", "t").distinct(), ["unit"], "t", "end", "value", "t")
    return rounded(made, "level").select("unit", "t", "level")
