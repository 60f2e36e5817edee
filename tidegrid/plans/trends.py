"""Queries: trends of the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import glm
from ..sources.tables import epoch_s, table
from .registry import query


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, t, y): mean value of each event type by hour; t counts hours since 1970."""
    t = F.floor(epoch_s("ts") / 3600).cast("long")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("unit"), t.alias("t")).agg(F.avg("value").alias("y"))


HOURLY = "h as (select event_type as unit, cast(floor(epoch(ts) / 3600) as bigint) as t, avg(value) as y from events group by 1, 2)"


@query(
    "ols_hourly_trend",
    f"""with {HOURLY}, s as (select unit, count(*) as n, regr_slope(y, t - 400000) as b, regr_sxx(y, t - 400000) as sxx, regr_syy(y, t - 400000) as syy from h group by 1)
    select unit, n, round(b, 6) as slope, round(b / sqrt(greatest(syy - b * b * sxx, 0) / (n - 2) / sxx), 4) as t_slope from s""",
)
def ols_hourly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = glm.simple_ols(hourly(spark, sf_dir).withColumn("t", F.col("t") - 400000), ["unit"], "t", "y")
    return fitted.select("unit", "n", F.round("slope", 6).alias("slope"), F.round("t_slope", 4).alias("t_slope"))
