"""Readers of the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a data folder; columns and filters are pushed down by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_us(name: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone; the session's zone has no part in it."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(name))


def epoch_s(name: str) -> Column:
    return epoch_us(name) / 1e6
