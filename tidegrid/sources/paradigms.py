"""Reader of paradigm files: which conditions were on when."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def paradigm(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(session, condition, onset, duration, amplitude) of CSV files without a header whose rows hold the first three, four or five of these; a missing duration is 0, a missing amplitude 1."""
    rows = spark.read.csv(path, sep=sep, schema="session string, condition string, onset double, duration double, amplitude double", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return rows.withColumn("duration", F.coalesce("duration", F.lit(0.0))).withColumn("amplitude", F.coalesce("amplitude", F.lit(1.0)))
