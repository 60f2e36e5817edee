"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="spark-tidegrid-"))
    return _LOCAL[0]


def run_dir(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{shared_dir(spark)}/tidegrid-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str, row_group_bytes: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there, and a lost executor loses nothing.

    The size estimate starts again from the files, so plans stay small in loops that join their own results.
    A task holds a row group while it writes or reads one: row_group_bytes bounds it for tables of wide rows.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**({"parquet.block.size": row_group_bytes} if row_group_bytes else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(*tables: DataFrame) -> None:
    """Deletes what stored() has written of these tables; frames that read them can't be used after."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(spark: SparkSession) -> None:
    """Deletes everything that stored() has written in this application; frames that read it can't be used after."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
