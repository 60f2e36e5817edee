"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components as connected_components
from ..storage import drop_tables as drop_tables
from ..storage import stored as stored


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: Rows of the batches that Python workers get where a row is as large as a document.
BATCH_ROWS = 512


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Queries that run inside decode at most so many rows of Parquet, and pass at most so many to Python, at a time, so memory does not follow the rows of a partition."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {key: spark.conf.get(key) for key in keys}
    for key, held in before.items():
        spark.conf.set(key, str(min(rows, int(held)) if int(held) > 0 else rows))
    try:
        yield
    finally:
        for key, held in before.items():
            spark.conf.set(key, held)


ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


#: Bits of the hashes that a bit set tells apart: 2**20 bits are 128 kB at any corpus size.
SET_BITS = 20


def bit_set(rows: DataFrame, hashed: Column, bits: int = SET_BITS) -> Column:
    """An array of longs with the lowest `bits` bits of the hashes as a set: a scalar subquery of one stored row.

    Its value reaches the tasks when a query starts and is no part of the plan's text, which the driver keeps.
    """
    low = hashed.bitwiseAND(F.lit((1 << bits) - 1))
    words = rows.select(low.alias("low")).groupBy(F.shiftright("low", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(low & 63 as int))")).alias("held"))
    every = rows.sparkSession.range(1 << (bits - 6)).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("held"))
    dense = every.union(words).groupBy("word").agg(F.bit_or("held").alias("held"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("word", "held"))), lambda x: x["held"])
    return stored(dense.agg(in_order.alias("held")), "bit-set").scalar()


def bit_test(hashed: Column, held: Column, bits: int = SET_BITS) -> Column:
    """Whether the hash may be in the set; never false for one that is."""
    low = hashed.bitwiseAND(F.lit((1 << bits) - 1))
    return F.getbit(F.element_at(held, (F.shiftright(low, 6) + 1).cast("int")), low.bitwiseAND(F.lit(63)).cast("int")) == 1


def without_rows(docs: DataFrame, bad: DataFrame, key: Column, keys: DataFrame | None = None) -> DataFrame:
    """docs without the rows whose key is in bad(row). A bit set of fixed size lets most of the others pass without a shuffle.

    Given keys(row), the keys of all rows of docs, those in the set that are not in bad make a second
    set, and rows in the first one alone go without a shuffle as well.
    """
    held_bad = bit_set(bad, F.col("row"))
    maybe = bit_test(key, held_bad)
    suspects = docs.where(maybe)
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held")
    if keys is None:
        stay = suspects.select(held, key.alias("row")).join(bad, "row", "left_anti")
    else:
        good = stored(keys.where(bit_test(F.col("row"), held_bad)).distinct().join(bad, "row", "left_anti"), "good-rows")
        suspects = suspects.where(bit_test(key, bit_set(good, F.col("row"))))
        stay = suspects.select(held, key.alias("row")).join(good, "row", "left_semi")
    return docs.where(~maybe).unionByName(stay.select("held.*"))
