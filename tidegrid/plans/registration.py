"""Queries: the grid of nations and months against itself, moved, by joint histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registration
from .registry import query
from .space import CELLS, cells

BINS = 6
#: The map of the histogram query, and the shifts at which the measures are taken.
MATRIX, SHIFT = ((1.0, 0.25), (0.0, 0.75)), (-0.5, 2.125)
MOVES, STEP = (-1.0, -0.5, 0.0, 0.5, 1.0), 0.25
BINNED = f"{CELLS}, z as (select i, j, cast(round((v - min(v) over ()) * ({BINS - 1} / (max(v) over () - min(v) over ()))) as int) as bin from g)"


def _placed(table: str, x: str, y: str) -> str:
    """CTEs from rows (k, a, x, y) to h(k, a, b, n): weights of the four cells about each place."""
    return f"""p as (select k, bin as a, {x} as x, {y} as y from {table}), o as (select unnest([0, 1]) as d),
    c as (select k, a, floor(x) + u.d as q, floor(y) + w.d as r, (case u.d when 1 then x - floor(x) else 1 - x + floor(x) end) * (case w.d when 1 then y - floor(y) else 1 - y + floor(y) end) as w from p, o u, o w),
    h as (select k, a, z.bin as b, sum(w) as n from c join z on z.i = q and z.j = r where w > 0 group by 1, 2, 3)"""


#: Squared correlation of each k's histogram.
CC = "m as (select k, sum(n) as s, sum(n * a) / sum(n) as ma, sum(n * b) / sum(n) as mb from h group by 1), cc as (select k, pow(sum(n * (a - ma) * (b - mb)), 2) / (sum(n * (a - ma) ** 2) * sum(n * (b - mb) ** 2)) as cc from h join m using (k) group by 1)"


def registered(spark: SparkSession, sf_dir: str, measure: str = "cc") -> registration.Registration:
    c = cells(spark, sf_dir)
    return registration.register(c, c, ["i", "j"], "v", BINS, measure=measure, to_map=registration.shifts)


@query("registration_histogram", f"with {BINNED}, {_placed('(select 0 as k, * from z)', f'{MATRIX[0][0]}::double * i + {MATRIX[0][1]}::double * j + {SHIFT[0]}::double', f'{MATRIX[1][0]}::double * i + {MATRIX[1][1]}::double * j + {SHIFT[1]}::double')} select a, b, round(n, 6) as n from h")
def registration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = registered(spark, sf_dir)
    return registration.histograms(held.source, held.target, held.at, [(MATRIX, SHIFT)]).select("a", "b", F.round("n", 6).alias("n"))


_LIST = ", ".join(f"({m}::double)" for m in MOVES)


@query("registration_explore", f"""with {BINNED}, t as (select x.m as di, y.m as dj, row_number() over (order by x.m, y.m) as k from (values {_LIST}) x(m), (values {_LIST}) y(m)), {_placed("(select * from z, t)", "i + di", "j + dj")}, {CC},
    pa as (select k, a, sum(n) as na from h group by 1, 2), pb as (select k, b, sum(n) as nb from h group by 1, 2), mi as (select k, sum(n / s * ln(n * s / (na * nb))) as mi from h join m using (k) join pa using (k, a) join pb using (k, b) group by 1)
    select di, dj, round(cc, 6) as cc, round(mi, 6) as mi from t join cc using (k) join mi using (k)""")  # fmt: skip
def registration_explore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two measures of the grid against itself under shifts by whole and half steps; one is largest where nothing moves."""
    found = [registered(spark, sf_dir, m).explore([0.0, 0.0], (0, MOVES), (1, MOVES)) for m in ("cc", "mi")]
    return spark.createDataFrame([(*p, round(cc, 6), round(mi, 6)) for (p, cc), (_, mi) in zip(*found)], "di double, dj double, cc double, mi double")


@query("registration_gradient", f"""with {BINNED}, t as (select * from (values (0, 0, 0.5 + {STEP}::double, 0.25::double), (1, 0, 0.5 - {STEP}::double, 0.25::double), (2, 1, 0.5::double, 0.25 + {STEP}::double), (3, 1, 0.5::double, 0.25 - {STEP}::double)) t(k, parameter, di, dj)), {_placed("(select * from z, t)", "i + di", "j + dj")}, {CC}
    select parameter, round(sum(case when k % 2 = 0 then cc else -cc end) / {2 * STEP}::double, 6) as gradient from t join cc using (k) group by 1""")  # fmt: skip
def registration_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Central differences of the squared correlation at a shift of a half and a quarter step."""
    g = registered(spark, sf_dir).gradient([0.5, 0.25], STEP)
    return spark.createDataFrame([(k, round(x, 6)) for k, x in enumerate(g)], "parameter int, gradient double")
