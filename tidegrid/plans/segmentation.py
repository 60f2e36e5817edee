"""Queries: Markov segmentation of the grid of nations and months by order totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import segmentation
from .registry import query
from .space import CELLS, cells

MU, VAR, BETA, ROUNDS = (0.8, 1.0, 1.2), (0.02, 0.02, 0.02), 0.4, 3


def _rounds() -> str:
    """CTEs: values over their mean; after each colour (a) and round the probabilities of a cell's classes and the classes' moments."""
    start = ", ".join(f"({k}, {m}::double, {v}::double)" for k, (m, v) in enumerate(zip(MU, VAR)))
    parts = [f"{CELLS}, d as (select i, j, v / avg(v) over () as v from g), m0 as (select * from (values {start}) t(k, mu, var)), q0 as (select i, j, v, k, 1.0::double / 3 as q from d, m0)"]
    for r in range(ROUNDS):
        last = f"q{r}"
        for colour in (0, 1):
            e = f"e{r}{colour} as (select a.i, a.j, a.k, any_value(a.v) as v, any_value(a.q) as q, count(b.q) - coalesce(sum(b.q), 0) as e from {last} a left join {last} b on a.k = b.k and abs(a.i - b.i) + abs(a.j - b.j) = 1 group by 1, 2, 3)"
            w = f"w{r}{colour} as (select *, exp(-((v - mu) ** 2) / (2 * var) - ln(var) / 2 - {2 * BETA} * e) as w from e{r}{colour} join m{r} using (k))"
            last = f"a{r}{colour}"
            parts += [e, w, f"{last} as (select i, j, v, k, case when (i + j) % 2 = {colour} then w / sum(w) over (partition by i, j) else q end as q from w{r}{colour})"]
        parts.append(f"q{r + 1} as (select * from {last}), m{r + 1} as (select k, sum(q * v) / sum(q) as mu, sum(q * v * v) / sum(q) - (sum(q * v) / sum(q)) ** 2 as var from {last} group by 1)")
    return f"with {', '.join(parts)}"


def segmented(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, segmentation.Classes, list[float]]:
    c = cells(spark, sf_dir)
    held = c.join(F.broadcast(c.agg(F.avg("v").alias("m")))).select("i", "j", (F.col("v") / F.col("m")).alias("v"))
    return segmentation.segment(held, ["i", "j"], "v", MU, VAR, BETA, ROUNDS)


@query("markov_segmentation", f"{_rounds()} select i, j, (arg_max(k, struct_pack(q := q, k := -k)))::int as label, round(max(q) filter (k = 0), 6) as q0, round(max(q) filter (k = 1), 6) as q1, round(max(q) filter (k = 2), 6) as q2 from q{ROUNDS} group by 1, 2")
def markov_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = segmented(spark, sf_dir)[0]
    return made.select("i", "j", "label", *[F.round(F.col("q")[k], 6).alias(f"q{k}") for k in range(3)])


@query("markov_classes", f"""{_rounds()}, n as (select a.i, a.j, a.k, count(b.q) - coalesce(sum(b.q), 0) as e from q{ROUNDS} a left join q{ROUNDS} b on a.k = b.k and abs(a.i - b.i) + abs(a.j - b.j) = 1 group by 1, 2, 3),
    f as (select sum(q * (ln(greatest(q, 1e-50)) + (v - mu) ** 2 / (2 * var) + ln(var) / 2 + {BETA} * e)) as energy from q{ROUNDS} join n using (i, j, k) join m{ROUNDS} using (k)) select k, round(mu, 6) as mu, round(var, 6) as var, round(energy, 4) as energy from m{ROUNDS}, f""")  # fmt: skip
def markov_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes' means and variances, and the free energy beside them."""
    _, model, energies = segmented(spark, sf_dir)
    return spark.createDataFrame([(k, round(m, 6), round(v, 6), round(energies[-1], 4)) for k, (m, v) in enumerate(zip(model.mu, model.var))], "k long, mu double, var double, energy double")
