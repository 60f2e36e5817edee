"""Queries: designs, contrasts and analysis of variance by formula."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formula import I, factor, natural_spline, term
from ..operators import formulas
from ..sources.tables import table
from .registry import query
from .sampling import rounded

#: Balances of customers by two factors of two levels, in unequal numbers.
CELLS = "d as (select case when c_custkey % 3 = 0 then 'x' else 'y' end as a, case when c_nationkey < 10 then 'p' else 'q' end as b, c_acctbal / 1000::double as y from customer), c as (select a, b, count(*) as n, avg(y) as m, sum(y * y) - count(*) * avg(y) ** 2 as sse from d group by 1, 2), e as (select sum(sse) as sse, sum(n) - 4 as dof, sum(sse) / (sum(n) - 4) as mse from c)"
SIGNS = {"a": "case a when 'x' then 1 else -1 end", "b": "case b when 'p' then 1 else -1 end", "a:b": "case when (a = 'x') = (b = 'p') then 1 else -1 end"}


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.when(F.col("c_custkey") % 3 == 0, "x").otherwise("y").alias("a"), F.when(F.col("c_nationkey") < 10, "p").otherwise("q").alias("b"), (F.col("c_acctbal") / 1000).alias("y"))


@query("anova", f"with {CELLS} " + " union all ".join(f"select '{name}' as effect, 1::bigint as df, round(sum({s} * m) ** 2 / sum(1.0 / n), 6) as ss, round(sum({s} * m) ** 2 / sum(1.0 / n) / any_value(mse), 6) as f from c, e" for name, s in SIGNS.items()) + " union all select 'residual', dof::bigint, round(sse, 6), null from e")
def anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two factors and their interaction; the design holds the constant and both factors besides, whose columns are aliased."""
    a, b = factor("a", ["x", "y"]), factor("b", ["p", "q"])
    effects = {"a": a.main_effect, "b": b.main_effect, "a:b": a.main_effect * b.main_effect}
    return rounded(formulas.anova(customers(spark, sf_dir), a * b + a + b + I, "y", effects).drop("p"), "ss", "f", places=6)


@query("formula_design", """select l_orderkey, l_linenumber, 1.0::double as one, l_quantity::double as quantity, (l_returnflag = 'A')::int::double as a, (l_returnflag = 'N')::int::double as n, l_quantity * l_quantity * (l_returnflag = 'R')::int::double as r_squares,
    round(ln(l_extendedprice), 6) as log_price, (l_returnflag = 'A')::int::double - (l_returnflag = 'R')::int as a_r, case when l_quantity > 25 then (l_quantity - 25) ** 3 else 0 end::double as knot from lineitem""")  # fmt: skip
def formula_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms, products, squares, functions, main effects and splines as columns of the lines."""
    q, flag = term("l_quantity"), factor("l_returnflag", ["A", "N", "R"])
    made = I + q + (flag - flag.level("R")) + q * q * flag.level("R") + term("log", lambda: F.log("l_extendedprice")) + flag.main_effect + natural_spline("l_quantity", [25.0])
    made = made - natural_spline("l_quantity", [])  # its powers
    names = ["one", "a", "n", "r_squares", "log_price", "a_r", "n_r", "knot"]
    cols = [t.column().alias(n) for t, n in zip(made.terms, names)]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("quantity"), *cols).drop("n_r").withColumn("log_price", F.round("log_price", 6))


@query("formula_fit", """with d as (select l_returnflag as unit, l_quantity / 10::double as x, case when l_quantity > 25 then l_quantity / 10 - 2.5 else 0 end::double as k, l_extendedprice / 1000::double as y from lineitem),
    s as (select unit, regr_sxx(x, x) as xx, regr_sxx(k, k) as kk, regr_sxy(x, k) as xk, regr_sxy(y, x) as yx, regr_sxy(y, k) as yk from d group by 1)
    select unit, round((kk * yx - xk * yk) / (xx * kk - xk * xk), 6) as slope, round((xx * yk - xk * yx) / (xx * kk - xk * xk), 6) as bend from s""")  # fmt: skip
def formula_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price by quantity for each flag, with a bend at 25."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("unit"), (F.col("l_quantity") / 10).alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    fits = formulas.fit(rows, ["unit"], I + natural_spline("x", [2.5], order=1), "y")
    return rounded(fits.select("unit", F.col("beta")[1].alias("slope"), F.col("beta")[2].alias("bend")), "slope", "bend", places=6)
