"""Queries: maximal cliques of the high cells, neighbours on the diagonal among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cliques
from .registry import query
from .space import HIGH, high_edges

FOUND = f"""with recursive {HIGH}, n as (select a.id::bigint as id, coalesce(list(b.id::bigint) filter (b.id is not null), []) as near from h a left join h b on greatest(abs(a.i - b.i), abs(a.j - b.j)) <= 2 and a.id <> b.id group by 1),
    c as (select [id] as clique, list_filter(near, lambda x: x > id) as rest from n union all select list_append(clique, id), list_filter(list_intersect(rest, near), lambda x: x > id) from c join n on list_contains(rest, id)),
    m as (select clique from c where not exists (select 1 from n where list_has_all(near, clique)))"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells are joined up to two steps apart, so a block of three by three is a clique."""
    h = high_edges(spark, sf_dir)[0]
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-2, 3) for b in range(-2, 3) if (a, b) > (0, 0)]))
    reached = h.select("id", "i", "j", step.alias("s")).select(F.col("id").alias("src"), (F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j"))
    return cliques.maximal_cliques(reached.join(h, ["i", "j"]).select("src", F.col("id").alias("dst")), h)


@query("maximal_cliques", f"{FOUND} select array_to_string(list_sort(clique), ',') as clique, len(clique)::int as size from m")
def maximal_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select(F.array_join(F.col("clique").cast("array<string>"), ",").alias("clique"), "size")


@query("largest_cliques", f"{FOUND} select vertex, count(*) as cliques, max(size)::int as largest from (select unnest(clique) as vertex, len(clique) as size from m) group by 1")
def largest_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cliques.largest_cliques(_found(spark, sf_dir))
