"""Queries: agglomerative clustering of grid cells and merge trees of their level sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clustering
from .registry import query
from .sampling import rounded
from .space import CELLS, HIGH, cells, high_edges

#: The cells above the median with their value and month; all cells and the edges between them.
POINTS = f"{HIGH}, f as (select h.id::bigint as id, v / 1000 as x, g.j / 4.0::double as y from h join g on g.i = h.i and g.j = h.j), u as (select distinct src::bigint as src, dst::bigint as dst from e)"
FIELD = f"{CELLS}, f as (select (i * 100 + j)::bigint as id, v, row_number() over (order by v desc, i * 100 + j) as k from g), e as (select (a.i * 100 + a.j)::bigint as src, (b.i * 100 + b.j)::bigint as dst from g a join g b on abs(a.i - b.i) + abs(a.j - b.j) = 1)"

#: Ward's merges one by one: each step takes the adjacent pair of clusters whose union has the least inertia.
WARD = f"""with recursive {POINTS}, w as (select 0 as step, id as leaf, id as c, 0::bigint as a, 0::bigint as b, 0.0::double as height from f
    union all select step + 1, leaf, case when c = best.b then best.a else c end, best.a, best.b, best.height from w, (
      with s as (select c, count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * x + y * y) as q from w join f on leaf = id group by c),
      p as (select distinct least(l.c, r.c) as a, greatest(l.c, r.c) as b from u join w l on l.leaf = src join w r on r.leaf = dst where l.c <> r.c)
      select p.a, p.b, l.q + r.q - ((l.sx + r.sx) ** 2 + (l.sy + r.sy) ** 2) / (l.n + r.n) as height from p join s l on l.c = p.a join s r on r.c = p.b order by height, p.a, p.b limit 1) best),
    m as (select distinct step, a, b, height from w where step > 0)"""
#: Similarities of adjacent cells, and merges by the mean similarity of all pairs of two clusters.
LINK = f"""with recursive {POINTS}, z as (select src, dst, 1 / (1 + abs(p.x - q.x)) as s from u join f p on p.id = src join f q on q.id = dst where src < dst),
    w as (select 0 as step, id as leaf, id as c, 0::bigint as a, 0::bigint as b, 0.0::double as height from f
    union all select step + 1, leaf, case when c = best.b then best.a else c end, best.a, best.b, best.height from w, (
      with n as (select c, count(*) as n from w group by c), p as (select least(l.c, r.c) as a, greatest(l.c, r.c) as b, sum(s) as s from z join w l on l.leaf = src join w r on r.leaf = dst where l.c <> r.c group by 1, 2)
      select p.a, p.b, s / (l.n * r.n) as height from p join n l on l.c = p.a join n r on r.c = p.b order by height desc, p.a, p.b limit 1) best),
    m as (select distinct step, a, b, height from w where step > 0)"""
#: The sweep vertex by vertex: label is the blob that a vertex joins, root the blob that holds it now.
SWEEP = f"""with recursive {FIELD}, t as (select 1::bigint as step, id as v, id as label, id as root from f where k = 1
    union all select n.step, x.v, x.label, case when n.many and list_contains(n.roots, x.root) then n.id else x.root end from (
        select any_value(t.step) + 1 as step, f.id, list_distinct(list(t.root) filter (e.src is not null)) as roots, len(list_distinct(list(t.root) filter (e.src is not null))) > 1 as many
        from t join f on f.k = t.step + 1 left join e on e.src = f.id and e.dst = t.v group by f.id) n,
      lateral (select v, label, root from t union all select n.id, case when len(n.roots) = 1 then n.roots[1] else n.id end, case when len(n.roots) = 1 then n.roots[1] else n.id end) x),
    l as (select distinct v, label from t), p as (select v as node, arg_min(root, step) as parent from t where v = label and root <> v group by v)"""


def points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    h, e = high_edges(spark, sf_dir)
    held = cells(spark, sf_dir).join(h, ["i", "j"]).select("id", (F.col("v") / 1000).alias("x"), (F.col("j") / 4).alias("y"))
    return held, e


def similar(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f, e = points(spark, sf_dir)
    end = lambda c: f.select(F.col("id").alias(c), F.col("x").alias(f"x_{c}"))
    return f, e.select("src", "dst").join(end("src"), "src").join(end("dst"), "dst").select("src", "dst", (1 / (1 + F.abs(F.col("x_src") - F.col("x_dst")))).alias("w"))


def field(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from ..operators.grid import neighbours

    f = cells(spark, sf_dir).withColumn("id", (F.col("i") * 100 + F.col("j")).cast("long"))
    e = neighbours(f, ["i", "j"], "id").select((F.col("i") * 100 + F.col("j")).cast("long").alias("src"), F.col("neighbour").alias("dst"))
    return f, e


@query("ward", f"{WARD} select b, a, round(height, 6) as height from m")
def ward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clustering.ward(*points(spark, sf_dir), ["x", "y"]), "height", places=6).select("b", "a", "height")


@query("ward_segment", f"{WARD}, o as (select row_number() over (order by height, step) as r, * from m), n as (select count(*) - 12 as keep from f), last as (select coalesce(max(step), 0) as step from o, n where r <= keep) select leaf as id, c as label from w join last using (step)")
def ward_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve clusters, or as many as the graph has components."""
    f, e = points(spark, sf_dir)
    return clustering.cut_tree(f, clustering.ward(f, e, ["x", "y"]), clusters=12)


@query("ward_dendrogram", f"""{WARD}, o as (select (row_number() over (order by height, step) + (select max(id) from f))::bigint as node, a, b, height from m),
    c as (select id as cluster, id as node, null::double as height, true as own, -1 as pos from f union all select a, node, height, true, node from o union all select b, node, height, false, node from o),
    p as (select *, lead(node) over (partition by cluster order by pos) as parent from c) select node, coalesce(parent, node) as parent, round(height, 6) as height from p where own""")  # fmt: skip
def ward_dendrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, e = points(spark, sf_dir)
    return rounded(clustering.dendrogram(f, clustering.ward(f, e, ["x", "y"])), "height", places=6)


@query("average_link", f"{LINK} select b, a, round(height, 6) as height from m")
def average_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clustering.average_link(similar(spark, sf_dir)[1]), "height", places=6).select("b", "a", "height")


@query("average_link_segment", f"{LINK}, last as (select coalesce(max(step), 0) as step from m where height >= 0.01) select leaf as id, c as label from w join last using (step)")
def average_link_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters that merges of a mean similarity of at least 0.01 make."""
    f, e = similar(spark, sf_dir)
    return clustering.cut_tree(f, clustering.average_link(e), stop=0.01, falling=True)


@query("level_set_tree", f"{SWEEP}, s as (select label, count(*) as size from l group by 1) select s.label as node, b.v as birth, coalesce(p.parent, s.label) as parent, d.v as death, size from s join f b on b.id = s.label left join p on p.node = s.label left join f d on d.id = p.parent")
def level_set_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, e = field(spark, sf_dir)
    return clustering.merge_tree(f, e, "v")[0]


@query("level_set_labels", f"{SWEEP} select v as id, label from l")
def level_set_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, e = field(spark, sf_dir)
    return clustering.merge_tree(f, e, "v")[1]
