"""Queries: neighbours of points, edge weights, fields over graphs and forests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graphs, grid
from ..sources.tables import table
from .registry import query
from .sampling import rounded
from .space import CELLS, HIGH, TREE, cells, high_edges, tree

#: Vectors; d2 of pairs; even and odd halves.
V = "v as (select vec_id as id, embedding::double[] as v from embeddings), p as (select a.id as src, b.id as dst, list_reduce(list_transform(range(1, 65), lambda k: (a.v[k] - b.v[k]) * (a.v[k] - b.v[k])), lambda s, x: s + x) as d2 from v a, v b)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = vectors(spark, sf_dir)
    return v.where("id % 10 = 0"), v.where("id % 10 <> 0")


HALVES = "h as (select * from p where src % 10 = 0 and dst % 10 <> 0)"


@query("knn", f"with {V}, k as (select src, dst, d2, row_number() over (partition by src order by d2, dst) as k from p where src <> dst), n as (select src, dst, d2 from k where k <= 3) select src, dst, round(sqrt(d2), 5) as w from n union select dst, src, round(sqrt(d2), 5) from n")
def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.knn(vectors(spark, sf_dir), 3), "w", places=5)


@query("cross_knn", f"with {V}, {HALVES} select src, dst, round(greatest(d2, 1e-15), 5) as w from (select *, row_number() over (partition by src order by d2, dst) as k from h) where k <= 2")
def cross_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.cross_knn(*halves(spark, sf_dir), 2), "w", places=5)


@query("cross_eps", f"with {V}, {HALVES} select src, dst, round(d2, 5) as w from h where d2 < 1.4")
def cross_eps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.cross_eps(*halves(spark, sf_dir), 1.4), "w", places=5)


@query("kernel_density", f"with {V}, {HALVES} select src as id, round(sum(exp(-d2 / 2.0)), 5) as density from h group by 1")
def kernel_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.kernel_density(*halves(spark, sf_dir), 1.0), "density", places=5)


@query("nearness_score", f"with {V}, {HALVES}, m as (select src, min(d2) as d2 from h group by 1) select round(avg(exp(-d2 / 2.0)), 6) as score from m")
def nearness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.nearness(*halves(spark, sf_dir), 1.0), "score", places=6)


@query("voronoi_diagram", f"with {V}, {HALVES}, k as (select dst, src, row_number() over (partition by dst order by d2, src) as k from h), t as (select dst, min(src) as a, max(src) as b from k where k <= 2 group by 1) select distinct a as src, b as dst from t where a < b")
def voronoi_diagram(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds, samples = halves(spark, sf_dir)
    return graphs.voronoi_diagram(samples, seeds)


@query("balls", f"with {V}, {HALVES} select dst as id, max(src) as label from h where d2 < (1.1 + src % 3 * 0.05) ** 2 group by 1")
def balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres, points = halves(spark, sf_dir)
    return graphs.balls(points, centres.withColumn("radius", F.lit(1.1) + F.col("id") % 3 * F.lit(0.05)))


#: A directed graph: customers' nations to the nations that supply them, by quantity.
FLOW = "f as (select c_nationkey as src, s_nationkey as dst, sum(l_quantity)::double as w from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by 1, 2)"


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src")), F.col("o_custkey") == F.col("c_custkey"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("src", "dst").agg(F.sum("l_quantity").alias("w"))


@query("degrees", f"with {FLOW} select n_nationkey as id, (select count(*) from f where src = n_nationkey) as \"right\", (select count(*) from f where dst = n_nationkey) as \"left\" from nation")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.degrees(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")), flow(spark, sf_dir))


@query("normalise_rows", f"with {FLOW} select src, dst, round(w / sum(w) over (partition by src), 8) as w from f")
def normalise_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.normalise(flow(spark, sf_dir), 0), "w", places=8)


@query("normalise_columns", f"with {FLOW} select src, dst, round(w / sum(w) over (partition by dst), 8) as w from f")
def normalise_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.normalise(flow(spark, sf_dir), 1), "w", places=8)


@query("normalise_both", f"with {FLOW} select src, dst, round(w / sqrt(sum(w) over (partition by src) * sum(w) over (partition by dst)), 8) as w from f")
def normalise_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.normalise(flow(spark, sf_dir), 2), "w", places=8)


@query("symmetrise", f"with {FLOW}, u as (select * from f union all select dst, src, w from f) select src, dst, round(sum(w) / 2, 4) as w from u group by 1, 2 having sum(w) <> 0")
def symmetrise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.symmetrise(flow(spark, sf_dir)), "w")


@query("antisymmetrise", f"with {FLOW}, u as (select * from f union all select dst, src, -w from f) select src, dst, round(sum(w) / 2, 4) as w from u group by 1, 2 having sum(w) <> 0")
def antisymmetrise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.symmetrise(flow(spark, sf_dir), anti=True), "w")


@query("concatenate_graphs", f"with {FLOW}, u as (select * from f union all select * from f where w > 50), r as (select src, dst, sum(w) as w from u group by 1, 2) select src, dst, w from r union all select src + 25, dst + 25, w from f where src <> dst")
def concatenate_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated edges are made one, then the graph without self-loops follows beside it."""
    f = flow(spark, sf_dir)
    return graphs.concatenate(graphs.cut_redundancies(f.union(f.where("w > 50"))), graphs.remove_trivial(f), 25)


@query("subgraph", f"with {FLOW}, n as (select n_nationkey from nation where n_regionkey = 1) select src, dst, w from f where src in (from n) and dst in (from n)")
def subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.subgraph(flow(spark, sf_dir), table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("id")))


@query("subgraph_left", f"with {FLOW}, n as (select n_nationkey from nation where n_regionkey = 1) select src, dst, w from f where src in (from n)")
def subgraph_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.subgraph(flow(spark, sf_dir), table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("id")), right=False)


@query("neighbour_lists", f"with {FLOW} select src, len(list(dst)) as n, string_agg(dst, ',' order by dst) as neighbours from f group by 1")
def neighbour_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.neighbour_lists(flow(spark, sf_dir)).select("src", F.size("neighbours").cast("long").alias("n"), F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, _ = high_edges(spark, sf_dir)
    return h.select("id", F.array(F.col("i").cast("double"), F.col("j") * 2.0).alias("v"))


@query("euclidean_weights", f"with {HIGH} select src, dst, round(sqrt(pow(a.i - b.i, 2) + pow(2 * (a.j - b.j), 2)), 6) as w from e join h a on a.id = src join h b on b.id = dst")
def euclidean_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.euclidean_weights(high_edges(spark, sf_dir)[1], _points(spark, sf_dir)), "w", places=6)


@query("gaussian_weights", f"with {HIGH}, d as (select src, dst, pow(a.i - b.i, 2) + pow(2 * (a.j - b.j), 2) as d2 from e join h a on a.id = src join h b on b.id = dst) select src, dst, round(exp(-d2 / 2 / (select avg(d2) from d)), 6) as w from d")
def gaussian_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.gaussian_weights(high_edges(spark, sf_dir)[1], _points(spark, sf_dir)), "w", places=6)


REACH = "r as (select id, id as label from h union select e.dst, r.label from r join e on r.id = e.src), c as (select id, min(label) as label from r group by 1)"


@query("is_connected", f"with recursive {HIGH}, {REACH} select count(distinct label) <= 1 as connected from c")
def is_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.is_connected(*high_edges(spark, sf_dir))


@query("main_component", f"with recursive {HIGH}, {REACH} select cast(id as bigint) as id from c where label = (select label from c group by 1 order by count(*) desc, label limit 1)")
def main_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.main_component(*high_edges(spark, sf_dir))


def _seeds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    h, e = high_edges(spark, sf_dir)
    return e, h.where("j % 5 = 0").select("id")


WALK = "r as (select id as seed, id, 0 as d from h where j % 5 = 0 union select r.seed, e.dst, r.d + 1 from r join e on r.id = e.src where r.d < 60), b as (select seed, id, min(d) as d from r group by 1, 2)"


@query("geodesic_voronoi", f"with recursive {HIGH}, {WALK} select cast(id as bigint) as id, cast(min(struct_pack(d := d, s := seed)).s as bigint) as label, min(d)::double as distance from b group by 1")
def geodesic_voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.geodesic_voronoi(*_seeds(spark, sf_dir))


@query("all_distances", f"with recursive {HIGH}, {WALK} select cast(seed as bigint) as seed, cast(id as bigint) as id, d::double as distance from b")
def all_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.all_distances(*_seeds(spark, sf_dir))


#: The values of the high cells.
VALUES = "hv as (select h.id, g.v from h join g using (i, j))"


@query("watershed", f"with recursive {HIGH}, {VALUES}, n as (select src, dst from e union all select id, id from h), u as (select src as id, arg_max(dst, struct_pack(v := hv.v, k := -dst)) as up from n join hv on hv.id = dst group by 1), r as (select id, id as pos from h union select r.id, u.up from r join u on u.id = r.pos), t as (select r.id, r.pos from r join u on u.id = r.pos and u.up = r.pos) select cast(t.id as bigint) as id, cast(pos as bigint) as peak, hv.v as peak_value from t join hv on hv.id = pos")
def watershed(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, e = _field(spark, sf_dir)
    return graphs.watershed(h, e)


def _field(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    h, e = high_edges(spark, sf_dir)
    return h.join(cells(spark, sf_dir), ["i", "j"]).select("id", F.col("v").alias("value")), e


@query(
    "local_maxima",
    f"""with recursive {HIGH}, {VALUES}, n as (select src, dst from e union all select id, id from h), s as (select id, id as pos, 0 as k from h union select s.id, n.dst, s.k + 1 from s join n on n.src = s.pos where s.k < 60),
    x as (select s.id, k, max(v) as v from s join hv on hv.id = s.pos group by 1, 2), w as (select coalesce(max(y.k), 0) as rounds from x y join x z on y.k = z.k + 1 and y.id = z.id and y.v <> z.v),
    a as (select x.id, min(k) filter (x.v > hv.v) - 1 as lost from x join hv on hv.id = x.id group by 1) select cast(id as bigint) as id, cast(coalesce(lost, greatest(1, (select rounds from w))) as int) as depth from a where coalesce(lost, 1) > 0""",
)
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.local_maxima(*_field(spark, sf_dir))


@query("tree_leaves", f"with {TREE} select id, not exists (select 1 from t c where c.parent = t.id and c.id <> c.parent) as leaf, id = parent as root, (select count(*) from t c where c.parent = t.id and c.id <> c.parent) as n from t")
def tree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    return graphs.is_leaf(t).join(graphs.children(t), "id")


UP = "r as (select id, id as up, 0 as s, v from t union all select r.id, t.parent, r.s + 1, r.v from r join t on t.id = r.up and t.id <> t.parent)"


@query("tree_heights", f"with recursive {TREE}, {UP} select up as id, max(s) as height from r group by 1")
def tree_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.depth_from_leaves(tree(spark, sf_dir))


@query("tree_order", f"with recursive {TREE}, {UP}, h as (select up as id, max(s) as height from r group by 1) select id, height, row_number() over (order by height, id) - 1 as place from h")
def tree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.top_down_order(tree(spark, sf_dir))


@query("tree_distances", f"with recursive {TREE}, {UP} select a.id as src, b.id as dst, min(a.s + b.s) as distance from r a join r b on a.up = b.up where a.id between 100 and 103 group by 1, 2")
def tree_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    return graphs.tree_distances(t, t.where("id between 100 and 103"))


@query("subforest", f"with {TREE}, k as (select * from t where id % 3 <> 0) select id, case when parent in (select id from k) then parent else id end as parent from k")
def subforest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    return graphs.subforest(t, t.where("id % 3 <> 0")).select("id", "parent")


@query("simple_branches", f"with recursive {TREE}, q as (select * from t where id < 1000 or id % 2 = 0), c as (select parent as id, count(*) as n from q where id <> parent group by 1), b as (select q.* from q left join c using (id) where coalesce(n, 0) <> 1 or q.id = parent), u as (select id, parent as up, id = parent as root from q union all select u.id, q.parent, q.id = q.parent from u join q on q.id = u.up where not u.root and u.up not in (select id from b)) select b.id, max(case when u.up in (select id from b) then u.up end) as parent from b join u on u.id = b.id group by 1")
def simple_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.merge_simple_branches(tree(spark, sf_dir).where("id < 1000 or id % 2 = 0").select("id", "parent"))


@query("subtree_leaves", f"with {TREE} select exists (select 1 from nation) as yes")
def subtree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of nation 3 are the leaves below it."""
    t = tree(spark, sf_dir)
    return graphs.leaves_of_subtree(t, t.where("parent = 103").select("id"))


@query("propagate_upward", f"with recursive {TREE}, {UP}, l as (select * from r where id >= 1000) select up as id, case when count(distinct v > 0) = 1 then min(v > 0) end as label from l group by 1 union all select t.id, null from t where t.id < 1000 and t.id not in (select up from l) and false")
def propagate_upward(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    kept = t.join(graphs.is_leaf(t).where("leaf and id < 1000").select("id"), "id", "left_anti")
    return graphs.propagate_upward(kept.withColumn("label", F.col("v") > 0), "label")


@query("propagate_upward_and", f"with recursive {TREE}, {UP}, l as (select * from r where id >= 1000) select up as id, bool_and(v > -900) as label from l group by 1")
def propagate_upward_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    kept = t.join(graphs.is_leaf(t).where("leaf and id < 1000").select("id"), "id", "left_anti")
    return graphs.propagate_upward(kept.withColumn("label", F.col("v") > -900), "label", every=True)


@query("opening", f"with {CELLS}, n as (select a.i, a.j, b.v as w from g a join g b on abs(a.i - b.i) + abs(a.j - b.j) = 1), e as (select i, j, min(w) as v from n group by 1, 2) select a.i, a.j, max(b.v) as v from e a join e b on abs(a.i - b.i) + abs(a.j - b.j) <= 1 group by 1, 2")
def opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.opening(cells(spark, sf_dir), ["i", "j"], "v")


@query("closing", f"with {CELLS}, e as (select a.i, a.j, max(b.v) as v from g a join g b on abs(a.i - b.i) + abs(a.j - b.j) <= 1 group by 1, 2) select a.i, a.j, min(b.v) as v from e a join e b on abs(a.i - b.i) + abs(a.j - b.j) = 1 group by 1, 2")
def closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.closing(cells(spark, sf_dir), ["i", "j"], "v")
