"""Queries: grids, graphs, regions, similarities and permutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid
from ..operators.ordered import quantile
from ..sources.tables import table
from .registry import query
from .sampling import rounded

#: Grid of nation and month: order totals in thousands.
CELLS = "g as (select c_nationkey as i, month(o_orderdate) as j, round(sum(o_totalprice) / 1000, 5) as v from orders join customer on o_custkey = c_custkey group by 1, 2)"
NEAR = "n as (select a.i, a.j, b.v as w from g a join g b on abs(a.i - b.i) + abs(a.j - b.j) = 1)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.month("o_orderdate").alias("j"), "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("i"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("i", "j").agg(F.round(F.sum("o_totalprice") / 1000, 5).alias("v"))


@query("grid_neighbors", f"with {CELLS}, {NEAR} select i, j, count(*) as n from n group by 1, 2")
def grid_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.neighbours(cells(spark, sf_dir), ["i", "j"], "v").groupBy("i", "j").agg(F.count("*").alias("n"))


@query("dilation", f"with {CELLS}, {NEAR} select g.i, g.j, greatest(any_value(g.v), coalesce(max(w), any_value(g.v))) as v from g left join n on g.i = n.i and g.j = n.j group by 1, 2")
def dilation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.dilation(cells(spark, sf_dir), ["i", "j"], "v")


@query("erosion", f"with {CELLS}, {NEAR} select i, j, min(w) as v from n group by 1, 2")
def erosion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.erosion(cells(spark, sf_dir), ["i", "j"], "v")


@query("diffusion", f"with {CELLS}, {NEAR} select i, j, round(sum(w), 5) as v from n group by 1, 2")
def diffusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.diffusion(cells(spark, sf_dir), ["i", "j"], "v"), "v", places=5)


@query("highest_neighbor", f"with {CELLS}, a as (select a.i, a.j, b.i * 100 + b.j as k, b.v from g a join g b on abs(a.i - b.i) + abs(a.j - b.j) <= 1) select i, j, cast(arg_max(k, struct_pack(v := v, k := -k)) as bigint) as top from a group by 1, 2")
def highest_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir).withColumn("s", F.struct("v", (-(F.col("i") * 100 + F.col("j"))).cast("long").alias("k")))
    return grid.dilation(c, ["i", "j"], "s").select("i", "j", (-F.col("s.k")).alias("top"))


#: Cells above the median, and edges between neighbours.
HIGH = f"{CELLS}, h as (select i, j, i * 100 + j as id from g where v > (select median(v) from g)), e as (select a.id as src, b.id as dst from h a join h b on abs(a.i - b.i) + abs(a.j - b.j) = 1)"


def high_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = cells(spark, sf_dir)
    h = c.join(F.broadcast(quantile(c, [], "v", 0.5, name="m"))).where("v > m").select("i", "j", (F.col("i") * 100 + F.col("j")).cast("long").alias("id"))
    return h, grid.neighbours(h, ["i", "j"], "id").select((F.col("i") * 100 + F.col("j")).cast("long").alias("src"), F.col("neighbour").alias("dst"), F.lit(1.0).alias("w"))


@query("connected_components", f"with recursive {HIGH}, r as (select id, id as label from h union select e.dst, r.label from r join e on r.id = e.src) select cast(id as bigint) as id, cast(min(label) as bigint) as label from r group by 1")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.components(*high_edges(spark, sf_dir))


@query("shortest_path", f"with recursive {HIGH}, r as (select min(id) as id, 0 as d from h union select e.dst, r.d + 1 from r join e on r.id = e.src where r.d < 60) select cast(id as bigint) as id, min(d)::double as distance from r group by 1")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, e = high_edges(spark, sf_dir)
    return grid.shortest_paths(e, h.agg(F.min("id").alias("id")))


@query("euler_characteristic_2d", f"with {HIGH}, t as (select (select count(*) from h) as v, (select count(*) from h a join h b on (b.i - a.i, b.j - a.j) in ((1, 0), (0, 1), (1, 1))) as e, (select count(*) from h a join h b on b.i = a.i + 1 and b.j = a.j + 1 join h c on (c.i = a.i + 1 and c.j = a.j) or (c.i = a.i and c.j = a.j + 1)) as f) select cast(v - e + f as bigint) as ec from t")
def euler_characteristic_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.euler_2d(high_edges(spark, sf_dir)[0])


#: Tree: region r, nation 100 + n, customer 1000 + c.
TREE = "t as (select r_regionkey::bigint as id, r_regionkey::bigint as parent, 0.0::double as v from region union all select 100 + n_nationkey, n_regionkey, 0 from nation union all select 1000 + c_custkey, 100 + c_nationkey, c_acctbal from customer)"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_regionkey").cast("long").alias("parent"), F.lit(0.0).alias("v"))
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long"), F.col("n_regionkey").cast("long"), F.lit(0.0))
    return r.union(n).union(table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000).cast("long"), (F.col("c_nationkey") + 100).cast("long"), F.col("c_acctbal")))


@query("forest_depth", f"with recursive {TREE}, r as (select id, 0 as depth from t where id = parent union all select t.id, r.depth + 1 from t join r on t.parent = r.id and t.id <> t.parent) select id, depth from r")
def forest_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.depths(tree(spark, sf_dir)).select("id", "depth")


@query("subtree_sum", f"with recursive {TREE}, r as (select id, id as ancestor, v from t union all select r.id, t.parent, r.v from r join t on t.id = r.ancestor and t.id <> t.parent) select ancestor as id, round(sum(v), 2) as v from r group by 1")
def subtree_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    return grid.below(t, {"v": ("v", "sum")}).select("id", F.round("v", 2).alias("v"))


@query("eps_graph", "select a.vec_id as src, b.vec_id as dst, round(list_distance(a.embedding::double[], b.embedding::double[]), 5) as w from embeddings a join embeddings b on a.vec_id < b.vec_id where list_distance(a.embedding::double[], b.embedding::double[]) < 1.2")
def eps_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.eps_graph(table(spark, sf_dir, "embeddings"), 1.2, "vec_id", "embedding"), "w", places=5)


#: The first five vectors are the centres.
@query("voronoi", "with c as (select vec_id - (select min(vec_id) from embeddings) as k, embedding::double[] as c from embeddings order by vec_id limit 5) select vec_id, cast(arg_min(k, struct_pack(d := round(list_distance(embedding::double[], c), 9), k := k)) as int) as label from embeddings, c group by 1")
def voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    centres = [r.embedding for r in e.orderBy("vec_id").limit(5).collect()]
    return e.select("vec_id", grid.nearest(F.col("embedding"), centres)["index"].alias("label"))


def _lloyd_sql(rounds: int = 5) -> str:
    parts = ["v as (select vec_id, embedding::double[] as e from embeddings)", "c0 as (select row_number() over (order by vec_id) - 1 as k, e as c from v order by vec_id limit 5)"]
    label = "l{r} as (select vec_id, any_value(e) as e, arg_min(k, struct_pack(d := list_distance(e, c), k := k)) as k from v, c{r} group by 1)"
    for r in range(rounds):
        parts.append(label.format(r=r))
        parts.append(f"m{r} as (select k, list(m order by d) as c from (select k, d, avg(e[d]) as m from l{r}, range(1, 65) t(d) group by 1, 2) group by 1)")
        parts.append(f"c{r + 1} as (select c{r}.k, coalesce(m{r}.c, c{r}.c) as c from c{r} left join m{r} on m{r}.k = c{r}.k)")
    return f"with {', '.join(parts)}, {label.format(r=rounds)} select vec_id, cast(k as int) as label from l{rounds}"


@query("kmeans_fixed_init", _lloyd_sql())
def kmeans_fixed_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    centres = grid.kmeans(e, "embedding", [list(r.embedding) for r in e.orderBy("vec_id").limit(5).collect()], 5)
    return e.select("vec_id", grid.nearest(F.col("embedding"), centres)["index"].alias("label"))


@query("mask_vote", "with m as (select l_partkey as part, year(l_shipdate) as session from lineitem group by 1, 2), n as (select count(distinct session) as n from m) select part, count(*) as votes from m, n group by part, n having count(*) > 0.8 * n")
def mask_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.year("l_shipdate").alias("session"))
    return grid.mask_vote(m, ["part"], "session", 0.8)


@query("parcel_mean", "select p_brand as parcel, s_nationkey as subject, count(*) as population, round(avg(l_extendedprice), 3) as mean, min(l_extendedprice) as min, max(l_extendedprice) as max, round(sum(l_extendedprice * l_quantity), 2) as integral from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey group by 1, 2")
def parcel_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("parcel"))
    j = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("subject")), F.col("l_suppkey") == F.col("s_suppkey"))
    x = "l_extendedprice"
    return j.groupBy("parcel", "subject").agg(F.count("*").alias("population"), F.round(F.avg(x), 3).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), F.round(F.sum(F.col(x) * F.col("l_quantity")), 2).alias("integral"))


HIST = "b as (select cast(floor(l_quantity / 5) as bigint) as a, cast(floor(l_extendedprice / 8000) as bigint) as b from lineitem)"


def binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_quantity") / 5).alias("a"), F.floor(F.col("l_extendedprice") / 8000).alias("b"))


@query("joint_hist", f"with {HIST} select a, b, count(*) as n from b group by 1, 2")
def joint_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.joint_histogram(binned(spark, sf_dir), "a", "b")


@query(
    "histogram_similarity",
    f"""with {HIST}, j as (select a, b, count(*) as n from b group by 1, 2), pa as (select a, sum(n) as na, sum(n * b) / sum(n) as mb from j group by 1), pb as (select b, sum(n) as nb from j group by 1), t as (select sum(n)::double as t from j),
    s as (select sum(n / t * ln(n * t / na / nb)) as mi, -sum(n / t * ln(n / t)) as hab, -sum(n / t * ln(na / t)) as ha, -sum(n / t * ln(nb / t)) as hb, sum(n / t * mb * mb) as between_ from j join pa using (a) join pb using (b), t), c as (select corr(a, b) as c, avg(b) as m, var_pop(b) as v from b)
    select round(mi, 6) as mi, round((ha + hb) / hab, 6) as nmi, round(c * c, 6) as cc2, round((between_ - m * m) / v, 6) as cr from s, c""",
)
def histogram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.similarity(joint_hist(spark, sf_dir), "a", "b"), "mi", "nmi", "cc2", "cr", places=6)


FLIPS = [0, 1, 5, 42, 85, 127]


@query(
    "perm_max_t",
    f"""with y as (select p_brand as unit, year(l_shipdate) - 1992 as s, avg(l_extendedprice) - 38000 as y from lineitem join part on l_partkey = p_partkey group by 1, 2), f as (select unnest({FLIPS}) as flip),
    t as (select flip, unit, avg(y * (1 - 2 * ((flip >> s) & 1))) / stddev_pop(y * (1 - 2 * ((flip >> s) & 1))) * sqrt(count(*) - 1) as t from y, f group by 1, 2) select cast(flip as bigint) as flip, round(max(t), 5) as max_t from t group by 1""",
)
def perm_max_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_partkey", (F.year("l_shipdate") - 1992).alias("s"), "l_extendedprice")
    y = items.join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("unit")), F.col("l_partkey") == F.col("p_partkey")).groupBy("unit", "s").agg((F.avg("l_extendedprice") - 38000).alias("y"))
    return rounded(grid.sign_flip_max_t(y, "unit", "s", "y", FLIPS), "max_t", places=5)


@query("pca_covariance", "with v as (select user_id as u, event_type as k, avg(value) as y from events group by 1, 2), c as (select u, k, y - avg(y) over (partition by k) as y from v) select a.k as k1, b.k as k2, round(sum(a.y * b.y), 3) as cov from c a join c b on a.u = b.u group by 1, 2")
def pca_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("u"), F.col("event_type").alias("k")).agg(F.avg("value").alias("y"))
    c = v.join(v.groupBy("k").agg(F.avg("y").alias("m")), "k").select("u", "k", (F.col("y") - F.col("m")).alias("y"))
    # a unit has one row for each of a few kinds
    return c.alias("a").join(c.alias("b"), "u").groupBy(F.col("a.k").alias("k1"), F.col("b.k").alias("k2")).agg(F.round(F.sum(F.col("a.y") * F.col("b.y")), 3).alias("cov"))
