"""Graphs, fields over graphs and forests, as tables of edges (src, dst, w), values (id, value) and parents (id, parent)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from . import vectors
from .grid import ancestors, below, components, distance, pointer_roots
from .ordered import ranked


def cross_knn(x: DataFrame, y: DataFrame, k: int, node: str = "id", vector: str = "v") -> DataFrame:
    """(src, dst, w): the k nearest y of every x, w their squared distance, 1e-15 at least. All pairs are compared, by products of blocks."""
    return vectors.nearest(x, y, k, node, vector).select("src", "dst", F.greatest("d2", F.lit(1e-15)).alias("w"))


def knn(points: DataFrame, k: int, node: str = "id", vector: str = "v") -> DataFrame:
    """(src, dst, w), both ways: pairs of which one is among the k nearest of the other; w is their distance."""
    near = vectors.nearest(points, None, k, node, vector)
    return near.select("src", "dst", "d2", F.explode(F.array(F.lit(False), F.lit(True))).alias("back")).select(F.when(F.col("back"), F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(F.col("back"), F.col("src")).otherwise(F.col("dst")).alias("dst"), F.sqrt("d2").alias("w")).distinct()


def cross_eps(x: DataFrame, y: DataFrame, eps: float, node: str = "id", vector: str = "v") -> DataFrame:
    """(src, dst, w): pairs whose squared distance is below eps, and that distance."""
    return vectors.within(x, y, F.lit(float(eps)), node, vector).select("src", "dst", F.col("d2").alias("w"))


def kernel_density(points: DataFrame, centres: DataFrame, sigma: float, node: str = "id", vector: str = "v") -> DataFrame:
    """(id, density): the sum of Gaussians about the centres at every point."""
    return vectors.gaussians(points, centres, sigma, node, vector)


def nearness(target: DataFrame, data: DataFrame, sigma: float, node: str = "id", vector: str = "v") -> DataFrame:
    """(score): over targets, the mean of exp(-d2 / 2 sigma^2) for the nearest of data."""
    near = vectors.nearest(target, data, 1, node, vector)
    return near.agg(F.coalesce(F.avg(F.exp(-F.col("d2") / (2 * sigma**2))), F.lit(0.0)).alias("score"))


def voronoi_diagram(samples: DataFrame, seeds: DataFrame, node: str = "id", vector: str = "v") -> DataFrame:
    """(src, dst), src < dst: seeds that are the two nearest of some sample."""
    near = vectors.nearest(samples, seeds, 2, node, vector).groupBy("src").agg(F.min("dst").alias("a"), F.max("dst").alias("b"))
    return near.where("a < b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def balls(points: DataFrame, centres: DataFrame, node: str = "id", vector: str = "v", radius: str = "radius") -> DataFrame:
    """(id, label): for points strictly within the radius of a centre its node; of several the last."""
    near = vectors.within(points, centres, F.col(radius) * F.col(radius), node, vector)
    return near.groupBy(F.col("src").alias(node)).agg(F.max("dst").alias("label"))


def degrees(vertices: DataFrame, edges: DataFrame, vertex: str = "id") -> DataFrame:
    """(vertex, right, left): edges from and to each vertex."""
    both = edges.select(F.col("src").alias(vertex), F.lit(1).alias("r"), F.lit(0).alias("l")).union(edges.select("dst", F.lit(0), F.lit(1)))
    n = both.groupBy(vertex).agg(F.sum("r").alias("right"), F.sum("l").alias("left"))
    return vertices.select(vertex).join(n, vertex, "left").na.fill(0, ["right", "left"])


def normalise(edges: DataFrame, c: int = 0) -> DataFrame:
    """Edges with weights over the sum of their source's (0), of their end's (1), or over the root of both (2); a sum of zero gives 0."""
    s = edges.groupBy("src").agg(F.sum("w").alias("__s"))
    d = edges.groupBy("dst").agg(F.sum("w").alias("__d"))
    j = edges.join(s, "src") if c == 0 else edges.join(d, "dst") if c == 1 else edges.join(s, "src").join(d, "dst")
    over = {0: F.col("__s"), 1: F.col("__d"), 2: F.sqrt(F.col("__s") * F.col("__d")) if c == 2 else None}[c]
    return j.select("src", "dst", F.coalesce(F.try_divide(F.col("w"), over), F.lit(0.0)).alias("w"))


def euclidean_weights(edges: DataFrame, points: DataFrame, node: str = "id", vector: str = "v") -> DataFrame:
    p = lambda end, name: points.select(F.col(node).alias(end), F.col(vector).alias(name))
    return edges.select("src", "dst").join(p("src", "__p"), "src").join(p("dst", "__q"), "dst").select("src", "dst", distance(F.col("__p"), F.col("__q")).alias("w"))


def gaussian_weights(edges: DataFrame, points: DataFrame, sigma: float = 0.0, node: str = "id", vector: str = "v") -> DataFrame:
    """Weights exp(-d2 / 2 sigma^2); a sigma of 0 stands for the mean squared distance as sigma squared."""
    e = euclidean_weights(edges, points, node, vector)
    s2 = F.lit(sigma**2) if sigma else F.col("__s2")
    e = e if sigma else e.join(F.broadcast(e.agg(F.avg(F.pow("w", 2)).alias("__s2"))))
    return e.select("src", "dst", F.exp(-F.pow("w", 2) / (2 * s2)).alias("w"))


def symmetrise(edges: DataFrame, anti: bool = False) -> DataFrame:
    """Half of the edges plus (anti: less) their reverses; weights of zero go."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (-F.col("w") if anti else F.col("w")).alias("w"))
    return edges.select("src", "dst", "w").union(back).groupBy("src", "dst").agg((F.sum("w") / 2).alias("w")).where("w <> 0")


def cut_redundancies(edges: DataFrame) -> DataFrame:
    """One edge for each pair of ends; the weights of repeated ones add up."""
    return edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def concatenate(a: DataFrame, b: DataFrame, offset: int) -> DataFrame:
    """Both graphs side by side; b's vertices count from offset on."""
    return a.select("src", "dst", "w").union(b.select(F.col("src") + offset, F.col("dst") + offset, "w"))


def subgraph(edges: DataFrame, valid: DataFrame, vertex: str = "id", left: bool = True, right: bool = True) -> DataFrame:
    """Edges whose source (left), end (right) or both are valid."""
    v = valid.select(F.col(vertex).alias("__v"))
    out = edges.join(v, F.col("src") == F.col("__v"), "left_semi") if left else edges
    return out.join(v, F.col("dst") == F.col("__v"), "left_semi") if right else out


def remove_trivial(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def neighbour_lists(edges: DataFrame) -> DataFrame:
    """(src, neighbours, weights), by end; a vertex's list is one row, so its degree bounds it."""
    pair = F.array_sort(F.collect_list(F.struct("dst", "w")))
    return edges.groupBy("src").agg(pair.alias("__p")).select("src", F.transform("__p", lambda x: x["dst"]).alias("neighbours"), F.transform("__p", lambda x: x["w"]).alias("weights"))


def is_connected(vertices: DataFrame, edges: DataFrame, vertex: str = "id") -> DataFrame:
    """(connected): whether there is one component."""
    return components(vertices, edges, vertex).agg((F.countDistinct("label") <= 1).alias("connected"))


def main_component(vertices: DataFrame, edges: DataFrame, vertex: str = "id") -> DataFrame:
    """(vertex) of the largest component; of equal ones that of the least vertex."""
    l = stored(components(vertices, edges, vertex), "labels")
    best = l.groupBy("label").agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select(F.col("b.label").alias("__label"))
    return l.join(F.broadcast(best), F.col("label") == F.col("__label")).select(vertex)


def geodesic_voronoi(edges: DataFrame, seeds: DataFrame, vertex: str = "id") -> DataFrame:
    """(vertex, label, distance): the seed that is nearest along the edges, of equally near ones the least, by relaxing the vertices that changed."""
    edges = stored(edges.select("src", "dst", "w"), "geodesic-edges")
    best = stored(seeds.select(vertex, F.struct(F.lit(0.0).alias("d"), F.col(vertex).alias("s")).alias("b")), "geodesic")
    front = best
    while not front.isEmpty():
        offered = front.join(edges, F.col(vertex) == F.col("src")).groupBy(F.col("dst").alias("__v")).agg(F.min(F.struct((F.col("b.d") + F.col("w")).alias("d"), F.col("b.s").alias("s"))).alias("__b"))
        met = best.join(offered, F.col(vertex) == F.col("__v"), "full")
        better = F.coalesce(F.col("__b") < F.col("b"), F.col("b").isNull())
        met = stored(met.select(F.coalesce(vertex, "__v").alias(vertex), F.when(better, F.col("__b")).otherwise(F.col("b")).alias("b"), better.alias("__new")), "geodesic")
        best, front = met.drop("__new"), met.where("__new").drop("__new")
    return best.select(vertex, F.col("b.s").alias("label"), F.col("b.d").alias("distance"))


def all_distances(edges: DataFrame, seeds: DataFrame, vertex: str = "id") -> DataFrame:
    """(seed, vertex, distance) for every vertex that a seed reaches: one relaxation for all seeds together."""
    edges = stored(edges.select("src", "dst", "w"), "distance-edges")
    best = stored(seeds.select(F.col(vertex).alias("seed"), vertex, F.lit(0.0).alias("distance")), "distances")
    front = best
    while not front.isEmpty():
        offered = front.join(edges, F.col(vertex) == F.col("src")).groupBy("seed", F.col("dst").alias(vertex)).agg(F.min(F.col("distance") + F.col("w")).alias("__d"))
        met = best.join(offered, ["seed", vertex], "full")
        better = F.col("__d") < F.coalesce("distance", F.lit(float("inf")))
        met = stored(met.select("seed", vertex, F.when(better, F.col("__d")).otherwise(F.col("distance")).alias("distance"), F.coalesce(better, F.lit(False)).alias("__new")), "distances")
        best, front = met.drop("__new"), met.where("__new").drop("__new")
    return best


def highest_neighbour(field: DataFrame, edges: DataFrame, vertex: str = "id", value: str = "value") -> DataFrame:
    """(vertex, top, top_value): of a vertex and those that its edges lead to the one of the highest value, of equal ones the least."""
    v = field.select(F.col(vertex).alias("dst"), F.struct(F.col(value).alias("x"), (-F.col(vertex)).alias("k")).alias("__s"))
    met = edges.select("src", "dst").union(field.select(vertex, vertex)).join(v, "dst").groupBy(F.col("src").alias(vertex)).agg(F.max("__s").alias("__s"))
    return met.select(vertex, (-F.col("__s.k")).alias("top"), F.col("__s.x").alias("top_value"))


def watershed(field: DataFrame, edges: DataFrame, threshold: float = float("-inf"), vertex: str = "id", value: str = "value") -> DataFrame:
    """(vertex, peak, peak_value): the basin of steepest ascent of every vertex above the threshold; its top is the peak."""
    f = field.where(F.col(value) > threshold).select(vertex, value)
    to = highest_neighbour(f, subgraph(edges, f, vertex), vertex, value).select(F.col(vertex).alias("tree"), F.col("top").alias("root"))
    roots = pointer_roots(to)
    tops = f.select(F.col(vertex).alias("peak"), F.col(value).alias("peak_value"))
    return roots.select(F.col("tree").alias(vertex), F.col("root").alias("peak")).join(tops, "peak").select(vertex, "peak", "peak_value")


def local_maxima(field: DataFrame, edges: DataFrame, threshold: float = float("-inf"), vertex: str = "id", value: str = "value") -> DataFrame:
    """(vertex, depth) of the local maxima above the threshold: for how many rounds of taking the largest value around, neighbours' included, the vertex keeps its own.

    Rounds go on while any value changes; a maximum that keeps its value to the end, as the highest of a component, has the number of rounds that changed one, 1 at least.
    """
    f = field.where(F.col(value) > threshold)
    e = stored(subgraph(edges, f, vertex).select("src", "dst"), "maxima-edges")
    now = stored(f.select(vertex, F.col(value).alias("own"), F.col(value).alias("now"), F.lit(0).alias("depth"), F.lit(True).alias("alive")), "maxima")
    rounds = 0
    while True:
        up = e.join(now.select(F.col(vertex).alias("dst"), F.col("now").alias("__n")), "dst").groupBy(F.col("src").alias("__v")).agg(F.max("__n").alias("__n"))
        new = F.greatest("now", F.coalesce("__n", "now"))
        stay = F.col("alive") & (new == F.col("own"))
        now = stored(now.join(up, F.col(vertex) == F.col("__v"), "left").select(vertex, "own", new.alias("now"), F.when(stay, F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"), stay.alias("alive"), (new != F.col("now")).alias("__moved")), "maxima")
        if now.where("__moved").isEmpty():
            break
        rounds += 1
        now = now.drop("__moved")
    depth = F.when(F.col("alive"), F.lit(max(1, rounds))).otherwise(F.col("depth"))
    return now.where("depth > 0").select(vertex, depth.alias("depth"))


def is_leaf(nodes: DataFrame, node: str = "id", parent: str = "parent") -> DataFrame:
    """(node, leaf, root)."""
    held = nodes.where(F.col(node) != F.col(parent)).select(F.col(parent).alias("__p")).distinct()
    return nodes.join(held, F.col(node) == F.col("__p"), "left").select(node, F.col("__p").isNull().alias("leaf"), (F.col(node) == F.col(parent)).alias("root"))


def children(nodes: DataFrame, node: str = "id", parent: str = "parent") -> DataFrame:
    """(node, n): how many children each node has."""
    n = nodes.where(F.col(node) != F.col(parent)).groupBy(F.col(parent).alias("__p")).agg(F.count("*").alias("n"))
    return nodes.select(node).join(n, F.col(node) == F.col("__p"), "left").select(node, F.coalesce("n", F.lit(0)).alias("n"))


def depth_from_leaves(nodes: DataFrame, node: str = "id", parent: str = "parent") -> DataFrame:
    """(node, height): the longest way down to a leaf; leaves have 0."""
    return below(nodes, {}, node, parent)


def subforest(nodes: DataFrame, valid: DataFrame, node: str = "id", parent: str = "parent") -> DataFrame:
    """The valid nodes; those whose parent is not valid become roots."""
    v = valid.select(F.col(node).alias("__v")).distinct()
    kept = nodes.join(v, F.col(node) == F.col("__v"), "left_semi")
    return kept.join(v, F.col(parent) == F.col("__v"), "left").select(*[F.coalesce("__v", node).alias(parent) if c == parent else F.col(c) for c in nodes.columns])


def merge_simple_branches(nodes: DataFrame, node: str = "id", parent: str = "parent") -> DataFrame:
    """The forest without the nodes that have one child: their children go to the nearest node above that stays; a root stays where it is the only one above."""
    n = children(nodes, node, parent)
    stays = (F.col("n") != 1) | (F.col(node) == F.col(parent))
    held = stored(nodes.select(node, parent).join(n, node).select(node, parent, stays.alias("__stays")), "branches")
    # a node that goes points up, one that stays to itself
    to = pointer_roots(held.select(F.col(node).alias("tree"), F.when(F.col("__stays"), F.col(node)).otherwise(F.col(parent)).alias("root")))
    return held.where("__stays").join(to, F.col(parent) == F.col("tree")).select(node, F.col("root").alias(parent))


def tree_distances(nodes: DataFrame, a: DataFrame, node: str = "id", parent: str = "parent") -> DataFrame:
    """(src, dst, distance): steps between each node of a(id) and all nodes of its tree, through the lowest ancestor of both."""
    up = ancestors(nodes, node, parent)
    mine = up.join(a.select(node), node, "left_semi").select(F.col(node).alias("src"), "ancestor", F.col("steps").alias("s"))
    return mine.join(up.select(F.col(node).alias("dst"), "ancestor", "steps"), "ancestor").groupBy("src", "dst").agg(F.min(F.col("s") + F.col("steps")).alias("distance"))


def leaves_of_subtree(nodes: DataFrame, ids: DataFrame, node: str = "id", parent: str = "parent") -> DataFrame:
    """(yes): whether ids are exactly the leaves under some node."""
    leaves = is_leaf(nodes, node, parent).where("leaf").select(node)
    marked = leaves.join(ids.select(F.col(node), F.lit(1).alias("__in")).distinct(), node, "left")
    counted = nodes.select(node, parent).join(marked.withColumn("__leaf", F.lit(1)), node, "left")
    under = below(counted, {"all": ("__leaf", "sum"), "mine": ("__in", "sum")}, node, parent)
    n = ids.select(node).distinct().agg(F.count("*").alias("n"))
    return under.join(F.broadcast(n)).agg(F.coalesce(F.bool_or((F.col("all") == F.col("n")) & (F.col("mine") == F.col("n"))), F.lit(False)).alias("yes"))


def propagate_upward(nodes: DataFrame, label: str, node: str = "id", parent: str = "parent", every: bool = False) -> DataFrame:
    """(node, label) from the leaves' labels: a node has the label of all leaves under it if they agree, else null; every: whether all are true."""
    leaves = is_leaf(nodes, node, parent).where("leaf").select(node)
    held = nodes.select(node, parent).join(nodes.select(node, F.col(label).alias("__l")).join(leaves, node), node, "left")
    under = below(held, {"low": ("__l", "min"), "high": ("__l", "max")}, node, parent)
    return under.select(node, (F.col("low") if every else F.when(F.col("low") == F.col("high"), F.col("low"))).alias(label))


def top_down_order(nodes: DataFrame, node: str = "id", parent: str = "parent") -> DataFrame:
    """(node, height, place): places from the leaves to the roots, by height, then node."""
    h = depth_from_leaves(nodes, node, parent).withColumn("__x", F.col("height").cast("double"))
    return ranked(h, [], "__x", [node]).select(node, "height", (F.col("rank") - 1).alias("place"))
