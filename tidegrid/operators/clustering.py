"""Agglomerative clustering on graphs, and merge trees of level sets: rounds that merge all reciprocally nearest clusters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stored
from .components import connected_components
from .grid import pointer_roots
from .ordered import ranked

#: Of two clusters' statistics and the payload of the edges between them, what the two clusters cost to merge; the least goes first.
Cost = Callable[[Column, Column, Column], Column]


def agglomerate(edges: DataFrame, cost: Cost, fuse: Callable[[Column, Column], Column], gather: Callable[[Column], Column]) -> DataFrame:
    """(a, b, round, cost): cluster b joins a, a cluster being named by its least vertex, of edges(a, b, sa, sb, w), a < b, once each.

    sa and sb are the statistics of the two ends, w what the edge carries; fuse() gives the statistics of a
    union, gather() aggregates w over the edges between two clusters. Every cluster picks its cheapest
    edge (then the least a, b), and edges picked from both ends merge, all in one round. If merging never
    makes a neighbour cheaper, as for the links below, that is the tree that merging the cheapest pair of
    all, one by one, makes. Where costs are spread at random a round merges a fixed share of the
    clusters, so rounds are the logarithm of their number; a chain of rising costs needs a round a merge.

    A round is two equi-joins and two aggregates over the edges left, written to the shared folder. A
    cluster without edges costs nothing more.
    """
    now, out, turn = stored(edges.select("a", "b", "sa", "sb", "w", cost(F.col("sa"), F.col("sb"), F.col("w")).alias("cost")), "clusters"), None, 0
    while True:
        asked = now.withColumn("s", fuse(F.col("sa"), F.col("sb")))
        best = asked.select(F.explode(F.array("a", "b")).alias("end"), F.struct("cost", "a", "b", "s").alias("pick")).groupBy("end").agg(F.min("pick").alias("pick"))
        merged = best.groupBy("pick.a", "pick.b").agg(F.count("*").alias("n"), F.first("pick.cost").alias("cost"), F.first("pick.s").alias("s")).where("n = 2")
        merged = stored(merged.select("a", "b", F.lit(turn).alias("round"), "cost", "s"), "merges")
        found = merged.drop("s")
        out = found if out is None else out.unionByName(found)
        if merged.isEmpty():
            return out
        moves = merged.select(F.explode(F.array("a", "b")).alias("old"), F.col("a").alias("new"), "s")
        end = lambda c: moves.select(F.col("old").alias(c), F.col("new").alias(f"new_{c}"), F.col("s").alias(f"to_{c}"))
        moved = now.drop("cost").join(end("a"), "a", "left").join(end("b"), "b", "left")
        side = lambda c: F.struct(F.coalesce(f"new_{c}", c).alias("v"), F.coalesce(f"to_{c}", f"s{c}").alias("s"))
        ends = moved.select(side("a").alias("x"), side("b").alias("y"), "w").where("x.v <> y.v")
        first = F.col("x.v") < F.col("y.v")
        pair = ends.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("x"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("y"), "w")
        kept = pair.groupBy(F.col("x.v").alias("a"), F.col("y.v").alias("b")).agg(F.first("x.s").alias("sa"), F.first("y.s").alias("sb"), gather(F.col("w")).alias("w"))
        now, turn = stored(kept.withColumn("cost", cost(F.col("sa"), F.col("sb"), F.col("w"))), "clusters"), turn + 1


def _once(edges: DataFrame, src: str, dst: str, *payload: Column) -> DataFrame:
    """Undirected edges once, without self-loops."""
    return edges.where(F.col(src) != F.col(dst)).groupBy(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).agg(*(payload or [F.lit(None).cast("int").alias("w")]))


def ward(vertices: DataFrame, edges: DataFrame, features: Sequence[str], vertex: str = "id", src: str = "src", dst: str = "dst") -> DataFrame:
    """(a, b, round, height): Ward's clustering of a graph's vertices by their features; only adjacent clusters merge.

    height is the inertia of the union: the sum of squares about its mean. Clusters are held as count,
    sums and sum of squares, about the mean of all vertices, so that offsets cost no digits. Components
    stay apart, and a single vertex has no row. Nulls in a feature leave a vertex out.
    """
    rows = vertices.dropna(subset=[vertex, *features])
    middle = rows.agg(*[F.avg(c).alias(c) for c in features]).first()
    at = [F.col(c).cast("double") - F.lit(middle[c]) for c in features]
    stats = rows.select(F.col(vertex).alias("v"), F.struct(F.lit(1).cast("long").alias("n"), F.array(*at).alias("s"), sum((x * x for x in at), F.lit(0.0)).alias("q")).alias("s"))
    end = lambda c: stats.select(F.col("v").alias(c), F.col("s").alias(f"s{c}"))
    start = _once(edges, src, dst).join(end("a"), "a").join(end("b"), "b")
    fuse = lambda x, y: F.struct((x["n"] + y["n"]).alias("n"), F.zip_with(x["s"], y["s"], lambda u, v: u + v).alias("s"), (x["q"] + y["q"]).alias("q"))
    inertia = lambda x, y, w: x["q"] + y["q"] - F.aggregate(F.zip_with(x["s"], y["s"], lambda u, v: (u + v) * (u + v)), F.lit(0.0), lambda t, u: t + u) / (x["n"] + y["n"])
    return agglomerate(start, inertia, fuse, F.first).withColumnRenamed("cost", "height")


def average_link(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str = "w") -> DataFrame:
    """(a, b, round, height): clusters of a similarity graph merge by the mean similarity of their pairs, the largest first.

    Pairs without an edge count as 0; similarities are not negative. Of repeated edges the largest counts.
    """
    one = F.lit(1).cast("long")
    start = _once(edges, src, dst, F.max(F.col(weight).cast("double")).alias("w")).select("a", "b", one.alias("sa"), one.alias("sb"), "w")
    made = agglomerate(start, lambda x, y, w: -w / (x * y), lambda x, y: x + y, F.sum)
    return made.select("a", "b", "round", (-F.col("cost")).alias("height"))


def cut_tree(vertices: DataFrame, merges: DataFrame, stop: float | None = None, clusters: int | None = None, falling: bool = False, vertex: str = "id") -> DataFrame:
    """(vertex, label): the clusters once merges up to height `stop`, or the first ones that leave so many clusters, are done; label is the cluster's least vertex.

    falling: heights are similarities, and those of at least `stop` are done.
    """
    done = merges
    if stop is not None:
        done = done.where(F.col("height") >= stop if falling else F.col("height") <= stop)
    if clusters is not None:
        keep = max(0, vertices.select(vertex).distinct().count() - clusters)
        order = merges.withColumn("__h", -F.col("height") if falling else F.col("height"))
        done = ranked(order, [], "__h", tie=["round", "a", "b"]).where(F.col("rank") <= keep)
    found = connected_components(done, "a", "b")
    return vertices.select(vertex).distinct().join(found, F.col(vertex) == F.col("node"), "left").select(vertex, F.coalesce("component", vertex).alias("label"))


def dendrogram(vertices: DataFrame, merges: DataFrame, falling: bool = False, vertex: str = "id") -> DataFrame:
    """(node, parent, height): the tree of a clustering. Vertices keep their ids and have a null height; merges are numbered after the largest id, in the order in which they are done; a root is its own parent.

    The merges that one cluster takes part in are ordered in one task.
    """
    least = vertices.agg(F.max(vertex)).first()[0]
    order = merges.withColumn("__h", -F.col("height") if falling else F.col("height"))
    made = ranked(order, [], "__h", tie=["round", "a", "b"]).select("a", "b", "height", (F.col("rank") + F.lit(least)).cast("long").alias("node"))
    leaves = vertices.select(F.col(vertex).alias("cluster")).distinct().select("cluster", F.col("cluster").cast("long").alias("node"), F.lit(None).cast("double").alias("height"), F.lit(-1).cast("long").alias("at"), F.lit(True).alias("own"))
    # a merge is a node of cluster a, and where cluster b ends
    own = made.select(F.col("a").alias("cluster"), "node", "height", F.col("node").alias("at"), F.lit(True).alias("own"))
    end = made.select(F.col("b").alias("cluster"), "node", "height", F.col("node").alias("at"), F.lit(False).alias("own"))
    both = leaves.unionByName(own).unionByName(end)
    parent = F.lead("node").over(Window.partitionBy("cluster").orderBy("at"))
    return both.withColumn("parent", parent).where("own").select("node", F.coalesce("parent", "node").alias("parent"), "height")


def merge_tree(vertices: DataFrame, edges: DataFrame, value: str, threshold: float | None = None, vertex: str = "id", src: str = "src", dst: str = "dst") -> tuple[DataFrame, DataFrame]:
    """(blobs, labels) of the level sets {value >= t} as t falls: blobs(node, birth, parent, death, size) and labels(vertex, label).

    A blob is born at a maximum, or at a saddle where two or more blobs meet; those die there and the
    saddle's blob is their parent. A blob is named by the vertex of its birth; a root is its own parent
    and has a null death. Each vertex belongs to the blob whose part of the level set it joins; size
    counts them. Equal values go by ascending id. Vertices under the threshold, or with a null value, are
    left out.

    Every vertex points to its best neighbour or itself, and pointer jumping gives the basins of the
    maxima. Basins meet at the best of the lower ends of the edges between them, so only the graph of
    basins is merged, by agglomerate(). Its merges at one saddle are one blob. Labels climb from the
    basin's maximum by jumps of halving length, so no vertex meets all its ancestors.
    """
    held = vertices.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    held = held if threshold is None else held.where(F.col(value) >= threshold)
    # the order of the sweep: the least key comes first
    key = F.struct((-F.col(value).cast("double")).alias("down"), F.col(vertex).cast("long").alias("v"))
    points = stored(held.select(F.col(vertex).cast("long").alias("v"), key.alias("k")), "field")
    end = lambda c: points.select(F.col("v").alias(c), F.col("k").alias(f"k{c}"))
    pairs = stored(_once(edges, src, dst).drop("w").join(end("a"), "a").join(end("b"), "b"), "field-edges")
    up = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("kb").alias("k")), F.struct(F.col("b").alias("v"), F.col("ka").alias("k")))).alias("x")).select("x.*").unionByName(points)
    basins = pointer_roots(up.groupBy("v").agg(F.min("k").alias("k")).select(F.col("v").alias("tree"), F.col("k.v").alias("root")))
    side = lambda c: basins.select(F.col("tree").alias(c), F.col("root").alias(f"basin_{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where("basin_a <> basin_b")
    one = F.lit(1)
    start = met.groupBy(F.least("basin_a", "basin_b").alias("a"), F.greatest("basin_a", "basin_b").alias("b")).agg(F.min(F.greatest("ka", "kb")).alias("w")).select("a", "b", one.alias("sa"), one.alias("sb"), "w")
    merges = stored(agglomerate(start, lambda x, y, w: w, lambda x, y: x, F.min).select("a", "b", F.col("cost").alias("k")), "field-merges")
    # clusters are named by their least maximum; the blob of a cluster is the last saddle it has met
    met_at = merges.select(F.explode(F.array("a", "b")).alias("cluster"), "k", F.col("a").alias("into"))
    maxima = basins.where("tree = root").select(F.col("tree").alias("cluster")).join(points, F.col("cluster") == F.col("v")).select("cluster", "k", F.col("cluster").alias("into"))
    line = Window.partitionBy("cluster").orderBy("k")
    steps = maxima.unionByName(met_at).dropDuplicates(["cluster", "k"])
    blobs = steps.select("k", F.lead("k").over(line).alias("next")).groupBy("k").agg(F.min("next").alias("next"))
    nodes = stored(blobs.select(F.col("k.v").alias("node"), F.col("k").alias("born"), "next"), "blobs")
    labels = _climbed(basins.select(F.col("tree").alias("v"), F.col("root").alias("r")).join(points, "v"), nodes)
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    out = nodes.join(sizes, F.col("node") == F.col("label"), "left")
    return out.select("node", (-F.col("born.down")).alias("birth"), F.coalesce("next.v", "node").alias("parent"), (-F.col("next.down")).alias("death"), F.coalesce("size", F.lit(0)).cast("long").alias("size")), labels.withColumnRenamed("v", vertex)


def _climbed(starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(v, label): from r, the furthest ancestor that is born no later than v's own key k; the jumps double until no node has one, then halve."""
    jump = nodes.where("next is not null").select("node", F.col("next").alias("to"))
    jumps: list[DataFrame] = []
    while not jump.isEmpty():
        jumps.append(jump)
        further = jump.select(F.col("node").alias("m"), F.col("to").alias("far"))
        jump = stored(jump.join(further, F.col("to.v") == F.col("m")).select("node", F.col("far").alias("to")), "blob-jumps")
    for up in reversed(jumps):
        moved = starts.join(up.withColumnRenamed("node", "r"), "r", "left")
        starts = moved.select("v", "k", F.when(F.col("to") <= F.col("k"), F.col("to.v")).otherwise(F.col("r")).alias("r"))
    return stored(starts.select("v", F.col("r").alias("label")), "blob-labels")
