"""Grids and graphs: neighbour joins, morphology, components, shortest paths, trees and masks."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from . import vectors
from .components import connected_components


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut, and its size estimate with it, through a table in the shared folder."""
    return stored(df, "cut")


def offsets(dims: int, reach: int = 1) -> list[tuple[int, ...]]:
    """Steps to neighbours that differ in at most `reach` coordinates: 2 x dims of them for 1; 18 and 26 for 2 and 3 in three dimensions."""
    return [o for o in itertools.product((-1, 0, 1), repeat=dims) if 0 < sum(map(abs, o)) <= reach]


def neighbours(cells: DataFrame, at: Sequence[str], value: str, reach: int = 1) -> DataFrame:
    """(at, neighbour value): a row for each cell and neighbour that exists, by one equi-join on shifted coordinates."""
    steps = F.array(*[F.struct(*[F.lit(d).alias(c) for c, d in zip(at, o)]) for o in offsets(len(at), reach)])
    moved = cells.select(F.explode(F.transform(steps, lambda s: F.struct(*[(F.col(c) + s[c]).alias(c) for c in at]))).alias("__to"), F.col(value).alias("neighbour"))
    return moved.select("__to.*", "neighbour").join(cells.select(*at), list(at), "left_semi")


def dilation(cells: DataFrame, at: Sequence[str], value: str, reach: int = 1) -> DataFrame:
    """Largest value of a cell and its neighbours."""
    own = cells.select(*at, F.col(value).alias("neighbour"))
    return neighbours(cells, at, value, reach).unionByName(own).groupBy(*at).agg(F.max("neighbour").alias(value))


def erosion(cells: DataFrame, at: Sequence[str], value: str, reach: int = 1) -> DataFrame:
    """Smallest value of a cell's neighbours, itself left out; a cell without any is left out."""
    return neighbours(cells, at, value, reach).groupBy(*at).agg(F.min("neighbour").alias(value))


def diffusion(cells: DataFrame, at: Sequence[str], value: str, reach: int = 1) -> DataFrame:
    """Sum of the neighbours' values."""
    return neighbours(cells, at, value, reach).groupBy(*at).agg(F.sum("neighbour").alias(value))


def opening(cells: DataFrame, at: Sequence[str], value: str, rounds: int = 1, reach: int = 1) -> DataFrame:
    """So many erosions, then as many dilations."""
    for _ in range(rounds):
        cells = erosion(cells, at, value, reach)
    for _ in range(rounds):
        cells = dilation(cells, at, value, reach)
    return cells


def closing(cells: DataFrame, at: Sequence[str], value: str, rounds: int = 1, reach: int = 1) -> DataFrame:
    """So many dilations, then as many erosions."""
    for _ in range(rounds):
        cells = dilation(cells, at, value, reach)
    for _ in range(rounds):
        cells = erosion(cells, at, value, reach)
    return cells


def components(vertices: DataFrame, edges: DataFrame, vertex: str = "id", src: str = "src", dst: str = "dst") -> DataFrame:
    """(vertex, label): label is the least vertex of its component, by star contraction; a vertex without edges is its own."""
    found = connected_components(edges, src, dst)
    return vertices.select(vertex).distinct().join(found, F.col(vertex) == F.col("node"), "left").select(vertex, F.coalesce("component", vertex).alias("label"))


def shortest_paths(edges: DataFrame, seeds: DataFrame, vertex: str = "id", src: str = "src", dst: str = "dst", weight: str = "w") -> DataFrame:
    """(vertex, distance) of every vertex that the seeds reach, by relaxing the vertices that changed in the round before."""
    edges = cut(edges.select(src, dst, weight))
    best = cut(seeds.select(vertex, F.lit(0.0).alias("distance")))
    front = best
    while front.limit(1).count():
        offered = front.join(edges, F.col(vertex) == F.col(src)).groupBy(F.col(dst).alias("__v")).agg(F.min(F.col("distance") + F.col(weight)).alias("__d"))
        met = best.join(offered, F.col(vertex) == F.col("__v"), "full")
        better = F.col("__d") < F.coalesce("distance", F.lit(float("inf")))
        met = cut(met.select(F.coalesce(vertex, "__v").alias(vertex), F.when(better, F.col("__d")).otherwise(F.col("distance")).alias("distance"), F.coalesce(better, F.lit(False)).alias("__new")))
        best, front = met.drop("__new"), met.where("__new").drop("__new")
    return best


def spanning_forest(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str = "w") -> DataFrame:
    """(src, dst, w), src < dst: the edges of a minimum spanning forest; of equal weights the least (src, dst) goes first.

    Every round each tree takes its least edge to another tree. These picks are a pointer forest once
    the smaller of two trees that picked each other stays, and pointer jumping joins the trees, which
    at least halves their number. Only edges between different trees go into the next round. Rounds
    are written out, and only emptiness is asked for. Self-loops are ignored.
    """
    ends = (F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst"))
    left = edges.where(F.col(src) != F.col(dst)).groupBy(*ends).agg(F.min(weight).alias("w"))
    left, out = stored(left.select("src", "dst", "w", F.col("src").alias("a"), F.col("dst").alias("b")), "forest-edges"), None
    while True:
        side = lambda t, o: F.struct(F.col(t).alias("tree"), F.struct("w", "src", "dst", F.col(o).alias("other")).alias("pick"))
        picks = left.select(F.inline(F.array(side("a", "b"), side("b", "a")))).groupBy("tree").agg(F.min("pick").alias("pick")).select("tree", "pick.*")
        picks = stored(picks, "forest-picks")
        found = picks.select("src", "dst", "w").distinct()
        out = found if out is None else out.unionByName(found)
        if picks.isEmpty():
            return out
        back = picks.select(F.col("tree").alias("other"), F.col("other").alias("theirs"))
        to = picks.join(back, "other").select("tree", F.when((F.col("theirs") == F.col("tree")) & (F.col("tree") < F.col("other")), F.col("tree")).otherwise(F.col("other")).alias("root"))
        roots = pointer_roots(to)
        end = lambda t: roots.select(F.col("tree").alias(t), F.col("root").alias(f"{t}_root"))
        left = left.join(end("a"), "a").join(end("b"), "b").where("a_root <> b_root")
        left = stored(left.select("src", "dst", "w", F.col("a_root").alias("a"), F.col("b_root").alias("b")), "forest-edges")


def pointer_roots(to: DataFrame, node: str = "tree", root: str = "root") -> DataFrame:
    """(node, root) of a pointer forest in which roots point to themselves, by pointer jumping: rounds are the logarithm of its depth."""
    now = stored(to.select(node, root), "pointers")
    while True:
        up = now.select(F.col(node).alias("__n"), F.col(root).alias("__r"))
        moved = stored(now.join(up, F.col(root) == F.col("__n")).select(node, F.col("__r").alias(root), (F.col("__r") != F.col(root)).alias("__moved")), "pointers")
        now = moved.drop("__moved")
        if moved.where("__moved").isEmpty():
            return now


def ancestors(nodes: DataFrame, node: str = "id", parent: str = "parent") -> DataFrame:
    """(node, ancestor, steps): every node with itself and all those above it; a root is its own parent.

    Jumps of 1, 2, 4, ... steps are joined to what was found before, so the rounds are the logarithm of the depth.
    """
    jump = nodes.where(F.col(node) != F.col(parent)).select(F.col(node).alias("__n"), F.col(parent).alias("__p"))
    out, size = nodes.select(node, F.col(node).alias("ancestor"), F.lit(0).alias("steps")), 1
    while not jump.isEmpty():
        further = out.join(jump, F.col("ancestor") == F.col("__n")).select(node, F.col("__p").alias("ancestor"), (F.col("steps") + size).alias("steps"))
        out = stored(out.union(further), "ancestors")
        jump = stored(jump.join(jump.select(F.col("__n").alias("__p"), F.col("__p").alias("__q")), "__p").select("__n", F.col("__q").alias("__p")), "jumps")
        size *= 2
    return out


def below(nodes: DataFrame, values: dict[str, tuple[str, str]], node: str = "id", parent: str = "parent") -> DataFrame:
    """(node, height, <name>...): the longest way down to a leaf, and for each name a (column, "sum", "min" or "max") of the node and all those below it; nulls don't count. A root is its own parent.

    A node holds what lies less than 1, 2, 4, ... steps below it and gives it to the node that many steps
    above, so rounds are the logarithm of the depth and each works on one row a node.
    """
    agg = {"sum": F.sum, "min": F.min, "max": F.max}
    both = {"sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), "min": F.least, "max": F.greatest}
    up = F.when(F.col(node) != F.col(parent), F.col(parent))
    now = stored(nodes.select(F.col(node).alias("__n"), up.alias("__p"), F.lit(0).alias("__h"), *[F.col(c).alias(f"__v{k}") for k, (c, _) in enumerate(values.values())]), "below")
    size = 1
    while not now.where("__p is not null").isEmpty():
        given = now.where("__p is not null").groupBy(F.col("__p").alias("__n")).agg((F.max("__h") + size).alias("__gh"), *[agg[how](f"__v{k}").alias(f"__g{k}") for k, (_, how) in enumerate(values.values())])
        above = now.where("__p is not null").select(F.col("__n").alias("__p"), F.col("__p").alias("__q"))
        met = now.join(given, "__n", "left").join(above, "__p", "left")
        mixed = [both[how](F.col(f"__v{k}"), F.col(f"__g{k}")).alias(f"__v{k}") for k, (_, how) in enumerate(values.values())]
        now = stored(met.select("__n", F.col("__q").alias("__p"), F.greatest("__h", F.coalesce("__gh", "__h")).alias("__h"), *mixed), "below")
        size *= 2
    return now.select(F.col("__n").alias(node), F.col("__h").alias("height"), *[F.col(f"__v{k}").alias(c) for k, c in enumerate(values)])


def depths(nodes: DataFrame, node: str = "id", parent: str = "parent") -> DataFrame:
    """(node, root, depth): the steps up to the root, by pointer jumping with one row a node; a root is its own parent."""
    now = stored(nodes.select(F.col(node).alias("__n"), F.col(parent).alias("__r"), (F.col(node) != F.col(parent)).cast("int").alias("__d")), "depths")
    while True:
        up = now.select(F.col("__n").alias("__r"), F.col("__r").alias("__q"), F.col("__d").alias("__e"))
        moved = stored(now.join(up, "__r").select("__n", F.col("__q").alias("__r"), (F.col("__d") + F.col("__e")).alias("__d"), (F.col("__q") != F.col("__r")).alias("__m")), "depths")
        now = moved.drop("__m")
        if moved.where("__m").isEmpty():
            return now.select(F.col("__n").alias(node), F.col("__r").alias("root"), F.col("__d").alias("depth"))


#: Points that a task meets with one block of others at most, in a join of vectors.
VECTOR_BLOCK = 4_000
#: Points, the least by node, whose distances to the others bound the distances of pairs.
PIVOTS = 6
#: How many pairs a product of blocks compares in the time that a join takes for one.
FASTER = 100


def eps_graph(points: DataFrame, eps: float, node: str, vector: str) -> DataFrame:
    """(src, dst, w), src < dst, of points less than eps apart.

    Distances to the origin and to a few pivots differ by less than eps if a pair's distance does. The
    one with the widest spread gives bands of width eps, an equi-join on same or neighbouring bands;
    the others drop pairs before their distance is taken. Bands of many points are split into blocks
    that meet the band apart, so no task holds a whole band. Where eps is as wide as the spread, as
    for unit vectors, no band prunes: all pairs are compared then, by products of blocks.
    """
    held = [r[vector] for r in points.orderBy(node).limit(PIVOTS).select(vector).collect()]
    held = [p for p in held if p is not None and all(v is not None and math.isfinite(v) for v in p)]
    norm = F.sqrt(F.aggregate(F.col(vector).cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    marks = F.array(norm, *[distance(F.col(vector), F.array(*[F.lit(float(x)) for x in p])) for p in held])
    # marks that overflow are alike, as are those that aren't numbers, which end with the distance
    marked = points.select(node, vector, F.transform(marks, lambda m: F.least(m, F.lit(1e150))).alias("__d"))
    spread = marked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.array_max("__d")), F.lit(0.0)).alias("top"), *[F.coalesce(F.stddev_pop(F.col("__d")[k]), F.lit(0.0)).alias(f"s{k}") for k in range(len(held) + 1)]).first()
    key = max(range(len(held) + 1), key=lambda k: spread[f"s{k}"])
    # marks are rounded
    wide = eps * (1 + 1e-9) + 1e-13 * spread["top"]
    banded = marked.withColumn("__band", F.floor(F.least(F.col("__d")[key] / wide, F.lit(1e15))))
    sizes = banded.groupBy("__band").agg(F.count("*").cast("double").alias("m"))
    beside = sizes.select(F.explode(F.array(F.col("__band") - 1, F.col("__band"), F.col("__band") + 1)).alias("__band"), F.col("m").alias("k"))
    met = sizes.join(beside, "__band").agg(F.coalesce(F.sum(F.col("m") * F.col("k")), F.lit(0.0)).alias("met")).first().met
    if FASTER * met > float(spread["n"]) ** 2:
        near = vectors.within(points, None, F.lit(float(eps) ** 2 * (1 + 1e-12)), node, vector)
        return near.select("src", "dst", F.sqrt("d2").alias("w")).where(F.col("w") < eps)
    blocks = max(1, math.ceil(spread["n"] / VECTOR_BLOCK))
    banded = banded.withColumn("__block", F.pmod(F.xxhash64(node), F.lit(blocks)))
    near = F.explode(F.array(F.col("__band") - 1, F.col("__band"), F.col("__band") + 1))
    other = banded.select(F.col(node).alias("dst"), F.col(vector).alias("__w"), F.col("__d").alias("__e"), near.alias("__band")).withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = banded.join(other, ["__band", "__block"]).where(F.col(node) < F.col("dst"))
    met = met.where(F.forall(F.zip_with("__d", "__e", lambda x, y: F.abs(x - y)), lambda x: x < wide))
    return met.select(F.col(node).alias("src"), "dst", distance(F.col(vector), F.col("__w")).alias("w")).where(F.col("w") < eps)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def nearest(vector: Column, centres: list[list[float]]) -> Column:
    """struct(distance, index) of the nearest of a few centres; the first wins ties."""
    each = [F.named_struct(F.lit("distance"), distance(vector, F.array(*[F.lit(float(x)) for x in c])), F.lit("index"), F.lit(k)) for k, c in enumerate(centres)]
    return F.least(*each) if len(each) > 1 else each[0]


def kmeans(points: DataFrame, vector: str, centres: list[list[float]], rounds: int) -> list[list[float]]:
    """Centres after a number of Lloyd rounds; only the sums of each centre and coordinate come to the driver. An empty centre stays."""
    for _ in range(rounds):
        held = points.select(nearest(F.col(vector), centres)["index"].alias("c"), F.posexplode(vector).alias("d", "x"))
        new = [list(c) for c in centres]
        for r in held.groupBy("c", "d").agg(F.avg("x").alias("m")).collect():
            new[r.c][r.d] = r.m
        centres = new
    return centres


def mask_vote(masks: DataFrame, at: Sequence[str], session: str, share: float) -> DataFrame:
    """Cells in more than `share` of the sessions; a share of one asks for all of them."""
    n = masks.agg(F.countDistinct(session)).first()[0]
    votes = masks.groupBy(*at).agg(F.countDistinct(session).alias("votes"))
    return votes.where(F.col("votes") > min(share, 1 - 1e-7) * n)


def euler_2d(cells: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    """(ec): vertices less edges plus faces of the squares' closure, cells being vertices of a grid cut into triangles."""
    c = cells.select(F.col(i).alias("i"), F.col(j).alias("j")).distinct()
    # faces of the triangulated grid, each named by its least corner
    shapes = [[(0, 0)], [(0, 0), (1, 0)], [(0, 0), (0, 1)], [(0, 0), (1, 1)], [(0, 0), (1, 0), (1, 1)], [(0, 0), (0, 1), (1, 1)]]
    found = c.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("i") - a).alias("i"), (F.col("j") - b).alias("j")) for k, s in enumerate(shapes) for a, b in s])).alias("x")).select("x.*")
    whole = found.groupBy("k", "i", "j").agg(F.count("*").alias("n"))
    size = F.element_at(F.array(*[F.lit(len(s)) for s in shapes]), F.col("k") + 1)
    sign = F.element_at(F.array(*[F.lit((-1) ** (len(s) - 1)) for s in shapes]), F.col("k") + 1)
    return whole.where(F.col("n") == size).agg(F.coalesce(F.sum(sign), F.lit(0)).alias("ec"))


def joint_histogram(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n)."""
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def similarity(hist: DataFrame, a: str, b: str) -> DataFrame:
    """(mi, nmi, cc2, cr): mutual information, its normalised form, squared correlation and correlation ratio of b given a, of a joint histogram; null where a variable is constant."""
    total = F.broadcast(hist.agg(F.sum("n").alias("__n")))
    pa = hist.groupBy(a).agg(F.sum("n").alias("__na"), (F.sum(F.col("n") * F.col(b)) / F.sum("n")).alias("__mb"))
    pb = hist.groupBy(b).agg(F.sum("n").alias("__nb"))
    h = hist.join(pa, a).join(pb, b).join(total)
    p = F.col("n") / F.col("__n")
    log = lambda x: F.log(x / F.col("__n"))
    s = h.agg(
        F.sum(p * (log(F.col("n")) - log(F.col("__na")) - log(F.col("__nb")))).alias("mi"), (-F.sum(p * log(F.col("n")))).alias("hab"), (-F.sum(p * log(F.col("__na")))).alias("ha"), (-F.sum(p * log(F.col("__nb")))).alias("hb"),
        F.sum(p * F.col(a)).alias("ma"), F.sum(p * F.col(b)).alias("mb"), F.sum(p * F.col(a) * F.col(a)).alias("aa"), F.sum(p * F.col(b) * F.col(b)).alias("bb"), F.sum(p * F.col(a) * F.col(b)).alias("ab"), F.sum(p * F.col("__mb") * F.col("__mb")).alias("between"),
    )
    va, vb = F.col("aa") - F.pow("ma", 2), F.col("bb") - F.pow("mb", 2)
    div = F.try_divide
    return s.select("mi", div(F.col("ha") + F.col("hb"), F.col("hab")).alias("nmi"), div(F.pow(F.col("ab") - F.col("ma") * F.col("mb"), 2), va * vb).alias("cc2"), div(F.col("between") - F.pow("mb", 2), vb).alias("cr"))


def sign_flip_max_t(df: DataFrame, unit: str, subject: str, y: str, flips: Sequence[int]) -> DataFrame:
    """(flip, max_t): largest t over units after the subjects' signs are set by the bits of each flip; subjects count from 0."""
    each = df.withColumn("flip", F.explode(F.array(*[F.lit(f).cast("long") for f in flips])))
    sign = F.when(F.call_function("shiftright", F.col("flip"), F.col(subject).cast("int")).bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0)
    t = each.groupBy("flip", unit).agg(F.try_divide(F.avg(sign * F.col(y)) * F.sqrt(F.count("*") - 1), F.stddev_pop(sign * F.col(y))).alias("t"))
    return t.groupBy("flip").agg(F.max("t").alias("max_t"))
