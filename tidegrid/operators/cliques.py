"""Maximal cliques: neighbours ordered by degree, lists intersected edge by edge, small subgraphs solved apart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def _within(near: dict[int, set[int]]) -> Iterator[list[int]]:
    """Maximal cliques of a small graph; a branch leaves out the neighbours of the vertex that has most of them."""
    todo: list[tuple[list[int], set[int], set[int]]] = [([], set(near), set())]
    while todo:
        held, free, done = todo.pop()
        if not free and not done:
            yield held
        elif free:
            pivot = max(free | done, key=lambda v: (len(near[v] & free), -v))
            for v in sorted(free - near[pivot]):
                todo.append(([*held, v], free & near[v], done & near[v]))
                free, done = free - {v}, done | {v}


def _solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for first, edges in zip(frame["first"], frame["edges"]):
            near: dict[int, set[int]] = {e["b"]: set() for e in edges}
            for e in edges:
                for c in e["common"]:
                    near[e["b"]].add(c)
                    near[c].add(e["b"])
            found = list(_within(near))
            for k in range(0, len(found), 1024):
                yield pd.DataFrame({"first": first, "others": found[k : k + 1024]})


def maximal_cliques(edges: DataFrame, vertices: DataFrame | None = None, vertex: str = "id", src: str = "src", dst: str = "dst") -> DataFrame:
    """(clique, size): the vertices of each maximal clique in ascending order; a vertex of `vertices` without an edge is one of size 1.

    Edges have whole numbers as ends and no direction; loops, repeats and nulls don't count. Vertices are
    ordered by degree, so that none has more than sqrt(2 x edges) later neighbours, hubs included. An edge
    meets the later neighbours of both its ends; a vertex, with these intersections, is one row whose
    cliques are found in a task. Those that an earlier vertex extends go: it is the apex of a triangle over
    the clique's first two vertices, and all of the clique is among its later neighbours.
    """
    e = edges.select(F.col(src).cast("long").alias("x"), F.col(dst).cast("long").alias("y")).dropna().where("x <> y")
    pairs = stored(e.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "cliques")
    degree = pairs.select(F.explode(F.array("x", "y")).alias("v")).groupBy("v").agg(F.count("*").alias("d"))
    placed = pairs.join(degree.select(F.col("v").alias("x"), F.col("d").alias("dx")), "x").join(degree.select(F.col("v").alias("y"), F.col("d").alias("dy")), "y")
    forward = F.struct("dx", "x") < F.struct("dy", "y")
    later = stored(placed.select(F.when(forward, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(forward, F.col("y")).otherwise(F.col("x")).alias("b")), "later")
    lists = stored(later.groupBy("a").agg(F.sort_array(F.collect_list("b")).alias("near")), "near")
    met = later.join(lists, "a").join(lists.select(F.col("a").alias("b"), F.col("near").alias("far")), "b", "left")
    common = stored(met.select("a", "b", F.coalesce(F.array_intersect("near", "far"), F.array().cast("array<long>")).alias("common")), "common")
    groups = common.groupBy(F.col("a").alias("first")).agg(F.collect_list(F.struct("b", "common")).alias("edges"))
    found = groups.mapInPandas(_solved, "first long, others array<long>")
    found = stored(found.select("first", F.array_sort(F.concat(F.array("first"), "others")).alias("clique"), F.array_min("others").alias("second")), "found")
    # both ways round, as the apex is before both
    apex = common.select(F.col("a").alias("u"), "b", F.explode("common").alias("c"))
    apex = apex.select("u", F.explode(F.array(F.struct(F.col("b").alias("first"), F.col("c").alias("second")), F.struct(F.col("c").alias("first"), F.col("b").alias("second")))).alias("e")).select("u", "e.*")
    wider = found.join(apex, ["first", "second"]).join(lists.select(F.col("a").alias("u"), "near"), "u").where(F.size(F.array_intersect("clique", "near")) == F.size("clique"))
    out = found.join(wider.select("clique").distinct(), "clique", "left_anti").select("clique")
    if vertices is not None:
        ends = degree.select(F.col("v").alias("__v"))
        alone = vertices.select(F.col(vertex).cast("long").alias("__v")).dropna().distinct().join(ends, "__v", "left_anti")
        out = out.unionByName(alone.select(F.array("__v").alias("clique")))
    return out.withColumn("size", F.size("clique"))


def largest_cliques(cliques: DataFrame) -> DataFrame:
    """(vertex, cliques, largest): in how many maximal cliques a vertex is, and the size of its largest."""
    return cliques.select(F.explode("clique").alias("vertex"), "size").groupBy("vertex").agg(F.count("*").alias("cliques"), F.max("size").alias("largest"))
