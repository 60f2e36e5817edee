"""Connected components by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component) for every node of the undirected edges; component is the smallest node reachable.

    Alternates large-star and small-star rounds. A round moves the edges through two shuffles, each
    aggregated before the shuffle, and is written to the shared folder, so lineage stays short. Only
    counts come to the driver. Self-loops and null ends are ignored; no edges give no rows.
    """
    now = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = stored(now, "edges"), None

    def star(e: DataFrame, large: bool) -> DataFrame:
        pairs = e.union(e.select("v", "u")) if large else e
        lowest = pairs.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        joined = pairs.join(lowest, "u")
        if large:
            moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
        return moved.where("u <> v").distinct()

    while True:
        now = stored(star(star(now, True), False), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v"))).distinct()
