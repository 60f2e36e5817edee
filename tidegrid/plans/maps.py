"""Queries: places of the cells of nations and months under affine maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import maps
from .registry import query
from .sampling import rounded
from .space import CELLS, cells

WORLD = maps.AffineMap.of(["i", "j"], ["x", "y"], [[2.0, 0.5, -10.0], [0.0, 1.5, 3.0]])
TURNED = maps.AffineMap.of(["x", "y"], ["u", "w"], [[0.6, -0.8, 1.0], [0.8, 0.6, -2.0]])


@query("affine_places", f"with {CELLS}, w as (select i, j, 2.0 * i + 0.5 * j - 10 as x, 1.5 * j + 3 as y from g) select i, j, round(0.6 * x - 0.8 * y + 1, 6)::double as u, round(0.8 * x + 0.6 * y - 2, 6)::double as w, i::double as bi, j::double as bj from w")
def affine_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps as one, and its inverse, which gives the cell back."""
    both = TURNED.after(WORLD)
    back = both.inverse().renamed({"i": "bi", "j": "bj"})
    return rounded(back.apply(both.apply(cells(spark, sf_dir).select("i", "j"))), "u", "w", "bi", "bj", places=6)


@query("grid_slice", f"with {CELLS} select ((i - 3) // 4)::bigint as i, (11 - j)::bigint as j, v, (2.0 * i + 0.5 * j - 10)::double as x, (1.5 * j + 3)::double as y from g where i >= 3 and i < 20 and (i - 3) % 4 = 0 and j <= 11 and j > 2")
def grid_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth nation from the third, months backwards: numbered anew, at the places they had."""
    kept, place = maps.sliced(cells(spark, sf_dir), WORLD, {"i": (3, 20, 4), "j": (11, 2, -1)})
    return place.apply(kept.withColumn("i", F.col("i").cast("long")))
