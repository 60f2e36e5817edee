"""Masks of grid cells: thresholds, components, votes, morphology and bounds."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .grid import mask_vote, neighbours, offsets
from .ordered import ranked


def gap_threshold(cells: DataFrame, value: str, low: float = 0.2, high: float = 0.9, exclude_zeros: bool = False) -> DataFrame:
    """(threshold): the middle of the first of the widest gaps between values in order, from the share low to the share high of them."""
    rows = cells.select(F.col(value).cast("double").alias("v"))
    r = ranked(rows.where("v <> 0") if exclude_zeros else rows, [], "v").select("v", "rank", "n")
    after = r.select(F.col("v").alias("w"), (F.col("rank") - 1).alias("rank"))
    met = r.where((F.col("rank") > F.floor(F.lit(low) * F.col("n"))) & (F.col("rank") <= F.floor(F.lit(high) * F.col("n")))).join(after, "rank")
    return met.agg(F.max_by((F.col("v") + F.col("w")) / 2, F.struct(F.col("w") - F.col("v"), -F.col("rank"))).alias("threshold"))


def mask_edges(cells: DataFrame, at: Sequence[str], reach: int = 1) -> DataFrame:
    """(src, dst) between neighbouring cells, each named by the struct of its coordinates."""
    here = F.struct(*at)
    return neighbours(cells.withColumn("__here", here), at, "__here", reach).select(here.alias("src"), F.col("neighbour").alias("dst"))


def labelled(cells: DataFrame, at: Sequence[str], reach: int = 1) -> DataFrame:
    """cells with label, the least cell of its component, and size, its number of cells."""
    held = cells.select(*at).distinct().withColumn("__here", F.struct(*at))
    found = connected_components(mask_edges(held.select(*at), at, reach), "src", "dst")
    named = held.join(found, F.col("__here") == F.col("node"), "left").select(*at, F.coalesce("component", "__here").alias("label"))
    sizes = named.groupBy("label").agg(F.count("*").alias("size"))
    return cells.join(named.join(sizes, "label"), list(at))


def largest_component(cells: DataFrame, at: Sequence[str], reach: int = 1) -> DataFrame:
    """The cells of the largest component; of equal ones that of the least cell."""
    l = labelled(cells, at, reach)
    best = l.groupBy("label").agg(F.max("size").alias("size")).agg(F.min(F.struct((-F.col("size")).alias("s"), "label")).alias("b")).select(F.col("b.label").alias("__label"))
    return l.join(F.broadcast(best), F.col("label") == F.col("__label")).select(*cells.columns)


def drop_small_components(cells: DataFrame, at: Sequence[str], least: int, reach: int = 1) -> DataFrame:
    """Cells in components of at least so many cells, with label and size."""
    return labelled(cells, at, reach).where(F.col("size") >= least)


def shrink(cells: DataFrame, at: Sequence[str]) -> DataFrame:
    """Cells of which all nearest neighbours are in the mask."""
    n = neighbours(cells.withColumn("__one", F.lit(1)), at, "__one").groupBy(*at).agg(F.count("*").alias("__n"))
    return cells.join(n.where(F.col("__n") == len(offsets(len(at)))).select(*at), list(at), "left_semi")


def grow(cells: DataFrame, at: Sequence[str]) -> DataFrame:
    """(at): the cells and their nearest neighbours, on the grid or off it."""
    steps = F.array(*[F.struct(*[(F.col(c) + d).alias(c) for c, d in zip(at, o)]) for o in [(0,) * len(at), *offsets(len(at))]])
    return cells.select(F.inline(steps)).distinct()


def open_mask(cells: DataFrame, at: Sequence[str], rounds: int) -> DataFrame:
    """Binary opening: so many rounds of shrinking, then of growing."""
    out = cells.select(*at)
    for _ in range(rounds):
        out = shrink(out, at)
    for _ in range(rounds):
        out = grow(out, at)
    return out


def compute_mask(cells: DataFrame, at: Sequence[str], value: str, low: float = 0.2, high: float = 0.9, largest: bool = True, opening: int = 2, exclude_zeros: bool = False, reference: str | None = None) -> DataFrame:
    """(at) of the cells whose reference (else value) reaches gap_threshold() of the values; then the largest component, then opened."""
    t = F.broadcast(gap_threshold(cells, value, low, high, exclude_zeros))
    out = cells.join(t).where(F.col(reference or value) >= F.col("threshold")).select(*at)
    out = largest_component(out, at) if largest else out
    return open_mask(out, at, opening) if opening else out


def compute_mask_series(volumes: DataFrame, at: Sequence[str], t: str, value: str, **options) -> DataFrame:
    """compute_mask() of the mean over t, null and NaN as 0, judged on the first volume."""
    v = F.nanvl(F.coalesce(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0))
    mean = volumes.groupBy(*at).agg(F.avg(v).alias("__mean"), F.min_by(v, t).alias("__first"))
    return compute_mask(mean, at, "__mean", reference="__first", **options)


def sessions_mask(masks: DataFrame, at: Sequence[str], session: str, share: float = 0.5, largest: bool = True) -> DataFrame:
    """(at) of the cells in more than `share` of the sessions' masks; a share of one asks for all. Then the largest component."""
    out = mask_vote(masks, at, session, share).select(*at)
    return largest_component(out, at) if largest else out


def masked_series(volumes: DataFrame, mask: DataFrame, at: Sequence[str], value: str) -> DataFrame:
    """The rows of volumes in the mask, values that are not finite as 0."""
    x = F.col(value).cast("double")
    finite = F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    return volumes.join(mask.select(*at), list(at), "left_semi").withColumn(value, finite)


def parcels(cells: DataFrame, label: str, groups: DataFrame | None = None, exclude: Sequence = ()) -> DataFrame:
    """cells with parcel: their label, or every parcel of groups(parcel, label) that it belongs to; excluded labels go."""
    kept = cells.where(~F.col(label).isin(list(exclude))) if exclude else cells
    return kept.withColumn("parcel", F.col(label)) if groups is None else kept.join(F.broadcast(groups.select("parcel", F.col("label").alias("__l"))), F.col(label) == F.col("__l")).drop("__l")


def clamp(df: DataFrame, x: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """df with bin: whole numbers whose range fits into the bins are shifted to 0; else values are scaled to 0 .. bins - 1 and rounded half to even."""
    v = F.col(x).cast("double")
    ends = df.groupBy(*by).agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"), F.bool_and(v == F.floor(v)).alias("__whole"))
    j = df.join(ends, list(by)) if by else df.join(F.broadcast(ends))
    scaled = F.rint(F.try_divide(F.lit(bins - 1.0), F.col("__hi") - F.col("__lo")) * (v - F.col("__lo")))
    fits = F.col("__whole") & (F.col("__hi") - F.col("__lo") <= bins - 1)
    return j.withColumn("bin", F.when(fits, v - F.col("__lo")).otherwise(F.coalesce(scaled, F.lit(0.0))).cast("int")).drop("__lo", "__hi", "__whole")


def bounding_box(cells: DataFrame, at: Sequence[str]) -> DataFrame:
    """(c_min, c_end ...): the first cell of each axis and the one after the last."""
    return cells.agg(*[f.alias(f"{c}_{n}") for c in at for n, f in (("min", F.min(c)), ("end", F.max(c) + 1))])


def ideal_spacing(cells: DataFrame, at: Sequence[str], points: int, shape: Sequence[int]) -> list[int]:
    """Steps by axis at which no more than so many cells are taken; again and again the axis that is sampled longest gets a wider step."""
    step = [1] * len(at)
    while True:
        held = cells.where(math_all([F.col(c) % s == 0 for c, s in zip(at, step)])).count()
        if held <= points:
            return step
        longest = max(range(len(at)), key=lambda k: math.ceil(shape[k] / step[k]))
        step[longest] += 1


def math_all(tests: Sequence[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def p_values_ok(df: DataFrame, p: str) -> DataFrame:
    """(ok): whether every p lies between 0 and 1."""
    x = F.col(p)
    return df.agg(F.coalesce(F.bool_and(x.isNotNull() & ~F.isnan(x) & x.between(0.0, 1.0)), F.lit(True)).alias("ok"))
