"""Pairs of vectors: nearest ones, those within a radius and sums of Gaussians, by products of blocks in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Numbers in the vectors of a block at most, rows of one at least, and blocks of a side where those allow.
BLOCK_NUMBERS, LEAST_ROWS, BLOCKS = 2**20, 512, 8
#: Pairs whose products a task holds at once, and pairs whose distances it sums at once.
CELLS, SUMMED = 2**21, 2**14

Side = tuple[pa.Array, np.ndarray, np.ndarray]


def nearest(x: DataFrame, y: DataFrame | None, k: int, node: str, vector: str) -> DataFrame:
    """(src, dst, d2): the k nearest y of every x by squared distance, of equal distances the least dst; pairs without a distance come last. Without y, others of x."""
    kind, alone = x.schema[node].dataType.simpleString(), y is None

    def work(a: Side, b: Side) -> Iterator[pa.RecordBatch]:
        ids, u, full = a
        order = pc.rank(b[0], tiebreaker="dense").to_numpy()
        # equal nodes lie in one block
        apart = alone and ids is b[0]
        whole = np.flatnonzero(b[2])
        kept = whole[_few(b[1][whole], order[whole], k, apart)]
        v = b[1][kept]
        least = np.flatnonzero(~b[2])[np.argsort(order[~b[2]], kind="stable")]
        for rows, low, slack in _lower(u, v):
            # the least of each of some groups of columns bound the k-th from above
            if apart:
                low[order[rows.start : rows.stop, None] == order[kept]] = np.inf
            groups = min(low.shape[1] // 8, 64 * k)
            if groups >= k:
                tops = low[:, : low.shape[1] // groups * groups].reshape(len(rows), -1, groups).min(axis=1)
                top = np.partition(tops, k - 1, axis=1)[:, k - 1] + slack
                i, j = np.nonzero(~(low > top[:, None]))
            else:
                i, j = (c.ravel() for c in np.indices(low.shape))
            good = full[rows.start + i]
            i, j = rows.start + i[good], kept[j[good]]
            if apart:
                differ = order[i] != order[j]
                i, j = i[differ], j[differ]
            d = _squared(u, b[1], i, j)
            by = np.lexsort((order[j], d, i))
            i, j, d = i[by], j[by], d[by]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.empty(0, int)
            sizes = np.diff(np.r_[first, len(i)])
            at = np.arange(len(i)) - np.repeat(first, sizes)
            i, j, d = i[at < k], j[at < k], d[at < k]
            yield _batch(ids, b[0], i, j, d)
            # where too few have a distance, the least of the others
            lacking = np.setdiff1d(np.arange(rows.start, rows.stop), i[np.flatnonzero(at[at < k] == k - 1)])
            for one in lacking if len(least) or not full.all() else ():
                rest = least if full[one] else np.argsort(order, kind="stable")
                other = (rest[order[rest] != order[one]] if apart else rest)[:k]
                yield _batch(ids, b[0], np.full(len(other), one), other, np.full(len(other), np.nan), True)

    few = _met(x, y, node, vector, work, f"src {kind}, dst {kind}, d2 double", both=True)
    order = Window.partitionBy("src").orderBy(F.col("d2").asc_nulls_last(), "dst")
    return few.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= k).drop("__k")


def within(x: DataFrame, y: DataFrame | None, limit: Column, node: str, vector: str) -> DataFrame:
    """(src, dst, d2): pairs whose squared distance is below the limit, a column of y or a constant. Without y, src < dst of x."""
    kind = x.schema[node].dataType.simpleString()

    def work(a: Side, b: Side, bound: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, u, full = a
        inner = ids is b[0]
        for rows, low, _ in _lower(u, b[1]):
            i, j = np.nonzero(~(low >= bound))
            i = rows.start + i
            good = full[i] & b[2][j] & ((i < j) if inner else True)
            i, j = i[good], j[good]
            for part in range(0, len(i), CELLS // 4):
                p, q = i[part : part + CELLS // 4], j[part : part + CELLS // 4]
                d = _squared(u, b[1], p, q)
                near = d < bound[q]
                p, q, d = p[near], q[near], d[near]
                yield _batch(ids, b[0], p, q, d)

    met = _met(x, y, node, vector, work, f"src {kind}, dst {kind}, d2 double", limit=limit)
    return met if y is not None else met.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "d2")


def gaussians(x: DataFrame, y: DataFrame, sigma: float, node: str, vector: str) -> DataFrame:
    """(node, density): the sum over y of exp(-d2 / 2 sigma^2) for every x."""
    kind = x.schema[node].dataType.simpleString()

    def work(a: Side, b: Side) -> Iterator[pa.RecordBatch]:
        ids, u, full = a
        v = b[1][b[2]]
        for rows, low, _ in _lower(u, v, slack=False):
            odd = np.nonzero(~np.isfinite(low))
            if len(odd[0]):
                low[odd] = _squared(u, v, rows.start + odd[0], odd[1])
            np.maximum(low, 0, out=low)
            low *= -1 / (2 * sigma**2)
            total = np.exp(low, out=low).sum(axis=1)
            known = pa.array(total, mask=~(full[rows.start : rows.stop] & (len(v) > 0)))
            yield pa.RecordBatch.from_arrays([ids.slice(rows.start, len(rows)), known], ["id", "density"])

    sums = _met(x, y, node, vector, work, f"id {kind}, density double")
    return sums.groupBy(F.col("id").alias(node)).agg(F.sum("density").alias("density"))


def _met(x: DataFrame, y: DataFrame | None, node: str, vector: str, work: Callable[..., Iterator[pa.RecordBatch]], schema: str, both: bool = False, limit: Column | None = None) -> DataFrame:
    """What work returns of all pairs of a block of x and one of y; without y, of each two blocks of x (both: in both orders).

    A row goes to as many tasks as the other side has blocks, and a task holds two blocks of a bounded
    number of numbers; blocks are dealt by a hash of the node. Null vectors, those with nulls and those
    that aren't as wide as the widest have no distances.
    """
    size = lambda s: s.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size(vector)), F.lit(1)).alias("w")).first()
    sizes = [size(s) for s in (x, y) if s is not None]
    width = max(s.w for s in sizes)
    most = max(64, BLOCK_NUMBERS // max(1, width))
    blocks = [max(1, -(-s.n // most), min(BLOCKS, -(-s.n // LEAST_ROWS))) for s in sizes]
    none = F.lit(None).cast("double")
    held = lambda s, n, bound: s.select(F.col(node).alias("id"), F.col(vector).alias("v"), (none if bound is None else bound.cast("double")).alias("bound"), F.pmod(F.xxhash64(node), F.lit(n)).alias("own"))
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    if y is None:
        dealt = held(x, blocks[0], limit).withColumn("to", to(blocks[0])).select("id", "v", "bound", (F.col("own") > F.col("to")).alias("right"), F.least("own", "to").alias("a"), F.greatest("own", "to").alias("b"))
        groups = blocks[0] * (blocks[0] + 1) // 2
    else:
        left = held(x, blocks[0], None).withColumn("b", to(blocks[1])).select("id", "v", "bound", F.lit(False).alias("right"), F.col("own").alias("a"), "b")
        right = held(y, blocks[1], limit).withColumn("a", to(blocks[0])).select("id", "v", "bound", F.lit(True).alias("right"), "a", F.col("own").alias("b"))
        dealt, groups = left.union(right), blocks[0] * blocks[1]
    one, limited = y is None, limit is not None

    def each(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        side = t["right"].to_numpy()
        bounds = t["bound"].to_numpy()
        parts = [pa.array(np.flatnonzero(~side)), pa.array(np.flatnonzero(side))]
        ids = [_flat(t["id"].take(p)) for p in parts]
        lists = [_flat(t["v"].take(p)) for p in parts]
        sides = [(i, *_matrix(c, width)) for i, c in zip(ids, lists)]
        if one and key[0].as_py() == key[1].as_py():
            pairs = [(sides[0], sides[0], bounds[~side])]
        else:
            pairs = [(sides[0], sides[1], bounds[side])] + ([(sides[1], sides[0], bounds[~side])] if one and both else [])
        for a, b, limits in pairs:
            if len(a[0]) and len(b[0]):
                yield from work(a, b, limits) if limited else work(a, b)

    return dealt.repartition(groups, "a", "b").groupBy("a", "b").applyInArrow(each, schema)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    c = column.combine_chunks()
    return c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def _matrix(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, and which of them are whole: not null, of that width, without nulls."""
    whole = pc.fill_null(pc.equal(pc.list_value_length(lists), width), False).to_numpy(zero_copy_only=False)
    values = lists.filter(pa.array(whole)).flatten()
    out = np.full((len(lists), width), np.nan)
    out[whole] = values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    if values.null_count:
        whole[np.flatnonzero(whole)[pc.is_null(values).to_numpy(zero_copy_only=False).reshape(-1, width).any(axis=1)]] = False
    return out, whole


def _lower(u: np.ndarray, v: np.ndarray, slack: bool = True) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """(rows, low, slack): lower bounds of squared distances of some rows of u to all of v, by a product about a middle of v, and how far above they can be; NaN where numbers aren't finite."""
    with np.errstate(all="ignore"):
        finite = v[np.isfinite(v).all(axis=1)]
        middle = finite.mean(axis=0) if len(finite) else np.zeros(u.shape[1])
        middle = np.where(np.isfinite(middle), middle, 0.0)
        a, b = u - middle, v - middle
        na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        # rounding in the product, the norms and the differences summed one by one
        share = 8 * (u.shape[1] + 8) * np.finfo(float).eps if slack else 0.0
        largest = np.max(nb, initial=0.0, where=np.isfinite(nb))
        step = max(1, CELLS // max(1, len(v)))
        for start in range(0, len(u), step):
            rows = range(start, min(start + step, len(u)))
            low = a[rows.start : rows.stop] @ b.T
            low *= -2
            low += (na[rows.start : rows.stop] * (1 - share))[:, None]
            low += nb * (1 - share)
            yield rows, low, 2 * share * (na[rows.start : rows.stop] + largest)


def _squared(u: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of rows, summed one number after the other as a fold does."""
    out = np.zeros(len(i))
    with np.errstate(all="ignore"):
        for part in range(0, len(i) if u.shape[1] else 0, SUMMED):
            d = u[i[part : part + SUMMED]]
            d -= v[j[part : part + SUMMED]]
            d *= d
            out[part : part + SUMMED] = np.add.accumulate(d, axis=1, out=d)[:, -1]
    return out


def _few(v: np.ndarray, order: np.ndarray, k: int, apart: bool) -> np.ndarray:
    """Rows among which any row finds its k nearest: of equal vectors those that come first, k of them, or as many more as one node that is left out can have."""
    if not len(v) or not v.shape[1]:
        return np.arange(len(v))
    bits = np.ascontiguousarray(v).view(np.int64)
    odd = np.random.default_rng(0).integers(-(2**62), 2**62, v.shape[1]) | 1
    with np.errstate(all="ignore"):
        marks = ((bits ^ (bits >> 29)) * odd).sum(axis=1)
    _, first, group = np.unique(marks, return_index=True, return_inverse=True)
    if len(first) == len(v) or not (bits == bits[first[group]]).all():
        return np.arange(len(v))
    by = np.lexsort((order, group))
    if apart:
        by = by[_places(group[by], order[by]) < k]
    return np.sort(by[_places(group[by]) < k * (1 + apart)])


def _places(*keys: np.ndarray) -> np.ndarray:
    """Each row's place, from 0, among neighbouring rows of equal keys."""
    n = len(keys[0])
    new = np.r_[True, np.any([c[1:] != c[:-1] for c in keys], axis=0)][:n]
    first = np.flatnonzero(new)
    return np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))


def _batch(a: pa.Array, b: pa.Array, i: np.ndarray, j: np.ndarray, d: np.ndarray, unknown: bool = False) -> pa.RecordBatch:
    d2 = pa.nulls(len(d), pa.float64()) if unknown else pa.array(d)
    return pa.RecordBatch.from_arrays([a.take(pa.array(i)), b.take(pa.array(j)), d2], ["src", "dst", "d2"])
