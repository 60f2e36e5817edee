"""Byte-balanced shards by Karmarkar-Karp differencing of indivisible groups."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, text_or_empty

#: Items that one task differences at a time.
BIN_ITEMS = 20_000
#: Documents that are numbered by one window group.
NUMBER_ROWS = 50_000


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp differencing of partial partitions.

    sums: items x shards. Again and again the two partial partitions with the largest spread are
    combined, the heavy slots of one with the light slots of the other. Returns where each slot of
    each item goes (items x shards), and the sums of the result.
    """
    n, k = sums.shape
    total: list = [row.astype(np.int64) for row in sums]
    children: list = [None] * n
    heap = [(-int(row.max() - row.min()), i) for i, row in enumerate(total)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        up, down = np.argsort(total[a], kind="stable"), np.argsort(-total[b], kind="stable")
        new = total[a][up] + total[b][down]
        children.append((a, b, up, down))
        total[a] = total[b] = None
        total.append(new)
        heapq.heappush(heap, (-int(new.max() - new.min()), len(total) - 1))
    place: list = [None] * len(total)
    place[-1] = np.arange(k)
    for at in range(len(total) - 1, n - 1, -1):
        a, b, up, down = children[at]
        for child, order in ((a, up), (b, down)):
            place[child] = np.empty(k, dtype=np.int64)
            place[child][order] = place[at]
        place[at] = None
    return np.stack(place[:n]), total[-1]


def balanced(groups: DataFrame, shards: int, bin_items: int = BIN_ITEMS) -> DataFrame:
    """(group, shard) for groups(group, size): whole groups, byte sums near equal.

    Groups are dealt by hash into bins of about bin_items, each bin is differenced into one partial
    partition, and the partial partitions are differenced in turn, level by level, until one is left.
    No task holds more than one bin, and nothing but row counts comes to the driver.
    """
    n = groups.count()
    items = groups.select(F.col("group").cast("string").alias("item"), F.array(F.col("size").cast("long"), *[F.lit(0).cast("long")] * (shards - 1)).alias("sums"))
    levels = []
    while True:
        bins = max(1, math.ceil(n / bin_items))

        def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("item", ignore_index=True)
            place, sums = difference(np.stack(part["sums"].to_numpy()))
            rows = pd.DataFrame({"item": part["item"], "bin": key[0], "place": list(place), "sums": None})
            return pd.concat([rows, pd.DataFrame({"item": [None], "bin": [key[0]], "place": [None], "sums": [sums]})], ignore_index=True)

        dealt = items.withColumn("bin", F.pmod(F.xxhash64("item"), F.lit(bins)).cast("string"))
        done = stored(dealt.groupBy("bin").applyInPandas(run, "item string, bin string, place array<long>, sums array<long>"), "shard-level")
        levels.append(done.where("item is not null").select("item", "bin", "place"))
        if bins == 1:
            break
        items, n = done.where("item is null").select(F.col("bin").alias("item"), "sums"), bins
    out = levels[0].select(F.col("item").alias("group"), "bin", F.element_at("place", 1).alias("shard"))
    for level in levels[1:]:
        out = out.join(level.select(F.col("item").alias("bin"), F.col("bin").alias("above"), "place"), "bin").select("group", F.col("above").alias("bin"), F.element_at("place", F.col("shard").cast("int") + 1).alias("shard"))
    return out.select("group", F.col("shard").cast("int").alias("shard"))


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", bin_items: int = BIN_ITEMS) -> DataFrame:
    """(id, size, text_crc32, shard, slot): every row of docs, equal texts in one shard, bytes near equal.

    size is the UTF-8 length plus one; a null text counts as empty. slot numbers a shard's rows from 0
    without gaps, by blocks whose counts are summed first, so no task numbers a whole shard. Rows with
    a null id are kept and numbered first in their block. Repeated rows are all kept. An empty table
    gives no rows. Other columns are ignored.
    """
    text = text_or_empty(text_col)
    rows = stored(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("group")), "shard-rows")
    groups = stored(rows.groupBy("group").agg(F.sum("size").alias("size")), "shard-groups")
    if groups.isEmpty():
        return rows.select("id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    blocks = max(1, math.ceil(rows.count() / (NUMBER_ROWS * shards)))
    placed = stored(rows.join(balanced(groups, shards, bin_items), "group").select("id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("id", "size"), F.lit(blocks)).alias("block")), "shard-placed")
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    first = counts.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("first"))
    number = F.row_number().over(Window.partitionBy("shard", "block").orderBy("id", "text_crc32", "size"))
    return placed.withColumn("number", number).join(first, ["shard", "block"]).select("id", "size", "text_crc32", "shard", (F.col("first") + F.col("number") - 1).cast("long").alias("slot"))
