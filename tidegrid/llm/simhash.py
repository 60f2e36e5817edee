"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import connected_components, stored

BITS = 64
#: Hashes whose bits are unpacked at a time, which bounds the memory of very long texts.
CHUNK = 1 << 16


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of one text: bit set if set in over half of the hashes of its word shingles.

    A-Z are lower-cased, words are runs without ASCII white space, repeats count. A text with fewer
    words than a shingle is one shingle; a text without words, or null, has fingerprint 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, seed) for g in grams], dtype=">u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): one row per row of docs; fp is the fingerprint as a signed long."""

    @F.pandas_udf(T.LongType())
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([simhash(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("id"), fp(F.col(text_col)).alias("fp"))


def masks(radius: int) -> list[int]:
    """Every signed 64-bit mask of at most radius set bits."""
    found = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(BITS), n)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in found]


def near_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, other): links that connect all fingerprints at most radius bits apart.

    distinct has one row per fingerprint (column fp). Each emits all variants within half the radius;
    two fingerprints within the radius share a variant. The members of a variant's bucket, 65 at
    most for radius 2, are linked to its smallest member rather than to each other: for an even
    radius all of them are within the radius, and so are these links, which are verified.
    """
    if radius % 2:
        raise ValueError("the radius must be even: each side takes half of it")
    variants = distinct.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in masks(radius // 2)])).alias("variant"))
    bucket = Window.partitionBy("variant")
    return (
        variants.withColumn("other", F.min("fp").over(bucket))
        .where("fp <> other")
        .select("fp", "other")
        .distinct()
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius)
    )


def near_duplicates(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links of radius bits or fewer.

    Equal fingerprints collapse before the variants are made, so copies cost one row. Rows with a null
    id are left out. Repeated rows stay repeated; empty and null texts share fingerprint 0. An empty
    table gives no rows. Other columns are ignored.
    """
    marks = stored(fingerprints(docs.where(F.col(id_col).isNotNull()), id_col, text_col, shingle), "simhash")
    classes = marks.groupBy("fp").agg(F.min("id").alias("least"))
    links = connected_components(near_links(classes.select("fp"), radius), "fp", "other")
    joined = classes.join(links.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = joined.groupBy("root").agg(F.min("least").alias("component"))
    labels = joined.join(roots, "root").select("fp", "component")
    return marks.join(labels, "fp").select("id", "fp", "component")


def hex16(fp: str):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
