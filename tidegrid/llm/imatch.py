"""I-Match document fingerprints over randomised lexicon subsets."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bit_set, bit_test, stored, text_or_empty

SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A subset keeps one in so many lexicon terms, chosen by so many bits of the term's hash from a given bit on.
#: A short document shows in the dense subsets, a long one in the sparse ones.
THINNING = ((8, 32), (32, 35), (128, 40), (512, 45))
#: Disjoint subsets of each thinning.
SUBSETS = 8
#: Natural logarithms of documents over documents with the term.
IDF_BAND = (1.5, 8.0)
#: Lexicon terms that may be a constant of the plan, as a table of buckets; each takes about 20 bytes.
CONSTANT_TERMS = 400_000
#: Terms a bucket of that table holds on average.
BUCKET_TERMS = 4
#: Documents that one window group orders, while there are no more than RANGES groups.
ORDER_ROWS, RANGES = 4_000, 1 << 16


def term_ids(text: Column) -> Column:
    """The distinct terms of a lower-cased text, as 64-bit hashes."""
    return F.array_distinct(F.transform(F.array_remove(F.split(F.lower(text), SPLIT), ""), lambda t: F.xxhash64(t)))


def lexicon(docs: DataFrame, text: Column, band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """(term) of the terms whose inverse document frequency lies in the band. Every document counts, and every term by itself.

    The band's upper end bounds the lexicon: a term in it is in one of e**band[1] documents at least, so
    there are at most that many times the mean number of terms of a document, at any corpus size.
    """
    each = docs.select(F.explode(term_ids(text)).alias("term"))
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.count()
    return stored(df.where(F.log(F.lit(n) / F.col("df")).between(*band)).select("term"), "lexicon")


class Membership:
    """Which of a text's terms are in a lexicon: by a constant table of buckets, or for a large lexicon by a join."""

    def __init__(self, terms: DataFrame, constant_terms: int = CONSTANT_TERMS):
        self.terms, n = terms, terms.count()
        self.table: Column | None = None
        if n <= constant_terms:
            self.bits = max(1, math.ceil(math.log2(max(1, n) / BUCKET_TERMS)) if n > BUCKET_TERMS else 1)
            buckets = [""] * (1 << self.bits)
            for slot, held in terms.groupBy(self.slot(F.col("term")).alias("slot")).agg(F.array_join(F.sort_array(F.collect_list(F.col("term").cast("string"))), ",")).collect():
                buckets[slot] = held
            self.table = F.split(F.lit(";".join(buckets)), ";")  # constant, so folded once

    def slot(self, term: Column) -> Column:
        return term.bitwiseAND(F.lit((1 << self.bits) - 1)).cast("int")

    def with_terms(self, df: DataFrame, text: Column, name: str) -> DataFrame:
        """df with the sorted lexicon terms of text as the column `name`."""
        table = self.table
        if table is not None:
            held = lambda t: F.find_in_set(t.cast("string"), F.element_at(table, self.slot(t) + 1)) > 0
            return df.withColumn(name, F.sort_array(F.filter(term_ids(text), held)))
        # equal texts share a row of terms; a set of fixed size keeps most terms that aren't in the lexicon out of the join
        key = F.xxhash64(text)
        each = df.select(key.alias("key"), F.explode(term_ids(text)).alias("term")).where(bit_test(F.col("term"), bit_set(self.terms, F.col("term")))).distinct()
        found = each.join(self.terms, "term").groupBy("key").agg(F.sort_array(F.collect_list("term")).alias("found"))
        held = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("held")
        joined = df.select(held, key.alias("key")).join(found, "key", "left")
        return joined.select("held.*", F.coalesce("found", F.array().cast("array<bigint>")).alias(name))


def fingerprint(terms: Column) -> Column:
    """For each lexicon subset 8 hex digits, the hash of its sorted terms, zeros if it has none; so a text without lexicon terms has zeros alone."""

    def slot(thin: int, shift: int, test: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda t: test(F.shiftright(t, shift).bitwiseAND(F.lit(thin - 1)))

    def subsets(held: Column, thin: int, shift: int) -> Column:
        own = F.array(*[F.filter(held, slot(thin, shift, _is(s))) for s in range(SUBSETS)])
        word = lambda t: F.lpad(F.lower(F.hex(F.xxhash64(t).bitwiseAND(F.lit((1 << 32) - 1)))), 8, "0")
        return F.array_join(F.transform(own, lambda t: F.when(F.size(t) > 0, word(t)).otherwise(F.lit("0" * 8))), "")

    parts = []
    for thin, shift in THINNING:
        some = F.filter(terms, slot(thin, shift, lambda x: x < SUBSETS))
        parts.append(_once(some, subsets, thin, shift))
    return F.concat(*parts)


def _once(terms: Column, f: Callable[[Column, int, int], Column], thin: int, shift: int) -> Column:
    """f of terms, which are evaluated once, held in a one-element array."""
    return F.transform(F.array(terms), lambda held: f(held, thin, shift))[0]


def _is(s: int) -> Callable[[Column], Column]:
    return lambda x: x == s


def likeness(a: Column, b: Column) -> Column:
    """Share of subsets with equal hashes among those that hold a term of either; 1 for equal fingerprints, so also where neither text has a lexicon term."""
    n = len(THINNING) * SUBSETS
    pairs = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.substring(a, i * 8 + 1, F.lit(8)).alias("a"), F.substring(b, i * 8 + 1, F.lit(8)).alias("b")))
    used = F.filter(pairs, lambda p: (p["a"] != "0" * 8) | (p["b"] != "0" * 8))
    same = F.filter(used, lambda p: p["a"] == p["b"])
    return F.when(a == b, F.lit(1.0)).otherwise(F.size(same) / F.size(used))


def with_fingerprint(df: DataFrame, text: Column, held: Membership, name: str) -> DataFrame:
    """df with the fingerprint of text as the column `name`; a column of df by that name, or by the name with a leading __, is replaced or dropped."""
    return held.with_terms(df, text, f"__{name}").withColumn(name, fingerprint(F.col(f"__{name}"))).drop(f"__{name}")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = IDF_BAND, constant_terms: int = CONSTANT_TERMS) -> DataFrame:
    """(id, fingerprint) for every row of docs.

    Null texts count as empty. A text without lexicon terms has a fingerprint of zeros. Equal texts have
    equal fingerprints. Rows with a null id and repeated rows are kept. An empty table gives no rows.
    Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    held = Membership(lexicon(rows, F.col("text"), band), constant_terms)
    return with_fingerprint(rows, F.col("text"), held, "fingerprint").select("id", "fingerprint")


def with_next(rows: DataFrame, columns: list[str], order_rows: int = ORDER_ROWS) -> DataFrame:
    """rows(id, text, ...) with next_<c> of the row that follows in descending id; after the last comes the first.

    Rows of one id are ordered by a hash of the text; null ids come last. Ids of any type that Spark
    orders will do. An order of the ids alone gives the cuts of ranges of about order_rows rows, and
    each range also gets the first row of the range after it, so no task orders more than a range, and
    only the cuts come to the driver. An empty table gives no rows.
    """
    key = F.struct("id", F.xxhash64("text").alias("mark"))
    n = rows.count()
    ranges = min(RANGES, max(1, math.ceil(n / order_rows)))
    firsts = rows.select(key.alias("k")).repartitionByRange(ranges, F.col("k").desc()).groupBy(F.spark_partition_id().alias("p")).agg(F.max("k").alias("k"))
    cuts = stored(firsts.select("k").distinct(), "cuts")
    # in two steps, as a row is compared with each cut of an array
    step = max(1, math.isqrt(ranges))
    listed = [tuple(r.k) for r in cuts.orderBy(F.desc("k")).collect()]
    kind = cuts.schema["k"].dataType.simpleString()
    outer = rows.sparkSession.createDataFrame([(listed[::step], [listed[i : i + step] for i in range(0, len(listed), step)])], f"heads array<{kind}>, blocks array<array<{kind}>>")
    placed = rows.withColumn("k", key).join(F.broadcast(outer)).withColumn("block", F.greatest(F.lit(1), F.size(F.filter("heads", lambda c: c >= F.col("k")))))
    placed = placed.withColumn("range", (F.col("block") - 1) * step + F.size(F.filter(F.element_at("blocks", F.col("block")), lambda c: c >= F.col("k")))).drop("heads", "blocks", "block")
    heads = placed.groupBy("range").agg(F.max("k").alias("k"))
    placed = placed.select(*rows.columns, "range", F.col("k.mark").alias("mark"))
    order = Window.orderBy("range")
    heads = heads.select("range", F.coalesce(F.lead("k").over(order), F.first("k").over(order)).alias("k"))
    follow = stored(heads.select("range", F.col("k.id").alias("head_id"), F.col("k.mark").alias("head_mark")), "heads")
    head_rows = rows.select(*rows.columns, F.xxhash64("text").alias("mark"))
    # a set of fixed size keeps most rows, which head no range, out of the shuffle
    near = head_rows.where(bit_test(F.col("mark"), bit_set(follow, F.col("head_mark"))))
    halo = near.join(follow, F.col("id").eqNullSafe(F.col("head_id")) & (F.col("mark") == F.col("head_mark"))).dropDuplicates(["range"]).select(*rows.columns, "range", "mark", F.lit(1).alias("halo"))
    inside = Window.partitionBy("range").orderBy("halo", F.desc("id"), F.desc("mark"))
    both = placed.withColumn("halo", F.lit(0)).unionByName(halo)
    return both.select(*rows.columns, "halo", *[F.lead(c).over(inside).alias(f"next_{c}") for c in columns]).where("halo = 0").drop("halo")
