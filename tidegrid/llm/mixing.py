"""Mixing sources to target weights: whole copies, then Pareto order samples of a fixed number of words."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: A maximal match is a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Copies of a document at most, so also how far a source's target may exceed its size.
MOST = 3
#: How much likelier each doubling of its length makes a document.
LONGER = 0.1
#: Sources that one task puts in order.
RANGE_SOURCES = 100_000
#: Ranks are whole numbers below 2**RANK_BITS; a round looks at DIGIT_BITS of them.
RANK_BITS, DIGIT_BITS = 50, 10
#: Documents after a source's boundary among which those are sought that still fit; a part of the ranks with more is cut further.
TAIL = 256
#: Inclusion probabilities this near to 0 or 1 count as such.
SURE = 1e-9


def sizes(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, s, size, level, draw): s is a struct of the source, size the words, level the binary digits of size, draw a number in (0, 1) that id, size and seed decide."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    held = docs.select(F.col(id_col).alias("id"), F.struct(F.col(source_col).alias("source")).alias("s"), size.alias("size"))
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "size"), 12) + F.lit(0.5)) / float(1 << 52)
    return stored(held.select("id", "s", "size", F.length(F.bin("size")).alias("level"), draw.alias("draw")), "mix-sizes")


def weighted(totals: DataFrame, weights: Sequence[float]) -> DataFrame:
    """totals(s, source_size) with w: the weights in turn, by the code points of the sources, null last. Ranges of sources are ordered apart and their counts added."""
    ranges = max(1, math.ceil(totals.count() / RANGE_SOURCES))
    keys = [F.col("s.source").isNull(), F.col("s")]
    cut = stored(totals.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("pos", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("pos", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = cut.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("pos").bitwiseAND(F.lit((1 << 33) - 1))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    return cut.withColumn("part", part).join(offsets, "part").select("s", "source_size", turn.alias("w"))


def targets(totals: DataFrame, weights: Sequence[float], share: float = 1.0, most: int = MOST) -> DataFrame:
    """(s, source_size, target): shares of all words by weight; what a source can't take at `most` times its size goes to the others by weight, until none is above.

    A round is one aggregate over the sources and caps at least one more; two numbers come to the driver.
    """
    sources = stored(weighted(totals, weights), "mix-weights")
    words, held = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    words = words * share
    unit, before = (words / held if held else 0.0), None
    while unit != before:
        over = F.col("w") * unit > most * F.col("source_size")
        capped, rest = sources.agg(F.coalesce(F.sum(F.when(over, most * F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0))).first()
        before = unit
        unit = (words - capped) / rest if rest else before
    return sources.select("s", "source_size", F.least(F.col("w") * unit, most * F.col("source_size")).cast("double").alias("target"))


def copies(held: DataFrame, aims: DataFrame, longer: float = LONGER, most: int = MOST) -> DataFrame:
    """(s, level, source_size, target, whole, p, words_left): for each source and level the certain copies, the probability of one more, and the words that the source's sample has to bring.

    A document is expected min(most, c z) times, where z = 1 + longer * level and c makes a source's
    expected words its target. A source has at most 64 levels, so c comes from sums in one row.
    """
    z = F.lit(1.0) + F.lit(longer) * F.col("level")
    levels = held.groupBy("s", "level").agg(F.sum("size").alias("words")).select("s", F.struct((-z).alias("key"), z.alias("z"), "level", "words").alias("x"))
    rows = levels.groupBy("s").agg(F.array_sort(F.collect_list("x")).alias("x")).join(aims, "s")
    # with the k likeliest levels at the most, the others share what is left; the first k that leaves none above it holds
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))
    full = lambda k: F.slice("x", 1, k)
    rest = lambda k: F.slice("x", k + 1, F.size("x"))
    room = lambda k: (F.col("target") - most * total(full(k), lambda x: x["words"])) / total(rest(k), lambda x: x["z"] * x["words"])
    tries = F.transform(F.sequence(F.lit(0), F.size("x") - 1), lambda k: F.struct(F.when(total(rest(k), lambda x: x["words"]) > 0, room(k)).alias("c"), F.element_at("x", k + 1)["z"].alias("z")))
    c = F.coalesce(F.get(F.filter(tries, lambda t: t["c"] * t["z"] <= most), F.lit(0))["c"], F.lit(float("inf")))

    def split(x: Column) -> Column:
        expected = F.least(F.lit(float(most)), F.col("c") * x["z"])
        whole = F.floor(expected + SURE)
        return F.struct(x["level"].alias("level"), x["words"].alias("words"), whole.alias("whole"), F.when(expected - whole > SURE, expected - whole).alias("p"))

    made = rows.withColumn("c", c).withColumn("x", F.transform("x", split))
    sure = F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + x["whole"] * x["words"])
    return stored(made.withColumn("words_left", F.round("target").cast("long") - sure).select("s", "source_size", "target", "words_left", F.inline("x")).drop("words"), "mix-copies")


def boundaries(ranked: DataFrame, budgets: DataFrame) -> DataFrame:
    """(s, low, high, words_left) of ranked(s, size, rank) and budgets(s, words_left): all ranks under low fit into a source's words; of those from low up to high some do, one by one.

    A round sums the words of a source by the next digit of the ranks, before any shuffle, and goes on
    inside the digit where the words run out; so no source is ever sorted, however many documents it has.
    """
    state = budgets.select("s", F.lit(0).cast("long").alias("prefix"), "words_left")
    done: list[DataFrame] = []
    for depth in range(RANK_BITS // DIGIT_BITS):
        shift = RANK_BITS - DIGIT_BITS * (depth + 1)
        inside = ranked.join(state, "s").where(F.shiftright("rank", shift + DIGIT_BITS) == F.col("prefix"))
        digit = F.shiftright("rank", shift)
        sums = inside.groupBy("s", digit.alias("digit")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        rows = sums.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("digit", "words", "n"))).alias("digits")).join(state, "s")
        none = F.lit(None).cast("long")
        begin = F.struct(F.col("words_left").alias("left"), none.alias("at"), none.alias("n"), none.alias("seen"), none.alias("upto"))

        def step(a: Column, x: Column) -> Column:
            fits, tail = a["at"].isNull() & (x["words"] <= a["left"]), a["seen"] < TAIL
            opens = a["at"].isNull() & (x["words"] > a["left"])
            return F.struct(
                F.when(fits, a["left"] - x["words"]).otherwise(a["left"]).alias("left"), F.when(opens, x["digit"]).otherwise(a["at"]).alias("at"), F.when(opens, x["n"]).otherwise(a["n"]).alias("n"),
                F.when(opens, x["n"]).when(tail, a["seen"] + x["n"]).otherwise(a["seen"]).alias("seen"), F.when(opens | tail, x["digit"]).otherwise(a["upto"]).alias("upto"),
            )

        found = stored(rows.select("s", F.aggregate("digits", begin, step).alias("f")), "mix-bounds")
        last = depth == RANK_BITS // DIGIT_BITS - 1
        goes_on = F.coalesce(F.col("f.n") > TAIL, F.lit(False)) & F.lit(not last)
        end = F.lit(1 << RANK_BITS)
        done.append(found.where(~goes_on).select("s", F.coalesce(F.shiftleft("f.at", shift), end).alias("low"), F.coalesce(F.shiftleft(F.col("f.upto") + 1, shift), end).alias("high"), F.col("f.left").alias("words_left")))
        state = found.where(goes_on).select("s", F.col("f.at").alias("prefix"), F.col("f.left").alias("words_left"))
        if last or state.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return stored(out, "mix-boundaries")


def mix(docs: DataFrame, weights: Sequence[float], share: float = 1.0, longer: float = LONGER, seed: int = 0, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, n_copies, taken), a row for every row of docs: taken = size * n_copies words, which in each source add up to about its target.

    Targets are those of targets(). Each document is expected to be taken between 0 and `most` times,
    longer ones more often (see copies()). The whole part of that is certain. For the rest, p, documents
    are ranked by random odds over inclusion odds, u (1 - p) / ((1 - u) p), and taken in that order while
    they fit into the words that the source still has to bring: a Pareto order sample whose fixed size is
    in words. Where the words run out, the next TAIL documents or so are tried one by one, so the sum is
    short of the target by less than most of those documents; short ones have a little more chance there.

    The draw u is a hash of seed, id and size, so reruns agree; rows with equal id and size are taken
    together or not at all. A null text has no words and is taken as 0 of them; the null source is a
    source, and so is a null id a document. A source without words has the target 0. An empty table gives
    no rows. Only sums and the tails are shuffled, apart from joins to tables with a row for each source,
    which Spark broadcasts while they are small and splits by skew beyond.
    """
    held = sizes(docs, seed, id_col, text_col, source_col)
    totals = held.groupBy("s").agg(F.sum("size").alias("source_size"))
    plan = copies(held, targets(totals, weights, share, most), longer, most)
    odds = F.log(F.col("draw") / (1 - F.col("draw"))) - F.log(F.col("p") / (1 - F.col("p")))
    # |odds| < 64
    rank = F.when(F.col("size") > 0, F.floor((odds + 64) * float(1 << (RANK_BITS - 7)))).cast("long")
    ranked = stored(held.join(plan.drop("words_left"), ["s", "level"]).select("id", "s", "size", "source_size", "target", "whole", rank.alias("rank")), "mix-ranks")
    asked = ranked.where("rank is not null").select("s", "size", "rank")
    ends = boundaries(asked, plan.select("s", "words_left").distinct())
    units = asked.join(ends, "s").where("rank >= low and rank < high").groupBy("s", "rank").agg(F.sum("size").alias("words"), F.first("words_left").alias("words_left"))
    none = F.array().cast("array<bigint>")
    step = lambda a, x: F.when(x["words"] <= a["left"], F.struct((a["left"] - x["words"]).alias("left"), F.array_append(a["ranks"], x["rank"]).alias("ranks"))).otherwise(a)
    tails = units.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("rank", "words"))).alias("units"), F.first("words_left").alias("words_left"))
    fitted = F.aggregate("units", F.struct(F.col("words_left").alias("left"), none.alias("ranks")), step, lambda a: a["ranks"])
    picked = tails.select("s", F.explode(fitted).alias("rank")).withColumn("picked", F.lit(True))
    both = ranked.join(ends.select("s", "low"), "s", "left").join(stored(picked, "mix-tails"), ["s", "rank"], "left")
    one = F.coalesce((F.col("rank") < F.col("low")) | F.col("picked"), F.lit(False))
    n = (F.col("whole") + one.cast("long")).alias("n_copies")
    return both.select("id", F.col("s.source").alias("source"), "size", "source_size", "target", n, (F.col("size") * n).alias("taken"))
