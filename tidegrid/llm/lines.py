"""Line dedup by a segment-partition edit join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_set, bit_test, connected_components, drop_tables, stored, text_or_empty

#: Edits at which two lines still link.
THRESHOLD = 1
#: Code points from which on lines link by edits, as one edit makes another of a short line ("Page 1", "Page 2"). Equal lines are one class at any length.
MIN_CHARS = 24
#: Lines of a segment index bucket, with its probes, that are paired; larger buckets go the way of hot_links().
BUCKET = 64


def segment(length: Column, i: int, n: int) -> tuple[Column, Column]:
    """Start, from 0, and length of segment i of n; the last ones are longer by one where they don't divide evenly."""
    base = F.floor(length / n).cast("int")
    short = F.lit(n) - length % n
    return base * i + F.greatest(F.lit(0), F.lit(i) - short), base + F.when(F.lit(i) >= short, 1).otherwise(0)


def index_keys(line: Column, length: Column, threshold: int) -> list[tuple[int, Column]]:
    """(segment, key) of the segments of a line."""
    out = []
    for i in range(threshold + 1):
        at, n = segment(length, i, threshold + 1)
        out.append((i, F.xxhash64(length, F.lit(i), F.substring(line, at + 1, n))))
    return out


def probe_keys(line: Column, length: Column, threshold: int, min_chars: int) -> list[tuple[int, int, Column]]:
    """(segment, how much longer, key) of the substrings of a line that can be segments of a line as long or shorter.

    A substring may lie off the segment's place by at most the edits that can come before it and by
    at most those that can come after it.
    """
    out = []
    for d in range(threshold + 1):
        target = length - d
        for i in range(threshold + 1):
            at, n = segment(target, i, threshold + 1)
            for off in range(max(-i, d - (threshold - i)), min(i, d + threshold - i) + 1):
                out.append((i, d, F.when(target >= min_chars, F.xxhash64(target, F.lit(i), F.substring(line, at + off + 1, n)))))
    return out


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether the edit distance of two strings is at most threshold: bit-parallel over a band of 2 x threshold + 1 diagonals.

    Bit v of a word is row j - threshold + v of column j. A word holds where the vertical steps of a
    column rise, another where they fall. The distance is followed down the band's last diagonal to
    the last row, then along that row. The strings must be longer than the threshold, and their
    lengths differ by it at most.
    """
    k = threshold
    full, top = (1 << (2 * k + 1)) - 1, 1 << (2 * k)
    p, t = F.split(a, ""), F.split(b, "")
    m = F.length(a)
    masks = F.transform(t, lambda c, j: _sum([F.when(F.get(p, j - k + v) == c, F.lit(1 << v)).otherwise(F.lit(0)) for v in range(2 * k + 1)]))
    start = F.struct(F.lit(((1 << (k + 1)) - 1) << k).alias("up"), F.lit(0).alias("down"), F.lit(k).alias("dist"), F.lit(1).alias("j"))

    def diagonal(s: Column, x: Column) -> Column:
        return ((x.bitwiseAND(s["up"]) + s["up"]).bitwiseXOR(s["up"])).bitwiseOR(x).bitwiseOR(s["down"]).bitwiseAND(F.lit(full))

    def column(s: Column, d: Column) -> Column:
        right = s["down"].bitwiseOR(F.lit(full) - d.bitwiseOR(s["up"]))
        left = d.bitwiseAND(s["up"])
        last = F.call_function("shiftright", F.lit(top), F.greatest(F.lit(0), s["j"] - (m - k)))
        step = F.when(s["j"] <= m - k, F.when(d.bitwiseAND(F.lit(top)) == 0, 1).otherwise(0)).otherwise(F.when(right.bitwiseAND(last) != 0, 1).when(left.bitwiseAND(last) != 0, -1).otherwise(0))
        below = F.shiftright(d, 1)
        return F.struct(left.bitwiseOR(F.lit(full) - below.bitwiseOR(right)).alias("up"), below.bitwiseAND(right).alias("down"), (s["dist"] + step).alias("dist"), (s["j"] + 1).alias("j"))

    def advance(s: Column, x: Column) -> Column:
        return F.transform(F.array(diagonal(s, x)), lambda d: column(s, d))[0]

    return F.aggregate(masks, start, advance, lambda s: s["dist"]) <= k


def _sum(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, line_no, line, chars): the lines of every document; row tells documents apart by id and text."""
    text = text_or_empty(text_col)
    rows = docs.select(F.xxhash64(F.col(id_col).cast("string"), text).alias("row"), F.col(id_col).alias("id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return rows.withColumn("chars", F.length("line"))


def edit_links(lines: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """Links between the different lines of lines(h, line, chars), where h is the line's hash; repeated lines are allowed.

    Gives (a, b), pairs of lines within the threshold, each once, and (h, other, more): for the lines
    of crowded buckets a link to the least line of those that differ in one place, and the number of
    its partners there. Together they join all lines within the threshold and count each partner once.

    Every line puts its segments into an index and probes it with its own substrings. A bucket of at
    most `bucket` entries gives candidate pairs, which are verified. Crowded buckets, which would give
    pairs by the square of their size, are resolved by the one edit outside the shared segment; that
    takes a threshold of 1. Above it crowded buckets are refused, as pairing them would not scale.
    """
    if min_chars <= 2 * threshold:
        raise ValueError("min_chars must be over twice the threshold")
    lines = lines.where(F.col("chars") >= min_chars)
    line, chars = F.col("line"), F.col("chars")
    entry = lambda key, role, i: F.struct(key.alias("key"), F.lit(role).cast("byte").alias("role"), F.lit(i).cast("byte").alias("part"))
    every = [entry(k, -1, i) for i, k in index_keys(line, chars, threshold)] + [entry(k, d, i) for i, d, k in probe_keys(line, chars, threshold, min_chars)]
    # role: -1 for the index, else how much longer the probing line is
    entries = lines.select("h", F.inline(F.array(*every))).where("key is not null").distinct()
    entries = stored(entries, "line-entries")
    sizes = entries.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("role") == -1).alias("held"), F.count_if(F.col("role") >= 0).alias("probes"))
    # an entry whose own line is the only one in the bucket needs no partner
    sizes = stored(sizes.where("held and (n > 2 or probes > 1)").select("key", "n"), "line-buckets")
    if threshold > 1 and not sizes.where(F.col("n") > bucket).isEmpty():
        raise ValueError(f"at a threshold over 1 no more than {bucket} entries may share a segment")
    cold = entries.join(sizes.where(F.col("n") <= bucket).select("key"), "key")
    x, y = cold.where("role >= 0"), cold.where("role = -1").select("key", F.col("h").alias("g"))
    pairs = x.join(y, "key").where((F.col("h") != F.col("g")) & ((F.col("role") > 0) | (F.col("h") > F.col("g")))).select(F.col("h").alias("a"), F.col("g").alias("b")).distinct()
    pairs = stored(pairs, "line-pairs")
    hot = stored(entries.join(sizes.where(F.col("n") > bucket).select("key"), "key"), "line-hot")
    texts = _texts(lines, pairs.select(F.col("a").alias("h")).union(pairs.select("b")).union(hot.select("h")))
    two = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("p")), "a").join(texts.select(F.col("h").alias("b"), F.col("line").alias("t")), "b")
    # an edit spoils one segment at most: of any cut of one line, all but so many segments must be in the other near their places
    near = two.where(_segments_kept(F.col("p"), F.col("t"), threshold, threshold + 5)).where(_pieces_kept(F.col("p"), F.col("t"), threshold))
    kept = near.where(within(F.col("p"), F.col("t"), threshold)).select("a", "b")
    linked, stars = hot_links(hot, texts, threshold)
    links = stored(kept.union(linked).distinct(), "line-links")
    drop_tables(entries, pairs, hot, texts)
    return links, stars


def _segments_kept(a: Column, b: Column, threshold: int, n: int) -> Column:
    lost = []
    for i in range(n):
        at, size = segment(F.length(a), i, n)
        near = F.substring(b, F.greatest(F.lit(1), at + 1 - threshold), size + 2 * threshold)
        lost.append(F.when(F.contains(near, F.substring(a, at + 1, size)), 0).otherwise(1))
    return _sum(lost) <= threshold


#: Code points of the pieces that a line is cut into before it is verified.
PIECE = 4


def _pieces_kept(a: Column, b: Column, threshold: int) -> Column:
    near = lambda i: F.substring(b, F.greatest(F.lit(1), i * PIECE + 1 - threshold), F.least(i * PIECE, F.lit(threshold)) + PIECE + threshold)
    lost = F.filter(F.sequence(F.lit(0), F.floor(F.length(a) / PIECE).cast("int") - 1), lambda i: ~F.contains(near(i), F.substring(a, i * PIECE + 1, F.lit(PIECE))))
    return F.size(lost) <= threshold


def _texts(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, line) of the wanted lines; a set of fixed size keeps most others out of the shuffle."""
    wanted = stored(wanted.distinct(), "line-wanted")
    near = lines.where(bit_test(F.col("h"), bit_set(wanted, F.col("h")))).select("h", "line").distinct()
    return stored(near.join(wanted, "h", "left_semi"), "line-texts")


def hot_links(hot: DataFrame, texts: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Links of crowded buckets at a threshold of 1, without pairing: (a, b) one longer by a character, and stars (h, other, more).

    Lines of a bucket share a half. Lines of a length that link differ in one place of the other half:
    they agree in all but that place, so they meet under a key made of the rest. A line longer by one
    meets the other without one of its characters.
    """
    if threshold != 1:
        none = texts.sparkSession.createDataFrame([], "h long, other long, more long")
        return none.select(F.col("h").alias("a"), F.col("other").alias("b")), none
    rows = hot.join(texts, "h").withColumn("chars", F.length("line"))
    at, size = segment(F.col("chars"), 1, 2)
    # first and last place, from 0, of the half that is not shared
    low = F.when(F.col("part") == 0, at).otherwise(0)
    high = F.when(F.col("part") == 0, F.col("chars") - 1).otherwise(at - 1)
    rest = lambda j: F.concat(F.substring("line", F.lit(1), j), F.substring(F.col("line"), j + 2, F.col("chars")))
    same = rows.where("role = -1").select("h", F.explode(F.transform(F.sequence(low, high), lambda j: F.xxhash64(F.col("key"), j, rest(j)))).alias("spot"))
    spots = same.groupBy("spot").agg(F.count("*").alias("n"), F.min("h").alias("other")).where("n > 1")
    met = same.join(spots, "spot")
    stars = met.groupBy("h", "other").agg(F.sum(F.col("n") - 1).alias("more"))
    longer = rows.where("role = 1").withColumn("gone", F.explode(F.sequence(low, F.greatest(low, high))))
    longer = longer.select(F.col("h").alias("a"), "key", F.xxhash64(rest(F.col("gone"))).alias("whole"))
    whole = rows.where("role = -1").select(F.col("h").alias("b"), "key", F.xxhash64("line").alias("whole"))
    return longer.join(whole, ["key", "whole"]).select("a", "b").distinct(), stored(stars, "line-stars")


def classes(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, line_no, first_id, first_line_no, n_links, keep): every line of every document.

    Two lines of min_chars code points or more link when their edit distance is at most threshold;
    n_links counts the different lines that a line links to. Lines connected by links, and equal ones of
    any length, form a class, named by its first line: the least id, then line number. keep is true for
    that line alone. Blank lines are kept, have no links and are named by themselves. Lines are told
    apart by a 64-bit hash. threshold must be 1 where many lines share a half; see edit_links().

    Null and empty texts are one empty line. A null id comes first. Rows equal in id and text share
    their decisions, and their first lines are all kept. An empty table gives no rows. Other columns are
    ignored.
    """
    occ = occurrences(docs, id_col, text_col)
    marked = occ.withColumn("h", F.xxhash64("line"))
    pairs, stars = edit_links(marked.select("h", "line", "chars"), threshold, min_chars, bucket)
    members = connected_components(pairs.union(stars.select("h", "other")), "a", "b").withColumnRenamed("node", "h")
    links = pairs.select(F.col("a").alias("h"), F.lit(1).cast("long").alias("n")).union(pairs.select("b", F.lit(1).cast("long"))).union(stars.select("h", "more")).groupBy("h").agg(F.sum("n").alias("n_links"))
    blank = F.trim("line") == ""
    spots = stored(marked.where(~blank).select("row", "id", "line_no", "h"), "line-spots")
    first = spots.groupBy("h").agg(F.min(F.struct("id", "line_no", "row")).alias("first"))
    first = first.join(members, "h", "left").join(links, "h", "left").select("h", "first", F.coalesce("component", "h").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    best = first.groupBy("class").agg(F.min("first").alias("best"), F.count("*").alias("lines"))
    named = first.join(best, "class").select("h", "best", "n_links")
    long = spots.join(named, "h").select("row", "id", "line_no", F.col("best.id").alias("first_id"), F.col("best.line_no").alias("first_line_no"), "n_links", (F.struct("id", "line_no", "row").eqNullSafe(F.col("best"))).alias("keep"))
    short = occ.where(blank).select("row", "id", "line_no", F.col("id").alias("first_id"), F.col("line_no").alias("first_line_no"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("keep"))
    return long.unionByName(short)


def dedup(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with only the lines that classes() keeps, in order; the row stays even if no line does.

    Null texts stay null. Rows keep all their columns, whatever their names. A bit set of fixed size lets
    most documents that lose no line pass without a shuffle.
    """
    text = text_or_empty(text_col)
    key = F.xxhash64(F.col(id_col).cast("string"), text)
    gone = stored(classes(docs, threshold, min_chars, bucket, id_col, text_col).where("not keep").groupBy("row").agg(F.collect_set("line_no").alias("gone")), "line-gone")
    maybe = bit_test(key, bit_set(gone, F.col("row")))
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held")
    rows = docs.where(maybe).select(held, key.alias("row")).join(gone, "row", "left")
    parts = F.split(F.coalesce(F.col("held")[text_col], F.lit("")), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    rows = rows.withColumn("parts", parts)
    whole = F.when(F.size("gone") > 0, F.array_join(F.transform(stay, lambda i: F.get("parts", i)), "\n")).otherwise(F.col("held")[text_col])
    cut = rows.select(F.col("held").withField(f"`{text_col}`", whole).alias("held")).select("held.*")
    return docs.where(~maybe).unionByName(cut)
