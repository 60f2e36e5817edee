"""Benchmark decontamination: an exact window containment join with prefix filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, bit_set, bit_test, stored, text_or_empty, without_rows

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words when A-Z has not been lower-cased yet; enough to count them.
SPLIT_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Tokens, and bytes of anchored windows, that may be broadcast.
BROADCAST_TOKENS, BROADCAST_BYTES = 1_000_000, 32 << 20


def words(text: Column) -> Column:
    """The words of a text: runs of digits, letters (A-Z lower-cased) and characters from U+0080."""
    return F.array_remove(F.split(ascii_lower(text), SPLIT), "")


def _shingles(rows: DataFrame, sizes: list[int], keep: list[str]) -> DataFrame:
    """(keep, w, at, size, token): a row for each shingle of each size in the array w; at counts from 0."""
    parts = []
    for n in sizes:
        token = F.xxhash64(F.lit(n), *[F.element_at("w", F.col("at") + 1 + i) for i in range(n)])
        # outer: otherwise Spark adds a filter on the size of w below, and splits each text twice
        each = rows.select(*keep, "w", F.posexplode_outer("w").alias("at", "word"))
        parts.append(each.where(F.col("at") + n <= F.size("w")).select(*keep, "w", "at", F.lit(n).alias("size"), token.alias("token")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def item_windows(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(wh, w), the different windows of the items(item_id, w), and (wh, item_id), who has them: a window that many items share is one row.

    wh is a 64-bit hash of the window's words.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window))
    each = items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s + 1, window))).alias("w")).select("item_id", F.xxhash64("w").alias("wh"), "w")
    each = stored(each, "item-windows")
    return stored(each.groupBy("wh").agg(F.min("w").alias("w")), "windows"), each.select("wh", "item_id").distinct()


def anchors(windows: DataFrame, tokens: DataFrame, seen: DataFrame) -> DataFrame:
    """(wh, w, at, token): the necessary prefix token of each window that a document may hold.

    A window's shingles are ordered by how rare they are in the corpus. Containment must be whole, so
    the prefix that has to be shared is one token: the rarest. A window with a shingle that no document has is dropped.
    """
    ranked = tokens.join(seen.groupBy("token").agg(F.count("*").alias("n")), "token", "left")
    rarest = ranked.groupBy("wh").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "token")).alias("best")).where("best.n > 0")
    return stored(rarest.select("wh", "best.at", "best.token").join(windows, "wh"), "anchors")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(row, wh, start, span), where windows occur in documents, as word positions, and (wh, item_id); row is row_key() of a document.

    One pass over the corpus keeps the places of shingles that any item has; their counts order the
    windows' shingles by rarity. A second pass over the documents with an anchor takes, at each anchor,
    the words that the window would cover: it must fit into the document there (length and positional
    bounds), and its words are then compared one by one. Places, not documents, are joined, so a long
    document is never one large row beyond its text. Few tokens and windows are broadcast, after they
    are counted; beyond that bound a bit set of fixed size drops most places, and the rest is shuffled.
    """
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), words(text_or_empty(item_text)).alias("w")).where(F.size("w") > 0).dropDuplicates()
    windows, members = item_windows(items, window)
    sizes = sorted(r[0] for r in windows.select(F.least(F.lit(shingle), F.size("w"))).distinct().collect()) or [shingle]  # at most `shingle` rows
    tokens = _shingles(windows, sizes, ["wh"]).where(F.col("size") == F.least(F.lit(shingle), F.size("w"))).select("wh", "at", "token")
    tokens = stored(tokens, "window-tokens")
    marked = docs.select(row_key(id_col, text_col).alias("row"), words(text_or_empty(text_col)).alias("w"))
    wanted = stored(tokens.select("token").distinct(), "wanted-tokens")
    seen = _shingles(marked, sizes, ["row"]).select("row", "token")
    small = wanted.count() <= BROADCAST_TOKENS
    seen = seen.join(F.broadcast(wanted), "token") if small else seen.where(bit_test(F.col("token"), bit_set(wanted, F.col("token")))).join(wanted, "token")
    seen = stored(seen, "seen-shingles")
    marks = anchors(windows, tokens, seen)
    size = marks.agg(F.sum(F.octet_length(F.array_join("w", " ")) + 16 * F.size("w") + 64)).first()[0] or 0
    # sets of fixed size: documents without an anchor aren't split again
    near = marked.where(bit_test(F.col("row"), bit_set(seen.join(marks.select("token").distinct(), "token").select("row"), F.col("row"))))
    places = _shingles(near, sizes, ["row"]).where(bit_test(F.col("token"), bit_set(marks, F.col("token"))))
    # the words around a place: from where a window can begin to where one can end
    low = F.greatest(F.lit(0), F.col("at") - (window - 1))
    around = places.select("row", "token", F.col("at").alias("doc_at"), low.alias("low"), F.slice("w", low + 1, F.least(F.size("w"), F.col("at") + window) - low).alias("around"))
    met = around.join(F.broadcast(marks) if size <= BROADCAST_BYTES else marks, "token")
    start = F.col("doc_at") - F.col("at")
    inside = (start >= 0) & (start + F.size("w") <= F.col("low") + F.size("around"))
    found = met.where(F.when(inside, F.slice("around", start - F.col("low") + 1, F.size("w")) == F.col("w")).otherwise(False))
    return found.select("row", "wh", start.alias("start"), F.size("w").alias("span")), members


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A 64-bit hash of a row's id and text: rows that share an id but not a text differ."""
    return F.xxhash64(F.col(id_col).cast("string"), text_or_empty(text_col))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(row, id, n_words, n_hit, items): a row for each row of docs; items holds the sorted item ids as strings, row is row_key().

    A window is `window` consecutive item words, or the whole of a shorter item; a document word is
    hit when it lies inside any occurrence of a window. Every row is judged by its own text, also where
    ids repeat or are null. Null and empty texts have no words and no hits, null item texts and items
    without an id no windows; repeated items count once. Other columns are ignored.
    """
    found, members = hits(docs, benchmark, window, shingle, id_col, text_col, item_col, item_text)
    found = stored(found.distinct(), "hits")
    order = Window.partitionBy("row").orderBy("start", "span")
    spans = found.select("row", "start", "span").distinct()
    # words that no earlier interval has covered
    before = F.coalesce(F.max(F.col("start") + F.col("span")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = spans.select("row", F.greatest(F.lit(0), F.col("start") + F.col("span") - F.greatest("start", before)).alias("new"))
    n_hit = new.groupBy("row").agg(F.sum("new").alias("n_hit"))
    items = found.select("row", "wh").distinct().join(members, "wh").groupBy("row").agg(F.array_sort(F.transform(F.collect_set("item_id"), lambda x: x.cast("string"))).alias("items"))
    n_words = F.size(F.array_remove(F.split(text_or_empty(text_col), SPLIT_ANY_CASE), ""))
    base = docs.select(row_key(id_col, text_col).alias("row"), F.col(id_col).alias("id"), n_words.cast("long").alias("n_words"))
    per = n_hit.join(items, "row")
    return base.join(per, "row", "left").select("row", "id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def is_contaminated(share: int = 20) -> Column:
    """The rule on n_hit and n_words: hit words are at least one in `share`."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, share: int = 20, window: int = 13, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that aren't contaminated, with their columns; rows, not ids, are judged, as in contamination().

    Only documents whose hash is in the bit set of the contaminated ones are shuffled.
    """
    bad = stored(contamination(docs, benchmark, window, shingle, id_col, text_col, item_col, item_text).where(is_contaminated(share)).select("row").distinct(), "contaminated")
    return without_rows(docs, bad, row_key(id_col, text_col))
