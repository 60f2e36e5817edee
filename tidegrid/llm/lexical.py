"""Ranked lexical search: Block-Max WAND over shards of compressed posting blocks."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SET_BITS, small_batches, stored

#: Bytes that end a term; every byte of a character beyond ASCII belongs to one.
ENDS = bytes(b for b in range(128) if not chr(b).isalnum())
TABLE = bytes.maketrans(ENDS + bytes(range(65, 91)), b" " * len(ENDS) + bytes(range(97, 123)))
#: A shard holds about so many documents, or so many term occurrences if those are reached first.
SHARD_DOCS, SHARD_TERMS = 8192, 1 << 22
#: A task deals its documents to the shards in runs of so many documents or occurrences.
RUN_DOCS, RUN_TERMS = 512, 1 << 18
#: Postings of a block.
BLOCK = 128
#: Rows of the batches that tasks write.
OUT_ROWS = 2048
#: Stretches of one bound that the first move takes; each later move takes twice as many as the one before.
FIRST_MOVE = 8


class Statistics(NamedTuple):
    """Documents with a term, all terms with repeats, and all rows."""

    documents: int
    terms: int
    rows: int


def terms_of(text: bytes | None) -> list[bytes]:
    """The maximal runs of letters and digits of ASCII and of all characters beyond it, with A-Z lower-cased."""
    return text.translate(TABLE).split() if text else []


def impact(tf: int, n: int, stats: Statistics) -> int:
    """The part of a term's score that its weight multiplies: between 0 and 1,000,000, rising with tf and falling with the length n."""
    m = 100 - 90 + (90 * n * stats.documents) // stats.terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def pack(values: np.ndarray) -> bytes:
    """Numbers below 2**32, each in as many bits as the largest needs; the first byte says how many."""
    width = int(values.max(initial=0)).bit_length()
    bits = np.unpackbits(values.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return bytes([width]) + np.packbits(bits[:, 32 - width :]).tobytes()


def unpack(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """The n numbers that pack() wrote at a place, and the place after them."""
    width = data[at]
    stop = at + 1 + (n * width + 7) // 8
    full = np.zeros((n, 32), np.uint8)
    full[:, 32 - width :] = np.unpackbits(np.frombuffer(data, np.uint8, stop - at - 1, at + 1), count=n * width).reshape(n, width)
    return np.packbits(full, axis=1).view(">u4").ravel().astype(np.int64), stop


class Postings:
    """One term's list in a shard: the last document and the largest impact of each block can be read without its payload."""

    __slots__ = ("n", "last", "top", "at", "data", "held")

    def __init__(self, n: int, last: np.ndarray, top: np.ndarray, at: np.ndarray, data: bytes) -> None:
        self.n, self.last, self.top, self.at, self.data = n, last, top, at, data
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, docs: np.ndarray, parts: np.ndarray) -> Postings:
        """From rising document numbers and their impacts."""
        starts = np.arange(0, len(docs), BLOCK)
        gaps = np.diff(docs, prepend=-1) - 1
        blocks = [pack(gaps[s : s + BLOCK]) + pack(parts[s : s + BLOCK]) for s in starts]
        return cls(len(docs), docs[np.minimum(starts + BLOCK, len(docs)) - 1], np.maximum.reduceat(parts, starts), np.cumsum([0, *map(len, blocks[:-1])]), b"".join(blocks))

    def block(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block; it is decompressed the first time."""
        if j not in self.held:
            n = min(BLOCK, self.n - j * BLOCK)
            gaps, at = unpack(self.data, int(self.at[j]), n)
            parts, _ = unpack(self.data, at, n)
            self.held[j] = (np.cumsum(gaps + 1) + (self.last[j - 1] if j else -1), parts)
        return self.held[j]


def best(lists: list[Postings], weights: list[int], ties: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the k highest scores above 0 of a shard; of equal scores those of lower ties.

    A pointer stands on a document of a list of one block and on a block of a longer list. The documents
    between two places where a pointer moves share one upper bound: the weighted sum of the impacts
    there, or of the largest ones of the blocks that they fall into. Pointers move over these stretches
    by the bounds alone. A stretch under the threshold, the k-th score so far, is passed over, and a block
    is decompressed only if a stretch that reaches the threshold lies in it. The first move goes to the
    stretches of highest bounds, so that the threshold is high from then on; the later ones go on in
    the order of documents.
    """
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not lists:
        return docs, scores
    # (first and last documents of a list's pieces, their largest impacts)
    pieces = [(x.block(0)[0], *x.block(0)) if len(x.last) == 1 else (np.concatenate([[0], x.last[:-1] + 1]), x.last, x.top) for x in lists]
    ends = np.unique(np.concatenate([np.concatenate([since[since > 0] - 1, last]) for since, last, _ in pieces]))
    change = np.zeros(len(ends) + 1, np.int64)
    for (since, last, top), w in zip(pieces, weights):
        value = top.astype(np.int64) * w
        np.add.at(change, np.searchsorted(ends, since), value)
        np.add.at(change, np.searchsorted(ends, last) + 1, -value)
    bound = np.cumsum(change)[:-1]
    left = np.ones(len(ends), bool)
    threshold, move, first = 1, FIRST_MOVE, True
    while True:
        live = np.flatnonzero(left & (bound >= threshold))
        if not len(live):
            return docs, scores
        here = live[np.argpartition(-bound[live], move - 1)[:move]] if first and len(live) > move else live[:move]
        left[here] = False
        chosen = np.zeros(len(ends), bool)
        chosen[here] = True
        found, added = [], []
        for x, w in zip(lists, weights):
            for j in np.unique(np.searchsorted(x.last, ends[here])):
                if j < len(x.last):
                    d, p = x.block(int(j))
                    keep = chosen[np.searchsorted(ends, d)]
                    found.append(d[keep])
                    added.append(p[keep] * w)
        new, at = np.unique(np.concatenate(found), return_inverse=True)
        total = np.zeros(len(new), np.int64)
        np.add.at(total, at, np.concatenate(added))
        good = total >= threshold
        docs, scores = np.concatenate([docs, new[good]]), np.concatenate([scores, total[good]])
        order = np.lexsort((ties[docs], -scores))[:k]
        docs, scores = docs[order], scores[order]
        threshold = max(1, int(scores[-1])) if len(scores) == k else 1
        first, move = False, move * 2


def statistics(docs: DataFrame, text_col: str = "text") -> Statistics:
    """Counts over all documents; a null text has no terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(terms_of(t.as_py())) for t in batch.column(0)]
            yield pa.RecordBatch.from_pydict({"documents": [sum(x > 0 for x in n)], "terms": [sum(n)], "rows": [len(n)]})

    with small_batches(docs.sparkSession):
        made = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "documents long, terms long, rows long")
        row = made.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("documents", "terms", "rows")]).first()
    return Statistics(*row)


def _hash(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term) & ((1 << SET_BITS) - 1)


def term_set(queries: DataFrame) -> np.ndarray:
    """A bit for each hash of a query term, 128 kB however many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = sorted({_hash(t.as_py()) for t in batch.column(0)})
            yield pa.RecordBatch.from_pydict({"low": pa.array(low, pa.int64())})

    words = queries.select(F.col("term").cast("binary")).mapInArrow(run, "low long").groupBy(F.shiftright("low", 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(low & 7 as int))")).alias("held"))
    bits = np.zeros(1 << (SET_BITS - 3), np.uint8)
    for byte, held in words.collect():  # at most 2**17 rows, by the set's size
        bits[byte] = held
    return np.unpackbits(bits, bitorder="little").astype(bool)


def build(docs: DataFrame, stats: Statistics, wanted: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index, one row for each shard and term: (shard, term, n, last, top, at, data), and one for each shard without a term: (shard, ids).

    Every row of docs is in one shard. wanted, from term_set(), leaves out the terms of no query. A
    task deals its documents to the shards in runs, drawn by a hash of the run, so neither a hot key nor
    the order of the documents fills one shard. Only postings are shuffled, never texts.
    """
    shards = max(1, math.ceil(stats.rows / SHARD_DOCS), math.ceil(stats.terms / SHARD_TERMS))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    id_type = rows.schema["id"].dataType
    arrow_ids = pa.list_(rows.limit(0).toArrow().schema.field("id").type)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0

        def emit(ids: list[Any], lists: dict[bytes, tuple[list[int], list[int]]]) -> Iterator[pa.RecordBatch]:
            run = (part << 32) + count
            shard = xxhash.xxh64_intdigest(run.to_bytes(8, "little")) % shards
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([run], pa.int64()), pa.array([None], pa.binary()), pa.array([ids], arrow_ids), pa.array([None], pa.list_(pa.int32())), pa.array([None], pa.list_(pa.int32()))], names)
            keys = list(lists)
            for at in range(0, len(keys), OUT_ROWS):
                some = keys[at : at + OUT_ROWS]
                docs_of, parts_of = ([lists[t][i] for t in some] for i in (0, 1))
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array([run] * n, pa.int64()), pa.array(some, pa.binary()), pa.nulls(n, arrow_ids), pa.array(docs_of, pa.list_(pa.int32())), pa.array(parts_of, pa.list_(pa.int32()))], names)

        names = ["shard", "run", "term", "ids", "docs", "parts"]
        ids: list[Any] = []
        lists: dict[bytes, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
        held = 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                found = terms_of(text.as_py())
                for term, tf in Counter(found).items():
                    if wanted is None or wanted[_hash(term)]:
                        to = lists[term]
                        to[0].append(len(ids))
                        to[1].append(impact(tf, len(found), stats))
                ids.append(key.as_py())
                held += len(found)
                if len(ids) >= RUN_DOCS or held >= RUN_TERMS:
                    yield from emit(ids, lists)
                    ids, held, count = [], 0, count + 1
                    lists.clear()
        if ids:
            yield from emit(ids, lists)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "term", "ids", "n", "last", "top", "at", "data"]
        types = [pa.int32(), pa.binary(), arrow_ids, pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out.clear()
            return made

        # rows come by shard and term, those without a term first
        shard, first, ids, term, docs, parts = None, {}, [], None, [], []

        def close() -> None:
            if docs:
                x = Postings.of(np.concatenate(docs), np.concatenate(parts))
                out.append((shard, term, None, x.n, x.last, x.top, x.at, x.data))
            elif ids:
                out.append((shard, None, list(ids), None, None, None, None, None))
            docs.clear(), parts.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                s, run, t, own, d, p = (batch.column(c)[i] for c in range(6))
                s, run, t = s.as_py(), run.as_py(), t.as_py()
                if (s, t) != (shard, term):
                    close()
                    if len(out) >= OUT_ROWS:
                        yield flush()
                    if s != shard:
                        first, ids = {}, []
                    shard, term = s, t
                if t is None:
                    first[run] = len(ids)
                    ids.extend(own.as_py())
                else:
                    docs.append(d.values.to_numpy().astype(np.int64) + first[run])
                    parts.append(p.values.to_numpy().astype(np.int64))
        close()
        if out:
            yield flush()

    dealt = rows.mapInArrow(deal, f"shard int, run long, term binary, ids array<{id_type.simpleString()}>, docs array<int>, parts array<int>")
    sorted_ = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("term").asc_nulls_first(), "run")
    with small_batches(docs.sparkSession):
        return stored(sorted_.mapInArrow(merge, f"shard int, term binary, ids array<{id_type.simpleString()}>, n int, last array<int>, top array<int>, at array<int>, data binary"), "lexical-index")


def query_terms(queries: DataFrame, query_col: str, text_col: str) -> DataFrame:
    """(query, term): the different terms of each query; rows of one id, null too, are one query."""
    rows = queries.select(F.col(query_col).alias("query"), F.col(text_col).cast("binary").alias("text"))
    made_of = rows.limit(0).toArrow().schema.field("query").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(t.as_py()))) for t in batch.column(1)]
            ids = [q.as_py() for q, ts in zip(batch.column(0), found) for _ in ts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, made_of), pa.array(list(chain.from_iterable(found)), pa.binary())], ["query", "term"])

    return rows.mapInArrow(run, f"query {rows.schema['query'].dataType.simpleString()}, term binary").distinct()


def search(index: DataFrame, terms: DataFrame, stats: Statistics, k: int = 10) -> DataFrame:
    """(query, rank, id, score): the k highest-scoring documents above 0 of each query of terms(query, term), equal scores by ascending id, null ids last.

    A query is sent to every shard, whose own best k then meet. A task holds one shard and streams the
    queries past it.
    """
    shards = max(1, math.ceil(stats.rows / SHARD_DOCS), math.ceil(stats.terms / SHARD_TERMS))
    df = index.where("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * stats.documents + 2) / (2 * F.col("df") + 1))).cast("long")
    # a term that no document has takes no part
    asked = terms.join(df, "term").select("query", F.struct("term", weight.alias("w")).alias("t")).where("t.w > 0").groupBy("query").agg(F.sort_array(F.collect_list("t")).alias("t"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "query", F.col("t.term").alias("terms"), F.col("t.w").alias("weights"))
    both = index.withColumn("kind", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    both = both.select("shard", "kind", "term", "ids", "n", "last", "top", "at", "data", "query", "terms", "weights")
    query_type, id_type = terms.schema["query"].dataType.simpleString(), index.schema["ids"].dataType.elementType.simpleString()
    head = both.limit(0).toArrow().schema
    arrow_query, arrow_id = head.field("query").type, head.field("ids").type.value_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, ties, lists = None, [], np.zeros(0, np.int64), {}
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                s, kind, term = (batch.column(c)[i].as_py() for c in range(3))
                if s != shard:
                    shard, ids, lists = s, [], {}
                if kind == 0 and term is None:
                    ids = batch.column(3)[i].as_py()
                    order = sorted(range(len(ids)), key=lambda d: (ids[d] is None, 0 if ids[d] is None else ids[d]))
                    ties = np.empty(len(ids), np.int64)
                    ties[order] = np.arange(len(ids))
                elif kind == 0:
                    last, top, at = (batch.column(c)[i].values.to_numpy() for c in (5, 6, 7))
                    lists[term] = Postings(batch.column(4)[i].as_py(), last.astype(np.int64), top, at, batch.column(8)[i].as_py())
                else:
                    here = [(lists[t], w) for t, w in zip(batch.column(10)[i].as_py(), batch.column(11)[i].as_py()) if t in lists]
                    docs, scores = best([x for x, _ in here], [w for _, w in here], ties, k)
                    query = batch.column(9)[i].as_py()
                    out.extend((query, ids[d], int(x)) for d, x in zip(docs, scores))
            if out:
                q, d, x = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(q, arrow_query), pa.array(d, arrow_id), pa.array(x, pa.int64())], ["query", "id", "score"])

    ready = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind", F.col("term").asc_nulls_first())
    with small_batches(index.sparkSession):
        found = stored(ready.mapInArrow(run, f"query {query_type}, id {id_type}, score long"), "lexical-found")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "score")


def top_documents(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text_col: str = "text") -> DataFrame:
    """(query, rank, id, score) of all queries against all documents, over an index of the terms that the queries hold.

    A score is the sum over a query's different terms of weight times impact(), in whole numbers; a
    weight is floor(1000 ln((2N + 2) / (2df + 1))). Whole texts count. A null or empty text has no
    terms: as a document it is found by no query, as a query it gives no rows. Rows of one query id
    are one query; repeated documents are ranked each for itself. Empty tables give no rows. Other
    columns are ignored.
    """
    stats = statistics(docs, text_col)
    terms = stored(query_terms(queries, query_col, query_text_col), "lexical-terms")
    return search(build(docs, stats, term_set(terms), id_col, text_col), terms, stats, k)
