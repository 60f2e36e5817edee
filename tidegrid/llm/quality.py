"""Quality classifier by co-training a content view and a page-metadata view."""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_tables, small_batches, stored, without_rows

#: Labelled rows that are fitted at most, and entries of their features together. They are chosen by a hash of the id.
LABELLED_ROWS, LABELLED_ENTRIES = 3_000, 2_000_000
ROUNDS = 3
#: Parts, by a hash, into which each class of pseudo-labelled documents is summed; their means are fitted.
PARTS = 4
#: What the pseudo-labelled documents of a round weigh against the labelled ones.
PSEUDO_WEIGHT = 0.5
#: A view labels a document for the other one when it is this sure, or as sure as of this share of the held-out rows, at either end: a weak view is seldom surer.
CONFIDENT, TAIL = 0.97, 0.05
#: Share of the labelled rows that are held out to calibrate the views.
HELD_OUT = 0.3
DIMENSION = 1 << 15
STEPS = 120
#: Word weights are kept as multiples of this, so that sums do not depend on their order.
UNIT = 2.0**-32
CACHE_WORDS = 60_000
#: Tokens longer than this, as of languages without spaces, are split into overlapping pieces of three characters.
LONG_TOKEN = 32
#: Entries of the training data that are worked on at a time.
BLOCK = 1 << 18
#: Rows of features that are scored or summed at a time, and what a task holds of their table while it writes or reads it.
SCORED_ROWS, ROW_GROUP = 256, 16 << 20


def word_features(word: str) -> list[int]:
    """Hashed features of a word: itself in lower case, its last three characters, its shape."""
    shape = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    short = re.sub(r"(.)\1+", r"\1", shape)
    return [xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) % DIMENSION for x in ("w" + word.lower(), "e" + word[-3:], "s" + short)]


def tokens(text: str) -> Counter:
    """Counts of a text's words; the whole of a long one counts, as its overlapping pieces."""
    counts = Counter(text.split())
    for w in [w for w in counts if len(w) > LONG_TOKEN]:
        n = counts.pop(w)
        for i in range(len(w) - 2):
            counts[w[i : i + 3]] += n
    return counts


def repetition_features(counts: Counter) -> list[int]:
    """Two hashed features of a whole text: the share of its commonest word, and how often words repeat, in steps."""
    total = max(1, sum(counts.values()))
    top, times = max(counts.values(), default=0) / total, total / max(1, len(counts))
    size = min(6, int(math.log10(total + 1) * 2))
    return [xxhash.xxh32_intdigest(x) % DIMENSION for x in (f"t{int(top * 10)}/{size}", f"r{min(12, int(2 * math.log2(times)))}/{size}")]


def metadata(text: str, source: object, lang: object) -> list[float]:
    """Page metadata: length and layout, then hashed source and language. Words themselves do not count."""
    words, lines = text.split(), text.count("\n") + 1
    n = max(1, len(text))
    out = [math.log1p(len(text)), math.log1p(lines), math.log1p(n / lines), len(words) / n * 6, math.log1p(len(words) / lines), 1.0]
    hashed = [0.0] * 48
    hashed[xxhash.xxh32_intdigest(f"s{source}".encode()) % 32] = 1.0
    hashed[32 + xxhash.xxh32_intdigest(f"l{lang}".encode()) % 16] = 1.0
    return out + hashed


META = 6 + 48


@dataclass
class Sparse:
    """Rows of sparse features: ids and values, cut at offsets."""

    ids: np.ndarray
    values: np.ndarray
    offsets: np.ndarray

    def blocks(self) -> Iterator[tuple[int, int, slice]]:
        """Row ranges of about BLOCK entries, with their slice of the entries: what is made of them at a time stays small."""
        row, n = 0, len(self.offsets) - 1
        while row < n:
            stop = max(row + 1, int(np.searchsorted(self.offsets, self.offsets[row] + BLOCK, "right")) - 1)
            yield row, stop, slice(int(self.offsets[row]), int(self.offsets[stop]))
            row = stop

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.offsets) - 1)
        for row, stop, part in self.blocks():
            sums = np.add.reduceat(np.append(w[self.ids[part]] * self.values[part], 0.0), self.offsets[row:stop] - part.start)
            out[row:stop] = sums * (np.diff(self.offsets[row : stop + 1]) > 0)
        return out

    def back(self, g: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n)
        for row, stop, part in self.blocks():
            out += np.bincount(self.ids[part], self.values[part] * np.repeat(g[row:stop], np.diff(self.offsets[row : stop + 1])), minlength=n)
        return out

    def rows(self, keep: np.ndarray) -> Sparse:
        parts = [slice(self.offsets[i], self.offsets[i + 1]) for i in keep]
        cat = lambda a: np.concatenate([a[p] for p in parts]) if parts else a[:0]
        return Sparse(cat(self.ids), cat(self.values), np.concatenate([[0], np.cumsum([p.stop - p.start for p in parts], dtype=np.int64)]))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(x: Sparse, y: np.ndarray, weight: np.ndarray, n: int, ridge: float = 1e-5, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Logistic regression with balanced classes, by Adam on the whole gradient."""
    share = np.array([max(1e-9, weight[y == c].sum()) for c in (0, 1)])
    weight = weight * (0.5 / share)[y]
    w, b = np.zeros(n + 1), 0.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        g = weight * (_sigmoid(x.dot(w[:n]) + w[n]) - y)
        grad = np.append(x.back(g, n) + ridge * w[:n], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.25 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    b = w[n]
    return w[:n], float(b)


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn scores into log odds; smoothed targets, Newton steps."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(1e-6, float(np.abs(score).max(initial=0.0)))
    s, theta = score / scale, np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(theta[0] * s + theta[1])
        g = np.array([((p - target) * s).sum() + 1e-3 * theta[0], (p - target).sum()])
        q = p * (1 - p)
        h = np.array([[(q * s * s).sum() + 1e-3, (q * s).sum()], [(q * s).sum(), q.sum() + 1e-6]])
        theta = theta - np.clip(np.linalg.solve(h, g), -2, 2)
    return float(max(0.0, theta[0]) / scale), float(theta[1])


@dataclass
class View:
    """A linear view, and what makes log odds of its scores."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    #: Probabilities from which on, and up to which, the view labels documents.
    high: float = 1.0
    low: float = 0.0


@dataclass
class Model:
    """The content view and the metadata view. Without both classes among the labels there are none, and the prior is the smoothed share of good ones."""

    prior: float
    views: list[View] = field(default_factory=list)
    mean: np.ndarray = field(default_factory=lambda: np.zeros(META))
    sd: np.ndarray = field(default_factory=lambda: np.ones(META))
    stats: dict = field(default_factory=dict)


_HELD: dict[str, array] = {}


def _lists(texts: list[str]) -> tuple[pa.Array, pa.Array]:
    """Ids (int16) of the content features of texts, three for each word and the two of repetition, and each word's share of its text (float32), packed. An id may occur more than once."""
    ids, shares, ends = array("h"), [], [0]
    for text in texts:
        counts = tokens(text)
        for w in counts:
            found = _HELD.get(w)
            if found is None:
                found = array("h", word_features(w))
                if len(_HELD) >= CACHE_WORDS:
                    _HELD.clear()
                _HELD[w] = found
            ids += found
        n = np.fromiter(counts.values(), dtype=np.float32, count=len(counts))
        shares.append(n / max(1.0, float(n.sum())))
        ids += array("h", repetition_features(counts))
        ends.append(len(ids))
    values = np.concatenate(shares) if shares else np.zeros(0, dtype=np.float32)
    words = np.cumsum([0, *map(len, shares)])
    return _packed(np.array(ends), ids.tobytes(), 2), _packed(words, values.tobytes(), 4)


def _packed(ends: np.ndarray, raw: bytes, width: int) -> pa.Array:
    """An array of byte strings that hold so many numbers of so many bytes each."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((width * ends).astype(np.int32).tobytes()), pa.py_buffer(raw)])


def _flat(column: pa.Array | pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All the numbers of a column of _packed(), and where each row's begin and end."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, at, raw = c.buffers()
    ends = np.frombuffer(at, dtype=np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64) if len(c) else np.zeros(1, dtype=np.int64)
    held = np.frombuffer(raw, dtype=np.uint8)[ends[0] : ends[-1]].copy().view(kind) if raw is not None and ends[-1] > ends[0] else np.zeros(0, dtype=kind)
    return held, (ends - ends[0]) // np.dtype(kind).itemsize


def _spread(shares: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The values of the ids that _lists() makes: each word's share for its three, and 1 for both of repetition, which end a row."""
    ends = words[1:] + np.arange(len(words) - 1)
    times = np.full(len(shares) + len(ends), 3)
    times[ends] = 2
    return np.repeat(np.insert(shares, words[1:], 1), times)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", lang_col: str | None = "lang") -> DataFrame:
    """(id, row, ids, shares, meta): both views' features of every row of docs, as packed numbers; row is row_key()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [t or "" for t in part.column(2).to_pylist()]
                meta = np.array([metadata(t, s, g) for t, s, g in zip(texts, part.column(3).to_pylist(), part.column(4).to_pylist())], dtype=np.float32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *_lists(texts), _packed(np.arange(len(texts) + 1) * META, meta.tobytes(), 4)],
                    ["id", "row", "ids", "shares", "meta"],
                )
            pa.default_memory_pool().release_unused()

    col = lambda c: (F.col(c) if c else F.lit(None)).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col, source_col, lang_col).alias("row"), F.col(text_col).alias("text"), col(source_col).alias("source"), col(lang_col).alias("lang"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, row long, ids binary, shares binary, meta binary")


def row_key(id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", lang_col: str | None = "lang") -> Column:
    """A 64-bit hash of what a row's scores come from, and of its id."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in (id_col, text_col, source_col, lang_col) if c])


def _matrices(batch: pa.RecordBatch | pa.Table, model: Model) -> tuple[Sparse, Sparse]:
    """Both views of a batch with columns ids, shares and meta."""
    (ids, ends), (shares, words), (meta, _) = (_flat(batch.column(c), k) for c, k in (("ids", np.int16), ("shares", np.float32), ("meta", np.float32)))
    n = batch.num_rows
    dense = (meta.astype(float).reshape(-1, META) - model.mean) / model.sd
    return Sparse(ids.astype(np.int32), _spread(shares, words), ends), Sparse(np.tile(np.arange(META), n), dense.ravel(), np.arange(n + 1) * META)


def scores(model: Model, batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Rows of (p_content, p_metadata, p_quality)."""
    if not model.views:
        return np.full((batch.num_rows, 3), model.prior)
    odds = [v.slope * (m.dot(v.weights) + v.bias) + v.offset for v, m in zip(model.views, _matrices(batch, model))]
    prior = math.log(model.prior / (1 - model.prior))
    # the views are taken as independent given the class
    return np.round(np.stack([*map(_sigmoid, odds), _sigmoid(odds[0] + odds[1] - prior)], axis=1), 9)


def _confident(table: DataFrame, model: Model) -> pa.Table:
    """(view, label, part, feature, total, n): sums of what the views label for each other, over all of table(row, ids, shares, meta).

    view is the one that learns. Sums are of whole multiples of UNIT, so their order has no part in them,
    and each task sums what it reads first. feature -1 counts documents. What comes to the driver is
    bounded by the features, classes and parts.
    """
    held = table.sparkSession.sparkContext.broadcast(model)
    sizes = (DIMENSION, META)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[[np.zeros(d + 1, dtype=np.int64) for _ in range(PARTS)] for _ in (0, 1)] for d in sizes]
        for batch in batches:
            for at in range(0, batch.num_rows, SCORED_ROWS):
                piece = batch.slice(at, SCORED_ROWS)
                m, p = _matrices(piece, held.value), scores(held.value, piece)
                part = piece.column("row").to_numpy() % PARTS
                for k in (0, 1):
                    for c, chosen in ((1, p[:, k] >= held.value.views[k].high), (0, p[:, k] <= held.value.views[k].low)):
                        for q in range(PARTS):
                            mine = np.flatnonzero(chosen & (part == q))
                            if len(mine):
                                other = m[1 - k].rows(mine)
                                into = sums[1 - k][c][q]
                                # sums of whole numbers below 2**53 are exact
                                into[:-1] += np.bincount(other.ids, np.rint(other.values.astype(float) / UNIT), len(into) - 1).astype(np.int64)
                                into[-1] += len(mine)
            pa.default_memory_pool().release_unused()
        for k, d in enumerate(sizes):
            for c in (0, 1):
                for q in range(PARTS):
                    at = np.flatnonzero(sums[k][c][q])
                    same = lambda x: pa.array(np.full(len(at), x, dtype=np.int32))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([same(k), same(c), same(q), pa.array(np.where(at == d, -1, at).astype(np.int32)), pa.array(sums[k][c][q][at])], ["view", "label", "part", "feature", "total"])

    made = table.select("row", "ids", "shares", "meta").mapInArrow(run, "view int, label int, part int, feature int, total long")
    return made.groupBy("view", "label", "part", "feature").agg(F.sum("total").alias("total")).toArrow()


def _labelled(table: DataFrame, labels: DataFrame, id_col: str, label_col: str, labelled_rows: int, labelled_entries: int) -> pa.Table:
    """(id, quality, ids, shares, meta) of the labelled documents that are fitted; of an id's texts the one of least row counts."""
    given = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("quality")).dropna().groupBy("id").agg(F.max("quality").alias("quality"))
    sized = table.select("id", "row", F.floor(F.octet_length("ids") / 2).alias("size")).join(given, "id").groupBy("id").agg(F.min(F.struct("row", "size", "quality")).alias("x"))
    drawn = sized.select("id", "x.*", F.xxhash64(F.col("id").cast("string"), F.lit(0)).alias("draw")).orderBy("draw", "id").limit(labelled_rows)
    # the limit holds few rows, so one window over them is small
    fits = drawn.withColumn("upto", F.sum("size").over(Window.orderBy("draw", "id"))).where(F.col("upto") <= labelled_entries).select(F.col("id").alias("chosen"), F.col("row").alias("chosen_row"), "quality")
    joined = table.join(F.broadcast(fits), (F.col("id") == F.col("chosen")) & (F.col("row") == F.col("chosen_row")))
    return joined.select(F.col("id").cast("string").alias("id"), "quality", "ids", "shares", "meta").dropDuplicates(["id"]).toArrow()


def train(table: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", labelled_rows: int = LABELLED_ROWS, labelled_entries: int = LABELLED_ENTRIES, rounds: int = ROUNDS, sure: float = CONFIDENT) -> Model:
    """Fit both views on labelled documents of table, which is that of features(), and on pseudo-labels of all its documents.

    In every round each view labels all the documents that it is sure of for the other view. They are
    summed in the executors, a class in PARTS parts, and the means of the parts are fitted beside the
    labelled documents, each class with the weight that the labels' proportion gives it. Held-out
    labelled rows calibrate each view. Null labels and null ids are left out; repeated labels of an id
    count once, as the highest.
    """
    data = _labelled(table, labels, id_col, label_col, labelled_rows, labelled_entries)
    data = data.take(np.argsort(np.array(data["id"].to_pylist(), dtype=object), kind="stable"))
    y = np.clip(data["quality"].fill_null(0).to_numpy(), 0, 1).astype(int)
    good = int(y.sum())
    prior = (good + 1) / (len(y) + 2)
    if min(good, len(y) - good) < 4:
        return Model(float(prior), stats={"labelled": len(y)})
    meta = _flat(data["meta"], np.float32)[0].astype(float).reshape(-1, META)
    model = Model(float(prior), mean=meta.mean(axis=0), sd=np.maximum(meta.std(axis=0), 0.05), stats={"labelled": len(y), "exchanged": [0, 0]})
    data_views = _matrices(data, model)
    # every class is split alike between fitting and calibration
    rank = np.array([xxhash.xxh64_intdigest(i.encode(), 7) for i in data["id"].to_pylist()], dtype=np.uint64)
    held = np.zeros(len(y), dtype=bool)
    for c in (0, 1):
        mine = np.flatnonzero(y == c)
        held[mine[np.argsort(rank[mine])[: max(2, int(HELD_OUT * len(mine)))]]] = True
    base, judged, sizes = np.flatnonzero(~held), np.flatnonzero(held), (DIMENSION, META)
    share = np.array([1 - prior, prior])
    extra: list[list[tuple[np.ndarray, np.ndarray, int, float]]] = [[], []]  # of each view: (ids, values, label, weight) of the means

    def refit(k: int) -> View:
        own = data_views[k].rows(base)
        ids, values = [own.ids, *[i for i, _, _, _ in extra[k]]], [own.values, *[v for _, v, _, _ in extra[k]]]
        ends = np.concatenate([own.offsets, own.offsets[-1] + np.cumsum([len(i) for i in ids[1:]], dtype=np.int64)])
        target = np.concatenate([y[base], np.array([c for _, _, c, _ in extra[k]], dtype=int)])
        weight = np.concatenate([np.ones(len(base)), np.array([w for _, _, _, w in extra[k]])])
        w, b = fit(Sparse(np.concatenate(ids), np.concatenate(values), ends), target, weight, sizes[k])
        score = data_views[k].rows(judged).dot(w) + b
        slope, offset = platt(score, y[judged])
        low, high = np.quantile(np.round(_sigmoid(slope * score + offset), 9), [TAIL, 1 - TAIL])
        return View(w, b, slope, offset, float(min(sure, high)), float(max(1 - sure, low)))

    model.views = [refit(0), refit(1)]
    for _ in range(rounds):
        found = _confident(table, model)
        view, label, part, feature, total = (found[c].to_numpy() for c in ("view", "label", "part", "feature", "total"))
        for k in (0, 1):
            counts = {(int(label[i]), int(part[i])): int(total[i]) for i in np.flatnonzero((view == k) & (feature < 0))}
            extra[k] = []
            for (c, q), n in sorted(counts.items()) if {c for c, _ in counts} == {0, 1} else ():
                cell = np.flatnonzero((view == k) & (label == c) & (part == q) & (feature >= 0))
                cell = cell[np.argsort(feature[cell])]
                all_of_class = sum(v for (other, _), v in counts.items() if other == c)
                extra[k].append((feature[cell], total[cell] * UNIT / n, c, PSEUDO_WEIGHT * len(base) * share[c] * n / all_of_class))
            model.stats["exchanged"][1 - k] = sum(counts.values())
        model.views = [refit(0), refit(1)]
    return model


def judged(table: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(id, row, p_content, p_metadata, p_quality, keep) of every row of table, which is that of features()."""
    held = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SCORED_ROWS):
                part = batch.slice(at, SCORED_ROWS)
                p = scores(held.value, part)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("row"), *[pa.array(p[:, k]) for k in range(3)]], ["id", "row", "p_content", "p_metadata", "p_quality"])

    kind = table.schema["id"].dataType.simpleString()
    made = table.mapInArrow(run, f"id {kind}, row long, p_content double, p_metadata double, p_quality double")
    return made.withColumn("keep", F.col("p_quality") >= threshold)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", lang_col: str | None = "lang", label_col: str = "quality", **bounds) -> DataFrame:
    """(id, row, p_content, p_metadata, p_quality, keep) for every row of docs; row is row_key().

    Texts are read once: their features are written to the shared folder, and training and scoring read
    those. They are deleted when the scores are written.
    """
    with small_batches(docs.sparkSession):
        table = stored(features(docs, id_col, text_col, source_col, lang_col), "quality-features", ROW_GROUP)
        found = stored(judged(table, train(table, labels, id_col, label_col, **bounds), threshold), "quality-scores")
    drop_tables(table)
    return found


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", lang_col: str | None = "lang", label_col: str = "quality", **bounds) -> DataFrame:
    """docs with p_content, p_metadata, p_quality and keep (p_quality >= threshold), for every row.

    The model is trained as in train(); all documents are scored, over their whole texts. Null texts
    count as empty; null sources and languages are values of their own. Repeated rows get equal scores.
    An empty table gives no rows; without labels of both classes all rows get the smoothed share of
    good labels, a half if there are none, and are kept at the threshold of a half. Columns of docs by
    the names of the results are replaced.
    """
    found = judge(docs, labels, threshold, id_col, text_col, source_col, lang_col, label_col, **bounds)
    new = ("p_content", "p_metadata", "p_quality", "keep")
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in new]).alias("held")
    rows = docs.select(held, row_key(id_col, text_col, source_col, lang_col).alias("row"))
    return rows.join(found.select("row", *new).dropDuplicates(["row"]), "row").select("held.*", *new)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", lang_col: str | None = "lang", label_col: str = "quality", **bounds) -> DataFrame:
    """The rows of docs that classify() keeps, with their columns; only rows that may be rejected are shuffled."""
    found = judge(docs, labels, threshold, id_col, text_col, source_col, lang_col, label_col, **bounds)
    bad = stored(found.where("not keep").select("row").distinct(), "quality-rejected")
    return without_rows(docs, bad, row_key(id_col, text_col, source_col, lang_col), found.select("row"))
