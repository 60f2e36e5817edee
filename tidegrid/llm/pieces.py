"""Encoding into, and decoding from, the pieces of a SentencePiece model: by a streaming Viterbi search, or by the merges of a BPE model."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: How far an unknown character lies below the lowest piece.
UNKNOWN_PENALTY = 10.0
#: Words that a Python worker remembers; it forgets the half not met of late.
CACHE_WORDS = 400_000
#: Words longer than this are not remembered.
CACHE_LENGTH = 64
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: In a model file: the fields of a piece and of the trainer's settings, a piece's type and the model's type, and the values of these.
PIECE_FIELD, TRAINER_FIELD, KIND_FIELD, MODEL_FIELD = 1, 2, 3, 3
USER_DEFINED, UNUSED, UNIGRAM, BPE = 4, 5, 1, 2


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            out |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return out

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, raw[at : at + size]
            at += size


def by_merges(model: bytes) -> bool:
    """Whether a model file's pieces are merges of a BPE model rather than those of a unigram model."""
    fields = list(_fields(model))
    found = next((dict(_fields(x)).get(MODEL_FIELD, UNIGRAM) for k, x in fields if k == TRAINER_FIELD), UNIGRAM)
    if found not in (UNIGRAM, BPE):
        raise ValueError("the model must be a unigram or a BPE model")
    if found == BPE and any(dict(_fields(x)).get(KIND_FIELD) in (USER_DEFINED, UNUSED) for k, x in fields if k == PIECE_FIELD):
        raise ValueError("user-defined and unused pieces of a BPE model are not supported")
    return found == BPE


def load_model(model_path: str) -> tuple[list[tuple[str, float, str]], bool]:
    """The table of load_table(), and whether the model encodes by merges."""
    import sentencepiece

    return load_table(model_path), by_merges(sentencepiece.SentencePieceProcessor(model_file=model_path).serialized_model_proto())


def load_table(model_path: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id; kind is normal, byte or other. Read where the file is, then sent to the tasks: its size is the model's."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    kind = lambda i: "byte" if m.is_byte(i) else "other" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "normal"
    return [(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())]


class Pieces:
    """The pieces of one model and the search over them."""

    def __init__(self, table: list[tuple[str, float, str]], merges: bool = False):
        self.table = table
        #: Whether texts are encoded by merges, as BPE models do, rather than by the largest sum of scores.
        self.merges = merges
        self.gains = {p: s for p, s, k in table if k == "normal"}
        self.ids = {p: (i, s) for i, (p, s, k) in enumerate(table) if k == "normal"}
        self.longest = max((len(p) for p in self.ids), default=1)
        #: The pieces as a tree: under each character, (what may follow, the ids of the piece that ends here or nothing, its score).
        self.tree: dict[str, tuple[dict, tuple[int, ...], float]] = {}
        for p, (i, x) in self.ids.items():
            under = self.tree
            for c in p[:-1]:
                under = under.setdefault(c, ({}, (), 0.0))[0]
            under[p[-1]] = (under[p[-1]][0] if p[-1] in under else {}, (i,), x)
        #: Neighbours within pieces: paths meet between any other two characters.
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, k) in enumerate(table) if k == "byte"}
        self.unknown = next((i for i, (p, _, k) in enumerate(table) if k == "other" and p == "<unk>"), 0)
        self.worst = min((s for _, s in self.ids.values() if s > -1e8), default=0.0) - UNKNOWN_PENALTY
        self.decoded = [bytes([int(p[1:-1], 16)]) if k == "byte" else b"" if k == "other" else p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for p, _, k in table]
        #: Where a piece may run on after a character that is not a space into a space; such models get no word cache.
        self.crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)

    def stream(self, chars: Iterable[str]) -> Iterator[int]:
        """Ids of the best segmentation: largest sum of scores; of equal ones the longest last piece, at each boundary.

        Characters are read in blocks. A boundary is extended once as many characters follow it as the
        longest piece has, so the paths that survive all end within that length of the last boundary
        extended. When they go back to one boundary, everything before it is final: its ids are given out
        and its characters forgotten. Without a common boundary the paths are held until one is found,
        which in the worst case is the end of the text.
        """
        tree, ids, longest, worst = self.tree, self.ids, self.longest, self.worst
        source, block = iter(chars), 2 * longest
        held, best, back = "", [0.0], [None]  # at each boundary: the best score, (characters, ids) of the last piece
        ready, ended = 0, False
        while not ended:
            more = "".join(islice(source, block))
            ended = len(more) < block
            held += more
            n = len(held)
            best += [float("-inf")] * len(more)
            back += [None] * len(more)
            last = n if ended else n - longest + 1
            for i in range(ready, last):
                score, under, j = best[i], tree, i
                for c in held[i : i + longest]:
                    hit = under.get(c)
                    if hit is None:
                        break
                    under, piece, gain = hit
                    j += 1
                    if piece and score + gain > best[j]:
                        best[j], back[j] = score + gain, (j - i, piece)
                if best[i + 1] < score + worst and held[i] not in ids:
                    best[i + 1], back[i + 1] = score + worst, (1, self.spelled(held[i]))
            ready = last
            if not ended:
                common = self.common(back, [k for k in range(ready, n + 1) if back[k] is not None])
                yield from self.path(back, common)
                held, best, back, ready = held[common:], best[common:], back[common:], ready - common
        yield from self.path(back, len(held))

    def merged(self, chars: str) -> Iterator[int]:
        """Ids by merges: of all neighbours that make a piece, those of the best score are joined first, of equal ones the leftmost."""
        pairs, at = self.pairs, 0
        # no piece holds two characters that are not in pairs, so nothing is joined across them
        for k in range(1, len(chars) + 1):
            if k == len(chars) or chars[k - 1 : k + 1] not in pairs:
                for p in self.joined(chars[at:k]) if k - at > 1 else chars[at:k]:
                    if p in self.ids:
                        yield self.ids[p][0]
                    else:
                        yield from self.spelled(p)
                at = k

    def joined(self, chars: str) -> list[str]:
        gains, none = self.gains, float("-inf")
        parts = list(chars)
        if len(parts) > CACHE_LENGTH:
            return self.joined_long(parts)
        scores = [gains.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > none:
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = gains.get(parts[k - 1] + parts[k], none)
            if k < len(scores):
                scores[k] = gains.get(parts[k] + parts[k + 1], none)
        return parts

    def joined_long(self, parts: list[str]) -> list[str]:
        """As joined(), with the neighbours in a heap and the parts as a linked list: n log n for texts without spaces."""
        gains, n = self.gains, len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(-gains[p], k, p) for k in range(n - 1) if (p := parts[k] + parts[k + 1]) in gains]
        heapify(heap)
        while heap:
            _, k, p = heappop(heap)
            j = after[k]
            # one of the two may have been joined to another since
            if not parts[k] or j == n or parts[k] + parts[j] != p:
                continue
            parts[k], parts[j], after[k] = p, "", after[j]
            if after[k] < n:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (q := parts[a] + parts[b]) in gains:
                    heappush(heap, (-gains[q], a, q))
        return [p for p in parts if p]

    def search(self, chars: str) -> Iterator[int]:
        return self.merged(chars) if self.merges else self.stream(chars)

    def spelled(self, c: str) -> tuple[int, ...]:
        """An unknown character as its bytes, or as the unknown id if the model has no bytes."""
        raw = c.encode("utf-8", "surrogatepass")
        return tuple(self.bytes[b] for b in raw) if all(b in self.bytes for b in raw) else (self.unknown,)

    @staticmethod
    def path(back: list, at: int) -> list[int]:
        parts = []
        while at > 0:
            size, piece = back[at]
            parts.append(piece)
            at -= size
        return [i for p in reversed(parts) for i in p]

    @staticmethod
    def common(back: list, alive: Iterable[int]) -> int:
        """The last boundary through which the paths into all of these boundaries go; 0 is one."""
        heads = set(alive)
        while len(heads) > 1:
            far = max(heads)
            heads.discard(far)
            heads.add(far - back[far][0])
        return heads.pop()

    def encode(self, text: str, cache: dict[str, bytes] | None = None) -> bytes:
        """Little-endian 32-bit ids of a text, after the model's leading space."""
        if not text:
            return b""
        if cache is None or self.crossing:
            return array("i", self.search(SPACE + text.replace(" ", SPACE))).tobytes()
        words = text.split(" ")
        if "" in words:
            # runs of spaces: no piece runs from other characters into a space, so paths meet before each run
            words = [w[1:] if w[0] == SPACE and (len(w) < 2 or w[1] != SPACE) else "\0" + w for w in UNIT.findall(SPACE + text.replace(" ", SPACE))]
        elif SPACE in text:
            return self.encode(text, None)
        return b"".join(map(cache.__getitem__, words))

    def decode(self, ids: memoryview | list[int]) -> str:
        """The text of ids: bytes are joined before they are read as UTF-8, and the leading space goes."""
        raw = b"".join(map(self.decoded.__getitem__, ids))
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


class WordCache(dict):
    """Ids by word. A missing word is looked for among those met before the last clearing, then searched."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        found = self.before.pop(word, None)
        if found is None:
            found = self.search(word)
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS // 2:
                self.before = dict(self)
                self.clear()
            self[word] = found
        return found

    def search(self, word: str) -> bytes:
        if 2 < len(word) <= CACHE_LENGTH and word[-2:] not in self.pieces.pairs:
            return self[word[:-1]] + array("i", self.pieces.search(word[-1])).tobytes()
        unit = word[1:] if word[:1] == "\0" and word[1:2] == SPACE else SPACE + word
        return array("i", self.pieces.search(unit)).tobytes()


_HELD: dict[str, tuple[Pieces, WordCache]] = {}


def _held(name: str, model: tuple[list[tuple[str, float, str]], bool]) -> tuple[Pieces, WordCache]:
    """One model and cache for a Python worker, however many tasks it runs."""
    if name not in _HELD:
        _HELD.clear()
        pieces = Pieces(*model)
        _HELD[name] = pieces, WordCache(pieces)
    return _HELD[name]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_pieces, round_trip) for every row of docs.

    A unigram model's texts get the pieces of the largest sum of scores, a BPE model's those that its
    merges make. Each text is searched whole, with a leading space and spaces as U+2581; other characters
    are taken as they are, and one that no piece covers becomes its UTF-8 bytes. round_trip says whether decoding
    the ids gives the text. Null and empty texts have no ids. Rows with a null id and repeated rows are
    kept. An empty table gives no rows. Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(load_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, cache = _held(model_path, model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = [pieces.encode(t, cache) for t in texts]
                counts = [len(x) // 4 for x in found]
                same = [pieces.decode(memoryview(x).cast("i")) == t for x, t in zip(found, texts)]
                offsets = [0]
                for n in counts:
                    offsets.append(offsets[-1] + n)
                values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(found))])
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(counts, pa.int64()), pa.array(same, pa.bool_())], ["id", "ids", "n_pieces", "round_trip"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, n_pieces long, round_trip boolean")


def decode(rows: DataFrame, model_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from ids; null ids give a null text, no ids an empty one."""
    model = rows.sparkSession.sparkContext.broadcast(load_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, _ = _held(model_path, model.value)
        for batch in batches:
            texts = [None if x is None else pieces.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    rows = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string")
