"""Conversation structure repair: cheapest edits for each distinct signature of roles and faults, replayed on the rows."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby, islice, pairwise
from operator import itemgetter
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, stored

#: What a text may hold and yet be blank.
SPACES = "\t\n\x0b\x0c\r "
ENDINGS = (".", "!", "?")
#: Rows of a conversation whose signature is solved as one.
SEGMENT = 64
#: Rows that one task puts in order.
RANGE_ROWS = 500_000
#: Suffixes of signatures whose cheapest edits a task remembers.
MEMO = 1 << 16

REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: States of what has been written: nothing, s, ends in u, ends in a. A conversation may end in the first or the last.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
FINAL = (EMPTY, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}

#: Columns of a signature's plans.
PLAN = ("start", "end", "cost", "audit")
#: Rows of the batches that tasks write.
OUT_ROWS = 512

Plan = dict[int, tuple[int, str]]


def inserts(state: int) -> list[tuple[int, int]]:
    """(state, number) reachable by the fewest insertions; more of them cost more and lead nowhere else."""
    out, now = [(state, 0)], state
    for n in (1, 2):
        now = next((MOVES[now, r] for r in "ua" if (now, r) in MOVES))
        if now not in [s for s, _ in out]:
            out.append((now, n))
    return out


REACH = {state: inserts(state) for state in range(4)}


@lru_cache(maxsize=MEMO)
def cheapest(signature: str, state: int) -> Plan:
    """End state to (cost, audit): the cheapest edits of the rows of a signature from a state on, of equal cost the least audit.

    A row is its role's initial, s, u, a or o (any other), in capitals if it is truncated, or - if it has
    to go. Two audits of one cost, start and end never begin one another, as those would differ by
    insertions, which cost; so the least of the parts make the least of the whole. Shared suffixes of
    different signatures are solved once.
    """
    out: Plan = {}

    def offer(end: int, cost: int, audit: str) -> None:
        if end not in out or (cost, audit) < out[end]:
            out[end] = (cost, audit)

    for before, n in REACH[state]:
        if not signature:
            offer(before, INSERT * n, "I" * n)
            continue
        row, rest = signature[0], signature[1:]
        edits = [(before, DELETE, "D")]
        if row != "-":
            cut = CUT if row.isupper() else 0
            edits += [(MOVES.get((before, row.lower())), cut, "K")] + [(MOVES.get((before, r)), REROLE + cut, "R") for r in "ua"]
        for after, cost, letter in edits:
            if after is not None:
                for end, (more, audit) in cheapest(rest, after).items():
                    offer(end, INSERT * n + cost + more, "I" * n + letter + audit)
    return out


def followed(first: dict[int, Plan], then: dict[int, Plan]) -> dict[int, Plan]:
    """The cheapest edits of two stretches of rows, from those of each."""
    out: dict[int, Plan] = {}
    for start, ends in first.items():
        for mid, (a, x) in ends.items():
            for end, (b, y) in then.get(mid, {}).items():
                held = out.setdefault(start, {}).get(end)
                if held is None or (a + b, x + y) < held:
                    out[start][end] = (a + b, x + y)
    return out


def whole(plans: list[dict[int, Plan]]) -> tuple[int, str]:
    """(cost, audit) of a conversation from those of its segments, joined two by two, so that its length costs no more than its logarithm times itself."""
    while len(plans) > 1:
        plans = [followed(*plans[i : i + 2]) if i + 1 < len(plans) else plans[i] for i in range(0, len(plans), 2)]
    return min(plans[0][EMPTY][end] for end in FINAL if end in plans[0][EMPTY])


def written(state: int, letter: str, initial: str) -> int:
    """The state after an edit of a row with that role initial. Where an edit may write either role, the grammar allows but one."""
    if letter == "D":
        return state
    return MOVES[state, initial if letter == "K" else next(r for r in "ua" if (state, r) in MOVES)]


def parts(audit: str, signatures: list[str]) -> list[tuple[int, str]]:
    """(state before, audit) of each segment of a conversation; insertions between two belong to the later, those at the end to the last."""
    out, state, at = [], EMPTY, 0
    for k, signature in enumerate(signatures):
        begin, before, used = at, state, 0
        while at < len(audit) and (used < len(signature) or k == len(signatures) - 1):
            letter = audit[at]
            state = written(state, letter, "" if letter == "I" else signature[used].lower())
            used += letter != "I"
            at += 1
        out.append((before, audit[begin:at]))
    return out


def replay(rows: list[tuple[str, str]], audit: str, state: int) -> list[tuple[str, str]]:
    """The (role, text) rows that an audit makes of a segment's rows."""
    out, at = [], 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else rows[at]
        at += letter != "I"
        state = written(state, letter, role[:1])
        if letter != "D":
            out.append((role if letter == "K" else ROLES["u" if state == USER else "a"], text))
    return out


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, turn, role, text) with the faults that crc32(conv_id:turn) % 20 draws: 0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's.

    Null roles and texts, and null ids and turns in the draw, are one space. c is a struct of the id, so that a null id is a conversation like others.
    """
    word = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(word(conv_col), F.lit(":"), word(turn_col))) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.translate(word(text_col), "".join(ENDINGS), "")).otherwise(word(text_col))
    made = conversations.where(draw != 0).select(F.struct(F.col(conv_col).alias("id")).alias("c"), F.col(turn_col).alias("turn"), F.when(draw == 4, "user").otherwise(word(role_col)).alias("role"), text.alias("text"), F.explode(F.when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return made.drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """rows(c, turn, role, text) with pos, which rises in the order of conversations and their rows, and start, the first pos of the row's segment.

    Rows are cut into ranges of the whole order and numbered range by range, so a conversation of very
    many rows is several ranges. Ties of turn are ordered by role and text; equal rows by where they were
    read, so that many equal rows can be cut too. A segment is SEGMENT rows of a conversation in a range.
    """
    ranges = max(8, math.ceil(rows.count() / RANGE_ROWS))
    keys = ["c", F.col("turn").asc_nulls_first(), "role", "text", "tie"]
    cut = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    placed = stored(cut.select("c", "turn", "role", "text", F.monotonically_increasing_id().alias("pos")), "repair-rows")
    here = F.min("pos").over(Window.partitionBy("c", F.shiftright("pos", 33)))
    return placed.withColumn("first", here).withColumn("start", F.col("first") + (F.floor((F.col("pos") - F.col("first")) / SEGMENT) * SEGMENT).cast("long")).drop("first")


def faults(rows: DataFrame) -> DataFrame:
    """(c, pos, start, turn, initial, fault): fault is the first of blank, duplicate and truncated that holds, else null."""
    kept = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    marks = rows.select("c", "pos", "start", "turn", initial.alias("initial"), (kept == "").alias("blank"), (~F.right(kept, F.lit(1)).isin(*ENDINGS)).alias("cut"), F.xxhash64("role", "text").alias("m"), F.xxhash64("text", "role").alias("m2"))
    repeated = marks.groupBy("c", "m", "m2").agg(F.min("pos").alias("seen"), F.count("*").alias("n")).where("n > 1").drop("n")
    both = marks.join(repeated, ["c", "m", "m2"], "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("seen") < F.col("pos"), "duplicate").when(F.col("cut"), "truncated")
    return both.select("c", "pos", "start", "turn", "initial", fault.alias("fault"))


def solutions(signatures: DataFrame) -> DataFrame:
    """(signature, plans): each distinct signature solved once, from every state it may begin in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            solved = [[(s, e, cost, audit) for s in range(4) for e, (cost, audit) in cheapest(x, s).items()] for x in batch.column(0).to_pylist()]
            plans = [[dict(zip(PLAN, p)) for p in ps] for ps in solved]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plans, pa.list_(pa.struct([(c, pa.string() if c == "audit" else pa.int64()) for c in PLAN])))], ["signature", "plans"])

    return stored(signatures.select("signature").distinct().mapInArrow(run, "signature string, plans array<struct<start:bigint,end:bigint,cost:bigint,audit:string>>"), "repair-plans")


def by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, Iterator[dict[str, Any]]]]:
    """Rows that come sorted by c, an iterator for each conversation; only the rows of a batch are held."""
    return groupby(chain.from_iterable(batch.to_pylist() for batch in batches), key=itemgetter("c"))


def batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, OUT_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)


def assigned(segments: DataFrame) -> DataFrame:
    """(c, start, state, audit, cost, illegal) of segments(c, start, signature, initials): each segment's part in the cheapest edits of its conversation, whose cost and illegal pairs are in the row of its first segment.

    The plans of a conversation's segments meet in one task, without texts: some bytes a row.
    """
    joined = segments.join(solutions(segments), "signature").select("c", "start", "signature", "initials", "plans")
    schema = pa.schema([joined.limit(0).toArrow().schema.field("c"), ("start", pa.int64()), ("state", pa.int32()), ("audit", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for c, rows in by_conversation(batches):
            held = list(rows)
            plans: list[dict[int, Plan]] = []
            for row in held:
                plans.append({})
                for p in row["plans"]:
                    plans[-1].setdefault(p["start"], {})[p["end"]] = (p["cost"], p["audit"])
            line = "".join(row["initials"] for row in held)
            illegal = sum(pair not in ("su", "ua", "au") for pair in map("".join, pairwise(line)))
            cost, audit = whole(plans)
            for k, (state, part) in enumerate(parts(audit, [row["signature"] for row in held])):
                yield c, held[k]["start"], state, part, 0 if k else cost, 0 if k else illegal

    ready = joined.repartition("c").sortWithinPartitions("c", "start")
    return ready.mapInArrow(lambda batches: batched(each(batches), schema), f"c {joined.schema['c'].dataType.simpleString()}, start long, state int, audit string, cost long, illegal long")


def replayed(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(c, start, piece, n) of rows(c, start, pos, role, text) and plans(c, start, state, audit): the repaired `role:text` lines of each segment, joined by newlines, and their number."""
    held = rows.groupBy("c", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("rows")).join(plans.select("c", "start", "state", "audit"), ["c", "start"])
    schema = pa.schema([held.limit(0).toArrow().schema.field("c"), ("start", pa.int64()), ("piece", pa.string()), ("n", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in batch.to_pylist():
                made = replay([(x["role"], x["text"]) for x in row["rows"]], row["audit"], row["state"])
                yield row["c"], row["start"], "\n".join(f"{role}:{text}" for role, text in made), len(made)

    return held.mapInArrow(lambda batches: batched(each(batches), schema), f"c {held.schema['c'].dataType.simpleString()}, start long, piece string, n long")


def fingerprinted(pieces: DataFrame, plans: DataFrame) -> DataFrame:
    """(c, cost, illegal, audit, sha256) of each conversation: its segments pass by in order, so that its text is never held whole."""
    both = pieces.join(plans, ["c", "start"]).select("c", "start", "piece", "n", "audit", "cost", "illegal")
    schema = pa.schema([both.limit(0).toArrow().schema.field("c"), ("cost", pa.int64()), ("illegal", pa.int64()), ("audit", pa.string()), ("sha256", pa.string())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for c, rows in by_conversation(batches):
            digest, begun, cost, illegal, audit = hashlib.sha256(), False, 0, 0, []
            for row in rows:
                cost, illegal = cost + row["cost"], illegal + row["illegal"]
                audit.append(row["audit"])
                if row["n"]:
                    digest.update((("\n" if begun else "") + row["piece"]).encode("utf-8", "surrogatepass"))
                    begun = True
            yield c, cost, illegal, "".join(audit), digest.hexdigest()

    ready = both.repartition("c").sortWithinPartitions("c", "start")
    return ready.mapInArrow(lambda batches: batched(each(batches), schema), f"c {both.schema['c'].dataType.simpleString()}, cost long, illegal long, audit string, sha256 string")


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(marks, plans, pieces) of ordered rows: faults(), assigned() and replayed()."""
    marks = stored(faults(rows), "repair-faults")
    gone = F.col("fault").isin("blank", "duplicate")
    code = F.when(F.coalesce(gone, F.lit(False)), "-").when(F.col("fault").isNotNull(), F.upper("initial")).otherwise(F.col("initial"))
    inside = F.array_sort(F.collect_list(F.struct("pos", code.alias("code"), "initial")))
    line = lambda name: F.array_join(F.transform("rows", lambda x: x[name]), "").alias(name)
    segments = marks.groupBy("c", "start").agg(inside.alias("rows")).select("c", "start", line("code").alias("signature"), line("initial").alias("initials"))
    plans = stored(assigned(stored(segments, "repair-segments")), "repair-edits")
    # a row holds the texts of a segment
    with small_batches(rows.sparkSession, max(1, OUT_ROWS // SEGMENT)):
        pieces = stored(replayed(rows, plans), "repair-pieces")
    return marks, plans, pieces


def audited(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for every conversation, of its damaged() rows.

    Faults are counted by the first that a row has. Edits keep a row, give it the role user or
    assistant (cost 2), delete it (3; blank and duplicate rows have to go) or insert an empty row of
    user or assistant (2); a truncated row that stays costs 1. The audit is the initials of the
    cheapest edits that leave a system turn or none and pairs of user and assistant, or nothing; of
    equal costs the least. gaps counts the turns missing between the least and the largest.

    Rows are ordered by turn, nulls first, then role and text. Null roles and texts are one space, a null
    conv_id is one conversation, which has a null id here. A conversation without rows after the damage
    has zeros, an empty audit and the hash of nothing. Repeated rows are duplicates. An empty table gives
    no rows. Other columns are ignored.
    """
    rows = ordered(damaged(conversations, conv_col, turn_col, role_col, text_col))
    marks, plans, pieces = repaired(rows)
    kinds = [F.count_if(F.col("fault") == kind).alias(kind) for kind in ("blank", "duplicate", "truncated")]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    counts = marks.groupBy("c").agg(gaps, *kinds)
    with small_batches(conversations.sparkSession):
        ends = stored(fingerprinted(pieces, plans), "repair-ends")
    every = conversations.select(F.struct(F.col(conv_col).alias("id")).alias("c")).distinct()
    out = every.join(counts.join(ends, "c"), "c", "left")
    zero = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("c.id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
