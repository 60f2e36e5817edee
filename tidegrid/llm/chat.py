"""Chat formatting into token-budgeted, turn-aligned windows with a loss mask."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, text_or_empty

START, END = "<|im_start|>", "<|im_end|>"
#: A turn's tokens are counted as runs of word characters and single other characters.
TOKEN = r"\w+|[^\w\s]"
#: Turns that one task numbers.
RANGE_ROWS = 500_000
#: Windows that are listed in one array while a conversation is walked.
BLOCK = 256


def escape(text: Column) -> Column:
    """No control string survives: a backslash is doubled, and <| becomes <\\|."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    """As escape; a line break, which would end the role, becomes <\\n|."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n|"), F.lit("\n")))


def indexed(turns: DataFrame) -> DataFrame:
    """turns(conv, lone, turn, role, mark, tokens) with i, the place in its conversation from 0, and before, the tokens of the turns before it.

    Turns are put into one order over all conversations, cut into ranges, and numbered range by range;
    the counts of a conversation's earlier ranges are added. So a conversation of very many turns is
    not numbered by one task.
    """
    ranges = max(8, math.ceil(turns.count() / RANGE_ROWS))
    placed = stored(turns.repartitionByRange(ranges, "conv", "lone", "turn", "role", "mark").withColumn("range", F.spark_partition_id()), "chat-ranges")
    sums = placed.groupBy("conv", "lone", "range").agg(F.count("*").alias("rows"), F.sum("tokens").alias("sum"))
    earlier = Window.partitionBy("conv", "lone").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv", "lone", "range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("rows", "sum")])
    here = Window.partitionBy("conv", "lone", "range").orderBy("turn", "role", "mark")
    upto = here.rowsBetween(Window.unboundedPreceding, -1)
    found = placed.withColumn("at", F.row_number().over(here) - 1).withColumn("sum", F.coalesce(F.sum("tokens").over(upto), F.lit(0)))
    joined = found.join(sums.withColumnRenamed("conv", "c").withColumnRenamed("lone", "l").withColumnRenamed("range", "r"), F.col("conv").eqNullSafe(F.col("c")) & F.col("lone").eqNullSafe(F.col("l")) & (F.col("range") == F.col("r")))
    return joined.select("conv", "lone", "turn", "role", "mark", "tokens", (F.col("at") + F.col("rows_before")).cast("int").alias("i"), (F.col("sum") + F.col("sum_before")).alias("before"))


def _spans(index: DataFrame, budget: int, history: int) -> DataFrame:
    """(conv, lone, window, since, start, stop, system): the windows of every conversation, as places of turns.

    A conversation's token counts, one int a turn, are walked once. The state holds the starts of the
    windows in blocks, so that adding one costs the same however many there are, and with each start
    the earliest turn that its history reaches.
    """
    counts = index.groupBy("conv", "lone").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.col("tokens").cast("int").alias("n")))), lambda x: x["n"]).alias("tokens"), F.max((F.col("i") == 0) & (F.col("role") == "system")).alias("system"))
    first = F.when(F.col("system"), 1).otherwise(0)
    room = F.greatest(F.lit(1), F.lit(budget - history) - F.when(F.col("system"), F.col("tokens")[0]).otherwise(0))
    counts = counts.select("conv", "lone", "tokens", "system", first.alias("first"), room.cast("long").alias("room"))
    zero, none = F.lit(0).cast("long"), F.array().cast("array<struct<start:int,since:int>>")
    # held: tokens since the window's start; past: tokens from since on
    begin = F.struct(F.col("first").alias("i"), F.col("first").alias("since"), zero.alias("held"), zero.alias("past"), F.array(F.struct(F.col("first").alias("start"), F.col("first").alias("since"))).alias("block"), F.array(none).alias("blocks"))

    def step(s: Column, n: Column) -> Column:
        opens = (s["held"] + n > F.col("room")) & (s["i"] > F.col("first"))
        # the history's far end moves up while it holds too many tokens
        drop = F.aggregate(F.sequence(s["since"], s["i"]), F.struct(s["since"].alias("j"), s["past"].alias("past")), lambda a, j: F.when((a["j"] == j) & (a["j"] < s["i"]) & (a["past"] > history), F.struct((j + 1).alias("j"), (a["past"] - F.element_at("tokens", j + 1)).alias("past"))).otherwise(a))
        moved = F.when(s["past"] > history, drop).otherwise(F.struct(s["since"].alias("j"), s["past"].alias("past")))
        return F.transform(F.array(F.struct(s.alias("s"), moved.alias("m"), opens.alias("opens"))), lambda x: _advance(x["s"], x["m"], x["opens"], n))[0]

    def _advance(s: Column, m: Column, opens: Column, n: Column) -> Column:
        entry = F.array(F.struct(s["i"].alias("start"), m["j"].alias("since")))
        full = opens & (F.size(s["block"]) >= BLOCK)
        return F.struct(
            (s["i"] + 1).alias("i"), m["j"].alias("since"), F.when(opens, n.cast("long")).otherwise(s["held"] + n).alias("held"), (m["past"] + n).alias("past"),
            F.when(full, entry).when(opens, F.concat(s["block"], entry)).otherwise(s["block"]).alias("block"), F.when(full, F.concat(s["blocks"], F.array(s["block"]))).otherwise(s["blocks"]).alias("blocks"),
        )

    walked = F.aggregate(F.slice("tokens", F.col("first") + 1, F.size("tokens")), begin, step, lambda s: F.concat(F.flatten(s["blocks"]), s["block"]))
    made = counts.select("conv", "lone", "system", "first", F.size("tokens").alias("n"), walked.alias("starts"))
    each = made.select("conv", "lone", "system", "n", "starts", F.posexplode("starts").alias("window", "w"))
    stop = F.coalesce(F.try_element_at("starts", F.col("window") + 2)["start"], F.col("n"))
    return each.select("conv", "lone", "window", F.when(F.col("window") == 0, F.col("w.start")).otherwise(F.col("w.since")).alias("since"), F.col("w.start").alias("start"), stop.alias("stop"), "system")


def windows(conversations: DataFrame, budget: int = 512, history: int = 128, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokens_col: str | None = None) -> DataFrame:
    """(conv_id, lone, window, n_context, n_new, tokens, formatted, mask), one row per window.

    Prefix sums of the turns' tokens choose spans of whole turns: a window takes new turns while they
    fit into the budget left by the system turn and the history; a single larger turn is a window of
    its own. Each window begins with the system turn (the first turn, if its role is system), then
    repeats as many turns before its first new one as fit into `history` tokens, then has its new
    turns. mask lists (start, length) in code points of formatted: the texts of the new assistant
    turns. Repeated turns are never under the mask, so each target counts once. Tokens are counted by
    TOKEN, or taken from tokens_col, where null is 0.

    Only the turns' keys are ordered, range by range, and only one int a turn of a conversation is
    held together; texts are joined to the windows that want them, so a window is the largest row.

    Null texts and roles are empty. Turns are ordered by turn, then role, then a hash of the text; null
    turns come first, and repeated rows are repeated turns. A row with a null conv_id is a conversation
    of its own, which `lone` (else null) tells apart; equal ones are repeated turns of one. An empty
    table gives no rows. Other columns are ignored.
    """
    text, role = text_or_empty(text_col), F.coalesce(F.col(role_col), F.lit(""))
    conv = F.col(conv_col)
    n = F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)) if tokens_col else F.regexp_count(text, F.lit(TOKEN)).cast("long")
    keys = [conv.alias("conv"), F.when(conv.isNull(), F.xxhash64(F.col(turn_col), role, text)).alias("lone"), F.col(turn_col).alias("turn"), role.alias("role"), F.xxhash64(text).alias("mark")]
    index = stored(indexed(conversations.select(*keys, n.alias("tokens"))), "chat-index")
    spans = stored(_spans(index, budget, history), "chat-windows")
    lead = F.when(F.col("system") & (F.col("start") > 0), F.array(F.struct(F.lit(0).alias("i"), (F.col("window") > 0).alias("old"))))
    turns = F.when(F.col("stop") > F.col("since"), F.transform(F.sequence("since", F.greatest("since", F.col("stop") - 1)), lambda i: F.struct(i.alias("i"), (i < F.col("start")).alias("old"))))
    none = F.array().cast("array<struct<i:int,old:boolean>>")
    wanted = spans.select("conv", "lone", "window", F.inline(F.concat(F.coalesce(lead, none), F.coalesce(turns, none))))
    same = lambda a, b, names: functools.reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in names])
    placed = wanted.join(index, same(wanted, index, ("conv", "lone")) & (wanted["i"] == index["i"])).select(wanted["conv"], wanted["lone"], "window", wanted["i"], "old", "turn", "role", "mark", "tokens")
    texts = conversations.select(*keys, text.alias("text")).groupBy("conv", "lone", "turn", "role", "mark").agg(F.first("text").alias("text"))
    held = placed.join(texts, same(placed, texts, ("conv", "lone", "turn", "role", "mark"))).select(placed["conv"], placed["lone"], "window", "i", "old", placed["role"], "tokens", "text")
    part = F.struct("i", "old", "tokens", (F.col("role") == "assistant").alias("target"), F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    rows = held.groupBy("conv", "lone", "window").agg(F.array_sort(F.collect_list(part)).alias("turns"))
    rows = rows.withColumn("parts", F.transform("turns", lambda t: F.struct(F.concat(t["head"], t["body"], F.lit(END + "\n")).alias("text"), (F.length(t["head"]) + F.length(t["body"]) + len(END) + 1).alias("size"))))
    n_old = F.size(F.filter("turns", lambda t: t["old"]))
    spot = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask"))

    def masked(s: Column, x: Column) -> Column:
        t = x["turns"]
        entry = F.array(F.struct((s["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length")))
        return F.struct((s["at"] + x["parts"]["size"]).alias("at"), F.when(t["target"] & ~t["old"], F.concat(s["mask"], entry)).otherwise(s["mask"]).alias("mask"))

    mask = F.aggregate(F.arrays_zip("turns", "parts"), spot, masked, lambda s: s["mask"])
    tokens = F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["tokens"])
    return rows.select(F.col("conv").alias("conv_id"), "lone", "window", n_old.alias("n_context"), (F.size("turns") - n_old).alias("n_new"), tokens.alias("tokens"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("formatted"), mask.alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, lone, turns, loss, formatted_chars) from windows() output alone: turns (role, text) each once, loss the unescaped text under the masks.

    A row holds a whole conversation. Windows may come in any order; an empty table gives no rows.
    """
    parts = F.split("formatted", r"<\|im_start\|>")
    # the system turn is new in the first window, where it leads; elsewhere what is repeated comes first
    pieces = F.slice("pieces", F.col("n_context") + 2, F.col("n_new"))
    turn = lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 2 - len(END))).alias("text"),
    )
    loss = F.array_join(F.transform("mask", lambda m: unescape(F.substring("formatted", m["start"] + 1, m["length"]))), "")
    rows = formatted.withColumn("pieces", parts).select("conv_id", "lone", F.struct("window", F.transform(pieces, turn).alias("turns"), loss.alias("loss")).alias("w"), F.length("formatted").cast("long").alias("chars"))
    whole = rows.groupBy("conv_id", "lone").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"))
    return whole.select("conv_id", "lone", F.flatten(F.transform("w", lambda w: w["turns"])).alias("turns"), F.array_join(F.transform("w", lambda w: w["loss"]), "").alias("loss"), "formatted_chars")
