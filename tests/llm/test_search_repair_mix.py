"""Lexical search, conversation repair and source mixing against brute force and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import lexical, mixing, queries, repair

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, source string, shard int, rank string, c string"


def ranking(docs, items, k=10):
    found = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    df = Counter(t for _, ts in found for t in set(ts))
    counted = [(i, len(ts), Counter(ts)) for i, ts in found]
    out = []
    for item, text in items:
        scores = []
        for i, n, tf in counted:
            score = 0
            for t in set(TERM.findall((text or "").translate(LOWER))) & set(tf):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * (10 + (90 * n * n_docs) // n_terms)))
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard, run, block", [(8192, 512, 128), (24, 4, 4)])
def test_ranking(spark, monkeypatch, shard, run, block):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical, "RUN_DOCS", run)
    monkeypatch.setattr(lexical, "BLOCK", block)
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted(map(tuple, lexical.top_documents(docs, items).collect()), key=repr)
    assert got == ranking([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_blocks_are_passed_over():
    r = np.random.default_rng(0)
    n = 40000
    common = [lexical.Postings.of(np.sort(r.choice(n, n // 2, replace=False)), r.integers(300000, 400000, n // 2)) for _ in range(3)]
    rare = lexical.Postings.of(np.sort(r.choice(n, 20, replace=False)), np.full(20, 900000))
    lists, weights = [*common, rare], [500, 600, 700, 9000]
    docs, scores = lexical.best(lists, weights, np.arange(n), 10)
    total = np.zeros(n, np.int64)
    opened = [len(x.held) for x in lists]
    for x, w in zip(lists, weights):
        for j in range(len(x.last)):
            d, p = x.block(j)
            total[d] += p * w
    order = np.lexsort((np.arange(n), -total))[:10]
    assert docs.tolist() == order.tolist() and scores.tolist() == total[order].tolist()
    assert all(o < len(x.last) / 3 for o, x in zip(opened[:3], common))


@pytest.mark.parametrize("top", [0, 1, 2, 1000, (1 << 32) - 1])
def test_packed_numbers(top):
    values = np.random.default_rng(top % 97).integers(0, top + 1, 77)
    data = b"x" + lexical.pack(values)
    back, at = lexical.unpack(data, 1, 77)
    assert back.tolist() == values.tolist() and at == len(data)


def test_ranking_of_odd_tables(spark):
    rows = [(1, "Ä b c"), (1, "Ä b c"), (None, "b b x"), (3, None), (4, ""), (5, "!!"), (2, "B"), (7, "b " * 50000), (8, "ä")]
    items = [(1, "b Ä?"), (None, "x"), (None, "c"), (2, None), (3, "zzz"), (4, "b")]
    docs = spark.createDataFrame([(i, t, None, 1, "x", "y") for i, t in rows], DOCS)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    merged = [(1, "b Ä?"), (None, "x c"), (4, "b")]
    assert sorted(map(tuple, lexical.top_documents(docs, asked).collect()), key=repr) == ranking(rows, merged)
    assert lexical.top_documents(docs.limit(0), asked).count() == 0
    assert lexical.top_documents(docs, asked.limit(0)).count() == 0
    assert lexical.top_documents(docs.where("text is null"), asked).count() == 0


def fits(roles):
    return re.fullmatch("(s?(ua)+)?", roles) is not None


def exhaustive(signature):
    """(cost, audit) by all edits with up to two insertions before each row and at the end."""
    best = None
    spaces = ["", "u", "a", "ua", "au"]

    def edits(row):
        out = [("D", 3, "")]
        if row != "-":
            cut = row.isupper()
            out += [("K", cut, row.lower()), ("R", 2 + cut, "u"), ("R", 2 + cut, "a")]
        return out

    for made in product(*[edits(row) for row in signature]):
        for gaps in product(spaces, repeat=len(signature) + 1):
            roles = gaps[0] + "".join(m[2] + g for m, g in zip(made, gaps[1:]))
            if fits(roles):
                cost = sum(m[1] for m in made) + 2 * sum(map(len, gaps))
                audit = "I" * len(gaps[0]) + "".join(m[0] + "I" * len(g) for m, g in zip(made, gaps[1:]))
                best = min(best or (cost, audit), (cost, audit))
    return best


def test_cheapest_edits():
    for n in range(4):
        for signature in map("".join, product("suaoSU-", repeat=n)):
            plans = repair.cheapest(signature, repair.EMPTY)
            assert min(plans[e] for e in repair.FINAL if e in plans) == exhaustive(signature), signature


def test_segments_make_the_whole():
    r = random.Random(5)
    for _ in range(300):
        signature = "".join(r.choice("suaauaoSUA-") for _ in range(r.randrange(1, 40)))
        plans = repair.cheapest(signature, repair.EMPTY)
        cuts = [signature[i : i + 3] for i in range(0, len(signature), 3)]
        cost, audit = repair.whole([{s: repair.cheapest(c, s) for s in range(4)} for c in cuts])
        assert (cost, audit) == min(plans[e] for e in repair.FINAL if e in plans)
        rows = [({"s": "system", "u": "user", "a": "assistant", "o": "tool", "-": "user"}[x.lower()], str(k)) for k, x in enumerate(signature)]
        made, at = [], 0
        for (state, part), c in zip(repair.parts(audit, cuts), cuts):
            made += repair.replay(rows[at : at + len(c)], part, state)
            at += len(c)
        assert fits("".join(role[0] for role, _ in made)) and made == repair.replay(rows, audit, repair.EMPTY)
        kept = [k for k, letter in enumerate(audit.replace("I", "")) if letter != "D"]
        assert [t for _, t in made if t] == [str(k) for k in kept]


def repaired_by_hand(rows):
    """The contract read row by row; the edits are found by shortest paths."""
    word = lambda x: " " if x is None else str(x)
    out = {}
    for conv in {r[0] for r in rows}:
        held = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            k = zlib.crc32(f"{word(c)}:{word(turn)}".encode()) % 20
            role, text = "user" if k == 4 else word(role), "" if k == 1 else re.sub("[.!?]", "", word(text)) if k == 2 else word(text)
            held += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        held.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faults = set(), []
        for _, role, text in held:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        states = {"": (0, "", [])}
        for fault, (_, role, text) in zip([*faults, None], [*held, (None, "", "")]):
            # up to two insertions, then the row
            for _ in range(2):
                for s, (cost, audit, made) in list(states.items()):
                    for r in ("user", "assistant"):
                        if fits_on(s, r[0]) and (cost + 2, audit + "I") < states.get(s[:1] * (s[:1] == "s") + r[0], (math.inf,))[:2]:
                            states[s[:1] * (s[:1] == "s") + r[0]] = (cost + 2, audit + "I", [*made, (r, "")])
            if fault is None:
                break
            after = {}
            for s, (cost, audit, made) in states.items():
                steps = [(s, 3, "D", None)]
                if fault not in ("blank", "duplicate"):
                    cut = fault == "truncated"
                    steps += [(s[:1] * (s[:1] == "s") + x[0] if x[0] != "s" else "s", c + cut, letter, (x, text)) for x, c, letter in [(role, 0, "K"), ("user", 2, "R"), ("assistant", 2, "R")] if x and fits_on(s, x[0])]
                for to, c, letter, row in steps:
                    if (cost + c, audit + letter) < after.get(to, (math.inf,))[:2]:
                        after[to] = (cost + c, audit + letter, made + ([row] if row else []))
            states = after
        cost, audit, made = min(v for s, v in states.items() if s == "" or s[-1] == "a")
        turns = [t for t, _, _ in held if t is not None]
        pairs = zip(held, held[1:])
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(k) for k in ("blank", "duplicate", "truncated")], sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return out


def fits_on(state, initial):
    """Whether a row of that initial may follow: state is what has been written, but for repeated pairs."""
    return initial in ({"": "su", "s": "u"}.get(state) or ("a" if state[-1] == "u" else "u"))


def odd_conversations():
    r = random.Random(3)
    texts = ["Hi.", "Hi.", "", " \t", None, "So?", "well", "A. B!  ", "é…", "x" * 5000]
    roles = ["user", "assistant", "system", "tool", None, "", "User", "assistant", "user"]
    rows = [(c, t, r.choice(roles), r.choice(texts)) for c in [*range(25), None] for t in [None, *range(r.randrange(1, 9))]]
    return rows + rows[:20] + [(77, t, ["user", "assistant"][t % 2], "Again.") for t in range(400)] + [(78, None, "user", "One.")]


@pytest.mark.parametrize("segment", [64, 3])
def test_repair(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = odd_conversations()
    table = spark.createDataFrame([(*x, "k", 1, "z") for x in rows], "conv_id long, turn long, role string, text string, c string, pos int, audit string").repartition(5)
    got = {x[0]: tuple(x)[1:] for x in repair.audited(table).collect()}
    assert got == repaired_by_hand(rows)
    assert repair.audited(table.limit(0)).count() == 0


def test_repair_of_a_dropped_conversation(spark):
    lone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = repair.audited(spark.createDataFrame([(lone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")).first()
    assert tuple(row) == (lone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def capped_shares(totals, weights):
    """Targets by handing out the excess again and again."""
    order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = sum(totals.values()), set(order), {}
    while True:
        unit = left / sum(w[s] for s in free) if free else 0
        over = {s for s in free if w[s] * unit > 3 * totals[s]}
        if not over:
            return out | {s: w[s] * unit for s in free}
        for s in over:
            out[s] = 3 * totals[s]
        left, free = sum(totals.values()) - sum(out.values()), free - over


def check_mix(rows, docs, weights=(5, 2, 1)):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = Counter()
    for _, t, s in docs:
        totals[s] += words(t)
    want = capped_shares(totals, weights)
    assert sorted((x.id is None, x.id or 0, x.size) for x in rows) == sorted((i is None, i or 0, words(t)) for i, t, _ in docs)
    taken, most = Counter(), Counter()
    for x in rows:
        assert x.source_size == totals[x.source] and math.isclose(x.target, want[x.source], abs_tol=1e-6, rel_tol=1e-9)
        assert 0 <= x.n_copies <= 3 and x.taken == x.size * x.n_copies
        taken[x.source] += x.taken
        most[x.source] = max(most[x.source], x.size)
    return {s: (taken[s], want[s], most[s]) for s in totals}


def test_mix_of_documents(spark):
    for sf in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        rows = mixing.mix(docs, (5, 2, 1)).collect()
        ends = check_mix(rows, [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()])
        assert all(abs(taken - want) <= max(0.05 * want, 40) for taken, want, _ in ends.values()) or sf == "sf0.001"
        assert all(abs(taken - want) <= most for taken, want, most in ends.values())
        again = queries.op13_pareto_mix(spark.newSession(), f"/root/testdata/{sf}").repartition(7).collect()
        assert sorted((x.id, x.taken) for x in rows) == sorted((x.doc_id, x.taken) for x in again)


def test_mix_cuts_and_tails(spark, monkeypatch):
    """Small tails and digits, so that boundaries are found in several rounds."""
    monkeypatch.setattr(mixing, "TAIL", 4)
    monkeypatch.setattr(mixing, "RANGE_SOURCES", 2)
    r = random.Random(1)
    docs = [(i, "w " * r.choice([0, 1, 3, 30, 200]), r.choice(["a", "a", "a", "b", "é", None, ""])) for i in range(3000)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), (5, 2, 1)).collect()
    for taken, want, most in check_mix(rows, docs).values():
        assert want - most <= taken <= want + 1


def test_mix_draws_by_probability(spark):
    """Over some seeds a document is taken about as often as expected, longer ones more often; the last words of a source favour short ones a little."""
    docs = spark.createDataFrame([(i, "w " * (2 if i % 2 else 30), "a" if i < 200 else "b") for i in range(260)], "doc_id long, text string, source string")
    n, seen = 8, Counter()
    for seed in range(n):
        for x in mixing.mix(docs, (1, 2), seed=seed).where("source = 'a'").collect():
            seen[x.size] += x.n_copies / 100 / n
    row = mixing.mix(docs, (1, 2)).where("source = 'a'").first()
    c = row.target / (100 * 2 * (1 + 0.1 * 2) + 100 * 30 * (1 + 0.1 * 5))
    assert abs(seen[30] - 1.5 * c) < 0.05 and -0.1 < seen[2] - 1.2 * c < 0.2


def test_mix_of_odd_tables(spark):
    docs = [(1, "a b", "x"), (1, "a b", "x"), (None, "c", "x"), (2, None, None), (3, "d e f", None), (4, "", "z"), (5, "g " * 3000, "y"), (6, "   ", "y")]
    table = spark.createDataFrame([(i, t, s, 1, "r", "c") for i, t, s in docs], DOCS)
    for taken, want, most in check_mix(mixing.mix(table, (5, 2, 1)).collect(), docs).values():
        assert abs(taken - want) <= 2 * most
    assert mixing.mix(table.limit(0), (5, 2, 1)).count() == 0
    assert all(x.taken == 0 and x.target == 0 for x in mixing.mix(table.where("doc_id in (2, 4)"), (5, 2, 1)).collect())


def test_sql_of_ties_and_nulls(spark):
    """The SQL of the two queries that have it, on tables with nulls and ties."""
    import duckdb

    from tidegrid.llm import oracles

    con = duckdb.connect()
    rows = odd_conversations()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    got = {x[0]: x[1:] for x in con.execute(oracles.conversation_repair()).fetchall()}
    assert got == repaired_by_hand(rows)
    docs, items = [(1, "Ä b c"), (1, "Ä b c"), (None, "b b x"), (3, None), (2, "B")], [(1, "b Ä?"), (None, "x"), (2, None)]
    for name, key, table in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.execute(f"create table {name} ({key} bigint, text varchar)")
        con.executemany(f"insert into {name} values (?, ?)", table)
    assert sorted(con.execute(oracles.lexical_search()).fetchall(), key=repr) == ranking(docs, items)
