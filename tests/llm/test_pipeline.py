"""The pipeline's stages against what they should do to their own input."""

import random

import corpus_pipeline
import numpy as np
import pytest
from tidegrid.llm import common, quality, queries, shingles, simhash

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids <= before and ids
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        if name == "line dedup":
            assert ids == before
        docs, before = out, ids
    assert docs.where("not round_trip").count() == 0


def test_run_is_registered():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert {k.split("_")[0] for k in queries.queries()} == {f"op{n}" for n in range(1, 11)}


def test_near_dedup_removes_near_copies(spark):
    r = random.Random(4)
    texts = {i: " ".join(f"w{r.randrange(5000)}" for _ in range(300)) for i in range(20)}
    for i in range(20):
        # ten words replaced far apart spoil 50 of 296 shingles at most, a Jaccard index of 0.71; five leave 0.84
        for n, far in ((5, 100), (10, 200)):
            words = texts[i].split()
            for k in range(n):
                words[25 * k + 10] = f"new{far}-{i}-{k}"
            texts[far + i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert got == set(texts) - set(range(100, 120))


@pytest.mark.parametrize("group", [24, 4])
def test_near_copies_against_brute_force(spark, group):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id is not null").select("doc_id", "text")
    sets = {x.doc_id: frozenset(shingles.shingle_set(x.text).tolist()) for x in rows.collect()}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids, n = sorted(sets), 0
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x == y or min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                n += x != y
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.id: x.component for x in shingles.near_copies(rows, group=group).collect()}
    assert n > 5 and got == {d: find(d) for d in ids}


def test_near_copies_that_share_a_long_passage(spark):
    """200 texts share four fifths of their words; a few of them have near copies besides."""
    r = random.Random(8)
    word = lambda: f"w{r.randrange(5000)}"
    passage = [word() for _ in range(160)]
    texts = {i: passage + [word() for _ in range(40 + i % 7)] for i in range(200)}
    for i in range(10):
        texts[1000 + i] = texts[i][:-5] + [word() for _ in range(5)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {x.id: x.component for x in shingles.near_copies(docs, group=8).collect()}
    assert got == {i: i % 1000 for i in texts}


def test_balls_of_simhashes_give_candidates(spark):
    """Texts whose five-word SimHashes differ in at most two bits are candidates; bands are not asked."""
    r = random.Random(5)
    texts = {i: [f"w{r.randrange(5000)}" for _ in range(1500)] for i in range(30)}
    for i in range(30):
        texts[100 + i] = [*texts[i][:-1], f"new{i}"]
    prints = {i: simhash.simhash(" ".join(t), shingles.WORDS) for i, t in texts.items()}
    near = {i for i in range(30) if (prints[i] ^ prints[100 + i]).bit_count() <= 2}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    marks = common.stored(shingles.marked(docs, "doc_id", "text", shingles.WORDS), "marks")
    name = {x.id: x.mark for x in marks.collect()}
    got = {(x.a, x.b) for x in shingles.ball_pairs(marks, shingles.JACCARD).collect()}
    assert len(near) > 10 and got == {tuple(sorted((name[i], name[100 + i]), reverse=True)) for i in near}


def test_without_rows_given_all_keys(spark):
    """A set of few bits has keys that are not in it."""
    docs = spark.createDataFrame([(i % 3000, f"t{i}") for i in range(4000)], "doc_id long, text string")
    bad = common.stored(docs.where("doc_id % 3 = 0").select(common.F.col("doc_id").alias("row")).distinct(), "bad")
    full = common.bit_set
    common.bit_set = lambda rows, hashed: full(rows, hashed, 7)
    test = common.bit_test
    common.bit_test = lambda hashed, held: test(hashed, held, 7)
    try:
        got = common.without_rows(docs, bad, common.F.col("doc_id"), docs.select(common.F.col("doc_id").alias("row")))
        assert sorted(x.text for x in got.collect()) == sorted(f"t{i}" for i in range(4000) if i % 3000 % 3)
    finally:
        common.bit_set, common.bit_test = full, test


def test_features_are_packed_and_deleted(spark):
    texts = ["", "a b a", "one", " ".join(f"w{i}" for i in range(50))]
    ids, shares = quality._lists(texts)
    flat, ends = quality._flat(ids, np.int16)
    parts, words = quality._flat(shares, np.float32)
    values = quality._spread(parts, words)
    # three ids of two bytes and one number of four for each different word
    assert len(ids[3].as_py()) == 2 * (3 * 50 + 2) and len(shares[3].as_py()) == 4 * 50
    assert ends.tolist() == [0, 2, 10, 15, 167] and len(values) == len(flat) == 167
    assert np.allclose(values[2:10], [2 / 3] * 3 + [1 / 3] * 3 + [1, 1]) and values[:2].tolist() == [1, 1]
    folder = common.stored(spark.range(3), "gone")
    assert folder.count() == 3
    common.drop_tables(folder)
    with pytest.raises(Exception, match="(?i)exist|not found"):
        folder.count()
