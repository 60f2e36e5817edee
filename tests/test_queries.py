"""Every registered query of the statistics engine against DuckDB on the same tables, and what SQL can't express against numpy."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import tails
from tidegrid.operators import glm, graphs, grid, models, regions, samples
from tidegrid.plans import registry
from tidegrid.streaming import incremental

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return v if isinstance(v, str) else repr(float(v) + 0.0)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    made = QUERIES[name](spark, SF)
    names = sorted(made.columns)
    got = sorted(tuple(map(value, r)) for r in made.select(*names).collect())
    found = duck.execute(ORACLES[name])
    at = {c[0]: k for k, c in enumerate(found.description)}
    assert sorted(at) == names
    assert got == sorted(tuple(value(r[at[c]]) for c in names) for r in found.fetchall())
    assert got


def test_kmeans(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], dtype=float)
    c = x[:5].copy()
    for _ in range(5):
        label = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[label == k].mean(axis=0) if (label == k).any() else c[k] for k in range(5)])
    label = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    got = {r.vec_id: r.label for r in QUERIES["kmeans_fixed_init"](spark, SF).collect()}
    assert got == {r.vec_id: int(k) for r, k in zip(rows, label)}


def test_grid_edge_counts(spark):
    flat = spark.createDataFrame([(i, j, 0, 1.0) for i in range(9) for j in range(6)], "i int, j int, k int, v double")
    cube = spark.createDataFrame([(i, j, k, 1.0) for i in range(10) for j in range(10) for k in range(10)], "i int, j int, k int, v double")
    count = lambda c, reach: grid.neighbours(c, ["i", "j", "k"], "v", reach).count()
    assert [count(flat, r) for r in (1, 2, 3)] == [186, 346, 346]
    assert [count(cube, r) for r in (1, 2, 3)] == [5400, 15120, 20952]


def test_euler_characteristic_adds(spark):
    box = lambda a, b: [(i, j) for i in range(a, a + 3) for j in range(b, b + 4)]
    ec = lambda rows: grid.euler_2d(spark.createDataFrame(rows, "i int, j int")).first().ec
    ring = [(i, j) for i in range(5) for j in range(5) if (i, j) not in [(a, b) for a in (1, 2, 3) for b in (1, 2, 3)]]
    assert (ec(box(0, 0)), ec(box(0, 0) + box(10, 10)), ec(ring)) == (1, 2, 0)


def test_student_of_constants(spark):
    rows = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 0.0), ("b", 0.0)], "u string, x double")
    got = {r.u: r.t for r in samples.student(rows, ["u"], "x").collect()}
    assert got == {"a": math.inf, "b": 0.0}


def test_streams_match_batches(spark, tmp_path):
    r = np.random.default_rng(0)
    rows = [(f"u{k % 3}", t, float(t), float(2 * t + r.normal())) for t in range(30) for k in range(3)]
    kind = "unit string, t long, x double, y double"
    for k in range(3):
        spark.createDataFrame([x for x in rows if x[1] // 10 == k], kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    files = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    for name, made in (("diffs", incremental.time_differences(files)), ("fits", incremental.recursive_least_squares(files))):
        q = made.writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    y = {(u, t): v for u, t, _, v in rows}
    assert {(x.unit, x.t) for x in spark.table("diffs").collect()} == {k for k in y if k[1] > 0}
    assert all(abs(x.d2 - (y[x.unit, x.t] - y[x.unit, x.t - 1]) ** 2) < 1e-9 for x in spark.table("diffs").collect())
    for x in spark.table("fits").where(F.col("t") == 29).collect():
        slope, intercept = np.polyfit(range(30), [y[x.unit, t] for t in range(30)], 1)
        assert abs(x.slope - slope) < 1e-4 and abs(x.intercept - intercept) < 1e-3


def test_spanning_forest(spark):
    r = np.random.default_rng(3)
    edges = sorted({(int(a), int(b)): float(r.integers(1, 6)) for a, b in r.integers(0, 24, (60, 2))}.items())
    rows = [(a, b, w) for (a, b), w in edges] + [(b, a, w + 1) for (a, b), w in edges[:5]]
    made = grid.spanning_forest(spark.createDataFrame(rows, "src long, dst long, w double"))
    least = {}
    for a, b, w in rows:
        k = (min(a, b), max(a, b))
        least[k] = min(w, least.get(k, w))
    tree, expected = list(range(26)), set()
    for w, (a, b) in sorted((w, k) for k, w in least.items()):
        if tree[a] != tree[b]:
            expected.add((a, b, w))
            tree = [tree[a] if t == tree[b] else t for t in tree]
    assert {(x.src, x.dst, x.w) for x in made.collect()} == expected
    assert grid.spanning_forest(spark.createDataFrame([], "src long, dst long, w double")).count() == 0


def test_degenerate_units_fail_alone(spark):
    rows = spark.createDataFrame([("same", 1.0, 2.0, 0.0, 1), ("same", 1.0, 2.0, 0.0, 2), ("one", 3.0, 1.0, 1.0, 1), ("good", 1.0, 2.0, 1.0, 1), ("good", 2.0, 5.0, 2.0, 2), ("good", 4.0, 1.0, 1.0, 3), ("good", 3.0, 2.0, 3.0, 4)], "u string, x double, y double, s double, t int")
    got = lambda df: {r.u: r for r in df.collect()}
    assert got(samples.grubb(rows, ["u"], "x"))["same"].grubb == 0
    assert got(samples.two_sample(rows, ["u"], "x", F.col("t") > 1))["same"].t == 0
    assert got(samples.weighted_mean(rows, ["u"], "y", "s"))["same"].mean is None
    fits = got(glm.simple_ols(rows, ["u"], "x", "y"))
    assert fits["same"].slope is None and fits["good"].t_slope is not None
    twice = got(glm.ols(rows.withColumn("z", 2 * F.col("x")), ["u"], ["x", "z"], "y"))
    assert twice["good"].b_x is None
    assert got(glm.ar1(rows.withColumn("r", F.lit(0.0)), ["u"], "t", "r"))["same"].rho is None
    assert got(models.results(models.fit(rows.withColumn("one", F.lit(1.0)), ["u"], ["one", "x"], "y"), ["u"], 2))["one"].r2 is None


def test_long_chains(spark):
    """Rounds are the logarithm of the length, and their plans don't grow."""
    n = 300
    chain = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("w"))
    assert {r.label for r in grid.components(spark.range(n), chain).collect()} == {0}
    tree = spark.range(n).select("id", F.greatest(F.lit(0), F.col("id") - 1).alias("parent"))
    assert {r.id: r.d for r in grid.ancestors(tree).groupBy("id").agg(F.max("steps").alias("d")).collect()} == {i: i for i in range(n)}
    assert grid.spanning_forest(chain).count() == n - 1


def test_pca_against_numpy(spark):
    x = np.random.default_rng(5).normal(size=(40, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1])
    rows = spark.createDataFrame([(u, t, float(x[u, t])) for u in range(40) for t in range(6)], "u int, t int, y double")
    shares, vectors, scores = regions.pca(rows, "u", "t", "y", 2)
    c = x - x.mean(axis=0)
    s = np.linalg.svd(c, compute_uv=False) ** 2
    assert np.allclose(shares, s[:2] / s.sum())
    got = {(r.u, r.component): r.score for r in scores.collect()}
    assert np.allclose([[got[u, k] for k in (0, 1)] for u in range(40)], c @ np.array(vectors).T)


def test_tails_far_out(spark):
    rows = spark.createDataFrame([(z,) for z in (-40.0, -8.0, -1.0, 0.0, 1.0, 5.0, 6.9, 7.05, 7.5, 8.0, 12.0, 30.0, 37.0)], "z double").select("z", tails.norm_sf(F.col("z")).alias("p"))
    for r in rows.withColumn("back", tails.norm_isf(F.col("p"))).collect():
        assert math.isclose(r.p, math.erfc(r.z / math.sqrt(2)) / 2, rel_tol=1e-11)
        assert abs(r.z) > 7.9 and r.z < 0 or math.isclose(r.back, r.z, rel_tol=1e-8, abs_tol=1e-8)
    assert spark.range(1).select(tails.z_score(F.lit(None).cast("double")).alias("z")).first().z == 0
    t = spark.createDataFrame([(x,) for x in (-3.0, 0.0, 0.5, 20.0)], "t double").select("t", tails.t_sf(F.col("t"), F.lit(1)).alias("p"))
    assert all(math.isclose(r.p, 0.5 - math.atan(r.t) / math.pi, rel_tol=1e-9) for r in t.collect())


def test_intrinsic_volumes_of_boxes(spark):
    box = spark.range(4 * 3).select((F.col("id") % 4).alias("i"), F.floor(F.col("id") / 4).alias("j"))
    r = regions.intrinsic_volumes(box, ["i", "j"], [2.0, 0.5]).first()
    assert np.allclose([r.mu0, r.mu1, r.mu2], [1, 7, 6])


def test_wide_designs_and_offsets(spark):
    """Twenty columns within seconds; eight digits at an offset of 10^8; a constant, dummies that hold one, none, and collinear columns."""
    import time

    r = np.random.default_rng(0)
    n, p = 200, 20
    x = np.column_stack([np.ones(n), r.normal(size=(n, p - 1))])
    y = x @ r.normal(size=p) + r.normal(size=n)
    names = [f"x{k}" for k in range(p)]
    rows = spark.createDataFrame([("a", *map(float, v), float(w)) for v, w in zip(x, y)], "u string, " + ", ".join(f"{c} double" for c in [*names, "y"])).cache()
    rows.count()
    began = time.perf_counter()
    got = models.fit(rows, ["u"], names, "y").first()
    assert time.perf_counter() - began < 20  # some 3 s on an idle machine; the bound is for a crowded one
    beta, rss, _, _ = np.linalg.lstsq(x, y)
    assert np.allclose(got.beta, beta, rtol=1e-10) and math.isclose(got.sse, rss[0], rel_tol=1e-10) and np.allclose(got.cov, np.linalg.inv(x.T @ x), rtol=1e-8, atol=1e-12)
    far = models.fit(rows.withColumn("y", F.col("y") + 1e8).withColumn("x1", F.col("x1") + 1e6), ["u"], names, "y").first()
    assert math.isclose(far.sse, rss[0], rel_tol=1e-8) and np.allclose(far.beta[1:], beta[1:], rtol=1e-7)
    quad = models.f_contrast(models.fit(rows, ["u"], names, "y"), ["u"], np.eye(p)[1:].tolist()).first()
    assert math.isclose(quad.f, ((np.sum((y - y.mean()) ** 2) - rss[0]) / (p - 1)) / (rss[0] / (n - p)), rel_tol=1e-9)
    dummies = rows.withColumn("d", (F.col("x1") > 0).cast("double")).withColumn("e", 1 - F.col("d")).withColumn("y8", F.col("y") + 1e8)
    both = models.fit(dummies, ["u"], ["d", "e"], "y8").first()
    want = sum(np.sum((y[m] - y[m].mean()) ** 2) for m in (x[:, 1] > 0, x[:, 1] <= 0))
    assert math.isclose(both.sse, want, rel_tol=1e-8)
    none = models.fit(rows, ["u"], ["x1", "x2"], "y").first()
    assert math.isclose(none.sse, np.linalg.lstsq(x[:, 1:3], y)[1][0], rel_tol=1e-10)
    assert models.fit(dummies, ["u"], ["x0", "d", "e"], "y").first().beta == [None] * 3
    solved = spark.range(1).select(glm.solve_symmetric([[F.lit(float(a)) for a in row] for row in (x.T @ x)], [F.lit(float(b)) for b in x.T @ y]).alias("b")).first().b
    assert np.allclose(solved, beta, rtol=1e-9)


def test_deep_forests(spark):
    """A chain of 20,000 nodes, whose closure would be 200,000,000 rows, and a random forest against one walk down."""
    n = 20_000
    chain = spark.range(n).select("id", F.greatest(F.col("id") - 1, F.lit(0)).alias("parent"), F.lit(1.0).alias("v"))
    assert grid.below(chain, {"v": ("v", "sum")}).where((F.col("v") != n - F.col("id")) | (F.col("height") != n - 1 - F.col("id"))).count() == 0
    assert grid.depths(chain).where((F.col("depth") != F.col("id")) | (F.col("root") != 0)).count() == 0
    assert sorted(map(tuple, graphs.merge_simple_branches(chain).collect())) == [(0, 0), (n - 1, 0)]
    r = np.random.default_rng(3)
    parent = {i: int(r.integers(0, i)) if i and r.random() > 0.05 else i for i in range(300)}
    value = {i: None if r.random() < 0.2 else int(r.integers(0, 3)) for i in parent}
    table = spark.createDataFrame([(i, p, value[i]) for i, p in parent.items()], "id long, parent long, v int")
    under = {i: {i} for i in parent}
    for i in sorted(parent, reverse=True):
        if parent[i] != i:
            under[parent[i]] |= under[i]
    inner = {p for i, p in parent.items() if p != i}
    for b in grid.below(table, {"s": ("v", "sum"), "a": ("v", "min"), "b": ("v", "max")}).collect():
        held = [value[i] for i in under[b.id] if value[i] is not None]
        assert (b.s, b.a, b.b) == ((sum(held), min(held), max(held)) if held else (None, None, None))
    for x in graphs.propagate_upward(table, "v").collect():
        held = {value[i] for i in under[x.id] if i not in inner and value[i] is not None}
        assert x.v == (held.pop() if len(held) == 1 else None)
    for ids, yes in (([i for i in under[0] if i not in inner], True), ([0, 299], False)):
        assert graphs.leaves_of_subtree(table, spark.createDataFrame([(i,) for i in ids], "id long")).first().yes is yes


def test_co_labelling_keeps_every_row(spark, duck):
    """Rows without a label and repeated rows are in the query's SQL too."""
    rows = [(1, 7), (2, 7), (3, None), (4, None), (5, 8), (5, 8)]
    made = regions.co_labelling(spark.createDataFrame(rows, "c_custkey long, c_nationkey long"), "c_custkey", "c_nationkey")
    given = ", ".join(f"({a}, {'null' if b is None else b})" for a, b in rows)
    wanted = duck.execute(f"with customer(c_custkey, c_nationkey) as (values {given}) {ORACLES['co_labelling']}").fetchall()
    assert sorted(map(tuple, made.collect())) == sorted(wanted)


def test_forest_of_unit_vectors(spark):
    """Where no band prunes, pairs don't meet in a join; the forest is that of one walk from point to point."""
    v = np.random.default_rng(8).normal(size=(700, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(v)], "id long, v array<float>")
    near = grid.eps_graph(table, 1.35, "id", "v")
    assert "Join" not in near._jdf.queryExecution().toString()
    d = np.linalg.norm(v[:, None].astype(float) - v[None], axis=2)
    best, out = np.where(d[0] < 1.35, d[0], np.inf), set()
    best[0], up, left = np.inf, np.zeros(700, int), set(range(1, 700))
    while left:
        k = min(left, key=lambda i: best[i])
        if best[k] < np.inf:
            out.add((min(k, int(up[k])), max(k, int(up[k]))))
        left.discard(k)
        closer = (d[k] < best) & (d[k] < 1.35)
        best[closer], up[closer] = d[k][closer], k
    assert {(r.src, r.dst) for r in grid.spanning_forest(near).collect()} == out
