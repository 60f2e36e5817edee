"""Clustering on graphs and merge trees against one-by-one versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import clustering


def one_by_one(nodes, edges, cost):
    """(a, b, height): the cheapest adjacent pair merges until none is left."""
    members, out = {v: [v] for v in nodes}, []
    near = {frozenset(e) for e in edges if e[0] != e[1]}
    while near:
        h, a, b = min((cost(members[min(p)], members[max(p)]), min(p), max(p)) for p in near)
        out.append((a, b, h))
        members[a] += members.pop(b)
        near = {frozenset(a if v == b else v for v in p) for p in near}
        near = {p for p in near if len(p) == 2}
    return out


def random_graph(seed, n=40, m=70):
    r = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in r.integers(0, n, (m, 2))]
    return r, edges, {frozenset(e): float(r.random()) for e in edges}


@pytest.mark.parametrize("seed", [0, 1])
def test_ward(spark, seed):
    r, edges, _ = random_graph(seed)
    x = r.normal(size=(40, 3)) + 1e6
    vertices = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "id long, x double, y double, z double")
    table = spark.createDataFrame(edges, "src long, dst long")
    merges = clustering.ward(vertices, table, ["x", "y", "z"]).cache()
    inertia = lambda a, b: float(((x[a + b] - x[a + b].mean(0)) ** 2).sum())
    want = one_by_one(range(40), edges, inertia)
    got = {(m.a, m.b): m.height for m in merges.collect()}
    assert set(got) == {(a, b) for a, b, _ in want} and all(np.isclose(got[a, b], h, rtol=1e-7) for a, b, h in want)
    assert merges.agg(F.max("round")).first()[0] < 20
    # the first 15 merges, and those under a height
    for args, done in (({"clusters": 25}, want[:15]), ({"stop": want[20][2] * 1.0001}, want[:21])):
        label = {v: v for v in range(40)}
        for a, b, _ in done:
            label = {v: a if c == b else c for v, c in label.items()}
        assert {c.id: c.label for c in clustering.cut_tree(vertices, merges, **args).collect()} == label
    tree = {t.node: (t.parent, t.height) for t in clustering.dendrogram(vertices, merges).collect()}
    assert len(tree) == 40 + len(want)
    for k, (a, b, h) in enumerate(want):
        assert np.isclose(tree[40 + k][1], h, rtol=1e-7) and sum(p == 40 + k and n != p for n, (p, _) in tree.items()) == 2
    assert all(n < 40 or tree[p][1] >= h for n, (p, h) in tree.items())


def test_average_link(spark):
    _, edges, weight = random_graph(3)
    table = spark.createDataFrame([(a, b, weight[frozenset((a, b))]) for a, b in edges], "src long, dst long, w double")
    mean = lambda a, b: -sum(weight.get(frozenset((i, j)), 0) for i in a for j in b) / (len(a) * len(b))
    want = one_by_one(range(40), edges, mean)
    got = {(m.a, m.b): m.height for m in clustering.average_link(table).collect()}
    assert set(got) == {(a, b) for a, b, _ in want} and all(np.isclose(got[a, b], -h) for a, b, h in want)


def sweep(values, edges, threshold=None):
    """Blobs {node: (parent, size)} and labels, vertex by vertex from the highest value down."""
    near = {v: set() for v in values}
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    label, root, parent = {}, {}, {}
    for v in sorted((v for v in values if threshold is None or values[v] >= threshold), key=lambda v: (-values[v], v)):
        roots = {root[u] for u in near[v] if u in root and u != v}
        label[v] = roots.pop() if len(roots) == 1 else v
        root[v] = label[v]
        for u in root:
            if root[u] in roots:
                root[u] = v
        parent.update((r, v) for r in roots)
    return {b: (parent.get(b, b), sum(x == b for x in label.values())) for b in set(label.values()) | set(parent)}, label


@pytest.mark.parametrize("seed, levels, threshold", [(0, 1000, None), (1, 6, None), (2, 1000, 300.0)])
def test_merge_tree(spark, seed, levels, threshold):
    r, edges, _ = random_graph(seed, 60, 110)
    values = {k: float(v) for k, v in enumerate(r.integers(0, levels, 60))}
    vertices = spark.createDataFrame([(k, v, "x") for k, v in values.items()] + [(99, None, "x")], "id long, h double, label string")
    blobs, labels = clustering.merge_tree(vertices, spark.createDataFrame(edges, "src long, dst long"), "h", threshold)
    want, own = sweep(values, edges, threshold)
    assert {x.id: x.label for x in labels.collect()} == own
    got = {b.node: b for b in blobs.collect()}
    assert {n: (b.parent, b.size) for n, b in got.items()} == want
    assert all(b.birth == values[n] and b.death == (values[b.parent] if b.parent != n else None) for n, b in got.items())


def test_merge_tree_of_a_path(spark):
    """Many saddles above each other: labels climb by halving jumps."""
    n = 60
    values = {k: float(k // 2 if k % 2 else 1000 - k) for k in range(n)}
    edges = [(k, k + 1) for k in range(n - 1)]
    vertices = spark.createDataFrame(list(values.items()), "id long, h double")
    blobs, labels = clustering.merge_tree(vertices, spark.createDataFrame(edges, "src long, dst long"), "h")
    want, own = sweep(values, edges)
    assert {b.node: (b.parent, b.size) for b in blobs.collect()} == want and {x.id: x.label for x in labels.collect()} == own


def test_nothing_to_merge(spark):
    vertices = spark.createDataFrame([(1, 2.0), (2, 1.0)], "id long, h double")
    none = spark.createDataFrame([(1, 1, 1.0)], "src long, dst long, w double")
    assert clustering.ward(vertices, none, ["h"]).count() == clustering.average_link(none).count() == 0
    blobs, labels = clustering.merge_tree(vertices, none, "h")
    assert sorted((b.node, b.parent, b.size) for b in blobs.collect()) == [(1, 1, 1), (2, 2, 1)] and labels.count() == 2
    assert clustering.merge_tree(vertices.limit(0), none, "h")[0].count() == 0
    assert sorted(tuple(x) for x in clustering.cut_tree(vertices, clustering.ward(vertices, none, ["h"]), clusters=1).collect()) == [(1, 1), (2, 2)]
