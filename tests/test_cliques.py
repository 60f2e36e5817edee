"""Maximal cliques against a search over all sets."""

import itertools

import numpy as np
import pytest

from tidegrid.operators import cliques


def by_hand(n, edges):
    near = {v: {w for e in edges for w in e if v in e and w != v} for v in range(n)}
    out = set()
    for size in range(n, 0, -1):
        for c in itertools.combinations(range(n), size):
            if all(b in near[a] for a, b in itertools.combinations(c, 2)) and not any(set(c) <= near[v] for v in near):
                out.add(c)
    return out


@pytest.mark.parametrize("n, share", [(12, 0.5), (13, 0.75), (11, 0.2)])
def test_random_graphs(spark, n, share):
    r = np.random.default_rng(n)
    edges = [(a, b) for a, b in itertools.combinations(range(n), 2) if r.random() < share]
    rows = [(b, a) if r.random() < 0.5 else (a, b) for a, b in edges] + edges[:3] + [(4, 4), (None, 2)]
    table = spark.createDataFrame(rows, "src int, dst int").repartition(3)
    got = [tuple(c.clique) for c in cliques.maximal_cliques(table, spark.range(n)).collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand(n, edges)


def test_hub_and_big_clique(spark):
    # a star of many leaves, and a clique of 40 that has 2^40 subsets
    star = [(0, k) for k in range(1, 3001)]
    block = list(itertools.combinations(range(5000, 5040), 2))
    found = cliques.maximal_cliques(spark.createDataFrame(star + block, "src long, dst long"))
    sizes = {r["size"]: r["count"] for r in found.groupBy("size").count().collect()}
    assert sizes == {2: 3000, 40: 1}
    top = cliques.largest_cliques(found).where("vertex in (0, 5000)").collect()
    assert {(t.vertex, t.cliques, t.largest) for t in top} == {(0, 3000, 2), (5000, 1, 40)}
    assert cliques.maximal_cliques(spark.createDataFrame([], "src long, dst long")).count() == 0
