"""Affine maps against matrices."""

import numpy as np
import pytest

from tidegrid.operators.maps import AffineMap, sliced

A = AffineMap.of("ijk", "xyz", [[2, 0, 0, 1], [0, 3, 1, -2], [0, 1, 1, 5]])


def test_algebra():
    p = np.array([1.0, 2.0, 3.0, 1.0])
    b = AffineMap.of("xyz", "uvw", np.vstack([np.random.default_rng(1).normal(size=(3, 4)), [0, 0, 0, 1]]))
    assert np.allclose(b.after(A).matrix @ p, b.matrix @ (A.matrix @ p))
    assert A.inverse().after(A).same(AffineMap.start_step("ijk", "ijk", [0] * 3, [1] * 3))
    assert A.reordered("kij", "zxy").same(A) and not A.same(A.shifted_domain([1, 0, 0]))
    assert np.allclose(A.shifted_domain([1, 2, 0]).matrix @ [0, 0, 0, 1], A.matrix @ [1, 2, 0, 1])
    both = A.product(AffineMap.of("t", "s", [[2.0, 7.0]]))
    assert np.allclose(both.matrix @ [1, 2, 3, 4, 1], [*(A.matrix @ p)[:3], 15, 1])
    assert both.dropped("t").same(A) and A.dropped("i").domain == ("j", "k") and A.dropped("i").range == ("y", "z")
    for bad in (lambda: A.dropped("j"), lambda: A.after(A), lambda: A.reordered("iij"), lambda: AffineMap.of("ii", "x", [[1, 1, 0]]), lambda: AffineMap.of("i", "x", [[1.0]]), lambda: AffineMap.of("ij", "xy", [[1, 1, 0], [1, 1, 0]]).inverse()):
        with pytest.raises(ValueError):
            bad()


def test_slices_keep_places(spark):
    cells = spark.createDataFrame([(i, j, k, float(100 * i + 10 * j + k)) for i in range(5) for j in range(4) for k in range(3)] + [(None, 0, 0, 1.0)], "i int, j int, k int, v double")
    where = {r.v: (r.x, r.y, r.z) for r in A.apply(cells.dropna()).collect()}
    kept, place = sliced(cells, A, {"i": (4, None, -2), "j": 2, "k": (1, 3, 1)})
    got = place.apply(kept).collect()
    data = np.arange(5)[:, None, None] * 100.0 + np.arange(4)[:, None] * 10 + np.arange(3)
    want = data[4::-2, 2, 1:3]
    assert {(r.i, r.k): r.v for r in got} == {(i, k): want[i, k] for i in range(3) for k in range(2)}
    assert all((r.x, r.y, r.z) == where[r.v] for r in got) and place.domain == ("i", "k")
    assert A.apply(cells.limit(0)).count() == 0
