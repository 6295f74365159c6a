"""Lengths from the root are added in the order of the way, bit by bit."""

import numpy as np

from arborium.operators import topology as T


def test_sums_in_order(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for tree, shape in enumerate((lambda n: n // 2, lambda n: n - 3 if n % 5 == 0 else n - 1, lambda n: int(rng.integers(1, n)), lambda n: -1 if n == 9 else n - 1)):
        at = {}
        for n in range(1, 61):
            parent = -1 if n == 1 else shape(n)
            at[n] = tuple(float(round(v, 2)) for v in rng.uniform(0, 100, 3))
            rows.append((tree, n, parent, *at[n]))
            if parent == -1:
                want[tree, n] = 0.0
            else:
                d = [p - q for p, q in zip(at[n], at[parent], strict=True)]
                want[tree, n] = want[tree, parent] + float(np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))
    got = {(r.neuron_id, r.point_no): r.dist for r in T.sums_from_root(spark.createDataFrame(rows, "neuron_id long, point_no long, parent long, x double, y double, z double")).collect()}
    assert got == want
