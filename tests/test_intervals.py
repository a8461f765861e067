import random

import numpy as np
import pytest

from skein.operators import intervals as I


def test_dominated_as_one_by_one():
    rng = np.random.default_rng(1)
    for m, n in ((0, 3), (5, 0), (1, 1), (200, 300)):
        x, y, at, upto = (rng.integers(0, 40, k) for k in (m, m, n, n))
        value = rng.permutation(m)
        want = [min([v for a, b, v in zip(x, y, value, strict=True) if a <= p and b >= q], default=m) for p, q in zip(at, upto, strict=True)]
        assert I.dominated(x, y, value, at, upto).tolist() == want


@pytest.mark.parametrize("most", [30, 100_000])
def test_as_with_all_blocks_of_a_path(spark, most):
    """Blocks that overlap, nest, repeat and contain nothing; one path holds most of both; with 30 rows a task there are ranges of ranges."""
    rng = random.Random(most)
    paths = ["big"] * 9 + ["x", "y", None]
    span = lambda top: (a := rng.randrange(600), a + int(rng.random() ** 6 * top))
    blocks = [(i, rng.choice(paths), *span(600)) for i in range(320)] + [(400, "big", 0, 2000), (399, "big", 0, 2000), (401, "big", None, 5), (402, "z", 1, 2)]
    nodes = [(1000 + i, rng.choice(paths), *span(90)) for i in range(420)] + [(2000, "big", 700, None), (2001, "nowhere", 1, 1), (2002, "big", 5, 2), (1000, "big", 3, 4)]
    want = {}
    for n, p, a, b in nodes:
        fit = [(d - c, k) for k, o, c, d in blocks if p is not None and o == p and None not in (a, b, c, d) and c <= a and d >= b]
        want[n] = min([x for x in (want.get(n), *fit) if x is not None], default=None)
    got = I.tightest(spark.createDataFrame(nodes, "node long, path string, a long, b long"), spark.createDataFrame(blocks, "block int, path string, ba int, bb int"), most).collect()
    assert {r["node"]: r["block"] for r in got} == {n: x and x[1] for n, x in want.items()} and len(got) == len(nodes)
