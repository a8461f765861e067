import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from skein.llm import codes
from skein.llm.base import lookup

SCHEMA = "vec_id long, embedding array<double>, label int, id int, code string, v int"


def plain(rows, dims, parts, entries, rounds):
    """All distances, in Python's integers."""
    kept = [(i, [math.floor(Fraction(x) * 1024) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    used = sorted((r for r in kept if len(r[1]) == dims), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = dims // parts
    books = [[r[1][p * w : p * w + w] for r in used[:entries]] for p in range(parts)]
    near = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(e, v[p * w : p * w + w], strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        groups = [defaultdict(list) for _ in range(parts)]
        for _, v, _ in used:
            for p in range(parts):
                groups[p][near(p, v)[1]].append(v[p * w : p * w + w])
        for p in range(parts):
            for k, g in groups[p].items():
                books[p][k] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    found = [(i, lab, *(("".join(f"{near(p, v)[1]:02x}" for p in range(parts)), sum(near(p, v)[0] for p in range(parts))) if len(v) == dims else (None, None))) for i, v, lab in kept]
    total = defaultdict(int)
    for _, lab, _, e in found:
        total[lab] += e or 0
    return books, [(i, lab, c, None if e is None else min(e, 2**63 - 1), min(total[lab], 2**63 - 1) if any(f[1] == lab and f[3] is not None for f in found) else None) for i, lab, c, e in found]


def rows_of(seed, n, dims, scale):
    rng = random.Random(seed)
    rows = [(rng.randrange(n), [rng.gauss(0, scale) for _ in range(dims)], rng.choice([0, 0, 1, None])) for _ in range(n)]
    rows += [rows[0]] * 5 + [(None, rows[1][1], 2), (-1, [0.0] * dims, 0), (-2, [-0.0001] * dims, 0)]
    return rows + [(1, None, 0), (2, [None] * dims, 0), (3, [math.nan] * dims, 0), (4, [math.inf] * dims, 0), (5, [], 3), (6, [1.0], 3)]


@pytest.mark.parametrize(("dims", "entries", "scale"), [(8, 32, 1.0), (4, 256, 0.003), (24, 7, 1e6), (8, 16, 1e12)])
def test_as_with_all_distances(spark, dims, entries, scale):
    """Few different values make ties; large ones need more than 64 bits."""
    rows = rows_of(dims, 300, dims, scale)
    found, books = codes.compress(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(5), entries=entries, rounds=3)
    want, all_rows = plain(rows, dims, 4, entries, 3)
    assert [b.tolist() for b in books] == want
    order = lambda r: tuple((x is None, 0 if x is None else x) for x in r)
    assert sorted(map(tuple, found.select("id", "label", "code", "error", "label_error").collect()), key=order) == sorted(all_rows, key=order)


def test_only_the_annulus_is_evaluated(monkeypatch):
    rng = np.random.default_rng(0)
    entries = rng.integers(-1000, 1000, (256, 4)) * rng.integers(1, 9, (256, 1))
    x, seen = entries[rng.integers(0, 256, 2000)] + rng.integers(-20, 20, (2000, 4)), []
    best = codes.Codebook._best
    monkeypatch.setattr(codes.Codebook, "_best", lambda self, q, low, high, at: (seen.append(np.maximum(high - low, 0).sum()), best(self, q, low, high, at))[1])
    e, d = codes.Codebook(entries).nearest(x)
    every = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (every.argmin(axis=1) == e).all() and (every.min(axis=1) == d).all()
    print(f"{sum(seen) / every.size:.3f} of all distances evaluated")
    assert sum(seen) < 0.3 * every.size


def test_empty_and_unusable(spark):
    found, books = codes.compress(spark.createDataFrame([], SCHEMA))
    assert found.collect() == [] and books == []
    found, books = codes.compress(spark.createDataFrame([(1, [1.0], 0, 1, "", 1), (2, None, 0, 1, "", 1), (3, [1e300] * 4, None, 1, "", 1)], SCHEMA))
    assert sorted(map(tuple, found.collect())) == [(1, 0, None, None, None), (3, None, None, None, None)]


def test_lookup_splits_hot_keys(spark):
    """Half the rows have one key and a tenth none."""
    rows = spark.range(2000).selectExpr("id", "case when id % 10 = 9 then null when id % 2 = 0 then 7 else id end as k", "1 as _key0")
    table = spark.createDataFrame([(7, "a"), (None, "b"), (13, "c"), (5000, "d")], "k long, x string")
    for share in (5, 100):
        got = {r["id"]: r["x"] for r in lookup(rows, table, ["k"], share).collect()}
        assert len(got) == 2000 and all(x == ("b" if i % 10 == 9 else "a" if i % 2 == 0 or i == 7 else "c" if i == 13 else None) for i, x in got.items())
