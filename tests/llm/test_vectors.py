import math
import random

import numpy as np
import pytest

from skein.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, rep int, score int"


def rows_of(seed=0, n=900, dims=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    x = (centres[rng.integers(0, 12, n)] + rng.normal(scale=0.6, size=(n, dims))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(n + i, rows[3][1]) for i in range(40)] + [(0, rows[0][1])]  # copies, and a repeated row
    odd = [None, [], [0.0] * dims, [None] + [1.0] * (dims - 1), [math.nan] + [1.0] * (dims - 1), [math.inf] + [1.0] * (dims - 1)]
    rows += [(10_000 + 50 * i, v) for i, v in enumerate(odd)] + [(None, rows[1][1]), (20_000, [1.0, 2.0]), (20_001, [2.0, 1.0])]
    random.Random(1).shuffle(rows)
    return [(*r, 1, 2) for r in rows]


def test_recall_where_few_lists_are_probed(spark, monkeypatch):
    """Clustered vectors, 48 lists of which a part is probed; all pairs tell the true neighbours."""
    rng = np.random.default_rng(9)
    x = (np.repeat(rng.normal(size=(48, 16)), 80, axis=0) + rng.normal(scale=0.35, size=(3840, 16))).astype(np.float32)
    probed, fit = [], ann.fit
    monkeypatch.setattr(ann, "BLOCK", 80)
    monkeypatch.setattr(ann, "fit", lambda *a, **b: (probed.append(m := fit(*a, **b)), m)[1])
    got = by_query(ann.search(spark.createDataFrame([(i, v.tolist(), 1, 2) for i, v in enumerate(x)], SCHEMA)).collect())
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    found = sum(len({i for i, _ in hits} & set(np.argsort(-np.where(np.arange(len(x)) == q, -2, unit @ unit[q]))[:5].tolist())) for q, hits in got.items())
    print(f"recall {found / (5 * len(got)):.4f} with {probed[0]['probes']} of {len(probed[0]['centres'])} lists probed")
    assert probed[0]["probes"] < len(probed[0]["centres"]) and found >= 0.95 * 5 * len(got)


def usable(rows, zero):
    out = {}
    for i, v, *_ in rows:
        if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and (zero or any(v)):
            out[i] = np.array(v, dtype=np.float32).astype(float)
    return out


def by_query(got):
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_exact_search(spark):
    rows = rows_of()
    v = {i: np.floor(x * 256) for i, x in usable(rows, True).items()}
    got = by_query(topk.search(spark.createDataFrame(rows, SCHEMA)).collect())
    want = {}
    for q in (i for i in v if i % 50 == 0):
        s = sorted((-int(v[q] @ x), i) for i, x in v.items() if i != q and len(x) == len(v[q]))[:5]
        if s:
            want[q] = [(i, -m) for m, i in s]
    assert got == want
    assert topk.search(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_id_with_several_vectors(spark):
    """The best pair of vectors counts, as query and as candidate, whatever the order of rows; many vectors of one id don't push others out."""
    rows = [(1, [0.9, 0.0]), (1, [0.0, 9.0]), (100, [0.0, 1.0])]
    for order in (rows, rows[::-1]):
        got = topk.search(spark.createDataFrame([(*r, 1, 2) for r in order], SCHEMA)).collect()
        assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(100, 1, 1, 589_824)]
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6)).astype(np.float32)
    rows = [(int(i), v.tolist()) for i, v in zip(rng.integers(0, 130, 400), x, strict=True)]
    rows += [(7, (x[3] + e).tolist()) for e in rng.normal(scale=0.01, size=(60, 6)).astype(np.float32)] + rows[:20] + [(200 + i, rows[5][1]) for i in range(9)]
    cosine = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    for search, score, as_v in ((topk.search, lambda a, b: int(a @ b), lambda v: np.floor(v * 256)), (ann.search, cosine, lambda v: v)):
        pairs = {}
        vectors = [(i, as_v(np.array(v, dtype=np.float32).astype(float))) for i, v in rows]
        for i, a in vectors:
            for j, b in vectors if i % 50 == 0 else ():
                if i != j:
                    pairs.setdefault(i, {})[j] = max(pairs.get(i, {}).get(j, -(2**62)), score(a, b))
        got = by_query(search(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)).collect())
        assert set(got) == set(pairs)
        for q, hits in got.items():
            want = sorted(pairs[q].items(), key=lambda h: (-round(h[1], 9), h[0]))[:5]
            assert [h[0] for h in hits] == [h[0] for h in want] and np.allclose([h[1] for h in hits], [h[1] for h in want])


@pytest.mark.parametrize("lists", [1, 24])
def test_queries_find_k_where_few_lists_are_probed(spark, lists, monkeypatch):
    """Clustered vectors, of which the sample's nearest may lie in lists that a query doesn't probe."""
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(24, 8)) * 5, 60, axis=0) + rng.normal(size=(1440, 8))
    monkeypatch.setattr(ann, "BLOCK", 1440 // lists)
    got = by_query(ann.search(spark.createDataFrame([(i, v.tolist(), 1, 2) for i, v in enumerate(x.astype(np.float32))], SCHEMA)).collect())
    assert len(got) == 29 and all(len(hits) == 5 for hits in got.values())


def test_products_beyond_doubles():
    q, x = np.array([2.0**40, 3.0]), np.array([[2.0**20, 1.0], [-(2.0**62), 0.0]])
    assert topk.products(q, x).tolist() == [2**60 + 3, -(2**63)]


def test_no_ball_is_cut_wrongly():
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(700, 16)) * 256)
    for q in np.floor(rng.normal(size=(20, 16)) * 256):
        got = topk.branch_and_bound(q[None], np.array([-np.inf]), x, np.arange(700), 6)[0]
        assert got == [(-s, i) for s, i in sorted((-int(q @ v), i) for i, v in enumerate(x))[:6]]
        names = np.arange(700) // 7
        got = topk.branch_and_bound(q[None], np.array([-np.inf]), x, names, 6, shared=True)[0]
        assert [(s, names[i]) for s, i in got] == [(-s, i) for s, i in sorted((-int((x[7 * i : 7 * i + 7] @ q).max()), i) for i in range(100))[:6]]


def test_recall_and_scores(spark):
    rows = rows_of(seed=5, n=3000)
    v = usable(rows, False)
    got = by_query(ann.search(spark.createDataFrame(rows, SCHEMA)).collect())
    found = total = 0
    for q in (i for i in v if i % 50 == 0):
        cos = {i: float(v[q] @ x / (np.linalg.norm(v[q]) * np.linalg.norm(x))) for i, x in v.items() if i != q and len(x) == len(v[q])}
        best = sorted(cos, key=lambda i: (-round(cos[i], 12), i))[:5]
        mine = got.get(q, [])
        assert len(mine) == len(best)
        assert all(abs(s - cos[i]) < 1e-12 for i, s in mine)
        assert all(a[1] > b[1] or (a[1] == b[1] and a[0] < b[0]) for a, b in zip(mine, mine[1:], strict=False))
        found += len({i for i, _ in mine} & set(best))
        total += len(best)
    print(f"recall {found / total:.4f} over {total} neighbours")
    assert total and found / total >= 0.95
    assert ann.search(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("dims", [8, 40])
def test_scan_without_loss_keeps_the_best(dims, monkeypatch):
    monkeypatch.setattr(ann, "EPSILON", 50.0)  # a test that never abandons
    rng = np.random.default_rng(1)
    q, x = rng.normal(size=(5, dims)), rng.normal(size=(300, dims))
    turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    i, j, s = ann.scan(q, np.full(5, 4.0), x, turn, 4)
    cos = (q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None]
    for k in range(5):
        assert j[i == k].tolist() == np.argsort(-cos[k])[:4].tolist()
        assert np.allclose(s[i == k], np.sort(cos[k])[::-1][:4])
