import random
import re

import numpy as np
import pytest

from skein.llm import components as comp
from skein.llm import minhash

from odd import ODD


def brute(rows, k, percent=80):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t, _ in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if rows[a][0] is not None and rows[b][0] is not None and both and 100 * both >= percent * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    first = {}
    for a in range(len(rows)):
        if rows[a][0] is not None and sets[a]:  # the rows of one id are one document
            up[find(a)] = find(first.setdefault(rows[a][0], a))
    groups = {}
    for a in range(len(rows)):
        groups.setdefault(find(a), []).append(rows[a][0])
    return sorted(((i, len(s), min(groups[find(a)]) if i is not None else None) for a, ((i, _, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def answer(df):
    return sorted(((r[0], r[1], r[2]) for r in df.collect()), key=str)


def copies(seed=1, groups=6, each=12, words=60):
    rng = random.Random(seed)
    rows, n = [], 100
    for g in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(words)]
        for c in range(each):
            t = list(base)
            for _ in range(rng.randrange(5)):
                t[rng.randrange(words)] = f"v{rng.randrange(4000)}"
            rows.append((n, " ".join(t), "s"))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("direct", [0, 500])
def test_groups_equal_brute_force(docs_of, monkeypatch, direct):
    monkeypatch.setattr(minhash, "DIRECT", direct)  # 0: by rare shingles only
    rows = copies()
    assert answer(minhash.near_duplicates(docs_of(rows), shingle=4)) == brute(rows, 4)


@pytest.mark.parametrize("direct", [0, 500])
def test_one_id_with_several_texts(docs_of, monkeypatch, direct):
    """Every text of an id links, and all of them are one document, whatever the order of rows."""
    monkeypatch.setattr(minhash, "DIRECT", direct)
    a, b = ([f"{x}{i}" for i in range(80)] for x in "ab")
    rows = [(1, " ".join(a), "s"), (1, " ".join(b), "s"), (2, " ".join([*a[:-1], "z"]), "s"), (3, " ".join([*b[:-1], "z"]), "s"), (0, "another text of no other id at all", "s"), (1, "", "s")]
    assert [r[2] for r in brute(rows, 4)] == [0, 1, 1, 1, 1, 1]
    for order in (rows, rows[::-1]):
        assert answer(minhash.near_duplicates(docs_of(order), shingle=4)) == brute(order, 4)
    rng = random.Random(4)
    more = [(rng.randrange(100, 150) if rng.random() < 0.3 else i, t, s) for i, t, s in copies(seed=6, groups=8, each=9)] + rows
    rng.shuffle(more)
    assert answer(minhash.near_duplicates(docs_of(more), shingle=4)) == brute(more, 4)


def test_bands_and_sketches_keep_pairs_at_the_limit():
    """20,000 pairs at similarity 0.8 with 4 of 5 to 80 of 100 shingles."""
    rng = np.random.default_rng(12)
    for common, n in ((4, 5), (8, 10), (16, 20), (80, 100)):
        each, pairs = (common + n) // 2, 5000
        left, right = (n - common + 1) // 2, (n - common) // 2
        x = rng.integers(0, 2**63, (pairs, n)).astype(np.uint64)
        sides = x[:, : common + left], np.concatenate([x[:, :common], x[:, common + left : common + left + right]], axis=1)
        a, b = (minhash.signatures(np.repeat(np.arange(pairs), s.shape[1]), s.reshape(-1), pairs) for s in sides)
        bands = (a == b).reshape(pairs, minhash.ROWS, -1).all(axis=1)
        mixed = [(minhash._mix(t) & np.uint64(15)) for t in (a, b)]
        apart = (mixed[0] != mixed[1]).sum(axis=1)
        assert each >= common and bands.any(axis=1).all() and apart.max() <= minhash.DIFFER
        print(f"{common} of {n}: slots that differ {apart.max()} at most")


def test_odd_rows(docs_of):
    for k in (4, 5):
        got = minhash.near_duplicates(docs_of(ODD, extra=True), shingle=k)
        assert answer(got) == brute(ODD, k)
        assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got.collect())
    assert minhash.near_duplicates(docs_of([]), shingle=4).collect() == []


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(3)
    for n, common in ((10, 5), (400, 300)):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[:common], rng.integers(0, 2**63, n - common).astype(np.uint64)])
        top = minhash.signatures(np.repeat([0, 1], n), np.concatenate([a, b]), 2, block=7 * n // 5)
        whole = minhash.signatures(np.repeat([0, 1], n), np.concatenate([a, b]), 2)
        assert (top == whole).all()  # blocks of elements don't matter
        assert abs((top[0] == top[1]).mean() - common / (2 * n - common)) < 0.2
        assert len(np.unique(top[0])) == minhash.SLOTS


@pytest.mark.parametrize("local", [0, 100_000])
def test_components(spark, local):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(1000, 1060)]
    links = chain + [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(5, 5), (None, 3)] + [(7, 300 + i) for i in range(50)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = comp.components(spark.createDataFrame(links, "u long, v long"), local=local)
    assert {r.id: r.component for r in got.collect()} == {x: find(x) for x in list(up)}
    assert comp.components(spark.createDataFrame([], "u long, v long"), local=local).collect() == []


def test_sketches_are_not_shuffled_with_every_band(spark, monkeypatch):
    """Pipeline, near-duplicate removal: of 32 keys a document only those shared are joined with its sketch."""
    written = {}
    monkeypatch.setattr(minhash, "write_table", lambda df, name, write=minhash.write_table: written.setdefault(name, df) and write(df, name))
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, text[::-1]), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    assert written["members"].columns == ["key", "rep", "hub"] and "s0" in written["unsettled"].columns
