import re

from pyspark.sql import functions as F

from skein.llm import mixing

from odd import ODD


def targets(sizes, weights=(5, 2, 1), most=3):
    """Sharing again and again until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=str.encode) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        total = sum(w[s] for s in open_)
        above = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not above:
            return out | {s: left * w[s] / total for s in open_}
        for s in above:
            out[s] = float(most * sizes[s])
        left -= sum(most * sizes[s] for s in above)
        open_ -= above
    return out


def check(rows, got):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets(sizes)
    by_id = {}
    for i, t, s in rows:
        by_id.setdefault(i, (t, s))
    taken, largest = {}, {}
    for r in got:
        t, s = by_id[r.doc_id]
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) and r.source_size == sizes[s]
        assert abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[s] = taken.get(s, 0) + r.taken
        largest[s] = max(largest.get(s, 0), r.size)
    for s, t in taken.items():
        assert abs(t - want[s]) <= largest[s] / 2 + 1e-6


def test_targets_and_budgets(docs_of):
    rows = [(i, "w " * (1 + i % 17), None if i % 9 == 8 else "src" + "abcdefg"[min(6, i % 11)]) for i in range(600)]
    df = docs_of(rows, extra=True)
    first = mixing.mix(df).collect()
    check(rows, first)
    again = mixing.mix(df.repartition(13, F.rand(1))).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_caps_cascade(docs_of):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (500, "e"), (90, "f"), (0, "g")] * 3)]
    check(rows, mixing.mix(docs_of(rows)).collect())


def test_odd_rows(docs_of):
    got = mixing.mix(docs_of(ODD, extra=True)).collect()
    assert len(got) == len(ODD)
    check(ODD, got)
    assert mixing.mix(docs_of([])).collect() == []
    assert [r.taken for r in mixing.mix(docs_of([(1, None, None), (2, "", "a")])).collect()] == [0, 0]
