import random
import re

from pyspark.sql import functions as F

from skein.llm import lines

from odd import ODD


def brute(rows, min_words):
    """Text of each (id, text), by comparing every run of lines with all before it."""
    seen, out = set(), {}
    keys = sorted({(i if i is not None else 2**63 - 1, t or "") for i, t, _ in rows})
    runs = {}
    for key in keys:
        split = key[1].split("\n")
        own = [(p, x.strip(" "), len(re.findall(r"[^\x20\x09-\x0D]+", x))) for p, x in enumerate(split)]
        own = [o for o in own if o[2]]
        gone = set()
        for a in range(len(own)):
            words, b = 0, a
            while b < len(own) and words < min_words:
                words += own[b][2]
                b += 1
            if words >= min_words:
                run = tuple(o[1] for o in own[a:b])
                if run in seen:
                    gone |= {o[0] for o in own[a:b]}
                seen.add(run)
        runs[key] = gone
        out[key] = "\n".join(x for p, x in enumerate(split) if p not in gone)
    return {k: (out[k], len(runs[k])) for k in keys}


def compare(docs_of, rows, min_words, extra=False):
    want = brute(rows, min_words)
    got = lines.line_dedup(docs_of(rows, extra), min_words=min_words, maximal=False).collect()
    assert len(got) == len(rows)
    texts = {}
    for r in got:
        texts.setdefault(r.doc_id if r.doc_id is not None else 2**63 - 1, []).append((r.text, int(r["_n_removed"] if extra else r.n_removed)))
    for (i, t), (clean, n) in want.items():
        assert (clean, n) in [(x or "", k) for x, k in texts[i]], (i, t[:80])


def test_runs_equal_brute_force(docs_of):
    rng = random.Random(8)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6))) for _ in range(14)]
    rows = []
    for i in range(120):
        body = []
        for _ in range(rng.randrange(1, 7)):
            if rng.random() < 0.5:
                a = rng.randrange(10)
                body += pool[a : a + rng.randrange(1, 9)]
            else:
                body.append(rng.choice(["", "  ", f"own line {rng.random()}", rng.choice(pool)]))
        rows.append((i, "\n".join(body), "s"))
    for min_words in (1, 7, 16):
        compare(docs_of, rows, min_words)


def test_order_of_suffixes(spark):
    """New ranks count the suffixes that come before, and refine the old."""
    pairs = [(0, 5, 2), (0, 9000, 1), (0, 70, 4), (7, 0, 3), (10, 1, 1), (10, 0, 1)]
    got = {(r.r, r.r2): r.new for r in lines._numbered(spark.createDataFrame(pairs, "r long, r2 long, c long")).collect()}
    assert got == {(0, 5): 0, (0, 70): 2, (0, 9000): 6, (7, 0): 7, (10, 0): 10, (10, 1): 11}


def test_odd_rows(docs_of):
    compare(docs_of, ODD + [(11, "long " * 60, "a"), (12, "q\n" + "long " * 60 + "\nz", "a")], 50, extra=True)
    assert lines.line_dedup(docs_of([])).collect() == []
    clashing = docs_of(ODD, extra=True)
    kept = lines.line_dedup(clashing)
    assert kept.columns == [*clashing.columns, "_n_lines", "_n_removed", "_words_removed"]
    assert {(r.n_lines, r.words_removed) for r in kept.collect()} == {("n_lines", "words_removed")}
    assert [r.text for r in lines.line_dedup(docs_of([(1, None, "a")])).collect()] == [None]


def brute_maximal(rows, min_words):
    """Text of each (id, text) less every line of a run of min_words words or more that stands earlier, by growing the common run of every two positions."""
    keys = sorted({(i if i is not None else 2**63 - 1, t or "") for i, t, _ in rows})
    at = []
    for key in keys:
        own = [(p, x.strip(" "), len(re.findall(r"[^\x20\x09-\x0D]+", x))) for p, x in enumerate(key[1].split("\n"))]
        own = [o for o in own if o[2]]
        at += [(key, own, a) for a in range(len(own))]
    gone = {key: set() for key in keys}
    for n, (key, own, a) in enumerate(at):
        for _, other, b in at[:n]:
            same = 0
            while a + same < len(own) and b + same < len(other) and own[a + same][1] == other[b + same][1]:
                same += 1
            if sum(o[2] for o in own[a : a + same]) >= min_words:
                gone[key] |= {o[0] for o in own[a : a + same]}
    return {(i, t): ("\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i, t]), len(gone[i, t])) for i, t in keys}


def test_the_filter_holds_every_document_that_loses_lines(spark, monkeypatch):
    """Whatever its size; one that is full lets all rows pass."""
    for bits, most in ((8, 1 << 26), (40, 1 << 18), (1, 1 << 16)):
        monkeypatch.setattr(lines, "BITS", bits)
        monkeypatch.setattr(lines, "MOST_BITS", most)
        isles = spark.range(20_000).selectExpr("xxhash64(id) as th")
        held = lines._held(isles)
        segment, word, bit = lines._place(F.col("th"), held._size)
        found = isles.withColumns({"s": segment, "w": word, "b": bit}).join(held, F.col("s") == F.col("segment"))
        assert held._size <= most and found.where(F.element_at("bits", (F.col("w") + 1).cast("int")).bitwiseAND(F.col("b")) != 0).count() == 20_000


def test_maximal_runs_go_whole(docs_of):
    """A shared run of 55 and 20 words loses both lines; on random texts results equal those of comparing every two positions."""
    run = " ".join(f"a{n}" for n in range(55)) + "\n" + " ".join(f"b{n}" for n in range(20))
    got = {r.doc_id: r for r in lines.line_dedup(docs_of([(1, f"x\n{run}\ny", "s"), (2, f"p\n{run}\nq", "s")]), maximal=True).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].words_removed, got[2].text) == (0, 2, 75, "p\nq")
    rng = random.Random(9)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(14)]
    rows = []
    for i in range(60):
        body = []
        for _ in range(rng.randrange(1, 7)):
            a = rng.randrange(10)
            body += pool[a : a + rng.randrange(1, 9)] if rng.random() < 0.6 else [rng.choice(["", "  ", f"own line {rng.random()}", rng.choice(pool)])]
        rows.append((i, "\n".join(body), "s"))
    for min_words in (1, 7, 16):
        want = brute_maximal(rows, min_words)
        assert want != brute(rows, min_words) or min_words == 1
        assert {(r.doc_id, r.text, r.n_removed) for r in lines.line_dedup(docs_of(rows), min_words=min_words, maximal=True).collect()} == {(i, *v) for (i, _), v in want.items()}
