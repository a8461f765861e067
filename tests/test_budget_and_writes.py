import random

import pytest
from pyspark.sql import functions as F

from skein.operators import rendering as D
from skein.sources import output as O


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_as_one_after_the_other(spark, seed):
    """Bytes and tokens that don't agree, ties, items beyond the budget."""
    rng = random.Random(seed)
    items = [(rng.choice([5, 9, rng.randrange(200)]), f"m{i:03}", rng.randrange(1, 60)) for i in range(90)]
    budget = rng.choice([0, 70, 700, 10_000])
    left, want = budget, set()
    for _, m, t in sorted(items, key=lambda x: (-x[0], x[1])):
        if t <= left:
            left, want = left - t, want | {m}
    got = set()
    for after, before, most in D.greedy(spark.createDataFrame(items, "bytes int, module string, tokens long"), budget, 7):
        place = lambda x: (-x[0], x[1])
        got |= {x[1] for x in items if x[2] <= most and (after is None or place(x) > place(after)) and (before is None or place(x) < place(before))}
    assert got == want


def test_files_are_written_by_executors(spark, tmp_path, monkeypatch):
    """Exact contents; after a crash between renames the next writer ends the work; a failed task leaves nothing."""
    rows = [("a.md", "one\ntwo\n"), ("d/e/b.md", "no end"), ("empty.md", ""), ("none.md", None), ("é x.md", "end 😀"), ("cr.md", "a\r\n"), ("twice.md", "a\n"), ("twice.md", "b\n")]
    files = spark.createDataFrame(rows, "path string, content string")
    want = {p: (c or "") for p, c in rows}
    root = tmp_path / "out"
    root.mkdir()
    (root / "a.md").write_text("old")
    names = lambda: {str(p.relative_to(root)): p.read_bytes().decode() for p in root.rglob("*") if p.is_file() and not p.name.startswith(".")}
    bad = files.withColumn("content", F.when(F.col("path") == "cr.md", F.raise_error(F.lit("no"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no"):
        O.write_files(bad, str(root))
    assert names() == {"a.md": "old"}
    place, done = O.Folder.place, []
    monkeypatch.setattr(O.Folder, "place", lambda self, d, n: place(self, d, n) if len(done) < 2 and not done.append(n) else (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        O.write_files(files, str(root))
    monkeypatch.setattr(O.Folder, "place", place)
    assert O.write_files(files.where("path = 'empty.md'"), str(root)) == 1
    assert names() == want
    assert not [p for p in root.iterdir() if p.name.startswith((".drafts", ".pending"))]
