import numpy as np
import pytest

from skein.operators import retrieval as R
from skein.operators import vector_index as V


def rows_of(seed, n, start=0, dims=12, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(0).normal(size=(20, dims))
    x = (centres[rng.integers(0, 20, n)] + rng.normal(scale=spread, size=(n, dims))).astype(np.float32)
    return [(f"f{i % 13}", start + i, v.tolist()) for i, v in enumerate(x)]


SCHEMA = "file string, node long, v array<float>"


@pytest.mark.parametrize("farthest", [0.7, 1.5])
def test_as_a_scan_of_all(spark, tmp_path, farthest):
    """After adding, removing, updating and compacting, searches give what all pairs give, and few lists meet a query."""
    ix = V.VectorIndex(spark, str(tmp_path / "ix"))
    a, b = rows_of(1, 1800), rows_of(2, 300, 5000)
    a += [("f1", 9000, [0.0] * 12), ("f1", 9001, a[0][2]), ("f2", 9002, a[0][2])]
    asked = [(n, v) for _, n, v in a[:40]] + [(7777, [0.0] * 12), (7778, None), (7779, [1.0])]
    q = spark.createDataFrame(asked, "query long, q array<float>")

    def same(rows, k=4, told=None):
        got = sorted(map(tuple, ix.search(q, k, farthest, told).collect()))
        df = spark.createDataFrame(rows, SCHEMA)
        assert got == sorted(map(tuple, R.neighbours(df.select("node", "v"), q, k, farthest).select("query", "node", "distance", "rank").collect()))

    assert ix.search(q, 4, farthest).collect() == []
    ix.add(spark.createDataFrame(a, SCHEMA))
    told = {}
    same(a, told=told)
    print(f"{told['met'] / told['pairs']:.3f} of {told['pairs']} pairs of queries and lists met")
    assert told["met"] < 0.5 * told["pairs"]
    ix.add(spark.createDataFrame(b, SCHEMA))
    assert ix.remove(spark.createDataFrame([("f3",)], "file string")) > 0
    left = [r for r in a + b if r[0] != "f3"]
    same(left)
    new = [("f4", 9100, a[3][2])]
    ix.update(spark.createDataFrame(new, SCHEMA), spark.createDataFrame([("f4",)], "file string"))
    left = [r for r in left if r[0] != "f4"] + new
    ix.compact()
    same(left)
    assert len(ix.index.manifest()["segments"]) == 1
    with pytest.raises(ValueError, match="components"):
        ix.add(spark.createDataFrame([("x", 1, [1.0]), ("x", 2, [])], SCHEMA))
