import tracemalloc

import numpy as np
import pyarrow as pa

from skein.operators import retrieval as R
from skein.operators import vector_index as V


def test_memory_of_a_block_does_not_grow_with_its_vectors():
    rng = np.random.default_rng(1)

    def table(n, names):
        return pa.table({names[0]: np.arange(n), names[1]: pa.array(list(rng.normal(size=(n, 8))))})

    peaks = []
    for n in (8192, 32_768):
        q, v = table(300, ("query", "q")), table(n, ("node", "v"))
        tracemalloc.start()
        got = R.nearest(q, v, 10, 0.3)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        x, y = (np.array(c.to_pylist()) for c in (v["v"], q["q"]))
        d = np.round(1 - y @ x.T / np.linalg.norm(y, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None], 6)
        best = np.lexsort((np.broadcast_to(np.arange(n), d.shape), d), axis=1)[:, :10]
        want = [(i, j) for i in range(300) for j in best[i] if d[i, j] <= 0.3]
        assert list(zip(got["query"].to_pylist(), got["node"].to_pylist())) == want
    assert peaks[1] < 1.5 * peaks[0] < 2**27


def test_memory_of_a_piece_does_not_grow_with_lists_and_queries():
    """F34 stored_knn: distances of all queries of a batch from all centres, and their copies for each list, are never there at once."""
    rng = np.random.default_rng(2)
    centres = V._unit(rng.normal(size=(500, 8)))
    radii = dict.fromkeys(range(500), 0.4) | {V.NOWHERE: 0.0}
    peaks, found = [], []
    for n in (500, 4000):
        x = np.random.default_rng(3).normal(size=(n, 8))
        b = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(list(x)), pa.array(["f"] * n), pa.array(np.arange(n)), pa.array(list(x))], ["query", "q", "file", "node", "v"])
        tracemalloc.start()
        rows = [sum(r.num_rows for r in V.reached(b, centres, radii, 0.3)), sum(r.num_rows for r in V.placed(b, centres))]
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        d = np.linalg.norm(V._unit(x)[:, None] - centres[None], axis=2)
        found.append(rows == [(np.maximum(0, d - 0.4 - 1e-9) ** 2 / 2 <= 0.3 + 1e-6).sum(), n])
    assert all(found) and peaks[1] < 1.5 * peaks[0] < 2**26
