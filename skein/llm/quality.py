"""Quality classifier: a generalised additive model with pairwise interactions, fitted by cyclic boosting of shallow trees.

Each text becomes a row of counts and shares. Training goes round the features again and again, each time fitting a tree of at most four
leaves to one feature's bins and adding a fraction of it to that feature's table; pairs of features with the largest remaining
gain then get tables of their own. A score is the sum of one table entry for each feature and pair.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import quoted, release, small_batches, table, write_table
from .bpe import _slices

#: Labelled rows that fit the model: at most so many, the smallest by hash.
LABELLED = 20_000
THRESHOLD = 0.3
FEATURES = (
    "words", "word_length", "distinct_words", "distinct_pairs", "repeated_at_once", "top_word", "upper", "digits", "stops", "marks",
    "symbols", "bars", "exclamations", "spaces", "lines", "repeated_lines", "capitalised", "beyond_ascii", "entropy", "last_word_stops",
)
_BYTES = {n: np.frombuffer(c, dtype=np.uint8) for n, c in (("stops", b".?"), ("marks", b",;:'\"()-"), ("symbols", b"#&$*%@~^_=+<>{}[]\\/`"), ("spaces", b" \t\n\r\x0b\x0c"))}


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text; all 0 for null, empty and blank texts."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    size = len(raw)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    p = count[count > 0] / size
    lines = [x for x in raw.split(b"\n") if x]
    share = {k: int(count[v].sum()) / size for k, v in _BYTES.items()}
    return [
        math.log1p(n),
        (size * (1 - share["spaces"])) / n,
        len(set(words)) / n,
        len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
        sum(map(bytes.__eq__, words, words[1:])) / n,
        max(Counter(words).values()) / n,
        upper / max(1, upper + lower),
        int(count[48:58].sum()) / size,
        share["stops"],
        share["marks"],
        share["symbols"],
        int(count[124]) / size,
        int(count[33]) / size,
        share["spaces"],
        len(lines) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(65 <= w[0] <= 90 for w in words) / n,
        int(count[128:].sum()) / size,
        float(-(p * np.log2(p)).sum()),
        float(words[-1][-1:] in (b".", b"?", b"!")),
    ]


def _tree(g: np.ndarray, h: np.ndarray, smooth: float, depth: int = 2) -> np.ndarray:
    """Values for each bin of the best tree of `depth` levels on ordered bins with gradients g and weights h."""

    def gain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * a / (b + smooth)

    out = np.full(len(g), g.sum() / (h.sum() + smooth))
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        score = gain(left_g, left_h) + gain(g.sum() - left_g, h.sum() - left_h)
        at = int(np.argmax(score)) + 1
        if score[at - 1] > gain(g.sum(), h.sum()) + 1e-12:
            out[:at] = _tree(g[:at], h[:at], smooth, depth - 1)
            out[at:] = _tree(g[at:], h[at:], smooth, depth - 1)
    return out


class Additive:
    """Tables of a generalised additive model with pairs; fit() and score()."""

    def __init__(self, bins: int = 32, rounds: int = 80, pairs: int = 6, coarse: int = 8, rate: float = 0.15, smooth: float = 4.0):
        self.bins, self.rounds, self.pairs, self.coarse, self.rate, self.smooth = bins, rounds, pairs, coarse, rate, smooth
        self.base, self.edges, self.tables, self.chosen, self.pair_tables = 0.0, [], [], [], []

    def _binned(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]

    def _crossed(self, b: list[np.ndarray], f: int, g: int) -> np.ndarray:
        def down(k: int) -> np.ndarray:
            return b[k] * self.coarse // (len(self.edges[k]) + 1)

        return down(f) * self.coarse + down(g)

    def _quadrants(self, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """Gain and values of the best cut of a coarse grid into four."""
        n = self.coarse
        cg, ch = (np.pad(v.reshape(n, n), ((1, 0), (1, 0))).cumsum(0).cumsum(1) for v in (g, h))
        best, where = -1.0, None
        parts = lambda c, i, j: np.array([c[i, j], c[i, n] - c[i, j], c[n, j] - c[i, j], c[n, n] - c[i, n] - c[n, j] + c[i, j]])
        for i in range(1, n):
            for j in range(1, n):
                a, b = parts(cg, i, j), parts(ch, i, j)
                if (gain := float((a * a / (b + self.smooth)).sum())) > best:
                    best, where = gain, (i, j, a / (b + self.smooth))
        i, j, v = where
        grid = np.empty((n, n))
        grid[:i, :j], grid[:i, j:], grid[i:, :j], grid[i:, j:] = v
        return best - float(g.sum() ** 2 / (h.sum() + self.smooth)), grid.reshape(-1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Additive:
        """Without rows every score is 0.5; with one label only, near that label's share."""
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        if not len(y):
            return self
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = math.log(share / (1 - share))
        b, z = self._binned(x), np.full(len(y), self.base)

        def gradients() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-z))
            return y - p, p * (1 - p)

        for _ in range(self.rounds):
            for f, own in enumerate(b):
                g, h = (np.bincount(own, v, minlength=len(self.tables[f])) for v in gradients())
                step = self.rate * _tree(g, h, self.smooth)
                self.tables[f] += step
                z += step[own]
        g0, h0 = gradients()
        size = self.coarse**2
        ranked = []
        for f, k in combinations(range(len(b)), 2):
            cell = self._crossed(b, f, k)
            ranked.append((-self._quadrants(np.bincount(cell, g0, minlength=size), np.bincount(cell, h0, minlength=size))[0], f, k))
        self.chosen = [(f, k) for _, f, k in sorted(ranked)[: self.pairs]]
        self.pair_tables = [np.zeros(size) for _ in self.chosen]
        for _ in range(self.rounds // 4):
            for t, (f, k) in enumerate(self.chosen):
                cell = self._crossed(b, f, k)
                g, h = (np.bincount(cell, v, minlength=size) for v in gradients())
                step = self.rate * self._quadrants(g, h)[1]
                self.pair_tables[t] += step
                z += step[cell]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        z = np.full(len(x), self.base)
        for own, values in zip(b, self.tables, strict=True):
            z += values[own]
        for (f, k), values in zip(self.chosen, self.pair_tables, strict=True):
            z += values[self._crossed(b, f, k)]
        return 1 / (1 + np.exp(-z))


def held_out(id_: Column) -> Column:
    """Whether a document's labels are kept from training: crc32 of its id as text, modulo 5, is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = LABELLED) -> Additive:
    """Fit on at most `most` labelled ids and at most as many rows (documented bounds), both the smallest by hash, held-out ids left out.

    Rows without label or id are ignored; texts of one id with equal features and label are one row, so that an id that stands often doesn't outweigh the others.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("y is not null and id is not null").where(~held_out(F.col("id")))
    marks = write_table(marks.orderBy(F.xxhash64("id"), "id", "y").limit(most), "labelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, "text"):
            rows = [features(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["id"], b["y"], pa.array(rows, pa.list_(pa.float64()))], ["id", "y", "x"])

    small_batches(docs.sparkSession)
    picked = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")).join(F.broadcast(marks), "id")  # at most `most` ids
    id_type = docs.schema[id_col].dataType.simpleString()
    told = picked.mapInArrow(run, f"id {id_type}, y double, x array<double>").dropDuplicates(["id", "y", "x"])
    got = told.orderBy(F.xxhash64("id", "y", "x"), "id", "y", "x").limit(most).toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    rows = np.array(got["x"].to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    order = np.lexsort((*rows.T[::-1], got["y"].to_numpy()))  # sums of doubles then don't depend on the order of rows
    return Additive().fit(rows[order], got["y"].to_numpy()[order])


def classify(docs: DataFrame, model: Additive, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: tuple[str, ...] = (), names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """(id_col, *keep, *names) for every row; names are those of the score and of whether it reaches the threshold. Null and empty texts get the score of a row of zeros; only the text counts."""
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"), *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(keep)])
    types = [docs.schema[c].dataType.simpleString() for c in (id_col, *keep)]
    own = ["id", *[f"c{i}" for i in range(len(keep))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, "text"):
            x = np.array([features(t) for t in b["text"].to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*[b[n] for n in own], pa.array(model.score(x))], [*own, "score"])
        release()

    small_batches(docs.sparkSession)
    scored = rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(own, types, strict=True)) + ", score double")
    return scored.select(*[F.col(n).alias(c) for n, c in zip(own, (id_col, *keep), strict=True)], F.col("score").alias(names[0]), (F.col("score") >= threshold).cast("int").alias(names[1]))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = classify(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
