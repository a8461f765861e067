"""Personal data by pattern, and terms that give it away by information-theoretic sanitisation.

Patterns find the protected entities. Over the whole corpus, the different contexts of an entity that hold a term are counted against
the documents that hold the term away from the entity. What a term discloses is the chance of the entity given the term, that is 2 to the power of its pointwise mutual information with the
entity less the entity's own information content; of that chance the lower end of a confidence interval counts, which means the same in a corpus of any size and which few observations can't raise. Terms
from a first threshold on are generalised, those from a second on removed, wherever they stand.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import drop_table, release, small_batches, table, write_table
from .bpe import _slices

KINDS = ("email", "ip", "card", "phone")
#: Words on each side that count as near, and the chances of an entity given a term from which the term is generalised, and removed.
NEAR, DISCLOSED, REMOVED = 6, 0.5, 0.8
#: Deviates of the lower end of the chance's interval (Wilson's, 90 % one-sided), and different contexts that a term needs at least.
DEVIATES, CONTEXTS = 1.2816, 2
#: Positions of the table of word hashes that workers get: 4 MB at most, whatever the corpus.
POSITIONS = 1 << 22

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive repeats and the look-behind change no match; they keep long runs linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_OTHER = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
    return (sum(twice) + sum(map(int, digits[-1::-2]))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match starts where the run of local characters before its @ does, but not before the end of the match before."""
    last = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            last = m.end()
            yield start, last


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _OTHER.sub("", m[0])
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_OTHER.sub("", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else _OTHER.sub('', value)}"


def _near(words: list[tuple[int, int, str]], start: int, end: int) -> tuple[list[str], list[str]]:
    """Up to NEAR words before and after a span, of a text's words in their order; a word that the span cuts is neither."""
    a, b = bisect_right(words, start, key=itemgetter(1)), bisect_left(words, end, key=itemgetter(0))
    return [w for _, _, w in words[max(0, a - NEAR) : a]], [w for _, _, w in words[b : b + NEAR]]


def _hash(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def _positions(terms: DataFrame) -> np.ndarray | None:
    """Which of POSITIONS hold a term's hash; None without terms. At most POSITIONS numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({_hash(t) % POSITIONS for t in b["term"].to_pylist()}), pa.int32())], ["at"])

    at = terms.select("term").mapInArrow(run, "at int").distinct().toArrow()["at"].to_numpy()
    if not len(at):
        return None
    held = np.zeros(POSITIONS, dtype=bool)
    held[at] = True
    return held


class _Held(dict):
    """Word to whether its position is held, worked out once while it is kept."""

    def __init__(self, held: np.ndarray):
        self.held = held

    def __missing__(self, word: str) -> bool:
        if len(self) > 300_000:
            self.clear()
        got = self[word] = bool(self.held[_hash(word.lower()) % POSITIONS])
        return got


def disclosure(contexts, away):
    """The lower end of the chance of an entity given a term that stands in so many contexts of it and so many documents away from it."""
    n, z = contexts + away, DEVIATES * DEVIATES
    return (contexts + z / 2 - DEVIATES * (contexts * away / n + z / 4) ** 0.5) / (n + z)


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", disclosed: float = DISCLOSED, removed: float = REMOVED, redacted: bool = False) -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base, spans[, clean]) for every row.

    base and spans are comma-joined kind:start:end; spans adds hint:start:end and term:start:end after the others, for terms that disclose from `disclosed` and from `removed` on. With `redacted`, clean is the text
    with entities and hints replaced by their kind in brackets, and terms left out. Defined cases: null is read as the empty text and has no
    spans (clean stays null); rows without id keep theirs; repeated rows get equal results and each counts as a document; an entity that
    every document holds is no secret; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("context", pa.int64()), ("doc", pa.int64())]))
        for b in _slices(batches, "text"):
            counts, bases, nears = [], [], []
            for t in b["text"].to_pylist():
                spans = base_spans(t)
                n = Counter(k for k, _, _ in spans)
                counts.append([n[k] for k in KINDS])
                bases.append(_joined(spans))
                near = {}
                words = [(*m.span(), m[0].lower()) for m in _TERM.finditer(t)] if spans else []
                for k, a, z in spans:
                    before, after = _near(words, a, z)
                    context = _hash(" ".join([*before, k, *after])) - (1 << 63)
                    entity = _entity(k, t[a:z])
                    for w in ("", *before, *after):
                        near.setdefault((entity, w), {})[context] = None
                nears.append([{"entity": e, "term": w, "context": c, "doc": int(not i)} for (e, w), cs in near.items() for i, c in enumerate(cs)])
            cols = [b["id"], b["th"], *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4)), pa.array(bases), pa.array(nears, pair)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "th", *(f"n_{k}" for k in KINDS), "base", "near"])
        release()

    fields = f"id {id_type}, th long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, near array<struct<entity string, term string, context long, doc long>>"
    found = write_table(rows.mapInArrow(first, fields), "personal")
    total = found.count()
    near = found.where("size(near) > 0").select(F.explode("near").alias("x")).select("x.*")
    joint = near.groupBy("entity", "term", "context").agg(F.sum("doc").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count("*").alias("contexts"))
    joint = write_table(joint, "near")
    pairs = joint.where("term != ''")
    marks = None
    if (held := _positions(pairs)) is not None:
        wide = spark.sparkContext.broadcast(held)  # POSITIONS bytes

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _Held(wide.value)
            for b in _slices(batches, "text"):
                n = Counter(w for t in b["text"].to_pylist() for w in {x.lower() for x in set(_TERM.findall(t)) if known[x]})
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "n"])

        terms = write_table(rows.mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("with_term")), "terms")
        entities = joint.where("term = ''").select("entity", F.col("both").alias("with_entity"))
        told = pairs.join(entities, "entity").join(terms, "term").where(F.col("with_entity") < total)
        # different contexts of both (copies are one) against documents with the term away from the entity
        told = told.where(F.col("contexts") >= CONTEXTS).select("term", disclosure(F.col("contexts"), F.greatest(F.col("with_term") - F.col("both"), F.lit(0))).alias("chance"))
        told = write_table(told.where(F.col("chance") >= disclosed).groupBy("term").agg((F.max("chance") >= removed).alias("out")), "disclosing")
        if (few := _positions(told)) is not None:
            narrow = spark.sparkContext.broadcast(few)  # POSITIONS bytes

            def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                known = _Held(narrow.value)
                for b in _slices(batches, "text"):
                    out = [(i, m[0].lower(), m.start(), m.end()) for i, t in enumerate(b["text"].to_pylist()) for m in _TERM.finditer(t) if known[m[0]]]
                    at = pa.array([o[0] for o in out], pa.int64())
                    yield pa.RecordBatch.from_arrays([b["id"].take(at), b["th"].take(at), *(pa.array([o[c] for o in out], t) for c, t in ((1, pa.string()), (2, pa.int64()), (3, pa.int64())))], ["id", "th", "term", "a", "b"])

            hits = rows.mapInArrow(mark, f"id {id_type}, th long, term string, a long, b long").join(told, "term").select("id", "th", "a", "b", "out").distinct()
            marks = hits.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("a", "b", "out"))).alias("marks"))
        drop_table(terms)
    drop_table(joint)
    if marks is None:
        out = found.withColumn("spans", F.col("base"))
    else:
        marks = write_table(marks, "marks").select(F.col("id").alias("mark_id"), F.col("th").alias("mark_th"), "marks")
        out = found.join(marks, F.col("id").eqNullSafe(F.col("mark_id")) & (F.col("th") == F.col("mark_th")), "left")
        more = F.array_join(F.transform("marks", lambda m: F.concat(F.when(m["out"], "term:").otherwise("hint:"), m["a"], F.lit(":"), m["b"])), ",")
        out = out.withColumn("spans", F.concat_ws(",", F.nullif("base", F.lit("")), more))
    cols = [*(f"n_{k}" for k in KINDS), "base", "spans"]
    if redacted:
        texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.col(text_col).alias("text")).withColumnsRenamed({"id": "text_id", "th": "text_th"}).distinct()
        out = out.join(texts, F.col("id").eqNullSafe(F.col("text_id")) & (F.col("th") == F.col("text_th")), "left").withColumn("clean", F.pandas_udf(_redact, "string")("text", "spans"))
        cols.append("clean")
    return out.select(F.col("id").alias(id_col), *cols)


def _redact(text: pd.Series, spans: pd.Series) -> pd.Series:

    def one(t: str | None, s: str) -> str | None:
        if t is None or not s:
            return t
        out, at = [], 0
        for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in s.split(","))):
            if a >= at:
                out += [t[at:a], "" if kind == "term" else f"[{kind.upper()}]"]
            at = max(at, b)
        return "".join([*out, t[at:]])

    return pd.Series([one(t, s) for t, s in zip(text, spans, strict=True)], dtype="object")


def query(spark, sf_dir):
    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
