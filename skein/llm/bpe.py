"""Byte-level BPE encoding and decoding over Arrow batches.

A text is cut by the tokenizer's pattern; each match is mapped to byte characters and merged on its own by the
tokenizers library. Matches repeat, so each worker keeps a bounded table of matches it has encoded. Decoding goes back
through the byte table: tokens may hold parts of a character, so bytes are joined first and only then read as UTF-8.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import release, small_batches, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: White space as the vocabulary's own pattern knows it; Python's \s has four more control characters.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Matches and chunks kept in a worker's table (about 40 MB), the longest that is kept, and the bytes of text that are read at a time.
KEPT, LONGEST, SLICE = 200_000, 48, 1_000_000
#: Matches that are merged in one call, whose result holds their tokens as strings too.
MERGED = 16_384


def _path(vocabulary: str | None) -> str:
    import public_tokenizers

    return vocabulary or public_tokenizers.path(VOCABULARY)


@cache
def byte_characters() -> dict[str, int]:
    """The character that stands for each byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def _patterns():
    """A function that gives a text's matches, and one that tells whether a space stands beside white space or a NUL is there."""
    import public_tokenizers
    import regex

    p = public_tokenizers.PATTERN
    p = p.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s+", f"[{_SPACE}]+")
    return regex.compile(p).findall, re.compile(f" [{_SPACE}]|[{_SPACE}] |\0").search


def _from_ranks(path: str):
    """A tokenizer of a file of ranks: a token's merge joins the two parts that merges of lower ranks make of its bytes."""
    import base64

    from tokenizers import Tokenizer, models

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    chars = {b: c for c, b in byte_characters().items()}
    named = {t: "".join([chars[b] for b in t]) for t in ranks}
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            pairs = [ranks.get(a + b, rank) for a, b in zip(parts, parts[1:], strict=False)]
            at = pairs.index(min(pairs))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            merges.append((named[parts[0]], named[parts[1]]))
    return Tokenizer(models.BPE(vocab={named[t]: r for t, r in ranks.items()}, merges=merges))


class Coder:
    """Encodes and decodes with one vocabulary file, of ranks (.tiktoken) or of the tokenizers library (.json)."""

    def __init__(self, vocabulary: str | None = None):
        from tokenizers import Tokenizer

        path = _path(vocabulary)
        t = _from_ranks(path) if path.endswith(".tiktoken") else Tokenizer.from_file(path)
        self.merge = Tokenizer(t.model)  # words come already cut and mapped to byte characters
        self.known: dict[str, bytes] = {}  # ids of matches and of chunks; a match is a chunk of its own
        self.again: set[str] = set()  # those of them that a later slice has met
        back = byte_characters()
        self.chars = {b: c for c, b in back.items()}
        special = {k for k, v in t.get_added_tokens_decoder().items() if v.special}
        tokens = [b""] * t.get_vocab_size()
        for token, i in t.get_vocab().items():
            tokens[i] = token.encode() if i in special else bytes(back[c] for c in token)
        self.length = np.array([len(b) for b in tokens], dtype=np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        #: Characters that begin in a token: its bytes that do not continue a character.
        self.begun = np.array([sum(c & 0xC0 != 0x80 for c in b) for b in tokens], dtype=np.int64)
        self.inside = np.array([bool(b) and b[0] & 0xC0 == 0x80 for b in tokens])

    def _learn(self, new: list[str]) -> None:
        """Ids of matches, each merged on its own."""
        for start in range(0, len(new), MERGED):
            some = new[start : start + MERGED]
            chars = self.chars
            bytes_of = [p.encode() for p in some]
            words = ["".join([chars[b] for b in x]) for x in bytes_of]
            ids = np.array(self.merge.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype="<u4")
            raw = ids.tobytes()
            # a word ends at the token at which as many bytes have gone by
            ends = ((np.searchsorted(np.cumsum(self.length[ids]), np.cumsum([len(x) for x in bytes_of])) + 1) * 4).tolist()
            at = 0
            for p, end in zip(some, ends, strict=True):
                self.known[p] = raw[at:end]
                at = end

    def _forget(self, met: dict[str, None]) -> None:
        """Beyond KEPT, strings stay that were met again; where these are too many, those of the last slice."""
        if len(self.known) > KEPT:
            stay = self.again if len(self.again) <= KEPT // 2 else self.again & met.keys()
            self.known = {c: self.known[c] for c in stay if c in self.known} if len(stay) <= KEPT // 2 else {}
            self.again = set()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null as the empty text.

        Where each space stands between characters that are not white space, the pattern has a match end before it,
        so a text falls into chunks at its spaces; other texts are one chunk.
        """
        cut, odd = _patterns()
        split = []
        for text in texts:
            text = text or ""
            split.append([text] if odd(text) else text.replace(" ", "\0 ").split("\0"))
        known, met = self.known, dict.fromkeys(x for row in split for x in row)
        self.again |= met.keys() & known.keys()
        new = [c for c in met if c not in known]
        parts = [cut(c) for c in new]
        self._learn([p for p in dict.fromkeys(x for row in parts for x in row) if p not in known])
        for c, row in zip(new, parts, strict=True):
            if len(row) != 1:
                known[c] = b"".join([known[p] for p in row])
        out = [b"".join([known[c] for c in row]) for row in split]
        for c, row in zip(new, parts, strict=True):
            if len(c) > LONGEST:
                for p in (c, *row):
                    if len(p) > LONGEST:
                        known.pop(p, None)
        self._forget(met)
        return out

    def decode(self, many: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids."""
        if not many:
            return []
        ids = np.frombuffer(b"".join(many), dtype="<u4").astype(np.int64)
        size = self.length[ids]
        ends = np.cumsum(size)
        index = np.repeat(self.first[ids] - (ends - size), size)
        index += np.arange(len(index))
        raw = self.flat[index].tobytes()
        at = np.concatenate([[0], ends])[np.cumsum([0, *(len(x) // 4 for x in many)])].tolist()
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def offsets(self, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one code point of each token; a token that starts inside a character counts from that character."""
        at = np.frombuffer(ids, dtype="<u4")
        end = np.cumsum(self.begun[at])
        start = end - self.begun[at] - self.inside[at]
        return start, end


@cache
def _coder(vocabulary: str | None) -> Coder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Coder(vocabulary)


def _slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches of about `most` bytes of the column, so that memory does not follow the length of the texts."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy()
        cut = np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(size)], strict=True):
            yield batch.slice(a, b - a)


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, offsets: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids_le binary[, starts, ends]) for every row.

    Null and empty texts have no ids; special tokens' strings are ordinary text; null ids and repeated rows stay as they
    are; other columns are ignored. starts and ends are offsets in code points.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, n_tokens long, ids_le binary" + (", starts array<long>, ends array<long>" if offsets else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary)
        for b in _slices(batches, "text"):
            ids = coder.encode(b["text"].to_pylist())
            cols = [b["id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            names = ["id", "n_tokens", "ids_le"]
            if offsets:
                spans = [coder.offsets(x) for x in ids]
                cols += [pa.array([s[k] for s in spans], pa.list_(pa.int64())) for k in (0, 1)]
                names += ["starts", "ends"]
            yield pa.RecordBatch.from_arrays(cols, names)
        release()

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids_le", vocabulary: str | None = None) -> DataFrame:
    """(id_col, decoded binary, text) for every row of ids; text reads the bytes as UTF-8, with U+FFFD where a cut left part of a character."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary)
        for b in _slices(batches, "ids"):
            raw = coder.decode([x or b"" for x in b["ids"].to_pylist()])
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw])], ["id", "decoded", "text"])

    small_batches(encoded.sparkSession)
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {id_type}, decoded binary, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id_col, n_tokens, ids_le, decoded) in one pass: what encode gives, decoded again."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary)
        for b in _slices(batches, "text"):
            ids = coder.encode(b["text"].to_pylist())
            cols = [b["id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(coder.decode(ids), pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_tokens", "ids_le", "decoded"])
        release()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, n_tokens long, ids_le binary, decoded binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of round_trip."""
    return round_trip(docs, **options).select(options.get("id_col", "doc_id"), "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))
