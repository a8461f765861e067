"""Token counts by a unigram model: forward scores over a trie of the distinct pre-tokens.

The forward score of a prefix, the best sum of piece scores that spells it, is the same for every pre-token that begins with it. The distinct
pre-tokens that a worker meets for the first time are sorted and put into a trie, level by level: a node is a prefix and is worked out once, for all
pre-tokens below it at a time. A node inherits from the node above the places at which a piece may still be under way, each with its state in a trie of the pieces, and
drops those that its character ends. The node at a pre-token's end gives its count, which is kept by pre-token; a text's count is the sum over its pre-tokens.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import release, small_batches, table
from .bpe import _slices

VOCABULARY = "piece_bpe_32k.model"
#: The character that stands for the white space before a word in the vocabulary.
SPACE = "▁"
#: Characters at which only str.split() cuts.
_ODD = re.compile("[\x1c-\x1f]")
#: Pre-tokens whose counts a worker keeps, and the longest that enters the trie.
KEPT, LONGEST = 300_000, 64
#: Bytes of text that are read at a time.
SLICE = 2_000_000


def unigram_scores(path: str | None = None) -> tuple[dict[str, float], float]:
    """Log probability of each piece, and of one byte of a character that no piece holds.

    The vocabulary's file has ranks instead of probabilities; a piece of rank r gets the probability 1 / (r + 2) over their sum (Zipf's law). A byte
    counts as a piece after the last.
    """
    import public_tokenizers
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    normal = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]
    total = math.log(sum(1 / (r + 2) for r in range(len(normal))))
    return {p.id_to_piece(i): -math.log(r + 2) - total for r, i in enumerate(normal)}, -math.log(len(normal) + 2) - total


class Pieces:
    """A trie of the pieces as a sorted table of (state, character) pairs, for many steps at a time."""

    def __init__(self, scores: dict[str, float]):
        child: dict[int, int] = {}
        final = [-math.inf]
        for piece, score in scores.items():
            at = 0
            for c in piece:
                key = at << 21 | ord(c)  # code points have 21 bits
                at = child.get(key, 0)
                if not at:
                    at = child[key] = len(final)
                    final.append(-math.inf)
            final[at] = score
        keys = np.fromiter(child.keys(), dtype=np.int64, count=len(child))
        order = np.argsort(keys)
        self.final = np.array(final)
        #: Open addressing: a pair's place, or one of the few after it.
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.states = np.zeros(1 << self.bits, dtype=np.int32)
        left, states = keys[order], np.fromiter(child.values(), dtype=np.int32, count=len(child))[order]
        at = self._place(left)
        while len(left):
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = left[free]  # of several that want one place, one gets it
            own = self.keys[at] == left
            self.states[at[own]] = states[own]
            left, states, at = left[~own], states[~own], (at[~own] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The state after each character; 0 where no piece goes on."""
        keys = states.astype(np.int64) << 21 | chars
        at, out = self._place(keys), np.zeros(len(keys), dtype=np.int32)
        rows = np.arange(len(keys))
        while len(rows):
            there = self.keys[at]
            hit = there == keys
            out[rows[hit]] = self.states[at[hit]]
            on = ~hit & (there >= 0)
            rows, keys, at = rows[on], keys[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out


class Forward(dict):
    """Pre-token to its number of pieces in the best segmentation; of equal ones, that with the longest last piece counts."""

    def __init__(self, scores: dict[str, float], byte: float):
        self.scores, self.byte, self.most = scores, byte, max(map(len, scores), default=1)
        self.pieces = Pieces(scores)
        self.nodes = 0  # worked out so far

    def learn(self, words: set[str]) -> None:
        """Counts of words, which are not known yet."""
        new = sorted(w for w in words if len(w) <= LONGEST)
        for w in words:
            if len(w) > LONGEST:
                self[w] = self._alone(w)
        if new:
            self.update(zip(new, self._shared(new), strict=True))

    def forget(self) -> None:
        """Start anew once more words are kept than KEPT, or one that is too long to keep."""
        if len(self) > KEPT:
            self.clear()
        else:
            for w in [w for w in self if len(w) > LONGEST]:
                del self[w]

    def _shared(self, words: list[str]) -> list[int]:
        """Counts of sorted words; each prefix that some of them share is worked out once."""
        text = [SPACE + w for w in words]
        chars = np.frombuffer("".join(text).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        length = np.fromiter(map(len, text), dtype=np.int64, count=len(text))
        first = np.cumsum(length) - length
        out = np.zeros(len(text), dtype=np.int64)
        alive, node = np.arange(len(text)), np.zeros(len(text), dtype=np.int64)  # words not at their end, and the node of each
        best, count = np.zeros(1), np.zeros(1, dtype=np.int64)  # of the nodes of one level
        # places at which a piece may be under way: the node, the piece's state, and the score and count before the piece
        at, state, was, had = np.zeros(1, np.int64), np.zeros(1, np.int32), np.zeros(1), np.zeros(1, np.int64)
        depth = 0
        while len(alive):
            c = chars[first[alive] + depth]
            begins = np.ones(len(alive), dtype=bool)
            begins[1:] = (node[1:] != node[:-1]) | (c[1:] != c[:-1])
            up, by = node[begins], c[begins]  # of each new node: the node above and the character
            node = np.cumsum(begins) - 1
            # what the node above has under way goes on in each node below it, in the order of the places
            held = np.searchsorted(at, np.arange(len(best) + 1))
            lengths = (held[1:] - held[:-1])[up]
            ends = np.cumsum(lengths)
            of = np.arange(int(ends[-1])) + np.repeat(held[up] - (ends - lengths), lengths)
            at = np.repeat(np.arange(len(up)), lengths)
            state = self.pieces.step(state[of], by[at])
            on = state > 0
            at, state, was, had = at[on], state[on], was[of[on]], had[of[on]]
            n = 1 + (by > 0x7F) + (by > 0x7FF) + (by > 0xFFFF)  # bytes of the character
            best, count = best[up] + n * self.byte, count[up] + n
            score = was + self.pieces.final[state]
            top = best.copy()
            np.maximum.at(top, at, score)
            win = np.flatnonzero(score >= top[at])[::-1]  # the first place, that is the longest piece, is written last
            best = top
            count[at[win]] = had[win] + 1
            self.nodes += len(up)
            depth += 1
            done = length[alive] == depth
            out[alive[done]] = count[node[done]]
            alive, node = alive[~done], node[~done]
            # a piece may start after each node
            at, new = np.concatenate([at, np.arange(len(best))]), len(best)
            order = np.argsort(at, kind="stable")
            at, state = at[order], np.concatenate([state, np.zeros(new, np.int32)])[order]
            was, had = np.concatenate([was, best])[order], np.concatenate([had, count])[order]
        return out.tolist()

    def _alone(self, word: str) -> int:
        """The count of one long word, by the same steps without a trie of words."""
        text = SPACE + word
        best, pieces, get = [0.0], [0], self.scores.get
        for i in range(1, len(text) + 1):
            n = len(text[i - 1].encode())
            score, count = best[i - 1] + n * self.byte, pieces[i - 1] + n
            for a in range(i - 1, max(0, i - self.most) - 1, -1):
                s = get(text[a:i])
                if s is not None and best[a] + s >= score:
                    score, count = best[a] + s, pieces[a] + 1
            best.append(score)
            pieces.append(count)
        return pieces[-1]


@cache
def _forward(path: str | None) -> Forward:
    return Forward(*unigram_scores(path))


def _cut(text: str | None) -> list[str]:
    """The pre-tokens: what stands between bytes of white space."""
    if not text:
        return []
    return text.split() if text.isascii() and not _ODD.search(text) else [w.decode() for w in text.encode().split()]


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id_col, n_words, n_tokens) for every row: pre-tokens between white space, and pieces of their best segmentations.

    Null and empty texts count 0; null ids and repeated rows stay; a pre-token of any length is counted whole; an empty table gives an
    empty result; other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _forward(vocabulary)
        for b in _slices(batches, "text", SLICE):
            out = np.zeros((b.num_rows, 2), dtype=np.int64)
            rows = [_cut(text) for text in b["text"].to_pylist()]
            known.learn(set().union(*rows).difference(known))
            for i, words in enumerate(rows):
                out[i] = len(words), sum(map(known.__getitem__, words))
            known.forget()
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(out[:, 0]), pa.array(out[:, 1])], ["id", "n_words", "n_tokens"])
        release()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, n_words long, n_tokens long").withColumnRenamed("id", id_col)


def query(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))
