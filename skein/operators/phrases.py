"""Many phrases in many texts: automata over bounded blocks of phrases, handed out block by block."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases of a block at most on average, and their characters; an automaton takes some 100 bytes a character.
BLOCK, CHARACTERS = 50_000, 1_000_000


@cache
def _automaton(phrases: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for p in phrases:
        a.add_word(p, p)
    a.make_automaton()
    return a


def numbered(phrases: Iterable[tuple[str, int]]) -> ahocorasick.Automaton:
    """An automaton that tells of each match where it ends and its phrase's number."""
    a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for p, i in phrases:
        a.add_word(p, i)
    a.make_automaton()
    return a


def occurrences(automaton: ahocorasick.Automaton, text: str) -> dict[str, int]:
    """How often each phrase occurs without overlapping itself, from the left, in one pass over the text."""
    count: dict[str, int] = {}
    end: dict[str, int] = {}
    for last, p in automaton.iter(text):
        if last - len(p) >= end.get(p, -1):
            count[p] = count.get(p, 0) + 1
            end[p] = last
    return count


def phrase_hits(pages: DataFrame, phrases: DataFrame) -> DataFrame:
    """(page, keyword, n) of pages (page, text) that hold distinct phrases (keyword): occurrences without overlaps; empty phrases and null texts have none.

    Phrases are dealt into blocks of bounded size by hash; each block becomes one automaton, broadcast and used in one pass over the pages, so that no page meets a phrase that it doesn't hold.
    """
    spark = pages.sparkSession
    phrases = phrases.where("keyword <> ''").select("keyword").distinct()
    n, size = phrases.agg(F.count("*"), F.coalesce(F.sum(F.length("keyword")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK), -(-size // CHARACTERS))
    page = pages.schema["page"].dataType.simpleString()
    out = spark.createDataFrame([], f"page {page}, keyword string, n long")

    def scan(block: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(block.value)
            for b in batches:
                hits = [(i, p, k) for i, t in enumerate(b["text"].to_pylist()) if t for p, k in occurrences(automaton, t).items()]
                if hits:
                    yield pa.RecordBatch.from_arrays([b["page"].take(pa.array([h[0] for h in hits])), pa.array([h[1] for h in hits]), pa.array([h[2] for h in hits], pa.int64())], ["page", "keyword", "n"])
            _automaton.cache_clear()

        return run

    for i in range(blocks if n else 0):
        block = tuple(sorted(r[0] for r in phrases.where(F.pmod(F.xxhash64("keyword"), F.lit(blocks)) == i).collect()))
        if block:
            out = out.union(pages.select("page", "text").mapInArrow(scan(spark.sparkContext.broadcast(block)), f"page {page}, keyword string, n long"))
    return out
