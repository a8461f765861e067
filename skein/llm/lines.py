"""Line dedup by a suffix array over sequences of line ids, with DataFrame operations only.

Lines become ids. A line that occurs once can be in no repeated run, so it ends the sequences on both sides of it; what is left
are segments of lines that occur again somewhere. Prefix doubling sorts the suffixes of all segments: the rank of a suffix by its first
2^(k+1) lines follows from its rank by 2^k lines and that of the suffix 2^k lines on. A round counts the pairs of
ranks before the shuffle and turns the counts into new ranks by sums in two levels, inside a range of second ranks and over ranges, so that a line
that most documents hold is no single task's work.

Suffixes that share their first m lines are an interval of the suffix array, the one whose longest common prefix is at least m. It is named by
two ranks of known length, of the first 2^k lines and of the 2^k lines that end the m. A suffix is a later copy
if its interval has an earlier member, for the fewest lines that hold `min_words` words and for every longer run that no later start of the document covers; so copies
of maximal runs go to their last line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import WORD, drop_table, free, quoted, table, write_table

_DOC = ("d", "th")
#: Second ranks of one range.
_RANGE_BITS = 12
#: Bits of the filter that tells documents that may lose lines from the rest: so many for each of them, as a power of two, and at most. Beyond that more texts
#: than need to are joined, at most each once.
BITS, MOST_BITS = 8, 1 << 26
_SEGMENT_BITS = 16


def _numbered(pairs: DataFrame) -> DataFrame:
    """(r, r2, new) of (r, r2, c): new is r plus the rows of r whose r2 is smaller; r itself counts the rows before r."""
    p = pairs.withColumn("range", F.shiftright("r2", _RANGE_BITS))
    inside = Window.partitionBy("r", "range").orderBy("r2").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("r").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = p.groupBy("r", "range").agg(F.sum("c").alias("n")).select("r", "range", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    p = p.withColumn("own", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(ranges, ["r", "range"])
    return p.select("r", "r2", (F.col("r") + F.col("before") + F.col("own")).alias("new"))


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, maximal: bool = True) -> DataFrame:
    """(d, th, pos, words): the lines to delete; d is the id (the largest long for null), th the hash of the text, pos from 0.

    With `maximal`, runs are followed to their last common line; else each start only to the fewest lines that hold min_words words.

    Documents come in the order of id and text hash, and lines in the order of their position.
    """
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    line = F.transform(
        F.split(text, "\n", -1),
        lambda x, i: F.struct(i.alias("pos"), F.xxhash64(F.trim(x)).alias("h1"), F.xxhash64(F.lit(7), F.trim(x)).alias("h2"), F.regexp_count(x, F.lit(WORD)).alias("words")),
    )
    lines = docs.select(F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(2**63 - 1)).alias("d"), F.xxhash64(text).alias("th"), F.posexplode(F.filter(line, lambda x: x["words"] > 0)).alias("i", "x"))
    lines = write_table(lines.select("d", "th", "i", "x.*"), "lines")
    often = write_table(lines.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1"), "often")
    # first ranks: lines in the order of their hashes, so ranges of the hash are even
    o = often.withColumn("range", F.shiftright("h1", 64 - _RANGE_BITS))
    inside = Window.partitionBy("range").orderBy("h1", "h2").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = o.groupBy("range").agg(F.sum("c").alias("n")).select("range", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    ranks = o.withColumn("own", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(ranges, "range")
    ranks = write_table(ranks.select("h1", "h2", (F.col("before") + F.col("own") + 1).alias("r")), "first-ranks")  # 0 ends a segment
    at = lines.join(ranks, ["h1", "h2"]).select(*_DOC, "i", "pos", "words", "r").dropDuplicates([*_DOC, "i"])
    seg = Window.partitionBy(*_DOC).orderBy("i")
    at = at.withColumn("seg", F.col("i") - F.row_number().over(seg))
    own = Window.partitionBy(*_DOC, "seg")
    so_far = own.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("w", F.coalesce(F.sum("words").over(so_far), F.lit(0))).withColumn("all", F.sum("words").over(own))
    # m: the lines that start before min_words words have gone by
    reach = own.orderBy("w").rangeBetween(0, min_words - 1)
    at = at.withColumn("m", F.when(F.col("all") - F.col("w") >= min_words, F.count("*").over(reach)))
    lengths = ["m"]
    if maximal:  # most: the lines up to the last end for which no later start holds min_words words; every longer run is covered by those of later starts
        left = F.max("i").over(own) - F.col("i") + 1
        at = at.withColumn("most", F.when(F.col("m").isNotNull(), F.greatest("m", F.coalesce(F.lead("m").over(own.orderBy("i")), left))))
        lengths.append("most")
    at = write_table(at.withColumn("rank0", F.col("r")).select(*_DOC, "seg", "i", "pos", "words", *lengths, "r", "rank0"), "suffixes")
    drop_table(lines, often, ranks)
    longest = at.agg(F.max(lengths[-1])).first()[0] or 0
    level = 0
    while 2 ** (level + 1) <= longest:
        ahead = Window.partitionBy(*_DOC, "seg").orderBy("i")
        paired = write_table(at.withColumn("r2", F.coalesce(F.lead("r", 2**level).over(ahead), F.lit(0))), "paired")
        new = write_table(_numbered(paired.groupBy("r", "r2").agg(F.count("*").alias("c"))), "ranks")
        level += 1
        joined = paired.join(new, ["r", "r2"]).drop("r", "r2").withColumnRenamed("new", "r").withColumn(f"rank{level}", F.col("r"))
        joined = write_table(joined, "suffixes")
        drop_table(at, paired, new)
        at = joined
    # the interval of a suffix for m of its lines: k is the largest level with 2^k <= m
    k = F.floor(F.log2(F.col("m") + F.lit(0.5))).cast("int")
    of_level = F.element_at(F.array(*[F.col(f"rank{j}") for j in range(level + 1)]), F.col("k") + 1)
    starts = at.where("m is not null")
    if maximal:
        starts = starts.withColumn("m", F.explode(F.sequence("m", "most")))
    starts = starts.withColumn("k", k)
    heads = starts.select(*_DOC, "seg", "i", "m", "k", of_level.alias("a"), (F.col("i") + F.col("m") - F.pow(F.lit(2), "k").cast("int")).alias("j"))
    tails = at.select(*_DOC, F.col("i").alias("j"), F.posexplode(F.array(*[F.col(f"rank{n}") for n in range(level + 1)])).alias("k", "b"))
    runs = write_table(heads.join(tails, [*_DOC, "j", "k"]).select(*_DOC, "i", "m", "a", "b"), "runs")
    first = runs.groupBy("m", "a", "b").agg(F.min(F.struct(*_DOC, "i")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = write_table(first, "intervals")
    copies = runs.join(first, ["m", "a", "b"]).where(F.struct(*_DOC, "i") > F.col("first")).select(*_DOC, "i", "m")
    if maximal:
        copies = copies.groupBy(*_DOC, "i").agg(F.max("m").alias("m"))
    marked = at.select(*_DOC, "i", "pos", "words").join(copies, [*_DOC, "i"], "left")
    upto = Window.partitionBy(*_DOC).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumn("end", F.max(F.col("i") + F.col("m")).over(upto)).where("end > i")
    gone = write_table(marked.select(*_DOC, "pos", "words"), "gone")
    drop_table(at, runs, first)
    return gone


def _held(isles: DataFrame) -> DataFrame:
    """(segment, bits): of a bit table by text hash, which hold that of a document that loses lines; (segment, bits) of a row are found by _place.

    The table has BITS bits or more for each such document, MOST_BITS (8 MB) at most. Other documents need no join, and their texts stay where they are.
    """
    size = min(MOST_BITS, max(1 << _SEGMENT_BITS, 1 << (BITS * isles.count()).bit_length()))
    segment, word, bit = _place(F.col("th"), size)
    words = isles.groupBy(segment.alias("segment"), word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    every = isles.sparkSession.range(size >> 6).select(F.shiftright("id", _SEGMENT_BITS - 6).alias("segment"), (F.col("id") % (1 << _SEGMENT_BITS - 6)).alias("word")).join(words, ["segment", "word"], "left")
    every = every.groupBy("segment").agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("all"))
    held = write_table(every.select("segment", F.col("all.bits").alias("bits")), "held")
    held._size = size
    return held


def _place(th: Column, size: int) -> tuple[Column, Column, Column]:
    """Segment, word within the segment and bit of a hash in a table of `size` bits."""
    at = F.pmod(th, F.lit(size))
    return F.shiftright(at, _SEGMENT_BITS), F.shiftright(at % (1 << _SEGMENT_BITS), 6), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, maximal: bool = True) -> DataFrame:
    """docs with its text less the later copies of repeated line runs, and (n_lines, n_removed, words_removed) for every row.

    A run is a sequence of lines of at least min_words words that occurs more than once, in one document or several; its later copies go whole. Without
    `maximal` only the fewest lines from a start that hold min_words words make a run, which can leave the end of a longer one. Lines are equal if they are
    after trimming spaces, and lines without words are neither compared nor deleted. The first copy, by id and position, stays.
    Defined cases: null texts stay null, empty ones empty; rows that repeat an id and its text are one document and come out equal; null ids sort last; an
    empty table gives an empty result; other columns stay as they are, whatever their names: an added column whose name the table has gets underscores before it.
    """
    out, names = _deduplicated(docs, id_col, text_col, min_words, maximal)
    return out.select(*(quoted(c) for c in docs.columns), *names)


def _deduplicated(docs: DataFrame, id_col: str, text_col: str, min_words: int, maximal: bool) -> tuple[DataFrame, list[str]]:
    """docs with its clean text and three columns more, and their names."""
    gone = repeated_lines(docs, id_col=id_col, text_col=text_col, min_words=min_words, maximal=maximal)
    isle = Window.partitionBy(*_DOC).orderBy("pos")
    isles = gone.withColumn("isle", F.col("pos") - F.row_number().over(isle)).groupBy(*_DOC, "isle").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.sum("words").alias("w"))
    isles = isles.groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("isles"), F.sum("w").alias("words"))
    isles = write_table(isles, "isles")
    drop_table(gone)
    names = free(docs.columns, "n_lines", "n_removed", "words_removed")
    own = free([*docs.columns, *names], "id", "hash", "segment", "bits", "d", "th", "isles", "words")
    id_, hash_, segment, bits, d, th, where, words = own
    text = F.col(quoted(text_col))
    key = docs.withColumns({id_: F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(2**63 - 1)), hash_: F.xxhash64(F.coalesce(text, F.lit("")))})
    held = _held(isles)
    in_segment, word, bit = _place(F.col(hash_), held._size)
    key = key.join(F.broadcast(held.withColumnsRenamed({"segment": segment, "bits": bits})), in_segment == F.col(segment))  # MOST_BITS at most
    may = F.element_at(bits, (word + 1).cast("int")).bitwiseAND(bit) != 0
    isles = isles.withColumnsRenamed({"d": d, "th": th, "isles": where, "words": words})
    touched = key.where(may).drop(bits).join(isles, (F.col(id_) == F.col(d)) & (F.col(hash_) == F.col(th)), "left")
    none = {f.name: F.lit(None).cast(f.dataType) for f in isles.schema}
    out = touched.unionByName(key.where(~may).drop(bits).withColumns(none))
    lines = F.split(text, "\n", -1)
    begin = F.concat(F.array(F.lit(0)), F.transform(where, lambda x: x["b"] + 1))
    end = F.concat(F.transform(where, lambda x: x["a"]), F.array(F.size(lines)))
    kept = F.flatten(F.transform(F.arrays_zip(begin.alias("a"), end.alias("b")), lambda x: F.slice(lines, x["a"] + 1, x["b"] - x["a"])))
    clean = F.when(F.col(where).isNull(), text).otherwise(F.array_join(kept, "\n"))
    removed = F.coalesce(F.aggregate(where, F.lit(0), lambda s, x: s + x["b"] - x["a"] + 1), F.lit(0))
    n_lines = F.when(text.isNull(), 0).otherwise(F.coalesce(F.size(lines), F.lit(0)))
    cols = [clean.alias(c) if c == text_col else F.col(quoted(c)) for c in docs.columns]
    return out.select(*cols, n_lines.cast("long").alias(names[0]), removed.cast("long").alias(names[1]), F.coalesce(words, F.lit(0)).cast("long").alias(names[2])), names


def without_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """docs with clean texts and the length of those that lost lines in size_col; a document of which nothing is left goes, its text stands elsewhere."""
    out, (_, removed, _) = _deduplicated(docs, id_col, text_col, 50, True)
    out = out.where((F.col(removed) == 0) | F.col(quoted(text_col)).rlike(WORD))
    size = {size_col: F.when(F.col(removed) > 0, F.length(quoted(text_col)).cast("long")).otherwise(F.col(quoted(size_col)))} if size_col else {}
    return out.withColumns(size).select(*map(quoted, docs.columns))


#: Lines of two places are equal along a diagonal; a stretch of one with 50 words or more is a common run, of which the later copy goes.
ORACLE = r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents),
w as (select doc_id, trim(line) as line, pos, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words from l),
n as (select *, row_number() over (partition by doc_id order by pos) as i from w where words > 0),
e as (select a.doc_id, a.pos, a.i, a.words, b.doc_id as other, a.i - b.i as shift from n a join n b on a.line = b.line and (b.doc_id, b.i) < (a.doc_id, a.i)),
h as (select *, i - row_number() over (partition by doc_id, other, shift order by i) as isle from e),
r as (select *, sum(words) over (partition by doc_id, other, shift, isle) as run from h),
g as (select distinct doc_id, pos, words from r where run >= 50),
k as (select l.doc_id, string_agg(l.line, chr(10) order by l.pos) as text from l left join g on l.doc_id = g.doc_id and l.pos = g.pos where g.pos is null group by l.doc_id),
t as (select doc_id, count(*) as n_removed, sum(words) as words_removed from g group by doc_id)
select d.doc_id, len(string_split(d.text, chr(10)))::bigint as n_lines, coalesce(t.n_removed, 0)::bigint as n_removed,
  coalesce(t.words_removed, 0)::bigint as words_removed, sha256(coalesce(k.text, '')) as text_sha256
from documents d left join k on d.doc_id = k.doc_id left join t on d.doc_id = t.doc_id
"""


def query(spark, sf_dir):
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "words_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
