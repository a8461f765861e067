"""Chat formatting by quotation linking, with DataFrame operations only.

A line's quote level is the number of > signs before it. Lines of one level in a row are a passage. Passages and lines are hashed after
normalising case and white space and joined to the messages of the conversation that said them first; what a message quotes at level one is
what it replies to. Messages then follow the first message of their thread, without the quotes, in bounded parts of formatted text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import drop_table, table, write_table

_MARKS = r"^[ \t>]*>"  # without groups: Java matches a repeated group by recursion
_WROTE = r"(?i)^\s*on\b.{1,200}\bwrote:\s*$"


def _norm(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, "[ \\t\\n\\x0B\\f\\r]+", " ")))


def parse(messages: DataFrame, *, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, th, role, own, passages): own is the text without quotes and the lines that announce them; passages are (level, said, words), quoted or
    own (level 0), of whole passages and of their single lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    marks = F.transform(F.split(text, "\n", -1), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, _MARKS + "[ \\t]?", "").alias("line")))
    rows = messages.select(
        F.coalesce(F.col(conv_col).cast("string"), F.lit("\0")).alias("conv"), F.col(conv_col).alias("conv_id"), F.coalesce(F.col(turn_col).cast("long"), F.lit(2**63 - 1)).alias("turn"),
        F.xxhash64(F.col(role_col), text).alias("th"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), marks.alias("lines"),
    )
    announced = F.transform("lines", lambda x, i: F.struct(x["level"].alias("level"), x["line"].alias("line"), ((x["level"] == 0) & x["line"].rlike(_WROTE) & (F.coalesce(F.try_element_at("lines", i + 2)["level"], F.lit(0)) > 0)).alias("intro")))
    rows = rows.withColumn("lines", F.filter(announced, lambda x: ~x["intro"]))
    quoting = F.exists("lines", lambda x: x["level"] > 0)
    own = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    rows = rows.withColumn("quoting", quoting).withColumn("own", F.when(F.col("quoting"), F.btrim(F.regexp_replace(own, r"\n{3,}", "\n\n"), F.lit(" \t\r\n"))).otherwise(own))
    # passages: lines in a row of one level; a blank line ends one
    blank = lambda x: F.trim(x["line"]) == ""
    before = lambda i: F.get("lines", i - 1)
    begins = lambda x, i: (i == 0) | blank(x) | blank(before(i)) | (before(i)["level"] != x["level"])
    rows = rows.withColumn("starts", F.array_compact(F.transform("lines", lambda x, i: F.when(begins(x, i), i))))
    until = lambda j: F.coalesce(F.get("starts", j + 1), F.size("lines"))
    whole = F.transform("starts", lambda s, j: F.struct(F.get("lines", s)["level"].alias("level"), F.array_join(F.transform(F.slice("lines", s + 1, until(j) - s), lambda x: x["line"]), " ").alias("line")))
    single = F.transform("lines", lambda x: F.struct(x["level"].alias("level"), x["line"].alias("line")))
    # as strings, the level first, so that equal ones are found by hashing
    told = F.array_distinct(F.transform(F.concat(whole, single), lambda x: F.concat(F.lpad(x["level"].cast("string"), 9, "0"), _norm(x["line"]))))
    passages = F.transform(F.filter(told, lambda x: F.length(x) > 9), lambda x: F.struct(F.substr(x, F.lit(1), F.lit(9)).cast("int").alias("level"), F.substr(x, F.lit(10)).alias("said")))
    return rows.select("conv", "conv_id", "turn", "th", "role", "quoting", "own", passages.alias("passages"))


def link(messages: DataFrame) -> DataFrame:
    """(conv, turn, th, parent, links) of the parsed messages that quote: parent is the turn they reply to, links the number of passages and lines traced.

    A passage belongs to the first turn of its conversation that says it as its own words. The parent is said at level one,
    in the longest passage traced; ties go to the later turn.
    """
    quotes = messages.where("quoting").select("conv", "turn", "th", F.explode(F.filter("passages", lambda x: x["level"] > 0)).alias("p")).select("conv", "turn", "th", "p.level", F.md5("p.said").alias("said"), F.length("p.said").alias("size"))
    quotes = write_table(quotes, "quotes")
    convs = quotes.select("conv").distinct()
    own = messages.join(convs, "conv", "left_semi").select("conv", "turn", F.explode(F.filter("passages", lambda x: x["level"] == 0)).alias("p"))
    first = write_table(own.groupBy("conv", F.md5("p.said").alias("said")).agg(F.min("turn").alias("source")), "said")
    traced = quotes.join(first, ["conv", "said"]).where("source < turn")
    best = F.max(F.when(F.col("level") == 1, F.struct("size", "source")))["source"]
    return traced.groupBy("conv", "turn", "th").agg(best.alias("parent"), F.count("*").alias("links"))


def threads(links: DataFrame) -> DataFrame:
    """(conv, turn, root, depth): the first turn of each replying turn's thread, by pointer jumping: the way to it doubles in each round."""
    at = write_table(links.where("parent is not null").groupBy("conv", "turn").agg(F.max("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        up = at.select("conv", F.col("turn").alias("root"), F.col("root").alias("higher"), F.col("depth").alias("more"))
        new = write_table(at.join(up, ["conv", "root"], "left").select("conv", "turn", F.coalesce("higher", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved")), "threads")
        done = new.where("moved").isEmpty()
        drop_table(at)
        at = new
        if done:
            return at.drop("moved")


def reply_order(
    messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part: int = 512
) -> DataFrame:
    """(conv_col, part, n_messages, n_replies, n_links, chat): every conversation in reply order, as parts of at most `part` messages.

    A thread's first message comes in the order of turns, its replies follow in that order. chat has <|role|> and the message without
    quotes, on lines. Defined cases: null texts are empty messages; null roles read unknown; null turns come last; messages with a null conversation are one
    conversation; repeated rows stay, next to each other; an empty table gives an empty result; other columns are ignored.
    """
    parsed = write_table(parse(messages, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col), "messages")
    links = write_table(link(parsed), "links")
    roots = threads(links)
    rows = parsed.select("conv", "conv_id", "turn", "th", "role", "own").join(roots, ["conv", "turn"], "left").join(links.drop("parent").dropDuplicates(["conv", "turn", "th"]), ["conv", "turn", "th"], "left")
    rows = rows.withColumn("root", F.coalesce("root", "turn")).withColumn("depth", F.coalesce("depth", F.lit(0)))
    rows = write_table(rows.withColumns({"roots": F.shiftright("root", 8), "turns": F.shiftright("turn", 8), "hashes": F.shiftright("th", 52)}), "placed")
    drop_table(parsed, links, roots)
    # positions: sums over ranges of first turns, first turns, ranges of turns, turns and ranges of hashes, then rows; so messages without conversation and turn
    # fall into 4096 windows
    place, levels, tables = F.lit(0), ("roots", "root", "turns", "turn", "hashes"), [rows]
    ranked = rows
    for i, level in enumerate(levels):
        by = ["conv", *levels[:i]]
        before = F.sum("n").over(Window.partitionBy(*by).orderBy(level).rowsBetween(Window.unboundedPreceding, -1))
        sums = rows.groupBy(*by, level).agg(F.count("*").alias("n")).withColumn(f"before{i}", F.coalesce(before, F.lit(0))).drop("n")
        tables.append(write_table(sums, "places"))
        ranked = ranked.join(tables[-1], [*by, level])
        place = place + F.col(f"before{i}")
    inner = Window.partitionBy("conv", *levels).orderBy("turn", "th")
    ranked = ranked.withColumn("place", place + F.row_number().over(inner) - 1).withColumn("part", F.floor(F.col("place") / part))
    said = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("own"), F.lit("\n"))
    out = ranked.groupBy("conv", "conv_id", "part").agg(
        F.count("*").alias("n_messages"), F.sum((F.col("depth") > 0).cast("long")).alias("n_replies"), F.sum(F.coalesce("links", F.lit(0))).alias("n_links"), F.sort_array(F.collect_list(F.struct("place", said.alias("said")))).alias("all")
    )
    out = out.select(F.col("conv_id").alias(conv_col), "part", "n_messages", "n_replies", "n_links", F.array_join(F.col("all.said"), "").alias("chat"))
    out = write_table(out, "chats")
    drop_table(*tables)
    return out


#: A passage is a run of lines of one level; it belongs to the first turn that says it at level 0, and the longest traced at level 1 gives the parent.
ORACLE = r"""
with recursive m as (select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations),
l as (select conv_id, turn, generate_subscripts(string_split(text, chr(10)), 1) as pos, unnest(string_split(text, chr(10))) as raw from m),
k as (select conv_id, turn, pos, len(regexp_replace(regexp_extract(raw, '^[ \t>]*>'), '[^>]', '', 'g')) as level, regexp_replace(raw, '^[ \t>]*>[ \t]?', '') as line from l),
i as (select *, lead(level) over (partition by conv_id, turn order by pos) as below from k),
n as (select conv_id, turn, pos, level, line, trim(line) = '' as blank from i where not (level = 0 and coalesce(below, 0) > 0 and regexp_matches(line, '(?i)^\s*on\b.{1,200}\bwrote:\s*$'))),
b as (select *, blank or coalesce(lag(blank) over w or lag(level) over w <> level, true) as begins from n window w as (partition by conv_id, turn order by pos)),
c as (select *, sum(begins::int) over (partition by conv_id, turn order by pos) as passage from b),
p as (select conv_id, turn, min(level) as level, string_agg(line, ' ' order by pos) as line from c group by conv_id, turn, passage union all select conv_id, turn, level, line from n),
s as (select distinct conv_id, turn, level, lower(trim(regexp_replace(line, '[ \t\n\x0B\f\r]+', ' ', 'g'))) as said from p),
f as (select conv_id, said, min(turn) as source from s where level = 0 and said <> '' group by all),
t as (select s.*, f.source from s join f using (conv_id, said) where s.level > 0 and f.source < s.turn),
r as (select conv_id, turn, arg_max(source, (len(said), source)) filter (level = 1) as parent, count(*) as links from t group by all),
up(conv_id, turn, root, depth) as (select conv_id, turn, parent, 1 from r where parent is not null union all select up.conv_id, up.turn, r.parent, depth + 1 from up join r on up.conv_id = r.conv_id and up.root = r.turn where r.parent is not null),
top as (select conv_id, turn, arg_max(root, depth) as root from up group by all),
q as (select conv_id, turn, bool_or(level > 0) as quoting, coalesce(string_agg(line, chr(10) order by pos) filter (level = 0), '') as own from n group by all),
o as (select conv_id, turn, case when quoting then trim(regexp_replace(own, '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(13) || chr(10)) else own end as own from q),
a as (select m.conv_id, m.role, coalesce(o.own, '') as own, top.root is not null as reply, coalesce(r.links, 0) as links,
        row_number() over (partition by m.conv_id order by coalesce(top.root, m.turn), m.turn) - 1 as place
      from m left join o using (conv_id, turn) left join r using (conv_id, turn) left join top using (conv_id, turn))
select conv_id, (place // 512)::bigint as part, count(*) as n_messages, sum(reply::int)::bigint as n_replies, sum(links)::bigint as n_links,
  sha256(string_agg('<|' || role || '|>' || chr(10) || own || chr(10), '' order by place)) as chat_sha256
from a group by conv_id, place // 512
"""


def query(spark, sf_dir):
    return reply_order(table(spark, sf_dir, "conversations")).withColumn("chat", F.sha2("chat", 256)).withColumnRenamed("chat", "chat_sha256")
