"""Filtering pages by their URLs: listed rules first, then a tree of path templates for each host.

Digits in path segments are variable from the start. Level by level below each branch of a host's tree, segments become one wildcard where there are too many for their pages,
and else branches whose pages are blocked, allowed and unlisted in shares that don't differ significantly are merged. What rules say of the pages they fit labels the templates; a template whose smoothed share of
blocked pages reaches the threshold is rejected, and with it the pages that no rule fits. Trees are grown over distinct path shapes with their counts, level by level for all hosts at once, so no host is one task's work.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import drop_table, free, lookup, quoted, table, write_table

#: (host, path, verdict): a rule fits its host and all subdomains, and paths that begin with its own.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Levels of a tree; segments below don't tell templates apart.
DEPTH = 4
#: A branch with more children than MOST, or with at least FEW that have fewer than EACH pages on average, gets a wildcard for them.
MOST, FEW, EACH = 64, 8, 4
#: Squared deviates beyond which two shares differ (5 % level); pages that stand in each template beforehand, and how many of them blocked, so that one without listed pages is not rejected; purity from which one is.
DIFFER, PRIOR, BAD, PURITY = 3.84, 4.0, 1.0, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where the URL is null or has no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    part = lambda n: F.coalesce(F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", n), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, of equal ones the first; nulls where none does."""
    if len(rules) > 1000:
        raise ValueError("more than 1000 rules make too large an expression")
    none = F.lit(None).cast("string")
    fits = [((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)) for h, p, _ in rules]
    first = sorted(range(len(rules)), key=lambda i: -len(rules[i][0] + rules[i][1]))
    pick = lambda of: reduce(lambda rest, i: F.when(fits[i], F.lit(of(rules[i]))).otherwise(rest), reversed(first), none)
    return pick(lambda r: r[0] + r[1]), pick(lambda r: r[2])


def shape_of(path: Column, depth: int) -> Column:
    """The first segments of a path, without the slash at its end, with `#` for digits."""
    inner = F.regexp_replace(F.regexp_replace(F.substring(path, F.lit(2), F.length(path)), "/$", ""), "[0-9]+", "#")
    return F.array_join(F.slice(F.split(inner, "/"), 1, depth), "/")


def _apart(a: str) -> Column:
    """Squared deviate of the difference between this branch's share a / n and that of the one beside it."""
    p, n, q, m = F.col(a).cast("double"), F.col("n").cast("double"), F.lag(a).over(_beside()).cast("double"), F.lag("n").over(_beside()).cast("double")
    share = (p + q) / (n + m)
    return F.when((share > 0) & (share < 1), F.pow(p / n - q / m, 2.0) / (share * (1 - share) * (1 / n + 1 / m))).otherwise(0.0)


def _beside():
    return Window.partitionBy("host", "template").orderBy((F.col("bad") / F.col("n")), (F.col("good") / F.col("n")), "seg")


def templates(shapes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(host, shape, n, bad, good, template) of shapes (host, shape, n, bad, good): pages, and how many of them rules block and allow.

    A window holds the children of one branch, MOST at most.
    """
    now = shapes.withColumn("template", F.lit(""))
    for level in range(depth):
        now = write_table(now.withColumn("seg", F.coalesce(F.get(F.split("shape", "/"), F.lit(level)), F.lit("$"))), "url-shapes")
        children = write_table(now.groupBy("host", "template", "seg").agg(*(F.sum(c).alias(c) for c in ("n", "bad", "good"))), "url-branches")
        above = children.groupBy("host", "template").agg(F.count("*").alias("k"), F.sum("n").alias("total"))
        few = above.where(~((F.col("k") > MOST) | ((F.col("k") >= FEW) & (F.col("total") < EACH * F.col("k"))))).select("host", "template")
        kept = children.join(few, ["host", "template"], "left_semi")
        cut = (F.lag("n").over(_beside()).isNull() | (F.greatest(_apart("bad"), _apart("good")) > DIFFER)).cast("int")
        groups = kept.withColumn("cut", cut).withColumn("g", F.sum("cut").over(_beside())).groupBy("host", "template", "g").agg(F.sort_array(F.collect_list("seg")).alias("segs"))
        name = F.when(F.size("segs") == 1, F.col("segs")[0]).otherwise(F.concat(F.lit("{"), F.array_join("segs", "|"), F.lit("}")))
        names = groups.withColumn("name", name).select("host", "template", F.explode("segs").alias("seg"), "name")
        names = write_table(names.groupBy("host", "template").agg(F.map_from_entries(F.collect_list(F.struct("seg", "name"))).alias("names")), "url-names")
        named = lookup(now, names, ["host", "template"])
        after = write_table(named.withColumn("template", F.concat("template", F.lit("/"), F.coalesce(F.try_element_at("names", F.col("seg")), F.lit("*")))).drop("names", "seg"), "url-templates")
        drop_table(now, children, names)
        now = after
    return now


def judge(pages: DataFrame, *, url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, depth: int = DEPTH) -> DataFrame:
    """All columns of pages with host, path, rule, template, purity and verdict; of those names, pages' own columns come first and the new ones have underscores before.

    `purity` is the share of blocked pages among those of the template that rules fit, smoothed by PRIOR pages of which BAD are blocked; the verdict is the rule's, or else block
    where the template's purity reaches PURITY. Defined cases: null URLs and those without `://` have an empty host and path, and a template of their own; an empty path fits no rule
    that has one; repeated rows all count; an empty table gives an empty result; without any page that a rule fits all are allowed.
    """
    names = free(pages.columns, "host", "path", "rule", "template", "purity", "verdict")
    host, path, rule, template, purity, verdict = names
    h, p, r, v, s = free(pages.columns, "own_host", "own_path", "own_rule", "own_verdict", "own_shape")
    hosts = host_and_path(F.col(quoted(url_col)))
    rows = pages.withColumns({h: hosts[0], p: hosts[1]})
    found = rule_of(F.col(h), F.col(p), rules)
    rows = rows.withColumns({r: found[0], v: found[1], s: shape_of(F.col(p), depth)})
    count = lambda what: F.count(F.when(F.col(v) == what, 1))
    shapes = write_table(rows.groupBy(F.col(h).alias("host"), F.col(s).alias("shape")).agg(F.count("*").alias("n"), count("block").alias("bad"), count("allow").alias("good")), "url-shapes")
    grown = templates(shapes, depth)
    sums = grown.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    pure = lookup(grown.select("host", "shape", "template"), sums.select("host", "template", ((F.col("bad") + BAD) / (F.col("bad") + F.col("good") + PRIOR)).alias("purity")), ["host", "template"])
    pure = write_table(pure.select(F.col("host").alias(h), F.col("shape").alias(s), F.col("template").alias(template), F.col("purity").alias(purity)), "url-purity")
    drop_table(shapes, grown)
    out = lookup(rows, pure, [h, s])
    out = out.withColumn(verdict, F.coalesce(F.col(v), F.when(F.col(purity) >= PURITY, "block").otherwise("allow")))
    return out.select(*map(quoted, pages.columns), F.col(h).alias(host), F.col(p).alias(path), F.col(r).alias(rule), template, purity, verdict)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    """All levels one after the other."""
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    longest = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    case = lambda k: "case " + " ".join(f"when {fits(h, p)} then '{(h + p, v)[k]}'" for h, p, v in longest) + " end"
    beside = "over (partition by host, t order by bad / n, good / n, seg)"
    apart = lambda c: f"case when {c} + q{c} > 0 and {c} + q{c} < n + qn then pow({c} / n - q{c} / qn, 2) / ((({c} + q{c}) / (n + qn)) * (1 - ({c} + q{c}) / (n + qn)) * (1.0 / n + 1.0 / qn)) else 0 end"
    levels = []
    for i in range(DEPTH):
        levels.append(f"""s{i} as (select *, coalesce(string_split(shape, '/')[{i + 1}], '$') as seg from t{i}),
c{i} as (select host, t, seg, cast(sum(n) as bigint) as n, cast(sum(bad) as bigint) as bad, cast(sum(good) as bigint) as good from s{i} group by all),
f{i} as (select host, t from c{i} group by all having not (count(*) > {MOST} or (count(*) >= {FEW} and sum(n) < {EACH} * count(*)))),
l{i} as (select *, lag(n) {beside} as qn, lag(bad) {beside} as qbad, lag(good) {beside} as qgood from c{i} semi join f{i} using (host, t)),
g{i} as (select *, sum(case when qn is null or greatest({apart("bad")}, {apart("good")}) > {DIFFER} then 1 else 0 end) {beside} as g from l{i}),
m{i} as (select host, t, g, list(seg order by seg) as segs from g{i} group by all),
n{i} as (select host, t, unnest(segs) as seg, case when len(segs) = 1 then segs[1] else '{{' || array_to_string(segs, '|') || '}}' end as name from m{i}),
t{i + 1} as (select s.host, s.shape, s.n, s.bad, s.good, s.t || '/' || coalesce(name, '*') as t from s{i} s left join n{i} m on m.host = s.host and m.t = s.t and m.seg = s.seg)""")
    return f"""with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
h as (select page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') as host, coalesce(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2), '') as path from u),
r as (select *, {case(0)} as rule, {case(1)} as v, array_to_string(string_split(regexp_replace(regexp_replace(substr(path, 2), '/$', ''), '[0-9]+', '#', 'g'), '/')[:{DEPTH}], '/') as shape from h),
t0 as (select host, shape, count(*) as n, count(*) filter (v = 'block') as bad, count(*) filter (v = 'allow') as good, '' as t from r group by host, shape),
{", ".join(levels)},
p as (select host, t, (sum(bad) + {BAD}) / (sum(bad + good) + {PRIOR}) as purity from t{DEPTH} group by host, t)
select page_id, r.host, path, rule, coalesce(v, case when purity >= {PURITY} then 'block' else 'allow' end) as verdict
from r join t{DEPTH} x on x.host = r.host and x.shape = r.shape join p on p.host = x.host and p.t = x.t"""


ORACLE = _oracle()
