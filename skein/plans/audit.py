"""Queries over audit operators; their markdown is put together from table columns in the same way on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein import registry
from skein.functions import text as T
from skein.operators import audit as A
from skein.plans.common import table
from skein.plans.incremental import _CITED, cited
from skein.registry import query

_HREF = r"""l as (select page_id as page, trim(unnest(regexp_extract_all(html, 'href="([^"]*)"', 1))) as target from pages), t as (select page, target from l where target <> '')"""


def _links(spark, d):
    """The links of the given pages, written as markdown and read back; every third link has a space beside its target, and each page ends in an empty one."""
    href = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    text = F.concat(F.array_join(F.transform(href, lambda x, i: F.concat(F.lit("see [x]("), F.when(i % 3 == 0, " ").otherwise(""), x, F.lit(") and"))), "\n"), F.lit("\n[no]( )"))
    return table(spark, d, "pages").select(F.col("page_id").alias("page"), F.explode(T.links(text)).alias("target"))


def _urls(spark, d):
    return table(spark, d, "pages").select(F.col("url").alias("page"))


@query("page_links", f"with {_HREF} select page, target, count(*) as n from t group by all")
def page_links(spark, d):
    return _links(spark, d).groupBy("page", "target").agg(F.count("*").alias("n"))


@query("orphan_pages", f"with {_HREF} select url as page from pages where url not in (select target from t)")
def orphan_pages(spark, d):
    return A.orphans(_urls(spark, d), _links(spark, d), ["index", "toc"])


@query("broken_links", f"with {_HREF} select page, target from t where target not in (select url from pages)")
def broken_links(spark, d):
    return A.broken(_urls(spark, d), _links(spark, d))


@query("staleness", """with p as (select doc_id as page, 'd' || doc_id as path, n_chars as written from documents), r as (select 'd' || doc_id as path, sha256(quality::varchar) as hash from labels),
c as (select 'd' || doc_id as path, sha256(toxic::varchar) as hash, doc_id as modified from labels union all select 'd' || doc_id, 'x', doc_id * 50 from documents where lang = 'fr' and doc_id not in (select doc_id from labels)),
j as (select page, r.hash as was, c.hash as now, modified, written from p left join r using (path) left join c using (path))
select * from (select page, case when now is null then 'source-missing' when was is not null and was <> now then 'stale' when was is null and modified > written then 'stale' end as state from j) where state is not null""")
def staleness(spark, d):
    docs, marks = table(spark, d, "documents"), table(spark, d, "labels")
    path = F.concat(F.lit("d"), "doc_id").alias("path")
    now = marks.select(path, F.sha2(F.col("toxic").cast("string"), 256).alias("hash"), F.col("doc_id").alias("modified"))
    now = now.union(docs.where("lang = 'fr'").join(marks, "doc_id", "left_anti").select(path, F.lit("x"), F.col("doc_id") * 50))
    return A.staleness(docs.select(F.col("doc_id").alias("page"), path, F.col("n_chars").alias("written")), marks.select(path, F.sha2(F.col("quality").cast("string"), 256).alias("hash")), now)


_PARSED = r"""x as (select page, unnest(regexp_extract_all(text, '[a-z]+/[a-z0-9]+\.[a-z]+:[0-9]+(?:-[0-9]+)?')) as c from pages_),
cites as (select page, string_split(c, ':')[1] as path, string_split(string_split(c, ':')[2], '-')[1]::int as start, coalesce(string_split(string_split(c, ':')[2], '-')[2], string_split(string_split(c, ':')[2], '-')[1])::int as "end" from x)"""


def _cites(spark, d):
    return cited(spark, d).select("page", F.explode(T.citations(F.col("text"))).alias("c")).select("page", "c.*")


@query("citations", f'with {_CITED}, {_PARSED} select page, path, start, "end" from cites')
def citations(spark, d):
    return _cites(spark, d)


@query("citation_check", f"""with {_CITED}, {_PARSED}, f as (select 'src/m' || r_regionkey || '.rs' as path, 18 as lines from region union all select 'lib/k' || r_regionkey || '.py', 10 + r_regionkey from region),
r as (select 'src/m' || n_regionkey || '.rs' as path, n_nationkey as a, n_nationkey + 1 as b from nation),
j as (select distinct c.page, c.path, c.start, c."end", f.lines, exists (select 1 from r where r.path = c.path) as has, exists (select 1 from r where r.path = c.path and start <= b and "end" >= a) as hit from cites c left join f using (path))
select * from (select page, path, start, "end", case when lines is null then 'missing' when "end" > lines then 'out-of-range' when has and not hit then 'no-entity' end as reason from j) where reason is not null""")
def citation_check(spark, d):
    g = table(spark, d, "region")
    f = g.select(F.expr("'src/m' || r_regionkey || '.rs'").alias("path"), F.lit(18).alias("lines")).union(g.select(F.expr("'lib/k' || r_regionkey || '.py'"), F.col("r_regionkey") + 10))
    r = table(spark, d, "nation").select(F.expr("'src/m' || n_regionkey || '.rs'").alias("path"), F.col("n_nationkey").alias("a"), (F.col("n_nationkey") + 1).alias("b"))
    return A.check_citations(_cites(spark, d), f, r)


_BODY = "'# P' || p_partkey || chr(10) || '## Dependencies' || chr(10) || '- `serde` - x' || chr(10) || '- k' || p_size || '::io' || chr(10) || '```mermaid' || chr(10) || '- inside' || chr(10) || '```' || chr(10) || '## Use' || chr(10) || 'text {{ name }} ' || p_name || case when p_size % 2 = 0 then ' src/a.rs:' || p_size else '' end || chr(10) || '- no claim'"


def _pages(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("page"), F.expr(_BODY).alias("text"))


def _view(spark, d):
    return A.lines(_pages(spark, d))


_FENCED = "repeat('a' || chr(10), p_size % 5) || case when p_size % 3 = 0 then '  ```rust' || chr(10) || repeat('b' || chr(10), p_size % 4) || '```' || chr(10) else '' end || 'c' || chr(10) || '```' || chr(10) || repeat('d' || chr(10), p_partkey % 3) || case when p_partkey % 2 = 0 then '```' || chr(10) || 'e' else 'e' end"


@query("fence_ranges", f"""with x as (select p_partkey as page, string_split({_FENCED}, chr(10)) as ls from part), l as (select page, unnest(ls) as t, generate_subscripts(ls, 1) as line, len(ls) as n from x),
m as (select *, row_number() over (partition by page order by line) as k, lead(line) over (partition by page order by line) as next from l where starts_with(ltrim(t), '```'))
select page, line::int as start, coalesce(next, n)::int as "end" from m where k % 2 = 1""")
def fence_ranges(spark, d):
    x = A.lines(table(spark, d, "part").select(F.col("p_partkey").alias("page"), F.expr(_FENCED).alias("text")))
    return A.fence_ranges(x).select("page", F.col("start").cast("int"), F.col("end").cast("int"))


@query("template_residue", "select p_partkey as page, 9 as line, left('text {{ name }} ' || p_name || case when p_size % 2 = 0 then ' src/a.rs:' || p_size else '' end, 120) as snippet from part")
def template_residue(spark, d):
    return A.residue(_view(spark, d)).withColumn("line", F.col("line").cast("int"))


@query("dependency_claims", "select p_partkey as page, 'serde' as claim from part union all select p_partkey, 'k' || p_size || '::io' from part")
def dependency_claims(spark, d):
    return A.dependency_claims(_view(spark, d), ["Dependencies"])


@query("fabricated_dependencies", "select p_partkey as page, 'k' || p_size || '::io' as claim, 'unknown' as reason from part where p_size > 24")
def fabricated_dependencies(spark, d):
    allowed = table(spark, d, "nation").select(F.concat(F.lit("k"), "n_nationkey").alias("name")).union(spark.createDataFrame([("serde",)], "name string"))
    return A.fabricated(A.dependency_claims(_view(spark, d), ["Dependencies"]), allowed)


@query("citation_density", r"""with x as (select p_partkey as page, 'text {{ name }} ' || p_name || case when p_size % 2 = 0 then ' src/a.rs:' || p_size else '' end || '- no claim' as t, p_size from part)
select page, 'Use' as section, greatest(ceil((length(regexp_replace(t, '\s', '', 'g')) + 5)::double / 200) - case when p_size % 2 = 0 then 1 else 0 end, case when p_size % 2 = 0 then 0 else 1 end)::bigint as missing from x
where greatest(ceil((length(regexp_replace(t, '\s', '', 'g')) + 5)::double / 200) - case when p_size % 2 = 0 then 1 else 0 end, case when p_size % 2 = 0 then 0 else 1 end) > 0
union all select p_partkey, 'Dependencies', 1 from part""")
def citation_density(spark, d):
    return A.citation_density(_view(spark, d))


@query("diagram_blocks", "select p_partkey as page, 5 as start, '- inside' as body from part")
def diagram_blocks(spark, d):
    return A.blocks(_view(spark, d), "mermaid").withColumn("start", F.col("start").cast("int"))


@query("span_hash", "select doc_id, left(sha256(array_to_string(string_split(text, chr(10))[2:3], chr(10))), 8) as hash from documents")
def span_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", T.span_hash(F.col("text"), F.lit(2), F.lit(3)).alias("hash"))


@query("verified_tokens", """with s as (select 'f' || n_nationkey as path, n_name || chr(10) || 'b' || n_regionkey || chr(10) || 'c' as source from nation),
t as (select s_suppkey as page, 'f' || s_suppkey % 30 as path, s_suppkey % 4 + 1 as b, s_nationkey from supplier),
j as (select page, t.path, b, source, left(sha256(array_to_string(string_split(source, chr(10))[1:b], chr(10))), 8) as good, s_nationkey from t left join s using (path)),
k as (select page, '[[' || path || '#L-1-L-' || b || '@' || case when s_nationkey % 3 = 0 then coalesce(good, 'aaaaaaaa') when s_nationkey % 3 = 1 then '00000000' else 'zz' end || ']]' as token, case when s_nationkey % 3 = 2 then 'malformed' when source is null then 'missing' when b > 3 then 'out-of-range' when s_nationkey % 3 = 1 then 'hash' end as reason from j)
select * from k where reason is not null""")
def verified_tokens(spark, d):
    s = table(spark, d, "nation").select(F.expr("'f' || n_nationkey").alias("path"), F.expr("n_name || chr(10) || 'b' || n_regionkey || chr(10) || 'c'").alias("source"))
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("page"), F.expr("'f' || s_suppkey % 30").alias("path"), F.expr("cast(s_suppkey % 4 + 1 as int)").alias("b"), "s_nationkey").join(s, "path", "left")
    good = F.coalesce(T.span_hash(F.col("source"), F.lit(1), F.col("b")), F.lit("aaaaaaaa"))
    mark = F.when(F.col("s_nationkey") % 3 == 0, good).when(F.col("s_nationkey") % 3 == 1, F.lit("00000000")).otherwise(F.lit("zz"))
    return A.verified_tokens(t.select("page", F.concat(F.lit("see [["), "path", F.lit("#L-1-L-"), F.col("b").cast("string"), F.lit("@"), mark, F.lit("]]")).alias("text")), s)


@query("entity_coverage", """with c as (select p_partkey as page, case when p_size % 2 = 0 then p_brand else 'Supplier#' || p_size || '_' end as name from part), k as (select 'Brand#' || r_regionkey + 11 as name from region union select 'Supplier#' || n_nationkey || '_x' from nation)
select distinct page, name from c where name not in (select name from k) and not (name like '%\\_' escape '\\' and exists (select 1 from k where starts_with(k.name, c.name)))""")
def entity_coverage(spark, d):
    c = table(spark, d, "part").select(F.col("p_partkey").alias("page"), F.expr("case when p_size % 2 = 0 then p_brand else 'Supplier#' || p_size || '_' end").alias("name"))
    k = table(spark, d, "region").select(F.expr("'Brand#' || (r_regionkey + 11)").alias("name")).union(table(spark, d, "nation").select(F.expr("'Supplier#' || n_nationkey || '_x'")))
    return A.uncovered(c, k)


@query("signature_names", """select p_partkey, case when p_size % 3 = 0 then 'run' || p_size when p_size % 3 = 1 then 'Part' || p_partkey else null end as name from part""")
def signature_names(spark, d):
    sig = F.expr("case when p_size % 3 = 0 then 'pub async fn run' || p_size || '(x: i32) -> u8' when p_size % 3 = 1 then '#[derive(Debug)] pub(crate) struct Part' || p_partkey || '<T> where T: Copy' else 'impl Part for X' end")
    return table(spark, d, "part").select("p_partkey", T.signature_name(sig).alias("name"))


#: The checks of pages: kind, severity, and the query that finds the pages (its column `kind`, where it has one, names the kind).
_CHECKS = (
    ("orphan", "Warning", "orphan_pages"), ("broken-link", "Error", "broken_links"), ("stale", "Warning", "staleness"), ("bad-citation", "Error", "citation_check"), ("bad-context", "Error", "verified_tokens"),
    ("entity", "Error", "entity_ownership"), ("stale-entity", "Error", "stale_entities"), ("dependency-fabricated", "Error", "fabricated_dependencies"), ("bad-diagram", "Warning", "diagram_problems"), ("residue", "Error", "template_residue"),
)


def _counts():
    from skein.plans import ownership  # noqa: F401  registers

    for kind, severity, name in _CHECKS:
        own = "kind, severity" if name == "entity_ownership" else f"'{kind}' as kind, '{severity}' as severity"
        yield f"select {own}, page::varchar as page from ({registry._SQL[name]})"


@query("lint_union_histogram", f"select kind, severity, count(*) as n from ({' union all '.join(_counts())}) group by all")
def lint_union_histogram(spark, d):
    """All checks over their pages, counted by kind."""
    own = registry._QUERIES["entity_ownership"](spark, d).select("kind", "severity", F.col("page").cast("string").alias("page"))
    parts = [(kind, severity, registry._QUERIES[name](spark, d)) for kind, severity, name in _CHECKS if name != "entity_ownership"]
    return A.issues(*parts).unionByName(own).groupBy("kind", "severity").agg(F.count("*").alias("n"))
