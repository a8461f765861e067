"""Queries over claims, listed entities and sources; pages are put together from table columns, and the SQL states names and citations by those columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import audit as A
from skein.operators import ownership as O
from skein.plans.common import table
from skein.registry import query


def _api(spark, d):
    """The reference page in sheets: a heading for each nation, the parts as entities below it. A module's lines are 100,000 apart, so a sheet holds as many keys at most, or a part would fall below another module's heading."""
    p = table(spark, d, "part")
    sheets = p.selectExpr("p_partkey div 100000 as sheet").union(spark.range(1)).distinct()
    page = "'api ' || sheet as page"
    h = table(spark, d, "nation").crossJoin(F.broadcast(sheets)).selectExpr(page, "(n_nationkey + sheet) * 100000 - 1 as line", "'## src::m' || n_nationkey as text", "false as fenced")
    e = p.selectExpr("p_partkey div 100000 as sheet", "*").selectExpr(page, "p_partkey % 25 * 100000 + p_partkey as line", "'- `pub fn fn_' || p_partkey % 997 || '(x: u8)` (fn) — src/m' || p_partkey % 25 || '.rs:' || (p_size + 1) as text", "false as fenced")
    return h.union(e)


def _entries(spark, d):
    """What the reference page lists; lines count through its sheets."""
    return O.api_entries(_api(spark, d)).withColumn("page", F.lit("api"))


_API = "api as (select p_partkey % 25 * 100000 + p_partkey as line, 'src::m' || p_partkey % 25 as module, 'fn_' || p_partkey % 997 as name, p_size + 1 as spot from part), own as (select name, arg_max(module, line) as owner from api group by name), mods as (select 'src::m' || n_nationkey as module from nation)"

_LINE = """case c_custkey % 8 when 0 then '- `fn_' || c_custkey % 1500 || '` does' when 1 then '- `fn_' || c_custkey % 997 || '` see src/x.rs:' || (c_custkey % 60 + 1) when 2 then '- `src::m3`'
when 3 then case when c_nationkey % 2 = 0 then '- `src/m' || c_custkey % 25 || '.rs`' else 'plain' end when 4 then '- `fn_` series' when 5 then '  - `zz_` series' when 6 then 'see src/m1.rs:' || (c_custkey % 60 + 1) || '-' || (c_custkey % 60 + 3) else '- `p' || c_custkey % 50 || '`' end"""


def _view(spark, d):
    """The pages of modules: customers as their lines, a section on usage from line 1001 to 1199."""
    page = "'src_m' || n_nationkey as page"
    n = table(spark, d, "nation")
    heads = n.selectExpr(page, "1001L as line", "'## Usage notes' as text", "false as fenced").union(n.selectExpr(page, "1200L", "'## More'", "false"))
    lines = table(spark, d, "customer").selectExpr("'src_m' || c_nationkey as page", "case when c_custkey + 10 in (1001, 1200) then c_custkey + 1000000 else c_custkey + 10 end as line", f"{_LINE} as text", "false as fenced")
    return lines.union(heads)


_CLAIMS = """al as (select *, 'src_m' || c_nationkey as page, case when c_custkey + 10 in (1001, 1200) then c_custkey + 1000000 else c_custkey + 10 end as line, c_custkey % 60 + 1 as spot from customer),
cl as (select page, line, spot, c_custkey % 8 = 1 as cites, case c_custkey % 8 when 0 then 'fn_' || c_custkey % 1500 when 1 then 'fn_' || c_custkey % 997 when 4 then 'fn_' when 5 then 'zz_' when 7 then 'p' || c_custkey % 50 end as name
  from al where c_custkey % 8 in (0, 1, 4, 5, 7) and not line between 1001 and 1199),
pc as (select page, spot as a, case when c_custkey % 8 = 6 then spot + 2 else spot end as b from al where c_custkey % 8 in (1, 6)),
rel as (select page, 'src/m' || c_custkey % 25 || '.rs' as path from al where c_custkey % 8 = 3 and c_nationkey % 2 = 0),
def as (select distinct 'fn_' || p_partkey % 1200 as name, 'src/m' || p_partkey % 40 || '.rs' as path from part)"""


def _defined(spark, d):
    return table(spark, d, "part").selectExpr("'fn_' || p_partkey % 1200 as name", "'/repo/src/m' || p_partkey % 40 || '.rs' as path").distinct()


@query("api_entries", f"with {_API} select line, module, name, 1 as cites, spot from api")
def api_entries(spark, d):
    return _entries(spark, d).select("line", "module", "name", F.size("cites").alias("cites"), F.col("cites")[0]["start"].alias("spot"))


@query("entity_modules", f"with {_API} select name, owner as module from own")
def entity_modules(spark, d):
    return O.entity_modules(_entries(spark, d))


@query("api_modules", f"with {_API} select module from mods")
def api_modules(spark, d):
    return O.api_modules(_api(spark, d))


@query("entity_claims", f"with {_CLAIMS} select page, line, name from cl")
def entity_claims(spark, d):
    return O.entity_claims(_view(spark, d), O.api_modules(_api(spark, d))).select("page", "line", "name")


@query("listed_sources", f"with {_CLAIMS} select page, path from rel")
def listed_sources(spark, d):
    return O.listed_sources(_view(spark, d))


_OWN = f"""{_API}, {_CLAIMS}, ct as (select distinct c.page, c.name from cl c join api using (name) join pc on pc.page = c.page and pc.a <= api.spot and pc.b >= api.spot),
fo as (select distinct c.page, c.name from cl c join def using (name) join rel on rel.page = c.page and rel.path = def.path
  union select distinct c.page, c.name from cl c join def using (name) where c.page not in (select page from rel) and def.path = 'src/' || replace(c.page, 'src_', '') || '.rs'),
x as (select cl.*, owner, ct.name is not null as cited, fo.name is not null as owned, cl.name in (select 'p' || n_nationkey from nation) as in_path, cl.name like '%\\_' escape '\\' and (exists (select 1 from own o where starts_with(o.name, cl.name)) or exists (select 1 from def where starts_with(def.name, cl.name))) as series
  from cl left join own using (name) left join ct on ct.page = cl.page and ct.name = cl.name left join fo on fo.page = cl.page and fo.name = cl.name),
y as (select page, line, name, case when owner is not null and (replace(owner, '::', '_') = page or cited) then null when owner is not null then 'entity-ownership' when owned then null when in_path then 'entity-ownership' when series then null else 'entity-coverage' end as kind,
  case when owner is not null then case when cites or length(name) <= 4 then 'Warning' else 'Error' end when in_path then 'Warning' else 'Error' end as severity from x)"""


@query("entity_ownership", f"with {_OWN} select * from y where kind is not null")
def entity_ownership(spark, d):
    view, api = _view(spark, d), _api(spark, d)
    modules = O.api_modules(api)
    cites = view.select("page", F.explode(T.citations(F.col("text"))).alias("c")).select("page", "c.start", "c.end")
    names = table(spark, d, "nation").selectExpr("'p' || n_nationkey as name")
    return O.ownership(O.entity_claims(view, modules), _entries(spark, d), modules, cites, O.listed_sources(view), _defined(spark, d), names)


@query("stale_entities", f"with {_API}, {_CLAIMS}, g as (select distinct name from api where name not in (select name from def where name < 'fn_5')), o as (select distinct page, name from cl join g using (name)) select * from o union all select 'api', name from g where name not in (select name from o)")
def stale_entities(spark, d):
    api = _api(spark, d)
    return O.stale_entities(_entries(spark, d), _defined(spark, d).where("name < 'fn_5'"), O.entity_claims(_view(spark, d), O.api_modules(api)))


@query("primary_language", "select min(lang) as language from documents where source in ('src1', 'src2') and lang > 'de'")
def primary_language(spark, d):
    return O.primary_language(table(spark, d, "documents").select(F.col("lang").alias("language"), F.when(F.col("source").isin("src1", "src2") & (F.col("lang") > "de"), "api").otherwise("x").alias("page")))


_CITED_PATHS = "case p_size % 6 when 0 then '../p' || p_partkey when 1 then 'a/..b/c' when 2 then 'C:p' || p_partkey when 3 then '/repo/p' || p_partkey when 4 then '/etc/p' || p_partkey else 'a\\b\\..\\c' end"


@query("path_escapes", f"select p_partkey, {_CITED_PATHS} as path, case p_size % 6 when 0 then 'parent' when 2 then 'drive' when 4 then 'outside' when 5 then 'parent' end as reason from part")
def path_escapes(spark, d):
    path = F.expr(_CITED_PATHS.replace("\\", "\\\\"))
    return table(spark, d, "part").select("p_partkey", path.alias("path"), O.path_escape(path, ["/repo"]).alias("reason"))


@query("resolved_paths", """with p as (select distinct 'f' || p_size || '.rs' as path from part), r as (select r_regionkey as place, '/r' || r_regionkey || '/' as root from region), f as (select '/r' || n_regionkey || '/f' || n_nationkey || '.rs' as file from nation)
select path, (select arg_min(file, place) from r join f on file = '/r' || place || '/' || path) as file from p""")
def resolved_paths(spark, d):
    p = table(spark, d, "part").selectExpr("'f' || p_size || '.rs' as path").distinct()
    r = table(spark, d, "region").selectExpr("r_regionkey as place", "'/r' || r_regionkey || '/' as root")
    return O.resolve(p, r, table(spark, d, "nation").selectExpr("'/r' || n_regionkey || '/f' || n_nationkey || '.rs' as file"))


_KEYS = "case p_partkey % 3 when 0 then 'p' || p_partkey when 1 then '/repo/p' || p_partkey else '/other/p' || p_partkey end"


@query("recorded_hashes", f"""with s as (select p_partkey, {_KEYS} as path from part),
k as (select case p_partkey % 5 when 0 then 'p' || p_partkey when 1 then '/repo/p' || p_partkey when 2 then '/other/p' || p_partkey else 'q' || p_partkey end as key, p_name as hash from part)
select path, coalesce(a.hash, b.hash, c.hash) as hash from s left join k a on a.key = path left join k b on b.key = case when starts_with(path, '/repo/') then path[7:] else path end left join k c on c.key = case when starts_with(path, '/') then path else '/repo/' || path end""")
def recorded_hashes(spark, d):
    p = table(spark, d, "part")
    k = p.selectExpr("case p_partkey % 5 when 0 then 'p' || p_partkey when 1 then '/repo/p' || p_partkey when 2 then '/other/p' || p_partkey else 'q' || p_partkey end as path", "p_name as hash")
    return O.recorded_hash(p.selectExpr(f"{_KEYS} as path"), k, "/repo")


@query("allowed_names", """with o as (select 'm' || n_regionkey as page, 'm' || (n_regionkey + 1) as name from nation union select 'm' || n_regionkey, 'k' || n_nationkey from nation)
select page, name from o union select distinct page, unnest(['std', 'core']) from o union select page, 'x' || r_regionkey from (select distinct page from o), region""")
def allowed_names(spark, d):
    n = table(spark, d, "nation")
    return O.allowed_names(n.selectExpr("'m' || n_regionkey as page", "'m' || (n_regionkey + 1) as name"), n.selectExpr("'m' || n_regionkey as page", "'k' || n_nationkey || '::a::b' as target"), table(spark, d, "region").selectExpr("'x' || r_regionkey as module"))


@query("claim_violations", f"""with {_CLAIMS}, c as (select page, line, name, name as claimed, spot from cl union all select page, line, 'src', 'src::m3', spot from al where c_custkey % 8 = 2 and not line between 1001 and 1199),
r as (select 'src_m' || n_nationkey as page, 'src' as name from nation where n_nationkey % 2 = 0), e as (select distinct 'src_m' || p_partkey % 25 as page, 'fn_' || p_partkey % 1200 as name from part)
select page, line, claimed, name from c where not (claimed = 'src::m3' and page in (select page from r)) and (page, name) not in (select page, name from e)
  and not (name like '%\\_' escape '\\' and exists (select 1 from e where e.page = c.page and starts_with(e.name, left(c.name, length(c.name) - 1))))""")
def claim_violations(spark, d):
    r = table(spark, d, "nation").where("n_nationkey % 2 = 0").selectExpr("'src_m' || n_nationkey as page", "'src' as name")
    e = table(spark, d, "part").selectExpr("'src_m' || p_partkey % 25 as page", "'fn_' || p_partkey % 1200 as name").distinct()
    return O.claim_violations(_view(spark, d), r, e)


_DRAWN = "case s_suppkey % 4 when 0 then 'graph TD' || chr(10) || 'a[x] --> b' when 1 then 'grph TD' || chr(10) || 'a' when 2 then 'flowchart LR' || chr(10) || 'a[x --> b' else 'pie' end"
_PAGE = f"'# S' || s_suppkey || chr(10) || '```mermaid' || chr(10) || {_DRAWN} || case when s_suppkey % 3 = 0 then '' else chr(10) || '```' || chr(10) || 'after' end"


def _drawn(spark, d):
    return A.lines(table(spark, d, "supplier").select(F.col("s_suppkey").alias("page"), F.expr(_PAGE).alias("text")))


_BAD = "case s_suppkey % 4 when 1 then 'unknown diagram grph' when 2 then 'brackets do not match' end"


@query("diagram_problems", f"select s_suppkey as page, 2 as start, {_BAD} as message from supplier where s_suppkey % 4 in (1, 2)")
def diagram_problems(spark, d):
    return O.diagram_problems(A.blocks(_drawn(spark, d), "mermaid")).withColumn("start", F.col("start").cast("int"))


@query("degraded_diagrams", f"select s_suppkey as page, case when s_suppkey % 4 in (1, 2) then replace({_PAGE}, '```mermaid', '<!-- diagram not valid: ' || {_BAD} || ' -->' || chr(10) || '```text') else {_PAGE} end || case when s_suppkey % 3 = 0 then chr(10) || '```' else '' end as text from supplier")
def degraded_diagrams(spark, d):
    view = _drawn(spark, d)
    return O.degrade_diagrams(view, O.diagram_problems(A.blocks(view, "mermaid")))


@query("semantic_conflicts", "select s_suppkey as id, 'p' || s_nationkey as page, s_name as claim, case when s_suppkey % 3 = 1 then '' else 'api' end as conflict from supplier where s_suppkey % 4 in (0, 1)")
def semantic_conflicts(spark, d):
    one = "'{\"page\": \"p' || s_nationkey || '\", \"claim\": \"' || s_name || '\"' || case when s_suppkey % 3 = 1 then '' else ', \"conflict\": \"api\"' end || '}'"
    t = f"case s_suppkey % 4 when 0 then '```json {{\"conflicts\": [' || {one} || ', {{\"page\": \"x\"}}]}} ```' when 1 then '{{\"conflicts\": [' || {one} || ']}}' when 2 then 'none found' else '{{\"conflicts\": []}}' end"
    return O.conflicts(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.expr(t.replace("{{", "{").replace("}}", "}")).alias("text")))


@query("judge_evidence", """with x as (select 'd' || doc_id as page, '# d' || doc_id || chr(10) || left(text, 6000) || chr(10) as text from documents), y as (select *, coalesce(sum(length(text)) over (order by page rows between unbounded preceding and 1 preceding), 0)::bigint as before from x)
select page, md5(left(text, 20000 - before)) as text, before from y where before < 20000""")
def judge_evidence(spark, d):
    return O.evidence(table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("page"), "text")).withColumn("text", F.md5("text"))
