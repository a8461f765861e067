"""Queries over incremental operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import codegraph as C
from skein.operators import incremental as I
from skein.operators import index as X
from skein.plans.codegraph import _EDGES, PARSED, parsed, written_links
from skein.plans.common import table
from skein.registry import query

_VERSIONS = """o as (select 'd' || doc_id as path, sha256(text) as hash from documents where lang <> 'de'), n as (select 'd' || doc_id as path, sha256(case when source = 'src3' then text || '!' else text end) as hash from documents where lang <> 'fr')"""


def _versions(spark, d):
    x = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), "text", "lang", "source")
    new = F.when(F.col("source") == "src3", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return x.where("lang <> 'de'").select("path", F.sha2("text", 256).alias("hash")), x.where("lang <> 'fr'").select("path", F.sha2(new, 256).alias("hash"))


@query("fingerprint_diff", f"with {_VERSIONS} select coalesce(o.path, n.path) as path, case when o.path is null then 'added' when n.path is null then 'removed' else 'changed' end as change from o full join n on o.path = n.path where o.hash is distinct from n.hash")
def fingerprint_diff(spark, d):
    return I.fingerprint_diff(*_versions(spark, d))


@query("fingerprints", "select doc_id, sha256(text) as hash from documents")
def fingerprints(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("full_rebuild_guard", """select lang, c as changed, n as total, c >= 200 and (c > 0.5 * n or t > 200000) as rebuild
from (select lang, count(*) as n, count(*) filter (source <> 'src1') as c, coalesce(sum(n_chars // 3) filter (source <> 'src1'), 0) as t from documents group by lang)""")
def full_rebuild_guard(spark, d):
    x = table(spark, d, "documents").select("lang", F.col("n_chars").alias("size"), (F.col("source") != "src1").alias("changed"))
    return I.full_rebuild(x, ["lang"])


_ENTITIES = """v as (select p_brand as file, 'e' || p_size as name, p_partkey as pos, 'fn e( ' || p_type || ' )' as sig, p_name as doc, p_partkey as a, p_partkey + 3 as b, p_partkey, p_size from part),
o as (select file, name, pos, sig, doc, a, b from v where p_size <> 4), n as (select file, name, pos, case when p_partkey % 7 = 0 then replace(sig, ' ', '  ') when p_size = 9 then sig || ' -> x' else sig end as sig, doc, case when p_partkey % 5 = 0 then a + 1 else a end as a, b from v where p_size <> 6)"""


@query("entity_diff", f"""with {_ENTITIES},
x as (select *, row_number() over w as place, list(regexp_replace(sig, '\\s', '', 'g')) over (partition by file, name order by pos rows between unbounded preceding and unbounded following) as sigs from o window w as (partition by file, name order by pos)),
y as (select *, row_number() over w as place, list(regexp_replace(sig, '\\s', '', 'g')) over (partition by file, name order by pos rows between unbounded preceding and unbounded following) as sigs from n window w as (partition by file, name order by pos))
select file, name, place, 'Added' as change from y where (file, name) not in (select file, name from x) union all select file, name, place, 'Removed' from x where (file, name) not in (select file, name from y)
union all select x.file, x.name, x.place, case when x.sigs <> y.sigs then 'SignatureChanged' else 'BodyChanged' end from x join y using (file, name, place) where not (x.sig = y.sig and x.doc = y.doc and x.a = y.a and x.b = y.b)""")
def entity_diff(spark, d):
    return I.entity_diff(*_entities(spark, d))


def _entities(spark, d):
    p = table(spark, d, "part").withColumn("sig", F.expr("'fn e( ' || p_type || ' )'"))
    new_sig = F.when(F.col("p_partkey") % 7 == 0, F.replace("sig", F.lit(" "), F.lit("  "))).when(F.col("p_size") == 9, F.concat("sig", F.lit(" -> x"))).otherwise(F.col("sig"))
    cols = [F.col("p_brand").alias("file"), F.concat(F.lit("e"), "p_size").alias("name"), F.col("p_partkey").alias("pos")]
    old = p.where("p_size <> 4").select(*cols, "sig", F.col("p_name").alias("doc"), F.col("p_partkey").alias("a"), (F.col("p_partkey") + 3).alias("b"))
    new = p.where("p_size <> 6").select(*cols, new_sig.alias("sig"), F.col("p_name").alias("doc"), F.expr("case when p_partkey % 5 = 0 then p_partkey + 1 else p_partkey end").alias("a"), (F.col("p_partkey") + 3).alias("b"))
    return old, new


@query("interface_changes", f"""with {_ENTITIES},
x as (select file, name, list(regexp_replace(sig, '\\s', '', 'g') order by pos) as sigs from o group by all), y as (select file, name, list(regexp_replace(sig, '\\s', '', 'g') order by pos) as sigs from n group by all),
p as (select *, row_number() over (partition by file, name order by pos) as place from o), q as (select *, row_number() over (partition by file, name order by pos) as place from n),
c as (select coalesce(x.file, y.file) as file, x.sigs is null or y.sigs is null as whole, x.sigs <> y.sigs as other, coalesce(x.name, y.name) as name from x full join y on x.file = y.file and x.name = y.name),
r as (select distinct p.file, p.name from p join q using (file, name, place) where not (p.sig = q.sig and p.doc = q.doc and p.a = q.a and p.b = q.b))
select c.file, bool_or(whole or other) as interface from c left join r on r.file = c.file and r.name = c.name where whole or r.name is not null group by c.file""")
def interface_changes(spark, d):
    return I.interface_changed(I.entity_diff(*_entities(spark, d)))


@query("prefix_starts", """with n as (select page_id as node, 'site/' || page_id % 10 || '/' || page_id % 7 || '/' || page_id as path from pages), c as (select distinct 'site/' || r_regionkey as change from region union select 'site/3/1' union select 'site/9/2/' )
select distinct rtrim(change, '/') as change, node from n join c on path = rtrim(change, '/') or starts_with(path, rtrim(change, '/') || '/')""")
def prefix_starts(spark, d):
    n = table(spark, d, "pages").select(F.col("page_id").alias("node"), F.expr("'site/' || page_id % 10 || '/' || page_id % 7 || '/' || page_id").alias("path"))
    c = table(spark, d, "region").select(F.expr("'site/' || r_regionkey").alias("change"))
    return I.prefix_starts(n, c.union(spark.createDataFrame([("site/3/1",), ("site/9/2/",)], "change string")))


_CITED = "pages_ as (select s_suppkey as page, 'see src/m' || (s_suppkey % 7) || '.rs:' || (s_nationkey + 1) || '-' || (s_nationkey + 4) || ' and lib/k' || (s_suppkey % 11) || '.py:12' as text from supplier)"


def cited(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("page"), F.expr("'see src/m' || (s_suppkey % 7) || '.rs:' || (s_nationkey + 1) || '-' || (s_nationkey + 4) || ' and lib/k' || (s_suppkey % 11) || '.py:12'").alias("text"))


@query("reverse_references", f"with {_CITED} select distinct page from pages_ where contains(text, 'src/m3.rs:') or contains(text, 'lib/k5.py:')")
def reverse_references(spark, d):
    return I.reverse_references(cited(spark, d), spark.createDataFrame([("src/m3.rs",), ("lib/k5.py",)], "path string"))


@query("vanished_modules", "with m as (select n_name as module, 'f' || s_suppkey as path, s_acctbal from supplier join nation on s_nationkey = n_nationkey) select module from m group by module having bool_and(s_acctbal >= 5000)")
def vanished_modules(spark, d):
    m = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("module"), F.concat(F.lit("f"), "s_suppkey").alias("path"))
    return I.vanished(m, table(spark, d, "supplier").where("s_acctbal < 5000").select(F.concat(F.lit("f"), "s_suppkey").alias("path")))


@query("unchanged_backfill", "select doc_id as module, lang from documents where doc_id not in (select doc_id from labels where quality = 1) and doc_id not in (select doc_id from labels where toxic = 1)")
def unchanged_backfill(spark, d):
    marks = table(spark, d, "labels")
    return I.backfill(table(spark, d, "documents").select(F.col("doc_id").alias("module"), "lang"), *[marks.where(f"{c} = 1").select(F.col("doc_id").alias("module")) for c in ("quality", "toxic")])


@query("stale_outputs", "select '/out/' || doc_id as path from labels where doc_id % 7 <> 0 and doc_id not in (select doc_id from documents where lang = 'en') and quality <> 0")
def stale_outputs(spark, d):
    """A seventh of the recorded paths is relative; documents in English were rendered again, and modules are the labels of quality, of which 0 is kept."""
    r = table(spark, d, "labels").select(F.expr("case when doc_id % 7 = 0 then '' else '/' end || 'out/' || doc_id").alias("path"), F.col("quality").alias("module"))
    return X.stale_artefacts(r, table(spark, d, "documents").where("lang = 'en'").selectExpr("'/out/' || doc_id as path"), spark.createDataFrame([(0,)], "module int"))


@query("fingerprint_sync", f"with {_VERSIONS}, j as (select coalesce(o.path, n.path) as path, o.hash as was, n.hash as now from o full join n on o.path = n.path), r as (select path, case when path like '%7' then coalesce(was, now) else now end as hash from j) select * from r where hash is not null")
def fingerprint_sync(spark, d):
    old, new = _versions(spark, d)
    return I.sync(old, new, old.select("path").union(new.select("path")).distinct().where("path like '%7'"))


@query("module_fingerprint", "select source as module, string_agg(sha256(text), '|' order by 'd' || doc_id) as fingerprint from documents group by source")
def module_fingerprint(spark, d):
    x = table(spark, d, "documents").select(F.col("source").alias("module"), F.concat(F.lit("d"), "doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    return I.module_fingerprints(x.select("module", "path"), x.select("path", "hash"))


@query("manual_edits", "select lang as module, string_agg(left(text || '!', 200), chr(10) order by 'd' || doc_id) as notes from documents where source in ('src1', 'src2') group by lang")
def manual_edits(spark, d):
    x = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("lang").alias("module"), "text", "source")
    edited = F.when(F.col("source").isin("src1", "src2"), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return I.manual_edits(x.select("path", "module", edited.alias("content")), x.select("path", F.sha2("text", 256).alias("hash")))


_TREE = "case p_partkey % 5 when 0 then 'wiki/p' || p_partkey when 1 then 'AGENTS.md' when 2 then 'wiki' when 3 then 'src\\p' || p_partkey || '.rs' else 'wikis/p' || p_partkey end"


@query("source_changes", f"select p_partkey as id, {_TREE} as path from part where p_partkey % 5 in (3, 4)")
def source_changes(spark, d):
    path = F.expr(_TREE.replace("\\", "\\\\"))
    return I.source_changes(table(spark, d, "part").select(F.col("p_partkey").alias("id"), path.alias("path")), "wiki/")


@query("project_inputs", "select path from (select 'a' || n_nationkey || '/' || (['Cargo.toml', 'cargo.toml', 'go.mod', 'x.rs', 'glossary.md'])[n_nationkey % 5 + 1] as path, n_nationkey from nation) where n_nationkey % 5 in (0, 2, 4)")
def project_inputs(spark, d):
    return I.project_inputs_changed(table(spark, d, "nation").selectExpr("'a' || n_nationkey || '/' || element_at(array('Cargo.toml', 'cargo.toml', 'go.mod', 'x.rs', 'glossary.md'), n_nationkey % 5 + 1) as path"))


@query("version_diff", f"""with {_ENTITIES}, f as (select distinct p_brand as file, case cast(right(p_brand, 1) as int) % 3 when 0 then 'modified' when 1 then 'deleted' else 'added' end as status from part),
o2 as (select * from o where file in (select file from f where status <> 'added')), n2 as (select * from n where file in (select file from f where status <> 'deleted')),
x as (select *, row_number() over w as place, list(regexp_replace(sig, '\\s', '', 'g')) over (partition by file, name order by pos rows between unbounded preceding and unbounded following) as sigs from o2 window w as (partition by file, name order by pos)),
y as (select *, row_number() over w as place, list(regexp_replace(sig, '\\s', '', 'g')) over (partition by file, name order by pos rows between unbounded preceding and unbounded following) as sigs from n2 window w as (partition by file, name order by pos))
select file, name, place, 'Added' as change from y where (file, name) not in (select file, name from x) union all select file, name, place, 'Removed' from x where (file, name) not in (select file, name from y)
union all select x.file, x.name, x.place, case when x.sigs <> y.sigs then 'SignatureChanged' else 'BodyChanged' end from x join y using (file, name, place) where not (x.sig = y.sig and x.doc = y.doc and x.a = y.a and x.b = y.b)""")
def version_diff(spark, d):
    status = F.expr("case cast(right(p_brand, 1) as int) % 3 when 0 then 'modified' when 1 then 'deleted' else 'added' end")
    return I.version_diff(*_entities(spark, d), table(spark, d, "part").select(F.col("p_brand").alias("file"), status.alias("status")).distinct())


_CHANGED = "chg as (select path from files where file % 13 = 5), ech as (select path as file, case when file % 2 = 0 then 'BodyChanged' else 'SignatureChanged' end as change from files where file % 13 = 5 and file % 3 <> 0)"


def _reach(changed):
    return f"st as (select c.path as change, n.id as node from nodes n join {changed} c on n.path = c.path)," + _REACH


_REACH = """
bd as (select src as node, dst as next from edges where kind in ('Imports', 'Calls') union select dst, src from edges where kind in ('Imports', 'Calls')),
w0 as (select distinct node from st where change in (select file from ech where change <> 'BodyChanged') or not exists (select 1 from ech)),
w1 as (select node from w0 union select next from w0 join bd using (node)), w2 as (select node from w1 union select next from w1 join bd using (node)), w3 as (select node from w2 union select next from w2 join bd using (node)),
hit as (select node from w3 union select node from st where exists (select 1 from ech) and change not in (select file from ech where change <> 'BodyChanged')
  union select src from edges where kind = 'Calls' and dst in (select node from st where change in (select file from ech where change = 'BodyChanged'))),
aff as (select distinct module from nodes where id in (select node from hit) and module <> '')"""


def _changed(spark, d):
    """(files, changed files, entity changes, nodes, links) of the code graph."""
    files, _, _, every, links = written_links(spark, d)
    changed = files.where("file % 13 = 5").select(F.col("path").alias("change"))
    changes = files.where("file % 13 = 5 and file % 3 <> 0").select(F.col("path").alias("file"), F.when(F.col("file") % 2 == 0, "BodyChanged").otherwise("SignatureChanged").alias("change"))
    return files, changed, changes, every.select(F.col("id").alias("node"), "path", "module"), links


@query("impact_semantic", f"with {PARSED}, {_EDGES}, {_CHANGED}, {_reach('chg')} select module from aff")
def impact_semantic(spark, d):
    _, changed, changes, every, links = _changed(spark, d)
    return I.impact_semantic(changed, changes, every, links)


@query("module_files", f"with {PARSED} select distinct path from nodes where path is not null and module in (select 'src::m' || n_nationkey from nation where n_nationkey % 3 = 0)")
def module_files(spark, d):
    files, entities, _ = parsed(spark, d)
    return I.module_files(table(spark, d, "nation").where("n_nationkey % 3 = 0").selectExpr("'src::m' || n_nationkey as module"), C.nodes(files, entities))


@query("output_fingerprints", "select 'wiki/d' || doc_id as path, source as module, sha256(text) as hash from documents")
def output_fingerprints(spark, d):
    return I.output_fingerprints(table(spark, d, "documents").selectExpr("'wiki/d' || doc_id as path", "source as module", "text as content"))


_CARDS = "cards as (select 'd' || doc_id as path, source || '-' || lang as module from documents)"


@query("surviving_siblings", f"with {_VERSIONS}, {_CARDS}, g as (select path from o where path like '%3' and path not in (select path from n)) select path from n where path in (select path from cards where module in (select module from cards join g using (path)))")
def surviving_siblings(spark, d):
    old, new = _versions(spark, d)
    cards = table(spark, d, "documents").selectExpr("'d' || doc_id as path", "source || '-' || lang as module")
    return I.survivors(old.where("path like '%3'"), cards, new)


@query("update_scope", f"""with {PARSED}, {_EDGES}, {_CHANGED}, op as (select path from files where file % 29 <> 3), np as (select path from files where file % 31 <> 4),
card as (select path, s_nationkey as module from files join supplier on s_suppkey = file), pg as (select s_nationkey as page, path from supplier, ns, files where file = s_suppkey * 7 % n + 1 and s_suppkey % 6 = 0),
gone as (select path from op where path not in (select path from np)), t as (select path from files where path in (select path from np) and (path not in (select path from op) or file % 13 = 5 or file % 41 = 7)), {_reach("t")},
r as (select path, 0 as place, 'changed' as reason from t union all select path, 1, 'removed' from gone union all select path, 2, 'failed' from card where module = 5
  union all select path, 3, 'impact' from nodes where path is not null and module in (select module from aff) union all select path, 4, 'sibling' from card where module in (select module from card join gone using (path))
  union all select path, 5, 'reference' from card where module in (select page from pg where path in (select path from gone)))
select path, arg_min(reason, place) as reason from r where reason = 'removed' or path in (select path from np) group by path""")
def update_scope(spark, d):
    files, _, changes, every, links = _changed(spark, d)
    old = files.where("file % 29 <> 3").selectExpr("path", "'a' as hash")
    new = files.where("file % 31 <> 4").selectExpr("path", "case when file % 13 = 5 then 'b' else 'a' end as hash")
    cards = files.join(table(spark, d, "supplier").selectExpr("s_suppkey as file", "s_nationkey as module"), "file").select("path", "module")
    return I.update_scope(old, new, changes, every, links, cards, spark.createDataFrame([(5,)], "module int"), _citing(spark, d, files), files.where("file % 41 = 7"))


def _citing(spark, d, files):
    n = table(spark, d, "supplier").count()
    s = table(spark, d, "supplier").where("s_suppkey % 6 = 0").select("s_nationkey", ((F.col("s_suppkey") * 7) % n + 1).alias("file"))
    return s.join(files, "file").select(F.col("s_nationkey").alias("page"), F.concat(F.lit("see "), "path", F.lit(":3")).alias("text"))
