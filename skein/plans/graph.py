"""Queries over graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import graph as G
from skein.plans.common import CALLS, MEMBERS, PATHS, calls, nations, paths, table
from skein.registry import query
from skein.sources.state import checkpoint_folder

_DEPS = f"with {MEMBERS}, {CALLS}, e as (select a.module as a, b.module as b, src, dst from calls join members a on a.node = src join members b on b.node = dst), deps as (select distinct a, b from e where a <> b)"


@query("module_dependencies", f"{_DEPS} select a, b from deps")
def module_dependencies(spark, d):
    return G.module_dependencies(calls(spark, d), nations(spark, d))


@query("dependency_lists", f"""{_DEPS}, m as (select distinct module from members),
u as (select a as module, string_agg(b, ',' order by b) as x from deps group by a), v as (select b as module, string_agg(a, ',' order by a) as x from deps group by b)
select m.module, coalesce(u.x, '') as uses, coalesce(v.x, '') as used_by from m left join u using (module) left join v using (module)""")
def dependency_lists(spark, d):
    return G.dependency_lists(calls(spark, d), nations(spark, d)).withColumns({c: F.array_join(c, ",") for c in ("uses", "used_by")})


@query("reading_order", f"""{_DEPS}, m as (select distinct module from members), n as (select m.module, count(deps.b) as used_by from m left join deps on deps.b = m.module group by m.module)
select module, used_by, row_number() over (order by used_by desc, module) as place from n""")
def reading_order(spark, d):
    return G.reading_order(calls(spark, d), nations(spark, d))


@query("module_call_counts", f"{_DEPS} select a, b, count(*) as n from e group by a, b")
def module_call_counts(spark, d):
    return G.module_call_counts(calls(spark, d), nations(spark, d))


@query("cohesion_coupling", f"""{_DEPS}, m as (select distinct module from members),
s as (select a as module, 1 as i, 0 as x from e where a = b union all select a, 0, 1 from e where a <> b union all select b, 0, 1 from e where a <> b),
n as (select m.module, coalesce(sum(i), 0)::bigint as internal, coalesce(sum(x), 0)::bigint as external from m left join s on s.module = m.module group by m.module)
select module, internal, external, case when internal + external = 0 then 0.0 else round(internal::double / (internal + external), 6) end as cohesion,
  case when internal + external = 0 then 0.0 else round(external::double / (internal + external), 6) end as coupling from n""")
def cohesion_coupling(spark, d):
    return G.cohesion(calls(spark, d), nations(spark, d))


@query("module_chain", f"""with {PATHS}, s as (select string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/') as s from paths),
p as (select distinct array_to_string(s[1:i], '/') as prefix, i as depth from (select s, unnest(range(1, len(s) + 1)) as i from s))
select prefix, regexp_extract(prefix, '^(.*)/[^/]*$', 1) as parent, depth::bigint as depth from p""")
def module_chain(spark, d):
    return G.module_chain(paths(spark, d))


def _entities(spark, d):
    """Parts as functions whose bodies call the part of the next key and one far away."""
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("fn_"), F.col("p_partkey") % 997).alias("name"), F.when(F.col("p_size") % 4 == 0, "struct").otherwise("fn").alias("kind"),
                    F.expr("'let x = fn_' || (p_partkey + 1) % 997 || '(1); fn_' || p_partkey * 7 % 997 || ' (2); fn_' || p_partkey % 997 || '(3)'").alias("body"))


@query("call_edges_lexical", r"""with e as (select p_partkey as id, 'fn_' || p_partkey % 997 as name, case when p_size % 4 = 0 then 'struct' else 'fn' end as kind,
  'let x = fn_' || (p_partkey + 1) % 997 || '(1); fn_' || p_partkey * 7 % 997 || ' (2); fn_' || p_partkey % 997 || '(3)' as body from part),
c as (select distinct id as src, name as own, unnest(regexp_extract_all(body, '([A-Za-z0-9_]+)\(', 1)) as callee from e where kind = 'fn')
select distinct src, e.id as dst from c join e on e.name = callee where callee <> own and src <> e.id""")
def call_edges_lexical(spark, d):
    return G.call_edges(_entities(spark, d))


@query("call_index", r"""with e as (select p_partkey as id, 'fn_' || p_partkey % 997 as name, case when p_size % 4 = 0 then 'struct' else 'fn' end as kind,
  'let x = fn_' || (p_partkey + 1) % 997 || '(1); fn_' || p_partkey * 7 % 997 || ' (2); fn_' || p_partkey % 997 || '(3)' as body from part),
c as (select distinct id as src, name as own, unnest(regexp_extract_all(body, '([A-Za-z0-9_]+)\(', 1)) as callee from e where kind = 'fn'),
x as (select distinct src, e.id as dst from c join e on e.name = callee where callee <> own and src <> e.id),
n as (select a.name as caller, b.name as callee from x join e a on a.id = src join e b on b.id = dst),
i as (select callee as name, string_agg(caller, ',' order by caller) as callers from n group by 1), o as (select caller as name, string_agg(callee, ',' order by callee) as callees from n group by 1)
select coalesce(i.name, o.name) as name, coalesce(callers, '') as callers, coalesce(callees, '') as callees from i full join o on i.name = o.name""")
def call_index(spark, d):
    return G.call_texts(G.call_counts(_entities(spark, d)))


_IMPORTS = """i as (select s_suppkey as src, s_suppkey * 3 as upto, 'crate::n' || s_nationkey || '::' || case when s_suppkey % 3 = 0 then 'x' || s_suppkey else 'node_' || s_suppkey * 2 end as target from supplier),
nodes as (select p_partkey as id, 'node_' || p_partkey as name, 'src/crate/n' || p_size % 25 || '/x' || p_partkey || '.rs' as path from part)"""


@query("import_edges_ordered", f"""with {_IMPORTS},
t as (select *, string_split(target, '::')[-1] as last, replace(target, '::', '/') as tail from i),
a as (select src, target, n.id as dst from t join nodes n on n.name = t.last where n.id <= upto and n.id <> src),
b as (select t.src, t.target, arg_min(n.id, (n.path, n.id)) as dst from t join nodes n on regexp_replace(n.path, '\\.[^./]+$', '') = t.tail or ends_with(regexp_replace(n.path, '\\.[^./]+$', ''), '/' || t.tail)
  where n.id <= upto and n.id <> t.src and not exists (select 1 from a where a.src = t.src and a.target = t.target) group by all)
select distinct src, dst from (select src, dst from a union all select src, dst from b)""")
def import_edges_ordered(spark, d):
    i = table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") * 3).alias("upto"), F.expr("'crate::n' || s_nationkey || '::' || case when s_suppkey % 3 = 0 then 'x' || s_suppkey else 'node_' || s_suppkey * 2 end").alias("target"))
    n = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr("'node_' || p_partkey").alias("name"), F.expr("'src/crate/n' || p_size % 25 || '/x' || p_partkey || '.rs'").alias("path"))
    return G.import_edges(i, n)


@query("impl_edges", """with n as (select p_partkey as id, case when p_size % 3 = 0 then 'impl T' || p_partkey % 50 || ' for U' || p_partkey else 'T' || p_partkey % 50 end as name from part),
i as (select id as src, id as upto, trim(regexp_extract(name, '^(?:impl )?(.*?) for ', 1)) as name from n)
select distinct src, n.id as dst from i join n on i.name = n.name where i.name <> '' and n.id <= upto and n.id <> src""")
def impl_edges(spark, d):
    n = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr("case when p_size % 3 = 0 then 'impl T' || p_partkey % 50 || ' for U' || p_partkey else 'T' || p_partkey % 50 end").alias("name"))
    return G.impl_edges(n.withColumn("upto", F.col("id")), n)


@query("neighbor_jaccard", """with e as (select distinct l_suppkey as node, l_partkey as neighbor from lineitem), s as (select node, count(*) as k from e group by node),
w as (select distinct s_suppkey as a, s_suppkey * 7 % 1000 + 1 as b from supplier), n as (select a, b, count(*) as n from w join e x on x.node = a join e y on y.node = b and x.neighbor = y.neighbor group by all)
select w.a, w.b, coalesce(round(n::double / (p.k + q.k - n), 6), 0.0) as jaccard from w left join n on n.a = w.a and n.b = w.b left join s p on p.node = w.a left join s q on q.node = w.b""")
def neighbor_jaccard(spark, d):
    w = table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") * 7 % 1000 + 1).alias("b"))
    return G.neighbor_jaccard(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("neighbor")), w)


@query("file_edge_weights", """with f as (select s_suppkey as node, 'f' || s_suppkey % 40 as file, case when s_nationkey < 12 then 'src' else 'lib' end as domain from supplier),
e as (select l_suppkey as src, l_partkey % (select count(*) from supplier) + 1 as dst, case when l_linenumber % 2 = 0 then 'Imports' else 'Calls' end as kind from lineitem)
select a.file as s, b.file as t, round(sum(case kind when 'Imports' then 0.8::double when 'Calls' then 0.7::double else 0 end), 6) as weight
from e join f a on a.node = src join f b on b.node = dst where a.file <> b.file and a.domain = b.domain group by all""")
def file_edge_weights(spark, d):
    s = table(spark, d, "supplier")
    n = s.count()
    f = s.select(F.col("s_suppkey").alias("node"), F.expr("'f' || s_suppkey % 40").alias("file"), F.expr("case when s_nationkey < 12 then 'src' else 'lib' end").alias("domain"))
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % n + 1).alias("dst"), F.expr("case when l_linenumber % 2 = 0 then 'Imports' else 'Calls' end").alias("kind"))
    return G.file_edges(e, f, {"Imports": 0.8, "Calls": 0.7})


_DIRS = "x as (select path, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir from paths), c as (select *, regexp_replace(dir, '/common$', '') as c from x), d as (select path, case when count(*) over (partition by c) > 20 then dir else c end as community from c)"


@query("directory_communities", f"""with {PATHS}, {_DIRS}, n as (select community, count(*) as n, min(path) as first from d group by community),
r as (select community, row_number() over (order by n desc, first) as place from n) select path, d.community, place from d join r on d.community = r.community""")
def directory_communities(spark, d):
    return G.directory_communities(paths(spark, d))


@query("community_names", f"""with {PATHS}, {_DIRS}, s as (select community, string_split(dir, '/') as s, dir from d join x using (path)),
n as (select community, count(*) as n from s group by 1), p as (select community, array_to_string(s[1:i], '/') as prefix, count(*) as k from (select community, s, unnest(range(1, len(s) + 1)) as i from s) group by all),
q as (select p.community, arg_max(prefix, len(prefix)) as common from p join n using (community) where k = n group by 1),
o as (select community, arg_max(dir, (k, dir)) as often from (select community, dir, count(*) as k from s group by all) group by 1)
select o.community, coalesce(common, often) as name from o left join q using (community)""")
def community_names(spark, d):
    return G.community_names(G.directory_communities(paths(spark, d)))


@query("path_keys", f"""with {PATHS} select id, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, string_split(path, '/')[1] as domain, 'p' || id as stem, 'rs' as ext, replace(regexp_replace(path, '\\.[^./]+$', ''), '/', '::') as module from paths""")
def path_keys(spark, d):
    p = F.col("path")
    return paths(spark, d).select("id", T.directory(p).alias("dir"), T.top_domain(p).alias("domain"), T.file_stem(p).alias("stem"), T.extension(p).alias("ext"), T.module_path(p).alias("module"))


_EDGE3 = "e as (select distinct c_nationkey as src, (c_custkey * 7 + c_nationkey) % 25 as dst from customer), b as (select src as node, dst as next from e union select dst, src from e)"


def _ring(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("src"), F.expr("(c_custkey * 7 + c_nationkey) % 25").alias("dst")).distinct()


@query("impact_bfs", f"""with recursive {_EDGE3}, w as (select n_nationkey::bigint as start, n_nationkey::bigint as node, 0::bigint as hops from nation
  union select start, b.next::bigint, hops + 1 from w join b on b.node = w.node where hops < 3)
select start, node, min(hops) as hops from w group by start, node""")
def impact_bfs(spark, d):
    return G.impact(_ring(spark, d), table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node")))


@query("caller_hop", f"with {CALLS} select distinct src as node from calls join supplier on dst = 's' || s_suppkey where s_nationkey = 3")
def caller_hop(spark, d):
    return G.callers(calls(spark, d), table(spark, d, "supplier").where("s_nationkey = 3").select(F.concat(F.lit("s"), "s_suppkey").alias("node")))


@query("scc_cycles", f"""with recursive e as (select distinct s_suppkey as src, s_suppkey * 5 % 97 as dst from supplier union select s_suppkey, s_suppkey * 11 % 89 from supplier),
r as (select src, dst from e where src <> dst union select r.src, e.dst from r join e on r.dst = e.src where e.src <> e.dst),
p as (select a.src as node, least(min(a.dst), a.src) as cycle from r a join r b on a.src = b.dst and a.dst = b.src where a.src <> a.dst group by a.src) select node, cycle from p""")
def scc_cycles(spark, d):
    s = table(spark, d, "supplier")
    checkpoint_folder(spark)
    e = s.select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") * 5 % 97).alias("dst")).union(s.select("s_suppkey", F.col("s_suppkey") * 11 % 89))
    return G.cycles(e)
