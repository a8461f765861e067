"""Queries over source operators; their files are put together from table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.plans.common import PATHS, paths, table
from skein.registry import query
from skein.sources import files as S
from skein.sources import manifests as N
from skein.sources import parsers as P
from skein.streaming import watch as W


# Every name that a scan knows, right below the root and deeper, and every extension, with one that differs a little beside each.
_NAMES = ["node_modules", ".venv", "venv", "vendor", "Pods", "Library", "target", ".next", ".nuxt", ".output", "coverage", ".cache", "__pycache__", ".pytest_cache", ".mypy_cache", "bower_components", "fixtures", ".git"]
_ROOT_NAMES = ["dist", "build", "out", "bin", "obj", "Packages", "Temp", "Logs"]
_OTHER_NAMES = ["src", "Target", "vendors", "packages", "temp", "logs", ".idea", "tests", "pods", "library"]
_EXTENSIONS = ["exe", "dll", "bin", "png", "jpg", "jpeg", "gif", "ico", "svg", "pdf", "ttf", "woff", "woff2", "eot", "zip", "tar", "gz", "7z", "rar", "mp3", "mp4", "avi", "mov", "wasm", "o", "obj", "lib", "a", "so", "dylib", "pyc", "class"]
_lists = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query("scan_scope", f"with {PATHS}, x as (select id, path from paths union all select id + 1000000, 'build/' || path from paths union all select id + 2000000, 'a/node_modules/' || path from paths union all select id + 3000000, replace(path, '.rs', '.png') from paths) select id, path from x where id < 1000000 and not contains(path, '/common/') and contains(path, 'src/')")
def scan_scope(spark, d):
    p = paths(spark, d)
    x = p.union(p.selectExpr("id + 1000000", "'build/' || path")).union(p.selectExpr("id + 2000000", "'a/node_modules/' || path")).union(p.selectExpr("id + 3000000", "replace(path, '.rs', '.png')"))
    c = F.col("path")
    return x.where(~S.is_binary(c) & ~S.is_noise(c) & S.language(c).isNotNull() & S.in_scope(c, ["src/**"], ["common"]))


@query("scan_noise", f"""with n as (select unnest({_lists(_NAMES)}) as name, 'any' as kind union all select unnest({_lists(_ROOT_NAMES)}), 'root' union all select unnest({_lists(_OTHER_NAMES)}), 'none'),
p as (select name || '/f' || r_regionkey || '.rs' as path, kind, 1 as depth from n, region union all select 'k' || r_regionkey || '/' || name || '/f.rs', kind, 2 from n, region union all select 'k/' || name, kind, 0 from n)
select path, (kind = 'any' and depth > 0) or (kind = 'root' and depth = 1) as noise from p""")
def scan_noise(spark, d):
    g = table(spark, d, "region").select("r_regionkey")
    n = spark.createDataFrame([(x,) for x in [*_NAMES, *_ROOT_NAMES, *_OTHER_NAMES]], "name string")
    both = n.join(g, F.lit(True))  # five regions
    p = both.selectExpr("name || '/f' || r_regionkey || '.rs' as path").union(both.selectExpr("'k' || r_regionkey || '/' || name || '/f.rs'")).union(n.selectExpr("'k/' || name"))
    return p.select("path", S.is_noise(F.col("path")).alias("noise"))


@query("scan_binary", f"select 'a/b' || r_regionkey || '.' || case when r_regionkey % 2 = 0 then upper(e) else e end as path, e not in ('rs', 'jar', 'md', 'py') as binary from region, (select unnest({_lists([*_EXTENSIONS, 'rs', 'jar', 'md', 'py'])}) as e)")
def scan_binary(spark, d):
    e = spark.createDataFrame([(x,) for x in [*_EXTENSIONS, "rs", "jar", "md", "py"]], "e string").join(table(spark, d, "region"), F.lit(True))  # five regions
    p = e.selectExpr("'a/b' || r_regionkey || '.' || case when r_regionkey % 2 = 0 then upper(e) else e end as path")
    return p.select("path", S.is_binary(F.col("path")).alias("binary"))


@query("sql_files", f"with {PATHS}, x as (select id, path from paths union all select id, replace(path, '.rs', '.SQL') from paths union all select id, '.git/' || replace(path, '.rs', '.sql') from paths union all select id, 'a/.h/' || replace(path, '.rs', '.sql') from paths) select path from x where path like 'src/%.SQL'")
def sql_files(spark, d):
    p = paths(spark, d).select("path")
    return S.sql_files(p.union(p.selectExpr("replace(path, '.rs', '.SQL')")).union(p.selectExpr("'.git/' || replace(path, '.rs', '.sql')")).union(p.selectExpr("'a/.h/' || replace(path, '.rs', '.sql')")))


_CONVENTIONS = "case n_nationkey when 3 then 'AGENTS.md' when 4 then 'rustfmt.toml' when 5 then '.rustfmt.toml' when 6 then 'clippy.toml' when 7 then 'docs/glossary.md' when 8 then 'CONTRIBUTING.md' else 'x/AGENTS.md' end"


@query("convention_files", f"select case n_nationkey when 3 then 0 when 5 then 2 when 7 then 5 else 4 end as slot, {_CONVENTIONS} as path, case n_nationkey when 7 then 16384 when 8 then 32768 else length(n_name) end as n from nation where n_nationkey in (3, 5, 7, 8)")
def convention_files(spark, d):
    """The glossary is 20,000 characters of two bytes, the guide for contributors 40,000 of one; clippy's file is blank."""
    text = "case n_nationkey when 6 then ' ' when 7 then repeat('é', 20000) when 8 then repeat('x', 40000) else n_name end"
    return S.convention_files(table(spark, d, "nation").select(F.expr(_CONVENTIONS).alias("path"), F.expr(text).alias("text"))).select("slot", "path", F.length("text").alias("n"))


@query("path_names", f"with {PATHS}, s as (select string_split(path, '/') as s from paths) select distinct unnest(list_append(s[1:-2], regexp_replace(s[-1], '\\.[^.]*$', ''))) as name from s")
def path_names(spark, d):
    return S.path_names(paths(spark, d))


_PARSED_FILES = "e as (select 'f' || p_partkey % 300 || '.rs' as path, p_name as name, p_partkey as a, p_partkey + 2 as b from part), i as (select 'f' || s_suppkey || '.rs' as path, 'k' || s_nationkey as head from supplier), f as (select distinct 'f' || c_custkey % 400 || '.rs' as path from customer)"


@query("lint_sources", f"""with {_PARSED_FILES} select 'ranges' as relation, count(*) as n, count(distinct path) as paths from e union all select 'names', count(distinct name), null from e union all select 'path_names', count(distinct path), null from f
union all select 'name_files', count(*), count(distinct path) from (select distinct name, path from e) union all select 'import_heads', count(*), count(distinct path) from (select distinct f.path, head from f left join i using (path))""")
def lint_sources(spark, d):
    e = table(spark, d, "part").selectExpr("'f' || p_partkey % 300 || '.rs' as path", "p_name as name", "p_partkey as line_start", "p_partkey + 2 as line_end")
    i = table(spark, d, "supplier").selectExpr("'f' || s_suppkey || '.rs' as path", "'k' || s_nationkey || '::a' as source")
    f = table(spark, d, "customer").selectExpr("'f' || c_custkey % 400 || '.rs' as path").distinct()
    out = None
    for name, df in S.lint_sources(e, i, f).items():
        part = df.agg(F.count("*").alias("n"), F.count_distinct(F.col("path") if "path" in df.columns else F.lit(None)).alias("paths"))
        part = part.select(F.lit(name).alias("relation"), "n", F.when(F.lit("path" in df.columns), F.col("paths")).alias("paths"))
        out = part if out is None else out.union(part)
    return out


_WATCHED = "case event_id % 7 when 0 then '/r/out/p' || user_id || '.rs' when 1 then '/r/wiki/p' || user_id || '.py' when 2 then '/r/src/out/p' || user_id || '.rs' when 3 then '/r/src/target/p' || user_id || '.rs' when 4 then '/r/p' || user_id || '.txt' when 5 then '/r/wikis/p' || user_id || '.go' else '/r/src/p' || user_id || '.rs' end"


@query("watch_report", f"""with e as (select {_WATCHED} as path, case event_type when 'signup' then 'Created' when 'error' then 'Deleted' else 'Modified' end as kind from events where event_id % 7 in (2, 5, 6))
select kind, count(distinct path) as n, md5(string_agg(distinct path, ',' order by path)) as paths from e group by kind""")
def watch_report(spark, d):
    raw = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "remove").otherwise("write")
    e = table(spark, d, "events").select(F.expr(_WATCHED).alias("path"), raw.alias("raw"))
    return W.batch_groups(e, "/r/wiki/").withColumn("paths", F.md5(F.array_join("paths", ",")))


@query("create_table_blocks", """select p_partkey as path, 1 as start, 'create table t' || p_partkey || ' (' || chr(10) || '  a int' || chr(10) || '); -- end' as block from part
union all select p_partkey, 5, 'CREATE TABLE u (b int);' from part""")
def create_table_blocks(spark, d):
    t = F.expr("'-- ' || p_name || chr(10) || 'create table t' || p_partkey || ' (' || chr(10) || '  a int' || chr(10) || '); -- end' || chr(10) || 'x' || chr(10) || 'CREATE TABLE u (b int);' || chr(10) || 'CREATE TABLE open ('")
    return S.create_table_blocks(table(spark, d, "part").select(F.col("p_partkey").alias("path"), t.alias("text"))).withColumn("start", F.col("start").cast("int"))


@query("techstack_merge", """with e as (select 'k' || p_size as name, '=' || p_partkey as version, case when p_partkey % 2 = 0 then 'python' else 'npm' end as category, case when p_partkey % 2 = 0 then 3 else 1 end as priority, p_partkey as pos from part)
select category, name, arg_min(version, (priority, pos)) as version from e group by all""")
def techstack_merge(spark, d):
    e = table(spark, d, "part").selectExpr("'k' || p_size as name", "'=' || p_partkey as version", "case when p_partkey % 2 = 0 then 'python' else 'npm' end as category", "case when p_partkey % 2 = 0 then 3 else 1 end as priority", "p_partkey as pos", "'m' as manifest")
    return N.tech_stack(e).drop("manifest")


@query("manifest_entries", "select 'requirements.txt' || p_partkey as manifest, p_brand as name, '>=' || p_size as version from part")
def manifest_entries(spark, d):
    f = table(spark, d, "part").select(F.expr("p_partkey || '/requirements.txt'").alias("path"), F.expr("'# list' || chr(10) || p_brand || '>=' || p_size || chr(10) || '-r other.txt'").alias("text"))
    return N.parse(f).select(F.expr("'requirements.txt' || split(manifest, '/')[0]").alias("manifest"), "name", "version")


@query("parsed_entities", "select p_partkey as id, 'run_' || p_size as name, 'function' as kind, 3 as line_start, 5 as line_end, 'Does ' || p_name as doc from part union all select p_partkey, 'P' || p_partkey, 'struct', 6, 6, null from part")
def parsed_entities(spark, d):
    src = F.expr("'use std::fmt;' || chr(10) || '/// Does ' || p_name || chr(10) || 'pub fn run_' || p_size || '(x: u8) {' || chr(10) || '    go(x)' || chr(10) || '}' || chr(10) || 'struct P' || p_partkey || ';'")
    f = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.lit("rust").alias("language"), src.alias("source"))
    return P.entities(f).select(F.col("path").cast("long").alias("id"), "name", "kind", "line_start", "line_end", "doc")


@query("watch_fold", """with e as (select 'f' || user_id as path, event_id as seq, case event_type when 'signup' then 'Created' when 'error' then 'Deleted' else 'Modified' end as kind from events)
select path, arg_max(kind, seq) as kind, min(seq) as first from e group by path""")
def watch_fold(spark, d):
    return W.fold(_watched(spark, d))


def _watched(spark, d):
    kind = F.when(F.col("event_type") == "signup", "Created").when(F.col("event_type") == "error", "Deleted").otherwise("Modified")
    return table(spark, d, "events").select(F.expr("'f' || user_id").alias("path"), F.col("event_id").alias("seq"), kind.alias("kind"), "ts")


@query("watch_groups", """with e as (select 'f' || user_id as path, event_id as seq, case event_type when 'signup' then 'Created' when 'error' then 'Deleted' else 'Modified' end as kind from events),
f as (select path, arg_max(kind, seq) as kind, min(seq) as first from e group by path) select kind, string_agg(path, ',' order by first) as paths from f group by kind""")
def watch_groups(spark, d):
    return W.groups(W.fold(_watched(spark, d))).withColumn("paths", F.array_join("paths", ","))


@query("watch_flush", """with e as (select user_id, ts, event_id, lag(ts) over (partition by user_id order by ts, event_id) as prev from events),
s as (select *, sum(case when prev is null or ts - prev >= interval 2 hours then 1 else 0 end) over (partition by user_id order by ts, event_id) as session from e)
select user_id, count(*) as n, min(event_id) as first from s group by user_id, session""")
def watch_flush(spark, d):
    return W.sessions(table(spark, d, "events"), "user_id", "ts", "event_id", 2 * 3600)


@query("watch_flush_deadline")
def watch_flush_deadline(spark, d):
    """Gap and deadline together have no plain SQL; tests hold it against a loop."""
    return W.flushes(table(spark, d, "events").select(F.col("user_id").cast("string").alias("stream"), F.col("ts"), F.col("event_id").alias("seq")), 2 * 3600, 5 * 3600)
