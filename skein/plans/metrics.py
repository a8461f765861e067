"""Queries over metrics; judgments and scores are put together from events, labels and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import metrics as M
from skein.plans.common import table
from skein.plans.retrieval import _BM25, _DOCS, bm25_topk
from skein.registry import query


@query("coverage_ratio", "with n as (select distinct regexp_extract(text, '[A-Za-z0-9]+', 0) as name from benchmark) select count(*) as total, count(*) filter (h) as found, round(count(*) filter (h)::double / count(*), 6) as ratio from (select name, exists (select 1 from documents where contains(text, name)) as h from n)")
def coverage_ratio(spark, d):
    return M.coverage(table(spark, d, "benchmark").select(F.regexp_extract("text", "[A-Za-z0-9]+", 0).alias("name")), table(spark, d, "documents"))


@query("completeness_at_k", f"""with {_DOCS}, {_BM25}, r as (select query, source as module from text_hits join documents on doc_id = node), w as (select distinct item_id as query, 'src' || item_id % 20 as module from benchmark)
select count(*) as total, count(*) filter (h) as hits, round(count(*) filter (h)::double / count(*), 6) as ratio from (select exists (select 1 from r where r.query = w.query and r.module = w.module) as h from w)""")
def completeness_at_k(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("node"), F.col("source").alias("module"))
    wanted = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.expr("'src' || item_id % 20").alias("module"))
    return M.completeness(bm25_topk(spark, d).join(docs, "node"), wanted, docs.select("module"))


@query("doc_info", """select count(*) as pages, sum(len(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n\\f]+'), lambda x: x <> '')))::bigint as words, sum(len(regexp_extract_all(text, '\\]\\(')))::bigint as links,
sum(ceil(len(list_filter(string_split(text, chr(10)), lambda x: starts_with(ltrim(x), '```')))::double / 2))::bigint as code_blocks, sum(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) = '```mermaid')))::bigint as diagrams from documents""")
def doc_info(spark, d):
    return M.doc_info(table(spark, d, "documents"))


def _marks(spark, d):
    return table(spark, d, "labels").select(F.col("quality").alias("a"), F.col("toxic").alias("b"))


@query("kappa_table", "select count(*) filter (quality = 1 and toxic = 1) as n11, count(*) filter (quality = 1 and toxic = 0) as n10, count(*) filter (quality = 0 and toxic = 1) as n01, count(*) filter (quality = 0 and toxic = 0) as n00 from labels")
def kappa_table(spark, d):
    return M.kappa_table(_marks(spark, d))


@query("cohen_kappa", "with x as (select avg((quality = toxic)::int) as po, avg(quality) as a, avg(toxic) as b from labels), y as (select po, a * b + (1 - a) * (1 - b) as pe from x) select case when pe >= 1 then 0.0 else round((po - pe) / (1 - pe), 6) end as kappa from y")
def cohen_kappa(spark, d):
    return M.cohen_kappa(_marks(spark, d))


_J = "j as (select event_type as module, row_number() over (partition by event_type order by event_id) - 1 as round, sign(user_id % 7 - 3)::int as judgment, event_id % 11 / 1.0 as s1, user_id % 10 / 1.0 as s2, (event_id + user_id) % 9 / 1.0 as s3 from events)"


def _judgments(spark, d):
    return table(spark, d, "events").selectExpr("event_type as module", "row_number() over (partition by event_type order by event_id) - 1 as round", "cast(sign(user_id % 7 - 3) as int) as judgment", "event_id % 11 / 1.0D as s1", "user_id % 10 / 1.0D as s2", "(event_id + user_id) % 9 / 1.0D as s3")


@query("judgment_majority", f"with {_J} select module, arg_max(judgment, (n, judgment)) as judgment from (select module, judgment, count(*) as n from j group by all) group by module")
def judgment_majority(spark, d):
    return M.majority(_judgments(spark, d), "module")


@query("flip_rates", f"""with {_J}, m as (select module, arg_max(judgment, (n, judgment)) as most from (select module, judgment, count(*) as n from j group by all) group by module),
a as (select module, round(avg((judgment <> most)::int), 6) as minority from j join m using (module) group by module), p as (select module, round // 2 as pair, min(judgment) <> max(judgment) as x from j group by all having count(*) = 2)
select module, minority, coalesce(adjacent, 0.0) as adjacent from a left join (select module, round(avg(x::int), 6) as adjacent from p group by module) using (module)""")
def flip_rates(spark, d):
    return M.flip_rates(_judgments(spark, d), "module")


@query("tie_rate", f"with {_J} select count(*) as n, round(avg((judgment = 0)::int), 6) as ties from j")
def tie_rate(spark, d):
    return M.tie_rate(_judgments(spark, d))


@query("module_std", f"with {_J} select module, round(sqrt((var_pop(s1) + var_pop(s2) + var_pop(s3)) / 3), 6) as std from j group by module")
def module_std(spark, d):
    return M.module_std(_judgments(spark, d), "module", ["s1", "s2", "s3"])


@query("pairwise_agreement", """with t as (select conv_id as module, turn as round, [length(text) % 5 / 1.0, length(text) % 7 / 1.0, turn / 1.0] as s from conversations), x as (select module, round, unnest(s) as s from t)
select a.module, count(*) as pairs, round(avg((abs(a.s - b.s) <= 1)::int), 6) as agreement from x a join x b on a.module = b.module and a.round < b.round group by a.module""")
def pairwise_agreement(spark, d):
    t = table(spark, d, "conversations").selectExpr("conv_id as module", "turn as round", "length(text) % 5 / 1.0D as s1", "length(text) % 7 / 1.0D as s2", "turn / 1.0D as s3")
    return M.pairwise_agreement(t, "module", ["s1", "s2", "s3"])


@query("position_bias", """with s as (select event_type as module, case when event_id % 2 = 0 then 'AB' else 'BA' end as o, value from events), m as (select module, avg(value) as mean from s where o = 'BA' group by module)
select s.module, round(abs(avg((value > mean)::int) - 0.5), 6) as bias from s join m on s.module = m.module where o = 'AB' group by s.module""")
def position_bias(spark, d):
    return M.position_bias(table(spark, d, "events").selectExpr("event_type as module", "case when event_id % 2 = 0 then 'AB' else 'BA' end as order", "value as score"), "module")


@query("rubric_aggregate", """with l as (select 'c' || c_custkey as node, 'n' || c_nationkey as parent, case when c_acctbal < 0 then 0.0 else greatest(1.0, least(3.0, c_custkey % 5)) end as w, case when c_acctbal < 0 then null else (c_acctbal > 5000)::int::double end as s from customer),
n as (select 'n' || n_nationkey as node, 'r' || n_regionkey as parent, case when sum(w) > 0 then sum(s * w) / sum(w) end as s, case when sum(w) > 0 then 1.0 else 0.0 end as w from l join nation on 'n' || n_nationkey = l.parent group by all),
r as (select parent as node, case when sum(w) > 0 then sum(s * w) / sum(w) end as s, case when sum(w) > 0 then 1.0 else 0.0 end as w from n group by parent)
select node, round(s, 6) as score, w::double as weight from l union all select node, round(s, 6), w::double from n union all select node, round(s, 6), w::double from r""")
def rubric_aggregate(spark, d):
    c = table(spark, d, "customer").selectExpr("'c' || c_custkey as node", "'n' || c_nationkey as parent", "2 as level", "cast(c_custkey % 5 as double) as weight", "case when c_acctbal < 0 then null else cast(c_acctbal > 5000 as int) end as verdict")
    used = table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    n = table(spark, d, "nation").join(used, "n_nationkey", "left_semi")
    r = n.selectExpr("'r' || n_regionkey as node", "cast(null as string) as parent", "0 as level", "1.0D as weight", "cast(null as int) as verdict").distinct()
    n = n.selectExpr("'n' || n_nationkey as node", "'r' || n_regionkey as parent", "1 as level", "1.0D as weight", "cast(null as int) as verdict")
    return M.rubric(c.union(n).union(r), 2)


@query("update_recall", "select count(*) filter (quality = 0) as changed, count(*) filter (quality = 0 and toxic = 0) as regenerated, round(count(*) filter (quality = 0 and toxic = 0)::double / count(*) filter (quality = 0), 6) as recall from labels")
def update_recall(spark, d):
    return M.recall(table(spark, d, "labels").select((F.col("quality") == 0).alias("changed"), (F.col("toxic") == 0).alias("regenerated")))


@query("verdict_scores", "select event_id, case when event_type = 'click' then null else greatest(0.0, least(10.0, round(value, 2))) end::double as score from events")
def verdict_scores(spark, d):
    said = F.expr("case when event_type = 'click' then 'no verdict' else 'so: {\"score\": ' || round(value, 2) || '} ok' end")
    return table(spark, d, "events").select("event_id", M.verdict_score(said).alias("score"))


@query("verdict_states", "select event_id, case event_type when 'click' then 'unparseable' when 'view' then 'uncertain' else 'judged' end as state from events")
def verdict_states(spark, d):
    said = F.expr("case event_type when 'click' then 'no verdict' when 'view' then '{\"uncertain\": true}' else 'so: {\"score\": ' || round(value, 2) || '} ok' end")
    return table(spark, d, "events").select("event_id", M.verdict_state(said).alias("state"))


@query("judged_mean", """with v as (select user_id as page, event_id as attempt, case event_type when 'click' then 'unparseable' when 'view' then 'uncertain' else 'judged' end as state, case when event_type not in ('click', 'view') then greatest(0.0, least(10.0, round(value, 2))) end as score from events),
f as (select page, arg_min(state, (state = 'uncertain', attempt)) as state, arg_min(struct_pack(s := score), (state = 'uncertain', attempt)) as x from v group by page)
select count(*) as pages, count(*) filter (state = 'judged') as judged, count(*) filter (state = 'uncertain') as uncertain, round(avg(x.s), 6) as mean from f""")
def judged_mean(spark, d):
    said = F.expr("case event_type when 'click' then 'no verdict' when 'view' then '{\"uncertain\": true}' else 'so: {\"score\": ' || round(value, 2) || '} ok' end")
    return M.judged_mean(table(spark, d, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("attempt"), said.alias("text")))


_TWO = "[(event_id % 11)::double, (event_id % 7)::double, (user_id % 9)::double, (event_id % 5)::double, (user_id % 6)::double] as a, [(user_id % 11)::double, (event_id % 8)::double, (event_id % 6)::double, (user_id % 5)::double, (event_id % 9)::double] as b"


def _scored(spark, d):
    names = "array('clarity', 'readability', 'conciseness', 'richness', 'structure')"
    one = lambda xs: "'{' || array_join(zip_with(" + names + ", array(" + ", ".join(xs) + "), (n, x) -> '\"' || n || '\": ' || x), ', ') || '}'"
    a = one(["event_id % 11 + 0.0", "event_id % 7 + 0.0", "user_id % 9 + 0.0", "event_id % 5 + 0.0", "user_id % 6 + 0.0"])
    b = one(["user_id % 11 + 0.0", "event_id % 8 + 0.0", "event_id % 6 + 0.0", "user_id % 5 + 0.0", "event_id % 9 + 0.0"])
    text = f"case when event_id % 10 = 3 then 'A is better' when event_id % 10 = 4 then '{{\"A\": {{\"clarity\": 3}}}}' else 'scores: {{\"A\": ' || {a} || ', \"B\": ' || {b} || '}}' end"
    # answers are long to read and their table is short: they are dealt out to all tasks, not read where the file's few parts lie
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")
    return rows.select("event_id", "user_id", "event_type", M.score_pairs(F.expr(text)).alias("x"))


@query("score_pairs", f"with s as (select event_id, {_TWO} from events) select event_id, case when event_id % 10 in (3, 4) then null else sign(list_sum(a) - list_sum(b))::int end as judgment, case when event_id % 10 in (3, 4) then null else list_sum(a) end as total from s")
def score_pairs(spark, d):
    x = _scored(spark, d)
    return x.select("event_id", M.judgment(F.col("x.a"), F.col("x.b")).alias("judgment"), F.aggregate("x.a", F.lit(0.0), lambda s, v: s + v).alias("total"))


@query("quality_report", f"""with s as (select event_type as module, event_id % 2 = 0 as a_first, {_TWO} from events where event_id % 10 not in (3, 4)), o as (select module, case when a_first then a else b end as old, (list_sum(a) = list_sum(b))::int as tie from s),
m as (select module, avg(old[1]) as m0, avg(old[2]) as m1, avg(old[3]) as m2, avg(old[4]) as m3, avg(old[5]) as m4, avg(tie) as tie, (stddev_pop(old[1]) + stddev_pop(old[2]) + stddev_pop(old[3]) + stddev_pop(old[4]) + stddev_pop(old[5])) / 5 as std from o group by module)
select count(*) as modules, round(avg(m0), 6) as mean_0, round(avg(m1), 6) as mean_1, round(avg(m2), 6) as mean_2, round(avg(m3), 6) as mean_3, round(avg(m4), 6) as mean_4, round(avg((m0 + m1 + m2 + m3 + m4) / 5), 6) as total, round(avg(tie), 6) as ties, round(avg(std), 6) as std from m""")
def quality_report(spark, d):
    x = _scored(spark, d).where("x is not null").select(F.col("event_type").alias("module"), F.col("event_id").alias("round"), (F.col("event_id") % 2 == 0).alias("a_first"), "x.a", "x.b")
    return M.quality_report(x)


@query("leaf_verdicts", """with v as (select user_id as leaf, case event_type when 'click' then true when 'view' then false end as vote from events), x as (select leaf, count(*) filter (vote) as t, count(*) filter (not vote) as f from v group by leaf)
select leaf, case when t > f then true when f > t then false end as verdict, t <> f as resolved from x""")
def leaf_verdicts(spark, d):
    return M.leaf_verdicts(table(spark, d, "events").select(F.col("user_id").alias("leaf"), F.when(F.col("event_type") == "click", True).when(F.col("event_type") == "view", False).alias("vote")))


@query("rubric_leaves", """with n as (select c_nationkey as tree, c_custkey, row_number() over (partition by c_nationkey order by c_custkey) as i, c_custkey % 3 as kids from customer),
x as (select *, 1 + coalesce(sum(1 + kids) over (partition by tree order by i rows between unbounded preceding and 1 preceding), 0) as pre from n),
l as (select tree, pre::bigint as node from x where kids = 0 union all select tree, (pre + k)::bigint from x, (select unnest([1, 2]) as k) where k <= kids)
select tree, node, row_number() over (partition by tree order by node) as place from l""")
def rubric_leaves(spark, d):
    """A rubric for each nation, as a judge writes it: one requirement, its customers below it, up to two below each of these."""
    kid = "case c_custkey % 3 when 0 then '' when 1 then '{\"requirement\": \"k1\"}' else '{\"requirement\": \"k1\"}, {\"requirement\": \"k2\", \"weight\": 2}' end"
    one = f"'{{\"requirement\": \"c\", \"weight\": 3, \"sub_tasks\": [' || {kid} || ']}}'"
    c = table(spark, d, "customer").selectExpr("c_nationkey as tree", "c_custkey", f"{one} as t").groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "t"))).alias("x"))
    text = F.concat(F.lit("```json\n{\"rubrics\": [{\"requirement\": \"root\", \"sub_tasks\": ["), F.array_join(F.transform("x", lambda r: r["t"]), ","), F.lit("]}]}\n```"))
    return M.leaves(M.rubric_nodes(c.select("tree", text.alias("text"))))


@query("gamma_sweep", """with m as (select r_regionkey as gamma, p_partkey % (10 * (r_regionkey + 1)) as community, p_brand as domain from part, region where p_partkey % 7 > r_regionkey), c as (select gamma, community, count(*) as n, count(distinct domain) as d from m group by all)
select gamma, count(*) as communities, count(*) filter (n = 1) as singletons, max(n) as largest, round(avg(n), 6) as mean, count(*) filter (d > 1) as mixed from c group by gamma""")
def gamma_sweep(spark, d):
    x = table(spark, d, "part").crossJoin(F.broadcast(table(spark, d, "region"))).where("p_partkey % 7 > r_regionkey")  # five regions
    return M.sweep(x.selectExpr("r_regionkey as gamma", "p_partkey % (10 * (r_regionkey + 1)) as community", "p_brand as domain"))
