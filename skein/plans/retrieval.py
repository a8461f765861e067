"""Queries over retrieval operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import retrieval as R
from skein.operators.postings import TextIndex
from skein.operators.vector_index import VectorIndex
from skein.plans.common import table
from skein.registry import query
from skein.sources.scratch import Scratch


@query("tokenize_documents", "select doc_id, t as term, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) as t from documents) group by all")
def tokenize_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query("cjk_bigrams", """with x as (select r_regionkey, '代码图' as a, '索引' as b, 'z' as c from region)
select r_regionkey, '代码 码图 索引' as grams, len(r_name) + len(regexp_extract_all(r_name, '[A-Za-z0-9]+')) + 4 as n from x join region using (r_regionkey)""")
def cjk_bigrams(spark, d):
    t = F.concat(F.lit("代码图 "), F.col("r_name"), F.lit("索引z字"))
    return table(spark, d, "region").select("r_regionkey", T.cjk_tokens(t).alias("grams"), (F.length("r_name") + F.size(T.tokens(t))).alias("n"))


_BM25 = """df as (select term, count(*) as df from p group by term), st as (select count(*) as n, avg(length) as mean from (select distinct node, length from p)),
s as (select query, node, round(sum(greatest(ln((st.n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / st.mean))), 6) as score from q join df using (term) join p using (term), st group by query, node),
text_hits as (select * from (select query, node, score, row_number() over (partition by query order by score desc, node) as rank from s) where rank <= 10)"""
_DOCS = """t as (select doc_id as node, regexp_extract_all(lower(text), '[a-z0-9]+') as ts from documents), p as (select node, len(ts) as length, term, count(*)::double as tf from (select node, ts, unnest(ts) as term from t) group by all),
q as (select distinct item_id as query, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from benchmark)"""


def _items(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.explode(T.tokens(F.lower("text"))).alias("term"))


@query("bm25_topk", f"with {_DOCS}, {_BM25} select * from text_hits")
def bm25_topk(spark, d):
    return R.text_search(table(spark, d, "documents"), "doc_id", {"text": 1}, _items(spark, d))


@query("bm25_field_weighted", f"""with t as (select p_partkey as node, regexp_extract_all(lower(p_name), '[a-z0-9]+') as a, regexp_extract_all(lower(p_type), '[a-z0-9]+') as b, regexp_extract_all(lower(p_brand), '[a-z0-9]+') as c from part),
x as (select node, unnest(a) as term, 5 as w from t union all select node, unnest(b), 3 from t union all select node, unnest(c), 1 from t),
p as (select x.node, len(a) + len(b) + len(c) as length, term, sum(w)::double as tf from x join t on t.node = x.node group by all),
q as (select distinct n_nationkey as query, unnest(['steel', 'brand', 'part', n_nationkey::varchar]) as term from nation), {_BM25} select * from text_hits""")
def bm25_field_weighted(spark, d):
    q = table(spark, d, "nation").select(F.col("n_nationkey").alias("query"), F.explode(F.array(F.lit("steel"), F.lit("brand"), F.lit("part"), F.col("n_nationkey").cast("string"))).alias("term"))
    return R.text_search(table(spark, d, "part"), "p_partkey", {"p_name": 5, "p_type": 3, "p_brand": 1}, q)


_NEAR = """v as (select vec_id as node, [x::double for x in embedding] as v from embeddings), k as (select node as query, v as q from v where node % 20 = 0),
vec as (select query, node, round(1 - list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v))), 6) + 0.0 as distance from k, v),
near as (select * from (select query, node, distance, row_number() over (partition by query order by distance, node) as rank from vec where distance <= 0.7) where rank <= 10)"""


def _near(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("v"))
    return R.neighbours(v, v.where("node % 20 = 0").select(F.col("node").alias("query"), F.col("v").alias("q")))


@query("knn_threshold", f"with {_NEAR} select * from near")
def knn_threshold(spark, d):
    return _near(spark, d)


@query("vector_scores", f"with {_NEAR} select query, node, round(1 - distance, 6) + 0.0 as score from near")
def vector_scores(spark, d):
    return _near(spark, d).select("query", "node", (F.round(1 - F.col("distance"), 6) + F.lit(0.0)).alias("score"))


_FUSE = "f as (select query, node, round(sum(20.0::double / (20 + rank - 1)), 6) as score from (select query, node, rank from text_hits union all select query, node, rank from near) group by all), fused as (select * from (select query, node, score, row_number() over (partition by query order by score desc, node) as rank from f) where rank <= 10)"


@query("rrf_fusion", f"with {_DOCS}, {_BM25}, {_NEAR}, {_FUSE} select * from fused")
def rrf_fusion(spark, d):
    return R.fuse([R.text_search(table(spark, d, "documents"), "doc_id", {"text": 1}, _items(spark, d)), _near(spark, d)])


@query("hybrid_search", f"with {_DOCS}, {_BM25}, {_NEAR}, {_FUSE} select query, node, score, fused.rank, source, lang from fused left join documents on doc_id = node")
def hybrid_search(spark, d):
    return rrf_fusion(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("node"), "source", "lang"), "node", "left")


@query("call_chain_enrichment", """with h as (select 'c' || c_custkey as name, c_acctbal from customer), e as (select distinct 'c' || o_custkey as name, 's' || l_suppkey as callee from lineitem join orders on l_orderkey = o_orderkey),
i as (select name, string_agg(callee, ',' order by callee) as callees from e group by name) select h.name, c_acctbal, coalesce(callees, '') as callees from h left join i using (name)""")
def call_chain_enrichment(spark, d):
    from skein.plans.common import calls

    e = calls(spark, d)
    index = e.groupBy(F.col("src").alias("name")).agg(F.sort_array(F.collect_list("dst")).alias("callees"))
    hits = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("name"), "c_acctbal")
    return R.enrich(hits, index.withColumn("callers", F.array().cast("array<string>"))).select("name", "c_acctbal", F.array_join("callees", ",").alias("callees"))


@query("symbol_lookup", "select p_brand as file, min(p_partkey) as line, arg_min(p_type, p_partkey) as kind from part where p_size = 7 group by p_brand")
def symbol_lookup(spark, d):
    e = table(spark, d, "part").select(F.col("p_brand").alias("file"), F.concat(F.lit("s"), "p_size").alias("name"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("line"))
    return R.symbol(e, "s7")


@query("definition_names", "select distinct p_name as name from part")
def definition_names(spark, d):
    return table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()


@query("page_keyword_retrieval", """with q as (select item_id as query, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) as keyword from benchmark), k as (select distinct keyword from q),
c as (select doc_id as page, keyword, ((length(text) - length(replace(text, keyword, ''))) // length(keyword))::bigint as n from documents, k where contains(text, keyword)),
h as (select query, page, sum(n)::bigint as hits from c join q using (keyword) group by all)
select query, page, hits, rank, md5(left(text, 3000)) as snippet from (select query, page, hits, row_number() over (partition by query order by hits desc, page) as rank from h) join documents on doc_id = page where rank <= 10""")
def page_keyword_retrieval(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.explode(T.tokens(F.col("text"))).alias("keyword"))
    return R.page_hits(table(spark, d, "documents").select(F.col("doc_id").alias("page"), "text"), q).withColumn("snippet", F.md5("snippet"))


@query("phrase_retrieval", """with w as (select item_id as query, regexp_extract_all(text, '[A-Za-z0-9]+ [A-Za-z0-9]+') as w from benchmark), q as (select query, unnest(w) as keyword from w), k as (select distinct keyword from q),
c as (select doc_id as page, keyword, ((length(text) - length(replace(text, keyword, ''))) // length(keyword))::bigint as n from documents, k where contains(text, keyword)),
h as (select query, page, sum(n)::bigint as hits from c join q using (keyword) group by all)
select query, page, hits, rank, md5(left(text, 3000)) as snippet from (select query, page, hits, row_number() over (partition by query order by hits desc, page) as rank from h) join documents on doc_id = page where rank <= 10""")
def phrase_retrieval(spark, d):
    """Keywords with white space in them."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+ [A-Za-z0-9]+"), F.lit(0))).alias("keyword"))
    return R.page_hits(table(spark, d, "documents").select(F.col("doc_id").alias("page"), "text"), q).withColumn("snippet", F.md5("snippet"))


def _stored_text(spark, d):
    ix = TextIndex(spark, Scratch(spark, "text-index").folder(), {"text": 1.0})
    ix.add(table(spark, d, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("node"), "text"))
    return ix


@query("stored_bm25_topk", f"with {_DOCS}, {_BM25} select * from text_hits")
def stored_bm25_topk(spark, d):
    """Documents are indexed once; the searches read the blocks of their terms."""
    return _stored_text(spark, d).search(_items(spark, d))


@query("stored_knn", f"with {_NEAR} select * from near")
def stored_knn(spark, d):
    """Vectors are indexed once; the searches read lists that may hold near ones."""
    v = table(spark, d, "embeddings").select(F.coalesce("label", F.lit(-1)).cast("string").alias("file"), F.col("vec_id").alias("node"), F.col("embedding").alias("v"))
    ix = VectorIndex(spark, Scratch(spark, "vector-index").folder())
    ix.add(v)
    return ix.search(v.where("node % 20 = 0").select(F.col("node").alias("query"), F.col("v").alias("q")))


@query("containing_block", """with n as (select l_orderkey * 10 + l_linenumber as node, l_suppkey as path, l_partkey as a, l_partkey + l_linenumber as b from lineitem),
k as (select p_partkey as block, p_partkey % (select count(*) from supplier) + 1 as path, p_partkey // 2 as ba, p_partkey + p_size as bb from part),
i as (select n.node, arg_min(block, (bb - ba, block)) as block from n join k on n.path = k.path and ba <= a and bb >= b group by n.node) select n.node, block from n left join i using (node)""")
def containing_block(spark, d):
    s = table(spark, d, "supplier").count()
    n = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("node"), F.col("l_suppkey").alias("path"), F.col("l_partkey").alias("a"), (F.col("l_partkey") + F.col("l_linenumber")).alias("b"))
    k = table(spark, d, "part").select(F.col("p_partkey").alias("block"), (F.col("p_partkey") % s + 1).alias("path"), F.expr("p_partkey div 2").alias("ba"), (F.col("p_partkey") + F.col("p_size")).alias("bb"))
    return R.tightest_block(n, k)


@query("block_dedup", "select p_brand as block, arg_min(p_partkey, (p_size <> 1, p_partkey)) as node from part group by p_brand")
def block_dedup(spark, d):
    return R.block_nodes(table(spark, d, "part").select(F.col("p_brand").alias("block"), F.col("p_partkey").alias("node"), (F.col("p_size") == 1).alias("starts")))


@query("embedding_text", """with x as (select p_partkey, 'fn ' || p_name || ' in ' || p_brand || chr(10) || case when length(repeat(p_type || ' ', 12)) > 160 then left(repeat(p_type || ' ', 12), 160) || '…' else repeat(p_type || ' ', 12) end || chr(10) || p_name || chr(10) || p_type as t from part)
select p_partkey, t as template from x""")
def embedding_text(spark, d):
    sig = F.expr("repeat(p_type || ' ', 12)")
    return table(spark, d, "part").select("p_partkey", R.embedding_text(F.lit("fn"), F.col("p_name"), F.col("p_brand"), sig, F.col("p_name"), F.col("p_type")).alias("template"))


@query("cosine_pairs", """with v as (select vec_id, label, [x::double for x in embedding] as v from embeddings), w as (select *, lag(vec_id) over (partition by label order by vec_id) as b from v)
select w.vec_id as a, w.b, round(list_dot_product(w.v, v.v) / (sqrt(list_dot_product(w.v, w.v)) * sqrt(list_dot_product(v.v, v.v))), 6) as score from w join v on w.b = v.vec_id""")
def cosine_pairs(spark, d):
    """Each vector and the one before it of the same label."""
    v = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    w = v.withColumn("before", F.lag(F.struct("vec_id", "embedding")).over(Window.partitionBy("label").orderBy("vec_id"))).where("before is not null")
    return w.select(F.col("vec_id").alias("a"), F.col("before.vec_id").alias("b"), F.round(R.cosine(F.col("embedding"), F.col("before.embedding")), 6).alias("score"))


_DEFS = """ent as (select 'f' || p_partkey % 40 || '.rs' as path, p_partkey as pos, p_name as name, p_type as kind, p_brand as signature, p_partkey // 3 as line_start, p_partkey // 3 + p_size // 5 as line_end from part),
fs as (select 'f' || s_suppkey || '.rs' as path, s_suppkey % 90 as lines from supplier union select 'f' || r_regionkey || '.txt', r_regionkey from region),
r as (select *, max(line_end) over (partition by path order by line_start, line_end desc, pos rows between unbounded preceding and 1 preceding) as reach from ent),
t as (select path, name, kind, signature, line_start as ba, line_end as bb from r where reach is null or reach < line_start),
b as (select path || '#' || ba || '-' || bb as block, * from t union all select path || '#1-' || greatest(1, lines), path, path, 'file', '', 1, greatest(1, lines)::int from fs where path not in (select path from t))"""


def _definitions(spark, d):
    e = table(spark, d, "part").selectExpr("'f' || p_partkey % 40 || '.rs' as path", "p_partkey as pos", "p_name as name", "p_type as kind", "p_brand as signature", "cast(p_partkey div 3 as int) as line_start", "cast(p_partkey div 3 + p_size div 5 as int) as line_end")
    f = table(spark, d, "supplier").selectExpr("'f' || s_suppkey || '.rs' as path", "s_suppkey % 90 as lines").union(table(spark, d, "region").selectExpr("'f' || r_regionkey || '.txt'", "r_regionkey"))
    return f, e


@query("top_blocks", f"with {_DEFS} select * from b")
def top_blocks(spark, d):
    return R.top_blocks(*_definitions(spark, d))


@query("index_items", f"""with {_DEFS}, i as (select e.pos as node, arg_min(block, (bb - ba, block)) as block from ent e join b on e.path = b.path and ba <= line_start and bb >= line_end where e.pos % 5 <> 0 group by e.pos),
n as (select pos + case when pos % 5 = 0 then 1000000 else 0 end as node, case when pos % 5 = 0 then 'gone.rs' else path end as path, line_start as a, line_end as b_ from ent),
p as (select coalesce(i.block, n.path || '#' || n.a || '-' || n.b_) as block, n.node, coalesce(n.a = ba, true) as starts from n left join i using (node) left join b on b.block = i.block)
select block, arg_min(node, (not starts, node)) as node from p group by block""")
def index_items(spark, d):
    f, e = _definitions(spark, d)
    n = e.selectExpr("pos + case when pos % 5 = 0 then 1000000 else 0 end as node", "case when pos % 5 = 0 then 'gone.rs' else path end as path", "line_start as a", "line_end as b")
    return R.index_items(n, R.top_blocks(f, e))


@query("block_headers", r"""with x as (select p_partkey, case p_size % 4 when 0 then 'pub fn ' || p_name || ' {' || chr(10) || 'a }' when 1 then 'export class ' || p_name when 2 then 'fn x()' || chr(10) || 'public y' else 'public int ' || p_name || ' { }' end as t, p_size, p_name from part)
select p_partkey, case p_size % 4 when 0 then 'pub fn ' || p_name when 1 then 'export class ' || p_name when 2 then 'fn x()' else 'public int ' || p_name end as header, case p_size % 4 when 0 then 'pub' when 1 then 'export' when 3 then 'public' end as visibility from x""")
def block_headers(spark, d):
    t = F.expr("case p_size % 4 when 0 then 'pub fn ' || p_name || ' {' || chr(10) || 'a }' when 1 then 'export class ' || p_name when 2 then 'fn x()' || chr(10) || 'public y' else 'public int ' || p_name || ' { }' end")
    return table(spark, d, "part").select("p_partkey", R.header(t).alias("header"), R.header_visibility(t).alias("visibility"))


@query("semantic_search", f"""with {_NEAR}, x as (select query, node, distance, 'b' || node // 4 as block from near), y as (select *, row_number() over (partition by query, block order by distance, node) as r from x)
select query, block, node, round(1 - distance, 6) + 0.0 as score, row_number() over (partition by query order by distance, node) as rank from y where r = 1""")
def semantic_search(spark, d):
    return R.nearest_blocks(_near(spark, d), table(spark, d, "embeddings").selectExpr("vec_id as node", "'b' || vec_id div 4 as block"))


@query("embedding_batches")
def embedding_batches(spark, d):
    """Vectors of an embedder without a model have no SQL; tests hold them against one call a text."""
    return R.embed(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), R.hashed_vector, 64).select("id", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


@query("tagged_hits", f"with {_DOCS}, {_BM25}, {_NEAR} select query, node, rank, 'text' as source from text_hits union all select query, node, rank, 'semantic' from near")
def tagged_hits(spark, d):
    return R.tagged(bm25_topk(spark, d).select("query", "node", "rank"), "text").union(R.tagged(_near(spark, d).select("query", "node", "rank"), "semantic"))
