"""Text, link graph and contract queries.

Benchmark passages ask, documents answer: every document is in the pool of one
passage (its id modulo the number of passages); gold are the documents that
hold the passage's text.  Suppliers and parts are the link graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import core as C
from ..operators import contract as K
from ..operators import text as T
from ..sources.corpus import scan_titles
from .registry import query, read

_POOL = """
nq as (select count(*) as n from benchmark),
qs as (select item_id as qid, text from benchmark),
pool as (select q.qid, d.doc_id as did, d.text from documents d, nq join qs q on q.qid = d.doc_id % nq.n)"""
_TOK = "regexp_extract_all(lower({}), '([a-z0-9]+)', 1)"


def _pool(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    qs = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    n = qs.count()
    pool = read(spark, sf_dir, "documents").select((F.col("doc_id") % n).alias("qid"), F.col("doc_id").alias("did"), "text")
    return qs, pool.join(qs.select("qid"), "qid", "left_semi")


_BM25 = f"""with {_POOL},
dt as (select qid, did, {_TOK.format("text")} as t from pool),
sz as (select qid, did, greatest(len(t), 1) as dl from dt), st as (select qid, count(*) as n, avg(dl) as avgdl from sz group by qid),
qt as (select qid, term, count(*) as qtf from (select qid, unnest({_TOK.format("text")}) as term from qs) group by all),
tf as (select qid, did, term, count(*) as tf from (select qid, did, unnest(t) as term from dt) group by all),
met as (select * from tf join qt using (qid, term)), df as (select qid, term, count(*) as df from met group by all),
sc as (select qid, did, sum(qtf * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl)))) as score
  from met join df using (qid, term) join sz using (qid, did) join st using (qid) group by all),
bm as (select qid, did, round(coalesce(score, 0), 6) as score from sz left join sc using (qid, did))"""


@query(_BM25 + " select * from bm")
def bm25_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.bm25_local(*_pool(spark, sf_dir))


@query(_BM25 + " select qid, did, score, row_number() over (partition by qid order by score desc, did) as rank from bm")
def rank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.bm25_local(*_pool(spark, sf_dir)).withColumn("rank", F.row_number().over(T.by_score()).cast("long"))


@query(_BM25 + """, w as (select *, exp(score - max(score) over (partition by qid)) as w, row_number() over (partition by qid order by score desc, did) as r from bm),
p as (select *, w / sum(w) over (partition by qid) as p from w)
select qid, round(coalesce(max(case when r = 1 then score end) - max(case when r = 2 then score end), 0), 6) as margin, round(-sum(p * ln(p + 1e-12)), 6) + 0.0::double as entropy from p group by qid""")
def score_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.margin_entropy(T.bm25_local(*_pool(spark, sf_dir)))


@query(_BM25 + """, gold as (select q.qid, d.doc_id as did from documents d join qs q on contains(d.text, q.text)),
g as (select qid, count(*) as n from gold group by qid), r as (select *, row_number() over (partition by qid order by score desc, did) as rank from bm),
h as (select r.qid, sum(case when gold.did is not null then 1 / log2(rank + 1) else 0 end) as dcg from r left join gold using (qid, did) where rank <= 10 group by r.qid),
i as (select qid, n, list_sum(list_transform(range(1, least(n, 10) + 1), lambda k: 1 / log2(k + 1))) as ideal from g)
select h.qid, round(case when ideal > 0 then dcg / ideal else 0 end, 6) as ndcg, coalesce(n, 0) as gold from h left join i using (qid)""")
def ndcg_binary_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    qs, pool = _pool(spark, sf_dir)
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("did"), "text")
    gold = T.holders(docs, qs).withColumn("hit", F.lit(True))
    n = gold.groupBy("qid").agg(F.count(F.lit(1)).alias("gold"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("gold", F.lit(10)).cast("int")), F.lit(0.0), lambda s, k: s + 1.0 / F.log2(k + 1.0))
    ranked = T.bm25_local(qs, pool).withColumn("rank", F.row_number().over(T.by_score())).where("rank <= 10").join(gold, ["qid", "did"], "left")
    dcg = ranked.groupBy("qid").agg(F.sum(F.when(F.col("hit"), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    return dcg.join(n, "qid", "left").select("qid", F.round(F.when(F.col("gold") > 0, F.col("dcg") / ideal).otherwise(0.0), 6).alias("ndcg"), F.coalesce("gold", F.lit(0)).alias("gold"))


_QT, _DT = f"list_distinct({_TOK.format('q.text')})", f"list_distinct({_TOK.format('p.p_name')})"


@query(f"""with x as (select item_id as qid, p_partkey as did, q.text as q, p_name as t, {_QT} as a, {_DT} as b from benchmark q join part p on p_partkey % (select count(*) from benchmark) = item_id)
select qid, did, round(case when len(b) > 0 then len(list_intersect(a, b)) / len(b) else 0 end + (contains(trim(regexp_replace(lower(replace(q, '_', ' ')), '\\s+', ' ', 'g')), trim(regexp_replace(lower(replace(t, '_', ' ')), '\\s+', ' ', 'g'))) and t <> '')::int, 6) as overlap from x""")
def title_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    qs = read(spark, sf_dir, "benchmark")
    n = qs.count()
    met = read(spark, sf_dir, "part").join(qs, F.col("p_partkey") % n == F.col("item_id"))
    return met.select(F.col("item_id").alias("qid"), F.col("p_partkey").alias("did"), F.round(C.overlap_share(F.col("text"), F.col("p_name")), 6).alias("overlap"))


@query("select p_partkey, trim(regexp_replace(lower(replace(p_type || '_' || p_name || '  X', '_', ' ')), '\\s+', ' ', 'g')) as title from part")
def norm_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("p_type", F.lit("_"), "p_name", F.lit("  X"))
    return read(spark, sf_dir, "part").select("p_partkey", C.norm_title(raw).alias("title"))


@query(f"select doc_id, len({_TOK.format('text')}) as n_tokens, len(list_distinct({_TOK.format('text')})) as n_distinct, array_to_string({_TOK.format('text')}[1:5], ' ') as first_five from documents")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = C.tokens(F.col("text"))
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.array_join(F.slice(t, 1, 5), " ").alias("first_five")
    )


_EDGES = """edges as (select distinct 's' || l_suppkey::varchar as src, 'p' || l_partkey::varchar as dst from lineitem union select distinct 'p' || l_partkey::varchar, 's' || l_suppkey::varchar from lineitem),
seeds as (select n_nationkey as qid, 's' || s_suppkey::varchar as node from supplier join nation on s_nationkey = n_nationkey)"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    line = read(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey").distinct()
    s, p = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    edges = line.select(s.alias("src"), p.alias("dst")).unionByName(line.select(p.alias("src"), s.alias("dst")))
    nodes = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    seeds = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return seeds.select(F.col("n_nationkey").alias("qid"), nodes.alias("node")), edges


_HOP1 = f"""with {_EDGES}, f as (select qid, dst as node, count(*) as links from seeds join edges on node = src group by all),
h1 as (select *, row_number() over (partition by qid order by links desc, node) as place from f where (qid, node) not in (select qid, node from seeds) qualify place <= 20)"""


@query(_HOP1 + " select * from h1")
def expand_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds, edges = _graph(spark, sf_dir)
    return T.expand(seeds, edges, 20)


@query(_HOP1 + """, f2 as (select qid, dst as node, count(*) as links from h1 join edges on node = src group by all)
select qid, node, links, row_number() over (partition by qid order by links desc, node) as place from f2
where (qid, node) not in (select qid, node from seeds) and (qid, node) not in (select qid, node from h1) qualify place <= 10""")
def expand_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds, edges = _graph(spark, sf_dir)
    return T.expand(T.expand(seeds, edges, 20), edges, 10, seeds)


_CTX = """edges as (select distinct l_suppkey as src, l_partkey as dst from lineitem union select distinct l_partkey, l_suppkey from lineitem),
pool as (select distinct l_orderkey % 50 as qid, l_suppkey as node, min(l_linenumber) over (partition by l_orderkey % 50, l_suppkey) = 1 as anchor from lineitem)"""


def _context(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    line = read(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_partkey", "l_linenumber")
    edges = line.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).unionByName(line.select("l_partkey", "l_suppkey").toDF("src", "dst")).distinct()
    pool = line.groupBy((F.col("l_orderkey") % 50).alias("qid"), F.col("l_suppkey").alias("node")).agg((F.min("l_linenumber") == 1).alias("anchor"))
    return pool, edges


_ONE = f"""with {_CTX}, ins as (select a.qid, src, dst, a.anchor as fa, b.anchor as ta from pool a join edges on a.node = src join pool b on b.qid = a.qid and b.node = dst),
i as (select qid, dst as node, sum(fa::int) as d, count(*) as ind from ins group by all), o as (select qid, src as node, sum(ta::int) as r, count(*) as outd from ins group by all),
one as (select qid, node, coalesce(d, 0) + 0.75::double * coalesce(r, 0) as one, coalesce(outd, 0) as out_degree, coalesce(ind, 0) as in_degree from pool left join i using (qid, node) left join o using (qid, node))"""


@query(_ONE + " select * from one")
def graph_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.one_hop_scores(*_context(spark, sf_dir))


@query(_ONE + """, p as (select x.qid, y.dst as node, count(*) as paths from ins x join ins y on x.qid = y.qid and x.dst = y.src where x.fa group by all)
select qid, node, round(one + 0.5::double * coalesce(paths, 0) + 0.05::double * (out_degree + in_degree), 6) as two from one left join p using (qid, node)""")
def graph_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.two_hop_scores(*_context(spark, sf_dir))


@query(_BM25 + """, a as (select *, row_number() over (partition by qid order by md5(qid::varchar || ':13:shuffle:' || did::varchar), did) as place from bm),
b as (select qid, score as dealt, row_number() over (partition by qid order by did) as place from bm) select qid, did, dealt as score from a join b using (qid, place)""")
def ctl_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.shuffled_within(T.bm25_local(*_pool(spark, sf_dir)), 13, "shuffle")


@query("with f as (select p_name, count(*) as n from part group by 1) select p_partkey, n as title_count, round(ln(1 + n), 6) as log_count from part join f using (p_name)")
def ctl_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return part.join(part.groupBy("p_name").agg(F.count(F.lit(1)).alias("title_count")), "p_name").select("p_partkey", "title_count", F.round(F.log1p("title_count"), 6).alias("log_count"))


@query("""with o as (select p_type, p_name, min(p_partkey) as first from part group by all) select p_type, string_agg(p_name, ' | ' order by first) as titles from o group by p_type""")
def dedup_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda s: s["p_name"])
    return read(spark, sf_dir, "part").groupBy("p_type").agg(F.array_join(F.array_distinct(listed), " | ").alias("titles"))


_TITLED = r"""with p as (select page_id, regexp_extract(html, '<title>([^<]*)', 1) as title, regexp_extract_all(html, '<p>([^<]*)', 1) as sentences, regexp_extract_all(html, 'href="/([^"]*)"', 1) as slugs from pages),
n as (select *, trim(regexp_replace(lower(replace(title, '_', ' ')), '\s+', ' ', 'g')) as norm_title from p)
select page_id::varchar as id, norm_title, len(sentences) as sentences, array_to_string(sentences, ' ') as text,
  len(list_distinct(list_transform(list_filter(slugs, lambda x: trim(x) <> ''), lambda x: trim(regexp_replace(lower(replace(x, '_', ' ')), '\s+', ' ', 'g'))))) as degree
from n where norm_title in (select norm_title from n where page_id % 10 = 3)"""


@query(_TITLED)
def src_linkcorpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as lines of JSON, scanned for the titles of every tenth page."""
    pages = read(spark, sf_dir, "pages")
    slugs = F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))
    row = F.struct(
        F.col("page_id").cast("string").alias("id"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.regexp_extract_all("html", F.lit("<p>([^<]*)"), F.lit(1)).alias("sentences"),
        F.transform(slugs, lambda s: F.struct(s.alias("ref_url"))).alias("mentions"),
    )
    needed = pages.where("page_id % 10 = 3").select(F.translate(F.regexp_extract("html", "<title>([^<]*)", 1), " ", "_").alias("title"))
    found = scan_titles(pages.select(F.to_json(row).alias("value")), needed)
    return found.select("id", "norm_title", F.size("sentences").alias("sentences"), "text", "degree")


@query("""with k as (select p_partkey, lower(trim(' ' || p_name || '-' || p_brand || '! ')) as k from part) select p_partkey, regexp_replace(regexp_replace(k, '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') as key from k""")
def norm_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" "), "p_name", F.lit("-"), "p_brand", F.lit("! "))
    return read(spark, sf_dir, "part").select("p_partkey", C.norm_key(raw).alias("key"))


_SUBMISSION = """sub as (select event_id as line, user_id::varchar as query_id, event_type as route, value as runtime_s, props,
  case when event_type = 'error' then null else event_type end as r, event_type = 'error' and value > 5 as abstain from events)"""


def _submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("line"), F.col("user_id").cast("string").alias("query_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("route"),
        ((F.col("event_type") == "error") & (F.col("value") > 5)).alias("abstain"), F.col("value").alias("runtime_s"), "props",
    )


@query(f"with {_SUBMISSION}, c as (select *, count(*) over (partition by query_id) as n from sub) select query_id, n, min(line) as first_line from c where n > 1 group by all")
def dup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.duplicates(_submission(spark, sf_dir), ["query_id"])


@query(f"with {_SUBMISSION} select query_id, line, r as route from sub qualify row_number() over (partition by query_id order by line desc) = 1")
def manifest_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.last_wins(_submission(spark, sf_dir), ["query_id"]).select("query_id", "line", "route")


@query("""with m as (select n_name as view_id, n_regionkey as cost from nation), c as (select r_regionkey as k from region where r_regionkey > 0)
select view_id, case when k is null then 'no cost' else '' end as error from m left join c on cost = k""")
def menu_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = read(spark, sf_dir, "nation").select(F.col("n_name").alias("view_id"), F.col("n_regionkey").alias("cost_key"))
    costs = read(spark, sf_dir, "region").where("r_regionkey > 0").select(F.col("r_regionkey").alias("cost_key"), F.lit(1.0).alias("cost"))
    return K.menu_errors(views, costs)


@query("select conv_id, turn, role from conversations")
def visible_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.visible(read(spark, sf_dir, "conversations"), ["conv_id", "turn", "role"], hidden=["target_points", "oracle_view"])


_SCORE = """vs as (select l_orderkey as query_id, l_linenumber as view, max(l_quantity) / 50 as score from lineitem group by all),
picked as (select o_orderkey as query_id, o_orderkey % 9 as route from orders),
orc as (select query_id, max(round(score - 0.08::double * view / 7, 9)) as best from vs group by query_id),
sc as (select p.query_id, coalesce(v.score, 0) as quality, case when v.score is null then 0 else route / 7.0::double end as cost, o.best from picked p join orc o using (query_id) left join vs v on v.query_id = p.query_id and v.view = p.route),
rowm as (select query_id, round(quality, 6) as quality, round(cost, 6) as cost, round(quality - 0.08::double * cost, 6) as utility, round(greatest(0.0::double, best - (quality - 0.08::double * cost)), 6) as regret from sc)"""


@query(f"with {_SCORE} select * from rowm")
def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.score(*_scored(spark, sf_dir))


@query(f"with {_SCORE} select count(*) as rows, round(avg(quality), 6) as quality, round(avg(cost), 6) as cost, round(avg(utility), 6) as utility, round(avg(regret), 6) as regret from rowm")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.score_summary(K.score(*_scored(spark, sf_dir)))


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    line = read(spark, sf_dir, "lineitem")
    reference = line.groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("view")).agg((F.max("l_quantity") / 50).alias("score")).withColumn("cost", F.col("view") / 7.0)
    routes = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), (F.col("o_orderkey") % 9).cast("int").alias("route"))
    return routes, reference


@query("""with o as (select l_orderkey as cell, array_agg(l_linenumber order by l_quantity desc, l_linenumber) as ranked, arg_min(l_linenumber, (l_extendedprice, l_linenumber)) as oracle from lineitem group by 1),
p as (select *, list_position(ranked, oracle) as pos from o)
select count(*) as cells, round(avg((pos <= 1)::int), 6) as top1, round(avg((pos <= 3)::int), 6) as top3, round(avg(coalesce(1.0::double / pos, 0)), 6) as mrr from p""")
def legacy_view_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("l_quantity")).alias("q"), "l_linenumber"))), lambda s: s["l_linenumber"]).alias("ranked"),
        F.min_by("l_linenumber", F.struct("l_extendedprice", "l_linenumber")).alias("oracle"),
    )
    pos = F.expr("array_position(ranked, oracle)")
    return per.select(pos.alias("pos")).agg(
        F.count(F.lit(1)).alias("cells"), F.round(F.avg((F.col("pos") <= 1).cast("int")), 6).alias("top1"), F.round(F.avg((F.col("pos") <= 3).cast("int")), 6).alias("top3"),
        F.round(F.avg(F.when(F.col("pos") > 0, 1.0 / F.col("pos")).otherwise(0.0)), 6).alias("mrr"),
    )
