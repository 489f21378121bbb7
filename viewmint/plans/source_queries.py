"""Shapes of source rows, support metrics and what is joined from several files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import core as C
from ..operators import metrics as M
from ..operators import text as T
from ..sources import files
from .fixtures import VM, view_table
from .geometry_queries import _POINTS, _sides
from .registry import query, read
from .text_queries import _BM25, _CTX, _context, _graph, _HOP1, _pool

_RANKED = _BM25 + ", r as (select *, row_number() over (partition by qid order by score desc, did) as rank from bm), gold as (select q.qid, d.doc_id as did from documents d join qs q on contains(d.text, q.text))"


def _ranked(spark, sf_dir):
    qs, pool = _pool(spark, sf_dir)
    ranked = T.bm25_local(qs, pool).withColumn("rank", F.row_number().over(T.by_score()).cast("long")).withColumn("view", F.lit("full"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("did"), "text")
    gold = T.holders(docs, qs).withColumn("rel", F.lit(1.0))
    return ranked, gold


@query(_RANKED + """, n as (select qid, count(*) as n from gold group by qid), h as (select r.qid, count(gold.did) as hits from r left join gold using (qid, did) where rank <= 5 group by r.qid)
select h.qid, round(coalesce(hits / n, 0), 6) as recall, coalesce(n, 0) as support from h left join n using (qid)""")
def support_title_recall(spark, sf_dir):
    ranked, gold = _ranked(spark, sf_dir)
    n = gold.groupBy("qid").agg(F.count(F.lit(1)).alias("support"))
    return M.set_metrics(ranked, gold, 5).select("qid", "recall").join(n, "qid", "left").na.fill(0, ["support"])


@query(_RANKED + """, n as (select qid, count(*) as n from gold group by qid), h as (select r.qid, count(gold.did) as hits, count(*) as shown from r left join gold using (qid, did) where rank <= 3 group by r.qid),
p as (select h.qid, hits / shown as p, coalesce(hits / n, 0) as r from h left join n using (qid)) select qid, round(2 * p * r / greatest(p + r, 1e-12::double), 6) as f1 from p""")
def support_sentence_f1(spark, sf_dir):
    return M.set_metrics(*_ranked(spark, sf_dir), 3).select("qid", "f1")


@query(_RANKED + ", d as (select qid, min(rank) as first from r join gold using (qid, did) group by qid) select q.qid, coalesce(first, 0) as first_rank, round(coalesce(1 / first, 0), 6) as reciprocal from qs q left join d using (qid)")
def endpoint_rank(spark, sf_dir):
    ranked, gold = _ranked(spark, sf_dir)
    first = ranked.join(gold, ["qid", "did"]).groupBy("qid").agg(F.min("rank").alias("first"))
    qs = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    return qs.join(first, "qid", "left").select("qid", F.coalesce("first", F.lit(0)).alias("first_rank"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal"))


@query(_HOP1 + ", u as (select node, 1 as prio, 'seed' as src from seeds union all select node, 2, 'hop1' from h1) select node, arg_max(src, prio) as source, count(*) as seen from u group by node")
def doc_map(spark, sf_dir):
    """Each page from the last source that has it: seeds, then expansions."""
    seeds, edges = _graph(spark, sf_dir)
    both = seeds.select("node", F.lit(1).alias("prio"), F.lit("seed").alias("src")).unionByName(T.expand(seeds, edges, 20).select("node", F.lit(2).alias("prio"), F.lit("hop1").alias("src")))
    return both.groupBy("node").agg(F.max_by("src", "prio").alias("source"), F.count(F.lit(1)).alias("seen"))


@query(_HOP1 + " select qid, string_agg(node, ' ' order by place) as text from h1 where place <= 4 group by qid")
def expand_text(spark, sf_dir):
    seeds, edges = _graph(spark, sf_dir)
    best = T.expand(seeds, edges, 20).where("place <= 4").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "node"))).alias("l"))
    return best.select("qid", F.array_join(F.transform("l", lambda s: s["node"]), " ").alias("text"))


@query("""select 'orders' as audit, max(o_totalprice) as top, count(*) as n from orders union all select 'lines', max(l_extendedprice), count(*) from lineitem union all select 'events', max(value), count(*) from events""")
def compact_audit(spark, sf_dir):
    one = lambda t, c, n: read(spark, sf_dir, t).agg(F.lit(n).alias("audit"), F.max(c).alias("top"), F.count(F.lit(1)).alias("n"))
    return one("orders", "o_totalprice", "orders").unionByName(one("lineitem", "l_extendedprice", "lines")).unionByName(one("events", "value", "events"))


@query("""select o_orderstatus || '-' || o_orderkey::varchar as cell_id, o_orderstatus from orders qualify row_number() over (partition by o_orderstatus order by md5('9:' || o_orderkey::varchar), o_orderkey) <= 20""")
def stratified_probe(spark, sf_dir):
    order = Window.partitionBy("o_orderstatus").orderBy(F.md5(F.concat(F.lit("9:"), F.col("o_orderkey").cast("string"))), "o_orderkey")
    return read(spark, sf_dir, "orders").withColumn("r", F.row_number().over(order)).where("r <= 20").select(F.concat_ws("-", "o_orderstatus", F.col("o_orderkey").cast("string")).alias("cell_id"), "o_orderstatus")


@query(f"with {VM} select query_id, any_value(dataset) as dataset, " + ", ".join(f"max(case when view = '{v}' then quality end) as q_{v}" for v in ("summary", "pq", "full")) + " from vm group by query_id")
def query_feature_concat(spark, sf_dir):
    w = view_table(spark, sf_dir).groupBy("query_id", "dataset").pivot("view", ["summary", "pq", "full"]).agg(F.max("quality"))
    return w.withColumnsRenamed({v: f"q_{v}" for v in ("summary", "pq", "full")})


@query("""with p as (select event_type as security, ts::date as d, 'PX_LAST' as field, value as v, event_id as line from events where value > 0)
select security, d as date, arg_max(v, line) as price from p group by all""")
def src_prices(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("security"), F.col("ts").cast("date").alias("date"), F.lit("PX_LAST").alias("field"), F.col("value").cast("string").alias("value"), F.col("event_id").alias("line"))
    return files.prices(e)


_TYPES = ["signup", "error", "click", "view", "purchase"]


@query("select ts::date as date, " + ", ".join(f"round(sum(case when event_type = '{t}' then value end), 6) as \"{t}\"" for t in _TYPES) + " from events group by 1")
def snk_wide(spark, sf_dir):
    w = read(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("date")).pivot("event_type", _TYPES).agg(F.round(F.sum("value"), 6))
    return w.select("date", *_TYPES)


@query("""with j as (select item_id as qid from benchmark order by md5('4:' || item_id::varchar), item_id limit 15), rel as (select b.item_id as qid, d.doc_id as did from benchmark b join documents d on contains(d.text, b.text)),
w as (select rel.* from rel join j using (qid)) select qid, did from w""")
def src_ir(spark, sf_dir):
    """Judged queries up to a number, with the judgements that remain."""
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    rel = T.holders(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("did"), "text"), q)
    order = F.md5(F.concat(F.lit("4:"), F.col("qid").cast("string")))
    return rel.join(q.select("qid").orderBy(order, "qid").limit(15), "qid", "left_semi")


@query("""with p as (select user_id, max((event_type = 'purchase')::int) as bought, max((event_type = 'error')::int) as failed from events group by 1)
select bought, failed, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share, bought <> failed as disagree from p group by bought, failed""")
def action_audit(spark, sf_dir):
    on = lambda t: F.max((F.col("event_type") == t).cast("int"))
    p = read(spark, sf_dir, "events").groupBy("user_id").agg(on("purchase").alias("bought"), on("error").alias("failed")).groupBy("bought", "failed").agg(F.count(F.lit(1)).alias("n"))
    return p.select("bought", "failed", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"), (F.col("bought") != F.col("failed")).alias("disagree"))


@query("select p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '([a-z0-9]+)', 1))), ' ') as token_set from part")
def token_set(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(C.token_set(F.concat_ws(" ", "p_name", "p_type"))), " ").alias("token_set"))
