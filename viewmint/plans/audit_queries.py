"""Audit tables: what remains of contracts, controls, features and summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import core as C
from ..operators import geometry as G
from ..operators import text as T
from .fixtures import VM, view_table
from .geometry_queries import _POINTS, _sides
from .rank_queries import _VECTORS, rankings
from .registry import query, read
from .text_queries import _BM25, _pool



@query("""with m as (select c_mktsegment as method, round(avg(case when c_acctbal < 0 then null else c_acctbal end), 4) as score, round(avg((c_acctbal >= 0)::int), 6) as feasible from customer group by 1)
select row_number() over (order by feasible desc, score, method) as place, * from m""")
def legacy_leaderboard(spark, sf_dir):
    m = read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("method")).agg(F.round(F.avg(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))), 4).alias("score"), F.round(F.avg((F.col("c_acctbal") >= 0).cast("int")), 6).alias("feasible"))
    return m.withColumn("place", F.row_number().over(Window.orderBy(F.col("feasible").desc(), "score", "method")).cast("long"))


@query(_BM25 + """, p as (select qid, did, row_number() over (partition by qid order by md5(qid::varchar || ':degree:' || did::varchar), did) as place from bm),
w as (select qid, score, row_number() over (partition by qid order by score desc, did) as place from bm where score > 0) select p.qid, p.did, coalesce(w.score, 0) as score from p left join w using (qid, place)""")
def ctl_degree(spark, sf_dir):
    """Positive weights dealt to random places of the same query."""
    bm = T.bm25_local(*_pool(spark, sf_dir))
    key = F.md5(F.concat(F.col("qid").cast("string"), F.lit(":degree:"), F.col("did").cast("string")))
    places = bm.select("qid", "did", F.row_number().over(Window.partitionBy("qid").orderBy(key, "did")).alias("place"))
    weights = bm.where("score > 0").select("qid", "score", F.row_number().over(T.by_score()).alias("place"))
    return places.join(weights, ["qid", "place"], "left").select("qid", "did", F.coalesce("score", F.lit(0.0)).alias("score"))


@query(f"""with {VM}, f as (select query_id, max(case when view = 'summary' then quality end) as a, max(case when view = 'pq' then quality end) as b, max(case when view = 'full' then quality end) as c from vm group by query_id)
select query_id, round(a - b, 6) as margin, round(-(abs(a) + abs(b)), 6) + 0.0::double as neg_spread, (a = c)::int as agree, (a > 0)::int + (b > 0)::int + (c > 0)::int as seen from f""")
def feat_gate(spark, sf_dir):
    w = view_table(spark, sf_dir).groupBy("query_id").pivot("view", ["summary", "pq", "full"]).agg(F.max("quality"))
    on = lambda c: (F.col(c) > 0).cast("int")
    return w.select("query_id", F.round(F.col("summary") - F.col("pq"), 6).alias("margin"), (F.round(-(F.abs("summary") + F.abs("pq")), 6) + 0.0).alias("neg_spread"), (F.col("summary") == F.col("full")).cast("int").alias("agree"), (on("summary") + on("pq") + on("full")).alias("seen"))


@query(f"""with {_VECTORS}, n as (select qid, did, score from rk where view = 'full' and rank <= 5), k as (select n.*, exp(score) as w, e.label as y from n join e on e.vec_id = did)
select qid, round(sum(w * y) / sum(w), 6) as mean, round(sqrt(greatest(0, sum(w * y * y) / sum(w) - pow(sum(w * y) / sum(w), 2))), 6) as std from k group by qid""")
def feat_knn_ctx(spark, sf_dir):
    """Kernel-weighted labels of the five nearest others."""
    y = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("did"), F.col("label").cast("double").alias("y"))
    k = rankings(spark, sf_dir, "full").where("rank <= 5").join(y, "did").withColumn("w", F.exp("score"))
    mean, second = F.sum(F.col("w") * F.col("y")) / F.sum("w"), F.sum(F.col("w") * F.col("y") * F.col("y")) / F.sum("w")
    return k.groupBy("qid").agg(F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.greatest(F.lit(0.0), second - mean * mean)), 6).alias("std"))


@query("""with c as (select n_nationkey as i, c_mktsegment as method, avg(c_acctbal) as v from customer join nation on c_nationkey = n_nationkey group by all), d as (select rep, k, ('0x' || substr(md5(rep::varchar || ':' || k::varchar), 1, 8))::bigint % 25 as pick from (select unnest(range(100)) as rep), (select unnest(range(25)) as k)),
m as (select rep, method, round(avg(v), 9) as v from d join c on i = pick group by all), r as (select *, rank() over (partition by rep order by v desc) as r from m)
select method, round(avg(r), 6) as mean_rank, round(avg((r = 1)::int), 6) as p_top1, round(avg((r <= 2)::int), 6) as p_top2 from r group by method""")
def boot_rank(spark, sf_dir):
    cells = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("i"), F.col("c_mktsegment").alias("method")).agg(F.avg("c_acctbal").alias("v"))
    reps = spark.range(100).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("k"))
    draws = reps.select("rep", C.hash_index(F.concat_ws(":", F.col("rep").cast("string"), F.col("k").cast("string")), F.lit(25)).alias("i"))
    means = draws.join(cells, "i").groupBy("rep", "method").agg(F.round(F.avg("v"), 9).alias("v"))
    r = means.withColumn("r", F.rank().over(Window.partitionBy("rep").orderBy(F.col("v").desc())))
    return r.groupBy("method").agg(F.round(F.avg("r"), 6).alias("mean_rank"), F.round(F.avg((F.col("r") == 1).cast("int")), 6).alias("p_top1"), F.round(F.avg((F.col("r") <= 2).cast("int")), 6).alias("p_top2"))


@query("""with u as (select o_orderpriority as w, max(case when o_orderstatus = 'F' then m end) as f, max(case when o_orderstatus = 'O' then m end) as o, max(case when o_orderstatus = 'P' then m end) as p from (select o_orderpriority, o_orderstatus, avg(o_totalprice) as m from orders group by all) group by 1)
select w, round(greatest(f, o, p), 4) as best, case when f >= o and f >= p then 'F' when o >= p then 'O' else 'P' end as best_view from u where f is not null and o is not null and p is not null""")
def oracle_pivot(spark, sf_dir):
    wide = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("w")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.avg("o_totalprice")).na.drop()
    best = F.greatest("F", "O", "P")
    return wide.select("w", F.round(best, 4).alias("best"), F.when(F.col("F") == best, "F").when(F.col("O") == best, "O").otherwise("P").alias("best_view"))


@query("select c_mktsegment, count(*) as n, round(avg(c_acctbal), 4) as mean from customer where c_nationkey not in (select s_nationkey from supplier where s_acctbal > 9000) group by 1 having count(*) >= 25")
def holdout_exclude(spark, sf_dir):
    held = read(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("c_nationkey"))
    kept = read(spark, sf_dir, "customer").join(held, "c_nationkey", "left_anti")
    return kept.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean")).where("n >= 25")


_COND = f"""with {_POINTS}, m as (select cell, count(*) as n, avg(x) as mx, avg(y) as my, var_pop(x) as vxx, var_pop(y) as vyy, covar_pop(x, y) as vxy from a group by cell having count(*) > 2),
e as (select *, (vxx + vyy) / 2 + sqrt(pow((vxx - vyy) / 2, 2) + pow(vxy, 2)) as big, greatest((vxx + vyy) / 2 - sqrt(pow((vxx - vyy) / 2, 2) + pow(vxy, 2)), 1e-12::double) as small from m)"""


def _cond(spark, sf_dir):
    half = (F.col("vxx") + F.col("vyy")) / 2
    root = F.sqrt(F.pow((F.col("vxx") - F.col("vyy")) / 2, 2) + F.pow("vxy", 2))
    return G.moments(_sides(spark, sf_dir)[0]).where("n > 2").withColumn("big", half + root).withColumn("small", F.greatest(half - root, F.lit(1e-12)))


@query(_COND + " select cell, round(big, 4) as big, round(small, 4) as small, round(vxy / sqrt(vxx * vyy), 6) as corr, round(n / 256, 6) as scaled_n from e")
def summary_cond(spark, sf_dir):
    return _cond(spark, sf_dir).select("cell", F.round("big", 4).alias("big"), F.round("small", 4).alias("small"), F.round(F.col("vxy") / F.sqrt(F.col("vxx") * F.col("vyy")), 6).alias("corr"), F.round(F.col("n") / 256, 6).alias("scaled_n"))


@query(_COND + " select cell, case when big / small >= 5 then 'point,raster,occupancy,moments' when big / small >= 2 then 'raster,occupancy,point,moments' else 'occupancy,moments,raster,point' end as ranked from e")
def view_rank_rule(spark, sf_dir):
    r = F.col("big") / F.col("small")
    return _cond(spark, sf_dir).select("cell", F.when(r >= 5, "point,raster,occupancy,moments").when(r >= 2, "raster,occupancy,point,moments").otherwise("occupancy,moments,raster,point").alias("ranked"))


@query(f"""with {_POINTS}, d as (select p.cell, p.idx, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) as d, row_number() over (partition by p.cell, p.idx order by pow(p.x - q.x, 2) + pow(p.y - q.y, 2), q.idx) as k from a p join a q on p.cell = q.cell and p.idx <> q.idx),
m as (select cell, idx, avg(d) as m from d where k <= 5 group by all) select cell, round(avg(m), 6) as density, round(var_pop(m) / greatest(pow(avg(m), 2), 1e-12::double), 6) as variation from m group by cell""")
def local_density(spark, sf_dir):
    m = G.mean_nearest(_sides(spark, sf_dir)[0], 5)
    return m.groupBy("cell").agg(F.round(F.avg("m"), 6).alias("density"), F.round(F.var_pop("m") / F.greatest(F.pow(F.avg("m"), 2), F.lit(1e-12)), 6).alias("variation"))


@query(f"""with {VM}, r as (select query_id, case when price > 200000 then 'full' else 'pq' end as view from vm where ord = 0),
u as (select dataset, utility from r join vm using (query_id, view)) select dataset, count(*) as queries, round(avg(utility), 8) as chosen_utility from u group by dataset""")
def util_for_choices(spark, sf_dir):
    v = view_table(spark, sf_dir)
    routes = v.where("ord = 0").select("query_id", F.when(F.col("price") > 200000, "full").otherwise("pq").alias("view"))
    return routes.join(v, ["query_id", "view"]).groupBy("dataset").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("utility"), 8).alias("chosen_utility"))


@query(f"with {VM} select view, count(*) as n, round(avg(quality), 6) as quality, round(max(quality), 6) as top, round(avg((quality > 0)::int), 6) as present from vm group by view")
def aggregate_view(spark, sf_dir):
    return view_table(spark, sf_dir).groupBy("view").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.max("quality"), 6).alias("top"), F.round(F.avg((F.col("quality") > 0).cast("int")), 6).alias("present"))


@query(f"""with {VM}, w as (select dataset, query_id, max(case when view = 'binary' then nullif(quality, 0) end) as b, max(case when view = 'full' then nullif(quality, 0) end) as f from vm group by all)
select dataset, count(*) as complete, round(avg(b), 6) as binary_reward, round(avg(f), 6) as full_reward from w where b is not null and f is not null group by dataset""")
def fitted_q_scopes(spark, sf_dir):
    w = view_table(spark, sf_dir).withColumn("r", F.nullif("quality", F.lit(0.0))).groupBy("dataset", "query_id").pivot("view", ["binary", "full"]).agg(F.max("r")).na.drop()
    return w.groupBy("dataset").agg(F.count(F.lit(1)).alias("complete"), F.round(F.avg("binary"), 6).alias("binary_reward"), F.round(F.avg("full"), 6).alias("full_reward"))


@query("select event_type, arg_max(event_id, (value, -event_id)) as hardest, round(max(value), 6) as severity, round(median(value), 6) as middle from events group by 1")
def representative(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct(F.col("value"), -F.col("event_id"))).alias("hardest"), F.round(F.max("value"), 6).alias("severity"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("middle"))


@query(f"""with {_VECTORS}, l as (select qid, list(did) filter (where view = 'binary') as x, list(did) filter (where view = 'int8') as y from rk group by qid)
select qid, round(len(list_intersect(x, y)) / 10, 6) as agreement, case when len(list_intersect(x, y)) >= 5 then 'binary' else 'int8' end as view from l""")
def gate_agreement(spark, sf_dir):
    r = rankings(spark, sf_dir, "binary", "int8").groupBy("qid").pivot("view", ["binary", "int8"]).agg(F.collect_list("did"))
    both = F.size(F.array_intersect("binary", "int8"))
    return r.select("qid", F.round(both / 10, 6).alias("agreement"), F.when(both >= 5, "binary").otherwise("int8").alias("view"))


@query("select o_orderkey, case when row_number() over (order by o_orderkey) <= floor(0.6::double * count(*) over ()) then 'train' else 'test' end as split from orders")
def split_head(spark, sf_dir):
    from ..operators.stats import running

    o = read(spark, sf_dir, "orders").select("o_orderkey", F.lit(1).alias("n"))
    n = o.count()
    first = F.col("n_before") < F.floor(F.lit(0.6) * n)
    return running(o, "o_orderkey", ["n"]).select("o_orderkey", F.when(first, "train").otherwise("test").alias("split"))


@query(f"""with {_VECTORS}, c as (select a.vec_id as qid, b.vec_id as did, (a.label = b.label)::int as rel, round(list_inner_product(a.x, b.x), 9) as score from e a join e b on a.vec_id % (select greatest(8, count(*) // 250) from embeddings) = b.vec_id % (select greatest(8, count(*) // 250) from embeddings) and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by qid order by score desc, did) as k, row_number() over (partition by qid order by rel desc, did) as i from c)
select qid, round(case when sum(rel) > 0 then sum(case when k <= 10 then rel / log2(k + 1) else 0 end) / sum(case when i <= 10 then rel / log2(i + 1) else 0 end) else 0 end, 6) as ndcg from r group by qid""")
def label_rerank(spark, sf_dir):
    """Others of the query's cell by score; relevant is what has its label.
    Cells grow in number with the vectors, not in size."""
    e = read(spark, sf_dir, "embeddings")
    e = e.withColumn("cell", F.col("vec_id") % max(8, e.count() // 250))
    q = e.select("cell", F.col("vec_id").alias("qid"), F.col("label").alias("ql"), F.col("embedding").alias("q"))
    d = e.select("cell", F.col("vec_id").alias("did"), F.col("label").alias("dl"), F.col("embedding").alias("d"))
    c = q.join(d, "cell").where("qid != did").select("qid", "did", (F.col("ql") == F.col("dl")).cast("int").alias("rel"), F.round(C.dot(F.col("q"), F.col("d")), 9).alias("score"))
    order = lambda s: F.row_number().over(Window.partitionBy("qid").orderBy(F.col(s).desc(), "did"))
    r = c.withColumn("k", order("score")).withColumn("i", order("rel"))
    dcg = lambda p: F.sum(F.when(F.col(p) <= 10, F.col("rel") / F.log2(F.col(p) + 1.0)).otherwise(0.0))
    return r.groupBy("qid").agg(F.round(F.when(F.sum("rel") > 0, dcg("k") / dcg("i")).otherwise(0.0), 6).alias("ndcg"))


@query("""with a as (select 'orders' as report, o_orderstatus as policy, round(avg(o_totalprice), 4) as value from orders group by 2), b as (select 'lines', l_returnflag, round(avg(l_extendedprice), 4) from lineitem group by 2)
select * from a union all select * from b union all select 'top', max(policy), max(value) from a""")
def solver_table(spark, sf_dir):
    a = read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("policy")).agg(F.round(F.avg("o_totalprice"), 4).alias("value")).select(F.lit("orders").alias("report"), "policy", "value")
    b = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("policy")).agg(F.round(F.avg("l_extendedprice"), 4).alias("value")).select(F.lit("lines").alias("report"), "policy", "value")
    return a.unionByName(b).unionByName(a.agg(F.lit("top").alias("report"), F.max("policy").alias("policy"), F.max("value").alias("value")))


@query(f"""with {VM}, o as (select dataset, view, avg(utility) as u, count(*) as n from vm group by all), b as (select view, sum(u * n) / sum(n) as pooled from o group by view)
select o.dataset, o.view, round(o.u, 9) as utility, round(pooled, 9) as pooled, round(o.u - pooled, 9) as delta from o join b using (view)""")
def router_rollup(spark, sf_dir):
    o = view_table(spark, sf_dir).groupBy("dataset", "view").agg(F.avg("utility").alias("u"), F.count(F.lit(1)).alias("n"))
    pooled = o.groupBy("view").agg((F.sum(F.col("u") * F.col("n")) / F.sum("n")).alias("p"))
    return o.join(pooled, "view").select("dataset", "view", F.round("u", 9).alias("utility"), F.round("p", 9).alias("pooled"), F.round(F.col("u") - F.col("p"), 9).alias("delta"))
