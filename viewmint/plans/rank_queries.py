"""Vector search under compressed views, and metrics of its rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..menus import LAMBDA
from ..operators import coded as D
from ..operators import graph_index as I
from ..operators import metrics as M
from ..operators import policy as P
from ..operators import search as S
from .registry import query, read

K = 10
CELL = "cast(vec_id % 8 as int)"
COSTS = {"summary": 0.0, "binary": 0.08, "trunc32": 0.26, "int8": 0.30, "full": 0.58}

_VECTORS = """
e as (select vec_id, embedding::double[] as x, label from embeddings),
v(view, id, x) as (
  select 'full', vec_id, x from e
  union all select 'binary', vec_id, list_transform(x, lambda c: case when c >= 0 then 1 / sqrt(len(x)) else -1 / sqrt(len(x)) end) from e
  union all select 'trunc32', vec_id, list_transform(x[1:32], lambda c: c / sqrt(list_inner_product(x[1:32], x[1:32]))) from e
  union all select 'int8', vec_id, list_transform(y, lambda c: c / sqrt(list_inner_product(y, y))) from (
    select vec_id, list_transform(x, lambda c: greatest(-127.0::double, least(127.0::double, round_even(c * 127, 0))) / 127) as y from e)),
s as (select q.view, q.id as qid, d.id as did, round(list_inner_product(q.x, d.x), 9) as score from v q join v d on q.view = d.view and q.id <> d.id),
flat as (select view, qid, did, score, row_number() over (partition by view, qid order by score desc, did) as rank from s),
c0 as (select cell, list(m order by i) as m from (select vec_id % 8 as cell, i, avg(x[i]) as m from e, (select unnest(range(1, 65)) as i) group by all) group by cell),
cen as (select cell, list_transform(m, lambda a: a / sqrt(list_inner_product(m, m))) as c from c0),
rep as (select cell, vec_id as did, row_number() over (partition by cell order by round(list_inner_product(x, c), 9) desc, vec_id) as rep from e join cen on cell = vec_id % 8),
near as (select vec_id as qid, cell, round(list_inner_product(x, c), 9) as score, row_number() over (partition by vec_id order by round(list_inner_product(x, c), 9) desc, cell) as cr from e, cen),
summ as (select 'summary' as view, qid, did, score, row_number() over (partition by qid order by cr, rep) as rank from near join rep using (cell) where cr <= 4 and rep <= 11 and qid <> did),
rk as (select * from flat where rank <= 10 union all select * from summ where rank <= 10),
rel as (select qid, did, case when rank <= 3 then 3.0 when rank <= 6 then 2.0 else 1.0 end::double as rel from rk where view = 'full')"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings")


def rankings(spark: SparkSession, sf_dir: str, *views: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    wanted = list(views or COSTS)
    flat = [v for v in wanted if v != "summary"]
    made = [S.centroid_search(e, e, K, F.expr(CELL))] if "summary" in wanted else []
    return reduce(DataFrame.unionByName, made + ([S.top_k_views(e, e, K, flat)] if flat else []))


def teacher(ranked: DataFrame) -> DataFrame:
    """Judgements: the exact top ten, graded 3, 2, 1."""
    grade = F.when(F.col("rank") <= 3, 3.0).when(F.col("rank") <= 6, 2.0).otherwise(1.0)
    return ranked.where("view = 'full'").select("qid", "did", grade.alias("rel"))


def _both(spark: SparkSession, sf_dir: str, *views: str) -> tuple[DataFrame, DataFrame]:
    """Rankings, computed once, and judgements."""
    r = rankings(spark, sf_dir, *views).persist()
    return r, teacher(r)


def _flat(view: str):
    sql = f"with {_VECTORS} select qid, view, rank, did, score from rk where view = '{view}'"
    query(sql, f"knn_{'flat' if view == 'full' else 'trunc' if view == 'trunc32' else view}")(lambda spark, sf_dir: rankings(spark, sf_dir, view))


for _view in ("full", "binary", "int8", "trunc32"):
    _flat(_view)
query(f"with {_VECTORS} select qid, view, rank, did, score from rk where view = 'summary'", "knn_centroid")(lambda spark, sf_dir: rankings(spark, sf_dir, "summary"))

_NDCG = f"""with {_VECTORS},
ideal as (select qid, sum((pow(2, rel) - 1) / log2(k + 1)) as ideal from (select *, row_number() over (partition by qid order by rel desc, did) as k from rel) where k <= 10 group by qid),
nd as (select r.qid, r.view, round(case when ideal > 0 then coalesce(sum((pow(2, rel) - 1) / log2(rank + 1)), 0) / ideal else 0 end, 6) as ndcg
  from rk r left join rel using (qid, did) left join ideal i on i.qid = r.qid group by r.qid, r.view, ideal)"""


@query(_NDCG + " select qid, view, ndcg from nd")
def ndcg_graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ndcg(*_both(spark, sf_dir), K)


_SETS = f"""with {_VECTORS}, n as (select qid, count(distinct did) as n from rel group by qid),
a as (select r.qid, r.view, count(distinct case when rel > 0 then did end) as found, count(*) as shown, min(case when rel > 0 then rank end) as first
  from rk r left join rel using (qid, did) group by r.qid, r.view),
m as (select a.qid, view, round(found / n, 6) as recall, (found > 0)::bigint as hit, round(coalesce(1 / first, 0), 6) as mrr,
  round(2 * (found / shown) * (found / n) / greatest(found / shown + found / n, 1e-12::double), 6) as f1 from a join n using (qid))"""


def _set_query(name: str) -> None:
    query(_SETS + f" select qid, view, {name} from m", f"{name}_at_k")(lambda spark, sf_dir: M.set_metrics(*_both(spark, sf_dir), K).select("qid", "view", name))


for _name in ("recall", "hit", "mrr", "f1"):
    _set_query(_name)


@query(f"""with {_VECTORS}, lab as (select a.vec_id as qid, b.vec_id as did, 1.0::double as rel from e a join e b on a.label = b.label and a.vec_id <> b.vec_id),
pool as (select r.*, coalesce(rel, 0) as rel from rk r left join lab using (qid, did)),
ideal as (select view, qid, sum(1 / log2(k + 1)) as ideal from (select *, row_number() over (partition by view, qid order by rel desc, did) as k from pool where rel > 0) where k <= 10 group by all)
select p.qid, p.view, round(coalesce(sum(p.rel / log2(p.rank + 1)) / any_value(ideal), 0), 6) as ndcg from pool p left join ideal i on i.view = p.view and i.qid = p.qid group by p.qid, p.view""")
def ndcg_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant is what has the query's label; ideal within what is ranked."""
    e = _vectors(spark, sf_dir)
    q = e.select(F.col("vec_id").alias("qid"), F.col("label").alias("ql"))
    d = e.select(F.col("vec_id").alias("did"), F.col("label").alias("dl"))
    pool = rankings(spark, sf_dir).join(q, "qid").join(d, "did").withColumn("rel", (F.col("ql") == F.col("dl")).cast("double"))
    ideal = F.row_number().over(Window.partitionBy("qid", "view").orderBy(F.col("rel").desc(), "did"))
    per = pool.withColumn("k", ideal).groupBy("qid", "view").agg(
        F.sum(F.col("rel") / M.discount(F.col("rank"))).alias("dcg"), F.sum(F.col("rel") / M.discount(F.col("k"))).alias("ideal")
    )
    return per.select("qid", "view", F.round(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0), 6).alias("ndcg"))


@query(f"""with {_VECTORS}, h as (select r.*, (coalesce(rel, 0) > 0)::int as hit from rk r left join rel using (qid, did)),
c as (select *, sum(hit) over (partition by qid, view order by rank) as so_far from h),
p as (select qid, view, sum(case when hit = 1 then so_far / rank else 0 end) / greatest(sum(hit), 1) as ap,
  max(case when rank <= 1 then hit else 0 end) as r1, max(case when rank <= 5 then hit else 0 end) as r5 from c group by qid, view)
select view, round(avg(ap), 6) as map, round(avg(r1), 6) as recall_1, round(avg(r5), 6) as recall_5 from p group by view""")
def recall_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mean_average_precision(*_both(spark, sf_dir))


@query(f"""with {_VECTORS}, p as (select qid, e.label as truth, d.label as predicted from rk join e on e.vec_id = qid join e d on d.vec_id = did where view = 'full' and rank = 1),
l as (select unnest(range(10)) as label), t as (select truth as label, count(*) as support, sum((truth = predicted)::int) as tp from p group by 1), c as (select predicted as label, count(*) as called from p group by 1),
m as (select label, coalesce(support, 0) as support, coalesce(tp, 0) as tp, coalesce(called, 0) as called from l left join t using (label) left join c using (label)),
r as (select *, case when called > 0 then tp / called else 0 end as p, case when support > 0 then tp / support else 0 end as r from m)
select label::int as label, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1, support from r""")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest neighbour's label as a prediction."""
    e = _vectors(spark, sf_dir)
    nearest = rankings(spark, sf_dir, "full").where("rank = 1")
    rows = nearest.join(e.select(F.col("vec_id").alias("qid"), F.col("label").alias("truth")), "qid").join(e.select(F.col("vec_id").alias("did"), F.col("label").alias("predicted")), "did")
    return M.class_report(rows, "truth", "predicted", list(range(10)))


@query(f"""with {_VECTORS}, w as (select *, exp(score - max(score) over (partition by qid, view)) as w from rk), p as (select *, w / sum(w) over (partition by qid, view) as p from w)
select qid, view, round(max(case when rank = 1 then score end), 6) as top, round(coalesce(max(case when rank = 1 then score end) - max(case when rank = 2 then score end), 0), 6) as margin,
  round(avg(score), 6) as mean, round(stddev_pop(score), 6) as std, round(max(score) - min(score), 6) as span, round(-sum(p * ln(p + 1e-12)), 6) as entropy from p group by qid, view""")
def feat_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.score_features(rankings(spark, sf_dir))


@query(f"""with {_VECTORS}, l as (select qid, list(did order by rank) filter (where view = 'int8') as x, list(did order by rank) filter (where view = 'full') as y from rk group by qid)
select qid, round(len(list_intersect(x, y)) / len(x), 6) as share_a, round(len(list_intersect(x, y)) / len(y), 6) as share_b,
  round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) as jaccard, x[1] = y[1] as top1_same,
  round(len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[i] = y[i])) / least(len(x), len(y)), 6) as same_rank from l""")
def feat_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.overlap_features(rankings(spark, sf_dir, "int8", "full"), "int8", "full")


@query(f"""with {_VECTORS}, pool as (select qid, did from rk where view = 'binary'),
f as (select qid, did, score from pool join s using (qid, did) where s.view = 'full')
select qid, 'full' as view, row_number() over (partition by qid order by score desc, did) as rank, did, score from f""")
def rerank_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return S.rerank(rankings(spark, sf_dir, "binary"), e, e, K, "full")


#: Fixed value: the depth that the surveyed pool's recall is measured at.
POOL_DEPTH = 200


@query(f"""with {_VECTORS}, l as (select label, count(*) as n from e group by label), j as (select vec_id as qid, label, coalesce(n - 1, 0) as n from e left join l using (label)),
pool as (select qid, did from flat where view = 'binary' and rank <= {POOL_DEPTH}),
a as (select qid, count(*) as shown, count(*) filter (q.label = d.label) as hits from pool join e q on q.vec_id = qid join e d on d.vec_id = did group by qid),
p as (select qid, n, coalesce(hits, 0) as hits, coalesce(shown, 0) as shown from j left join a using (qid))
select round(avg(n), 6) as mean_qrels, median(n) as median_qrels, round(avg(hits / greatest(n, 1)), 6) as candidate_recall, round(avg((hits > 0)::int), 6) as candidate_hit, round(sum(hits) / sum(shown), 6) as candidate_density from p""")
def qrel_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged are all vectors that have the query's label, however many; the
    pool is the surveyed one, a binary search's first ``POOL_DEPTH``."""
    e = _vectors(spark, sf_dir)
    asked = e.select(F.col("vec_id").alias("qid"), F.col("label").alias("ql"))
    judged = e.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n")).withColumnRenamed("label", "ql")  # all but the query itself
    pool = S.top_k(e, e, POOL_DEPTH, "binary").select("qid", "did")
    same = F.col("ql") == F.col("dl")
    hits = pool.join(e.select(F.col("vec_id").alias("did"), F.col("label").alias("dl")), "did").join(asked, "qid").groupBy("qid").agg(F.count(F.lit(1)).alias("shown"), F.count_if(same).alias("hits"))
    per = asked.join(judged, "ql", "left").select("qid", "n").join(hits, "qid", "left").na.fill(0)
    return per.agg(
        F.round(F.avg("n"), 6).alias("mean_qrels"), F.percentile("n", F.lit(0.5)).alias("median_qrels"),
        F.round(F.avg(F.col("hits") / F.greatest("n", F.lit(1))), 6).alias("candidate_recall"), F.round(F.avg((F.col("hits") > 0).cast("int")), 6).alias("candidate_hit"),
        F.round(F.sum("hits") / F.sum("shown"), 6).alias("candidate_density"),
    )


@query(f"""with {_VECTORS}, d as (select cell, vec_id, label, list_inner_product(x, c) as sim from e join cen on cell = vec_id % 8),
h as (select cell, label, count(*) as n from d group by all), t as (select cell, sum(n) as n from h group by cell),
z as (select cell, -sum(h.n / t.n * log2(h.n / t.n)) as entropy, max(h.n / t.n) as majority from h join t using (cell) group by cell)
select cell::int as cell, count(*) as n, round(avg(sim), 6) as mean_sim, round(avg(1 - sim), 6) as radius, round(stddev_pop(1 - sim), 6) as radius_std, round(any_value(entropy), 6) as label_entropy, round(any_value(majority), 6) as majority_share
from d join z using (cell) group by cell""")
def cell_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.core import dot

    e = _vectors(spark, sf_dir)
    held = e.withColumn("cell", F.expr(CELL)).join(S.centroids(e, F.expr(CELL)), "cell").select("cell", "label", dot(F.col("embedding"), F.col("c")).alias("sim"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("cell"))
    mix = held.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("p", share)
    labels = mix.groupBy("cell").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("label_entropy"), F.round(F.max("p"), 6).alias("majority_share"))
    far = 1 - F.col("sim")
    return held.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("sim"), 6).alias("mean_sim"), F.round(F.avg(far), 6).alias("radius"), F.round(F.stddev_pop(far), 6).alias("radius_std")
    ).join(labels, "cell")


@query("""with e as (select vec_id, embedding::double[] as x from embeddings)
select vec_id, round(list_avg(x), 6) as mean, round(list_stddev_pop(x), 6) as std, round(list_min(x), 6) as lo, round(list_max(x), 6) as hi,
  round(len(list_filter(x, lambda c: c > 0)) / len(x), 6) as positive, round(x[1], 6) as d0, round(x[2], 6) as d1 from e""")
def feat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform("embedding", lambda c: c.cast("double"))
    n = F.size("x")
    mean = F.aggregate("x", F.lit(0.0), lambda s, c: s + c) / n
    return _vectors(spark, sf_dir).select("vec_id", x.alias("x")).withColumn("m", mean).select(
        "vec_id", F.round("m", 6).alias("mean"),
        F.round(F.sqrt(F.aggregate(F.transform("x", lambda c: (c - F.col("m")) * (c - F.col("m"))), F.lit(0.0), lambda s, c: s + c) / n), 6).alias("std"),
        F.round(F.array_min("x"), 6).alias("lo"), F.round(F.array_max("x"), 6).alias("hi"),
        F.round(F.size(F.filter("x", lambda c: c > 0)) / n, 6).alias("positive"), F.round(F.col("x")[0], 6).alias("d0"), F.round(F.col("x")[1], 6).alias("d1"),
    )


def _cells(e: DataFrame) -> int:
    """Cells of an inverted file: as the root of the number of vectors."""
    return max(16, int(e.count() ** 0.5) // 2)


def _asked(e: DataFrame) -> DataFrame:
    """The queries of indexed search: every 20th vector, against all."""
    return e.where(F.col("vec_id") % 20 == 0)


@query()
def knn_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverted file of residual codes, 8 parts of 16 codes, 8 cells probed."""
    e = _vectors(spark, sf_dir)
    found = D.coded_search(D.coded_file(e, _cells(e), 8, 16), _asked(e), K, 8)
    return found.select("qid", F.lit("ivfpq").alias("view"), "rank", "did", "score")


@query()
def knn_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layered neighbour graph, searched with a beam of 64."""
    e = _vectors(spark, sf_dir)
    found = I.graph_search(I.layered_graph(e), _asked(e), K, 64)
    return found.select("qid", F.lit("hnsw64").alias("view"), "rank", "did", "score", "distances")


@query()
def pq_recon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.product_quantized(_vectors(spark, sf_dir), 8, 16)


@query()
def ivf_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    held, _ = S.inverted_file(e, _cells(e))
    return held.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@query()
def ann_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDCG of deeper and deeper probes of an inverted file."""
    e = _vectors(spark, sf_dir)
    exact = S.top_k(e, e, K, "full").persist()
    made = S.probes(e, e, K, _cells(e), [1, 2, 4, 8])
    return M.ndcg(made.unionByName(exact), teacher(exact), K).groupBy("view").agg(F.round(F.avg("ndcg"), 6).alias("ndcg"))


_COSTS_SQL = ", ".join(f"('{v}', {i}, {c}::double)" for i, (v, c) in enumerate(COSTS.items()))


@query(_NDCG + f""", c(view, ord, cost) as (values {_COSTS_SQL}), vm as (select qid, view, ord, cost, ndcg, round(ndcg - {LAMBDA}::double * cost, 9) as u from nd join c using (view)),
t as (select *, max(u) over (partition by qid) as top from vm)
select 'fixed_' || view as policy, count(*) as queries, round(avg(u), 6) as mean_utility, round(avg(ndcg), 6) as mean_quality, round(avg(cost), 6) as mean_cost,
  round(avg(greatest(0.0::double, top - u)), 6) as mean_regret, 0.0::double as buy_share from t group by view""")
def dense_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search under every view, NDCG, utility, oracle and regret, by view."""
    costs = spark.createDataFrame([(v, i, c) for i, (v, c) in enumerate(COSTS.items())], "view string, ord int, cost double")
    nd = M.ndcg(*_both(spark, sf_dir), K)
    views = P.with_utility(nd.join(F.broadcast(costs), "view").select(F.col("qid").alias("query_id"), "view", "ord", "cost", F.col("ndcg").alias("quality")))
    return P.evaluate(P.fixed_routes(views), views)
