"""Anchors, hyperlink scores, price windows, failures, traces and boundaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import hash_unit
from ..operators import geometry as G
from ..operators import text as T
from .fixtures import VM, view_table
from .geometry_queries import _NEAR, _OWN, _PATHS, _POINTS, _RASTER, _paths, _points, _sides
from .registry import query, read
from .text_queries import _CTX, _TOK, _context

_WORDS = "list_distinct({})".format(_TOK.format("{}"))
_NORM = "trim(regexp_replace(lower(replace({}, '_', ' ')), '\\s+', ' ', 'g'))"


@query(f"""with x as (select item_id as qid, p_partkey as did, text as q, p_type || ' ' || p_name as t from benchmark join part on p_partkey % (select count(*) from benchmark) = item_id),
w as (select qid, did, len(list_intersect({_WORDS.format("q")}, {_WORDS.format("t")})) as n, len({_WORDS.format("t")}) as k, contains({_NORM.format("q")}, {_NORM.format("t")}) and t <> '' as inside from x),
a as (select *, inside or (n >= 0.5::double * greatest(k, 1) and n >= 1) as plain from w), r as (select *, bool_or(plain) over (partition by qid) as known, row_number() over (partition by qid order by n desc, did) as r from a)
select qid, did, case when known then plain else r = 1 end as anchor from r""")
def anchors(spark, sf_dir):
    """Part titles that a passage names, or shares half their words with."""
    qs = read(spark, sf_dir, "benchmark")
    n = qs.count()
    met = read(spark, sf_dir, "part").join(qs, F.col("p_partkey") % n == F.col("item_id"))
    return T.title_anchors(met.select(F.col("item_id").alias("qid"), F.col("p_partkey").alias("did"), F.col("text").alias("question"), F.concat_ws(" ", "p_type", "p_name").alias("title")))


@query(f"""with {_CTX}, po as (select *, node % 10 / 10.0::double as overlap from pool), fst as (select distinct qid, dst as node from pool join edges on node = src where anchor and dst % 5 = 0),
i as (select qid, dst as node, sum(case when anchor then 1.5::double else 0.35::double end) as one from pool join edges on node = src group by all), o as (select po.*, coalesce(one, 0) as one from po left join i using (qid, node)),
m as (select f.qid, f.node, case when o.one > 0 then 0.6::double else 0.3::double end as w from fst f left join o using (qid, node)), h as (select qid, dst as node, sum(w) as hop from m join edges on node = src group by all), d as (select src as node, count(*) as deg from edges group by 1)
select qid, node, round(one, 6) as one, round(one + coalesce(hop, 0) + 0.01::double * least(coalesce(deg, 0), 50) + 0.05::double * overlap, 6) as two from o left join h using (qid, node) left join d using (node)""")
def graph_hyper(spark, sf_dir):
    """First-hop titles are every fifth neighbour of an anchor; the titles'
    overlap is a made-up share of their number."""
    pool, edges = _context(spark, sf_dir)
    first = T.neighbours(pool.where("anchor"), edges.where("dst % 5 = 0"))
    return T.hyper_scores(pool.withColumn("overlap", F.col("node") % 10 / F.lit(10.0)), edges, first)


@query(f"""with {_PATHS}, p as (select cell, idx, y + 1 as price from ev), n as (select cell, max(idx) as n from p group by cell),
st as (select distinct cell, unnest(case when n <= 8 then [0] when n - 7 <= 3 then range(0, n - 7) else [round_even(i * (n - 8) / 2.0::double, 0)::bigint for i in range(3)] end) as start from n),
w as (select p.cell, start, idx - start as pos, price, ln(price) as l from p join st on st.cell = p.cell and idx > start and idx <= start + 8),
b as (select *, l - arg_min(l, pos) over (partition by cell, start) as c, count(*) over (partition by cell, start) as k from w), s as (select *, avg(c) over (partition by cell, start) as m, stddev_pop(c) over (partition by cell, start) as sd from b),
pts as (select cell, start, pos, round(-1 + 2 * (pos - 1) / greatest(k - 1, 1), 6) as x, round(0.35 * (c - m) / case when sd > 1e-12 then sd else 1 end, 6) as y, price from s),
f as (select *, (max(price) over u - price) / max(price) over u as fall, ln(price) - ln(lag(price) over (partition by cell, start order by pos)) as r from pts window u as (partition by cell, start order by pos)),
z as (select cell, start, count(*) as points, round(avg(x), 5) as mx, round(var_pop(y), 5) as vyy, max(fall) as drawdown, coalesce(sqrt(avg(r * r)), 0) as vol from f group by all)
select cell, start, points, mx, vyy, case when drawdown >= 0.18 then 'point' when vol >= 0.018 then 'raster' when vol >= 0.010 then 'occupancy' else 'moments' end as view from z""")
def price_window(spark, sf_dir):
    """Three windows of eight prices a series: their moments and best view."""
    from pyspark.sql import Window

    prices = _paths(spark, sf_dir).select("cell", F.col("idx").cast("long").alias("idx"), (F.col("y") + 1).alias("price"))
    points = G.price_windows(prices, 8, 3)
    along = Window.partitionBy("cell", "start").orderBy("idx")
    peak = F.max("price").over(along.rowsBetween(Window.unboundedPreceding, 0))
    path = points.withColumn("fall", (peak - F.col("price")) / peak).withColumn("r", F.log("price") - F.log(F.lag("price").over(along)))
    per = path.groupBy("cell", "start").agg(F.count(F.lit(1)).alias("points"), F.round(F.avg("x"), 5).alias("mx"), F.round(F.var_pop("y"), 5).alias("vyy"), F.max("fall").alias("d"), F.coalesce(F.sqrt(F.avg(F.col("r") * F.col("r"))), F.lit(0.0)).alias("v"))
    view = F.when(F.col("d") >= 0.18, "point").when(F.col("v") >= 0.018, "raster").when(F.col("v") >= 0.010, "occupancy").otherwise("moments")
    return per.select("cell", "start", "points", "mx", "vyy", view.alias("view"))


_XOR = f"""ra as {_RASTER.format("a")}, rb as {_RASTER.format("b")}, xm as (select coalesce(ra.cell, rb.cell) as cell, (ra.cell is not null and rb.cell is not null)::int as both_ from ra full join rb on ra.cell = rb.cell and ra.i = rb.i and ra.j = rb.j),
xo as (select cell, round((count(*) - sum(both_)) / count(*), 6) as topology from xm group by cell)"""


@query(f"""with {_POINTS}, src as (select cell, idx, x, y from uniq where l_returnflag = 'A'), {_NEAR}, {_OWN}, {_XOR}, rr as (select cell, quantile_cont(d, 0.5) as r from own group by cell), cov as (select cell, round(avg((d <= r)::int::double), 6) as coverage from nb join rr using (cell) group by cell),
oa as (select p.cell, p.idx, sqrt(min(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))) as d from a p join a q on p.cell = q.cell and p.idx <> q.idx group by all), un as (select cell, round(stddev_pop(d) / greatest(avg(d), 1e-12::double), 6) as uniformity from oa group by cell),
dt as (select cell, avg(d * d) as dt from na group by cell), ns as (select a.cell, a.idx, min(pow(a.x - s.x, 2) + pow(a.y - s.y, 2)) as d2 from a join src s on a.cell = s.cell group by all), ds as (select cell, avg(d2) as ds from ns group by cell),
f as (select cell, round(greatest(0, coalesce(dt - ds, 0)), 6) as locking, round(greatest(0, (1 - coverage) * greatest(uniformity, 0)), 6) as collapse, topology from cov join un using (cell) join xo using (cell) join dt using (cell) left join ds using (cell))
select cell, round(locking, 4) as locking, collapse, topology, case when locking = greatest(locking, collapse, topology) then 'locking' when collapse = greatest(locking, collapse, topology) then 'collapse' else 'topology' end as dominant from f""")
def failure(spark, sf_dir):
    """Returned lines should come to the others, from those of flag A."""
    a, b = _sides(spark, sf_dir)
    source = _points(spark, sf_dir).where("l_returnflag = 'A'").drop("l_returnflag")
    return G.failure(a, b, source).withColumn("locking", F.round("locking", 4))


_TRACE = f"""w as (select query_id, max(case when view = 'summary' then utility end) as s, max(case when view = 'pq' then utility end) as p, max(case when view = 'full' then utility end) as f, max(case when view = 'full' then quality end) as q from vm group by query_id),
c as (select * from w order by f <= s + 0.05::double, query_id limit 1), r as (select *, case when s >= p and s >= f then 'summary' when p >= f then 'pq' else 'full' end as route from c)"""


@query(f"""with {VM}, {_TRACE} select 'legal' as kind, query_id::varchar as query_id, route, array_to_string(list_distinct([route, 'summary', 'pq', 'full']).list_sort(), ',') as ranked, '' as hidden from r
union all select 'illegal', query_id::varchar, 'ce', '', 'ce_score_margin=' || round(q, 4)::varchar from r""")
def trace_row(spark, sf_dir):
    """The first query where full beats the summary clearly, as a legal route
    and as one that shows what it mustn't."""
    at = lambda v, c: F.max(F.when(F.col("view") == v, F.col(c)))
    w = view_table(spark, sf_dir).groupBy("query_id").agg(at("summary", "utility").alias("s"), at("pq", "utility").alias("p"), at("full", "utility").alias("f"), at("full", "quality").alias("q"))
    chosen = w.agg(F.min_by(F.struct("query_id", "s", "p", "f", "q"), F.struct(F.col("f") <= F.col("s") + 0.05, F.col("query_id"))).alias("c")).select("c.*")
    route = F.when((F.col("s") >= F.col("p")) & (F.col("s") >= F.col("f")), "summary").when(F.col("p") >= F.col("f"), "pq").otherwise("full")
    ranked = F.array_join(F.array_sort(F.array_distinct(F.array(route, F.lit("summary"), F.lit("pq"), F.lit("full")))), ",")
    legal = F.struct(F.lit("legal").alias("kind"), F.col("query_id").cast("string").alias("query_id"), route.alias("route"), ranked.alias("ranked"), F.lit("").alias("hidden"))
    illegal = F.struct(F.lit("illegal").alias("kind"), F.col("query_id").cast("string").alias("query_id"), F.lit("ce").alias("route"), F.lit("").alias("ranked"), F.concat(F.lit("ce_score_margin="), F.round("q", 4).cast("string")).alias("hidden"))
    return chosen.select(F.explode(F.array(legal, illegal)).alias("r")).select("r.*")


@query(f"""with {VM}, w as (select query_id, any_value(price) as price, max(case when view = 'summary' then quality end) as bi, max(case when view = 'full' then quality end) as cross_, max(quality) as top, avg(quality) as mean, stddev_pop(quality) as sd, max(quality) - min(quality) as span from vm group by query_id),
m as (select query_id, (select q from (select quality as q, row_number() over (order by quality desc, ord) as r from vm v where v.query_id = w.query_id) where r = 2) as second from w)
select query_id, round(bi, 6) as bi_ndcg, round(cross_, 6) as cross_ndcg, round(top, 6) as top_score, round(top - second, 6) as margin, round(mean, 6) as mean_score, round(sd, 6) as std_score, round(span, 6) as span,
  round(cross_ - bi, 6) as raw_gain, round(cross_ - bi - 0.08::double * 0.45::double, 6) as net_gain, cross_ - bi > 0.08::double * 0.45::double as worth_buying from w join m using (query_id)""")
def boundary_table(spark, sf_dir):
    """Features of each query's scores, its gain and whether that is worth its price."""
    at = lambda v: F.max(F.when(F.col("view") == v, F.col("quality")))
    sorted_ = F.array_sort(F.collect_list(-F.col("quality")))
    w = view_table(spark, sf_dir).groupBy("query_id").agg(
        at("summary").alias("bi"), at("full").alias("cross"), F.max("quality").alias("top"), (-F.get(sorted_, F.lit(1))).alias("second"), F.avg("quality").alias("mean"), F.stddev_pop("quality").alias("sd"), (F.max("quality") - F.min("quality")).alias("span")
    )
    gain, price = F.col("cross") - F.col("bi"), F.lit(0.08) * F.lit(0.45)
    r = lambda c, n: F.round(c, 6).alias(n)
    return w.select(
        "query_id", r(F.col("bi"), "bi_ndcg"), r(F.col("cross"), "cross_ndcg"), r(F.col("top"), "top_score"), r(F.col("top") - F.col("second"), "margin"), r(F.col("mean"), "mean_score"), r(F.col("sd"), "std_score"), r(F.col("span"), "span"),
        r(gain, "raw_gain"), r(gain - price, "net_gain"), (gain > price).alias("worth_buying"),
    )


def _noise(seed: str) -> str:
    return f"('0x' || substr(md5(({seed})::varchar || ':' || c_mktsegment), 1, 8))::bigint / 4294967296.0::double"


@query(f"""with s as (select c_mktsegment as method, avg(c_acctbal / 10000 + {_noise("c_custkey")}) as a, avg(c_acctbal / 10000 + {_noise("c_custkey + 1000")}) as b from customer group by 1)
select method, round(a, 6) as public, round(b, 6) as private, round(abs(a - b), 6) as delta, rank() over (order by round(a, 6) desc) as public_rank, rank() over (order by round(b, 6) desc) as private_rank from s""")
def private_seed(spark, sf_dir):
    """The same board with every cell's seed moved by a thousand."""
    from pyspark.sql import Window

    noisy = lambda move: F.avg(F.col("c_acctbal") / 10000 + hash_unit(F.concat_ws(":", (F.col("c_custkey") + move).cast("string"), "c_mktsegment")))
    m = read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("method")).agg(noisy(0).alias("a"), noisy(1000).alias("b"))
    place = lambda c: F.rank().over(Window.orderBy(F.round(c, 6).desc())).cast("long")
    return m.select("method", F.round("a", 6).alias("public"), F.round("b", 6).alias("private"), F.round(F.abs(F.col("a") - F.col("b")), 6).alias("delta"), place("a").alias("public_rank"), place("b").alias("private_rank"))
