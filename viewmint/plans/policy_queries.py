"""Scoring: utility, oracle, policies, price sweeps, leaderboards."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import hash_unit
from ..operators import policy as P
from .fixtures import VM, view_table
from .registry import query, read

_RANKED = f"""with {VM}, ranked as (select *, row_number() over (partition by query_id order by utility desc, ord) as r,
  max(utility) over (partition by query_id) as top from vm)"""
_SUMMARY = f"""with {VM}, scored as (select *, max(utility) over (partition by query_id) as top from vm),
summary as (select 'fixed_' || view as policy, count(*) as queries, round(avg(utility), 6) as mean_utility,
  round(avg(quality), 6) as mean_quality, round(avg(cost), 6) as mean_cost,
  round(avg(greatest(0.0::double, top - utility)), 6) as mean_regret,
  round(avg((view = 'ce')::int::double), 6) as buy_share from scored group by view)"""


@query(f"with {VM} select query_id, view, utility from vm")
def utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view_table(spark, sf_dir).select("query_id", "view", "utility")


@query(_RANKED + " select query_id, view as oracle_view, quality as oracle_quality, cost as oracle_cost, utility as oracle_utility from ranked where r = 1")
def oracle_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.oracle(view_table(spark, sf_dir))


@query(_SUMMARY + " select * from summary")
def fixed_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = view_table(spark, sf_dir)
    return P.evaluate(P.fixed_routes(views), views)


@query(_SUMMARY + """, o as (select round(avg(top), 6) as u from (select max(utility) as top from vm group by query_id))
select policy, mean_utility, round((mean_utility - max(mean_utility) over ()) / greatest(u - max(mean_utility) over (), 1e-9::double), 6) as gap_closed
from summary, o""")
def gap_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = view_table(spark, sf_dir)
    top = P.oracle(views).agg(F.round(F.avg("oracle_utility"), 6).alias("top"))
    summary = P.evaluate(P.fixed_routes(views), views).crossJoin(top)
    return P.gap_closed(summary, F.col("top")).select("policy", "mean_utility", "gap_closed")


@query(_SUMMARY + " select row_number() over (order by mean_regret, mean_utility desc, policy) as place, policy, mean_regret, mean_utility, mean_cost from summary")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = view_table(spark, sf_dir)
    order = Window.orderBy("mean_regret", F.col("mean_utility").desc(), "policy")
    return P.evaluate(P.fixed_routes(views), views).select(
        F.row_number().over(order).cast("long").alias("place"), "policy", "mean_regret", "mean_utility", "mean_cost"
    )


_HELD = "('0x' || substr(md5('7:' || query_id::varchar), 1, 8))::bigint"


@query(f"""with {VM}, n as (select count(*) as n from orders),
ord as (select o_orderkey, row_number() over (order by ('0x' || substr(md5('7:' || o_orderkey::varchar), 1, 8))::bigint, o_orderkey) as r from orders)
select view, round(avg(utility), 6) as mean_utility, count(*) as queries
from vm join ord on query_id = o_orderkey, n where r > floor(0.6::double * n) group by view""")
def heldout_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.splits import split_602020

    views = view_table(spark, sf_dir)
    split = split_602020(views.select("query_id").distinct(), "query_id", 7)
    held = views.join(split.where("split != 'train'"), "query_id")
    return held.groupBy("view").agg(F.round(F.avg("utility"), 6).alias("mean_utility"), F.count(F.lit(1)).alias("queries"))


_MEANS = f"with {VM}, m as (select view, ord, round(avg(quality), 9) as quality, min(cost) as cost from vm group by view, ord)"


def _means(views: DataFrame) -> DataFrame:
    return views.groupBy("view", "ord").agg(F.round(F.avg("quality"), 9).alias("quality"), F.min("cost").alias("cost"))


@query(_MEANS + """, s as (select view, lead(view) over w as next_view, lead(quality) over w - quality as dq, lead(cost) over w - cost as dc
  from m window w as (order by ord))
select view, next_view, case when abs(dc) > 1e-12 then round(dq / dc, 6) end as lambda_star from s where next_view is not null""")
def lambda_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.lambda_star(_means(view_table(spark, sf_dir)))


_GRID = [0.0, 0.02, 0.05, 0.08, 0.16, 0.32, 0.64, 1.0]


@query(f"""with {VM}, lams as (select unnest({_GRID}::double[]) as lam),
p as (select lam, query_id, view, ord, round(quality - lam * cost, 9) as utility from vm, lams),
f as (select lam, view, ord, round(avg(utility), 9) as utility from p group by all),
b as (select * from f qualify row_number() over (partition by lam order by utility desc, ord) = 1),
o as (select lam, avg(u) as u from (select lam, query_id, max(utility) as u from p group by all) group by lam)
select lam, view as best_fixed, round(utility, 6) as best_fixed_utility, round(u, 6) as oracle_utility from b join o using (lam)""")
def lambda_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.lambda_sweep(view_table(spark, sf_dir), _GRID)


@query(_RANKED + """, b as (select dataset, view from ranked where r = 1 union all select 'all', view from ranked where r = 1),
c as (select dataset, view, count(*) as n from b group by all)
select dataset, view, n, round(n / sum(n) over (partition by dataset), 6) as share from c""")
def best_view_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.oracle_shares(view_table(spark, sf_dir), "dataset")


@query(f"""with {VM}, d as (select max(case when view = 'full' then quality end) - max(case when view = 'pq' then quality end) as d from vm group by query_id)
select count(*) as n, round(avg((d > 1e-8)::int::double), 6) as better, round(avg((abs(d) <= 1e-8)::int::double), 6) as tie,
  round(avg((d < -1e-8)::int::double), 6) as worse from d where d is not null""")
def tie_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tie_breakdown(view_table(spark, sf_dir), "pq", "full")


@query(f"""with {VM}, d as (select dataset, view, avg(utility) as u, count(*) as n from vm group by all)
select view, round(sum(u * n) / sum(n), 6) as weighted_u from d group by view""")
def weighted_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = view_table(spark, sf_dir).groupBy("dataset", "view").agg(F.avg("utility").alias("u"), F.count(F.lit(1)).alias("n"))
    return P.weighted_means(per, "view", "u", "n")


_MENUS = {"cheap": ["summary", "binary", "pq"], "graph": ["summary", "hnsw16", "hnsw64"], "rich": ["int8", "full"]}
_MENU_SQL = ", ".join(f"('{m}', '{v}')" for m, vs in _MENUS.items() for v in vs)


@query(f"""with {VM}, menus(menu, view) as (values {_MENU_SQL}),
p as (select menu, vm.* from vm join menus using (view)),
f as (select menu, view, ord, round(avg(utility), 9) as utility from p group by all),
b as (select * from f qualify row_number() over (partition by menu order by utility desc, ord) = 1),
o as (select menu, avg(u) as u from (select menu, query_id, max(utility) as u from p group by all) group by menu)
select menu, view as best_fixed, round(utility, 6) as best_fixed_utility, round(u, 6) as oracle_utility from b join o using (menu)""")
def restricted_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.restricted_menus(view_table(spark, sf_dir), _MENUS)


@query(_MEANS + """, d as (select a.view, a.cost, a.quality as benefit, b.view as by_ from m a left join m b on a.view <> b.view
  and b.cost <= a.cost + 1e-12 and b.quality >= a.quality - 1e-12 and (b.cost < a.cost - 1e-12 or b.quality > a.quality + 1e-12))
select view, cost, benefit, coalesce(string_agg(by_, ';' order by by_), '') as dominated_by, count(by_) > 0 as dominated from d group by view, cost, benefit""")
def pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pareto(_means(view_table(spark, sf_dir)).withColumnRenamed("quality", "benefit"))


@query(_MEANS + """, l as (select unnest(range(151)) / 100.0::double as lam), c as (select unnest(range(101)) / 50.0::double as mult),
g as (select lam, mult, view, ord, round(quality - lam * mult * cost, 9) as u from m, l, c),
w as (select view from g qualify row_number() over (partition by lam, mult order by u desc, ord) = 1)
select view, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from w group by view""")
def winner_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    lambdas = spark.range(151).select((F.col("id") / F.lit(100.0)).alias("lam"))
    multipliers = spark.range(101).select((F.col("id") / F.lit(50.0)).alias("mult"))
    return P.winner_grid(_means(view_table(spark, sf_dir)), lambdas, multipliers)


_CUTS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
_CE = f"""with {VM}, s as (select query_id, max(case when view = 'summary' then quality end) as q0, max(case when view = 'full' then quality end) as q1,
  max(case when view = 'pq' then quality end) as score from vm group by query_id),
g as (select query_id, score, q1 - q0 as gain from s)"""


def _gains(views: DataFrame) -> DataFrame:
    wide = views.groupBy("query_id").pivot("view", ["summary", "pq", "full"]).agg(F.max("quality"))
    return wide.select("query_id", F.col("pq").alias("score"), (F.col("full") - F.col("summary")).alias("gain"))


@query(_CE + f""", t as (select unnest({_CUTS}::double[]) as threshold), x as (select *, score > threshold as buy, gain > 0.0464::double as worth from g, t),
a as (select threshold, round(avg(buy::int::double), 6) as buy_rate, round(avg(case when buy then gain - 0.0464::double else 0 end), 6) as net_gain,
  round(avg(greatest(0.0::double, gain - 0.0464::double) - case when buy then gain - 0.0464::double else 0 end), 6) as regret,
  sum((buy and worth)::int::double) as hit, sum(buy::int::double) as bought, sum(worth::int::double) as worth from x group by threshold)
select threshold, buy_rate, net_gain, regret, round(hit / greatest(1.0::double, bought), 6) as precision,
  round(hit / greatest(1.0::double, worth), 6) as recall, round((bought - hit) / greatest(1.0::double, bought), 6) as false_buy from a""")
def decision_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.decision_curve(_gains(view_table(spark, sf_dir)), _CUTS, 0.0464)


@query(_CE + f""", t as (select unnest({_CUTS}::double[]) as threshold),
n as (select threshold, avg(case when score > threshold then gain - 0.0464::double else 0 end) as net from g, t group by threshold),
b as (select threshold, round(net, 9) as net from n order by round(net, 9) desc, threshold limit 1),
f as (select 0.0::double as never, round(avg(gain - 0.0464::double), 6) as always, round(avg(greatest(0.0::double, gain - 0.0464::double)), 6) as oracle from g)
select never, always, oracle, threshold as best_threshold, round(net, 6) as best_net,
  round((net - greatest(never, always)) / greatest(oracle - greatest(never, always), 1e-9::double), 4) as gap_closed from f, b""")
def ce_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _gains(view_table(spark, sf_dir))
    net = F.col("gain") - F.lit(0.0464)
    grid = rows.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in _CUTS])))
    per = grid.groupBy("threshold").agg(F.round(F.avg(F.when(F.col("score") > F.col("threshold"), net).otherwise(0.0)), 9).alias("net"))
    best = per.agg(F.max_by(F.struct("threshold", "net"), F.struct(F.col("net"), -F.col("threshold"))).alias("b"))
    fixed = rows.agg(F.lit(0.0).alias("never"), F.round(F.avg(net), 6).alias("always"), F.round(F.avg(F.greatest(F.lit(0.0), net)), 6).alias("oracle"))
    bar = F.greatest("never", "always")
    return fixed.crossJoin(best).select(
        "never", "always", "oracle", F.col("b.threshold").alias("best_threshold"), F.round("b.net", 6).alias("best_net"),
        F.round((F.col("b.net") - bar) / F.greatest(F.col("oracle") - bar, F.lit(1e-9)), 4).alias("gap_closed"),
    )


@query(_RANKED + """, m as (select dataset, view, ord, round(avg(utility), 9) as u from vm group by all),
b as (select * from m qualify row_number() over (partition by dataset order by u desc, ord) = 1),
o as (select dataset, avg(utility) as u, count(*) as queries from ranked where r = 1 group by dataset)
select dataset, queries, b.view as best_fixed, round(b.u, 8) as best_fixed_utility, round(o.u, 8) as oracle_utility, round(o.u - b.u, 8) as headroom from b join o using (dataset)""")
def type_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = view_table(spark, sf_dir)
    fixed = views.groupBy("dataset", "view", "ord").agg(F.round(F.avg("utility"), 9).alias("utility")).groupBy("dataset").agg(P.best_by("utility", "utility").alias("b"))
    top = P.oracle(views, ("dataset", "query_id")).groupBy("dataset").agg(F.avg("oracle_utility").alias("u"), F.count(F.lit(1)).alias("queries"))
    return fixed.join(top, "dataset").select(
        "dataset", "queries", F.col("b.view").alias("best_fixed"), F.round("b.utility", 8).alias("best_fixed_utility"),
        F.round("u", 8).alias("oracle_utility"), F.round(F.col("u") - F.col("b.utility"), 8).alias("headroom"),
    )


@query(_RANKED + """, s as (select query_id, max(case when view = 'summary' then quality end) as q0 from vm group by query_id),
k as (select 'all' as scope, query_id from s union all select 'imperfect', query_id from s where q0 < 0.999::double union all select 'hard', query_id from s where q0 < 0.5::double)
select scope, view, count(*) as queries, round(avg(quality), 6) as mean_quality, round(avg(utility), 6) as mean_utility from k join vm using (query_id) group by scope, view""")
def scope_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = view_table(spark, sf_dir)
    first = F.max(F.when(F.col("view") == "summary", F.col("quality"))).over(Window.partitionBy("query_id"))
    scopes = F.array_compact(F.array(F.lit("all"), F.when(first < 0.999, F.lit("imperfect")), F.when(first < 0.5, F.lit("hard"))))
    return views.withColumn("scopes", scopes).withColumn("scope", F.explode("scopes")).groupBy("scope", "view").agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg("quality"), 6).alias("mean_quality"), F.round(F.avg("utility"), 6).alias("mean_utility")
    )


@query(_RANKED + """, p as (select query_id, view as oracle, utility as u from ranked where r = 1),
two as (select query_id, view, utility, row_number() over (partition by query_id order by quality desc, ord) as k from vm),
s as (select query_id, max(utility) as u2, bool_or(view = oracle) as covered from two join p using (query_id) where k <= 2 group by query_id)
select round(avg(covered::int::double), 6) as oracle_coverage, round(avg(u2), 6) as utility_at_2, round(avg(u - u2), 6) as regret_at_2 from s join p using (query_id)""")
def set_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = view_table(spark, sf_dir)
    per = views.groupBy("query_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("quality")).alias("q"), "ord", "view", "utility"))), 1, 2).alias("two"),
        P.best_by("utility", "utility").alias("b"),
    )
    u2 = F.array_max(F.transform("two", lambda t: t["utility"]))
    return per.agg(
        F.round(F.avg(F.array_contains(F.transform("two", lambda t: t["view"]), F.col("b.view")).cast("double")), 6).alias("oracle_coverage"),
        F.round(F.avg(u2), 6).alias("utility_at_2"), F.round(F.avg(F.col("b.utility") - u2), 6).alias("regret_at_2"),
    )


@query("""with k as (select l_returnflag as control, l_orderkey, avg(l_discount) as q from lineitem group by 1, 2),
m as (select control, round(avg(q), 6) as mean_quality, count(*) as queries from k group by control)
select control, queries, mean_quality, round(mean_quality - max(case when control <> 'R' then mean_quality end) over (), 6) as diff_vs_best_control from m""")
def control_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("control"), "l_orderkey").agg(F.avg("l_discount").alias("q"))
    means = per.groupBy("control").agg(F.round(F.avg("q"), 6).alias("mean_quality"), F.count(F.lit(1)).alias("queries"))
    best = F.max(F.when(F.col("control") != "R", F.col("mean_quality"))).over(Window.partitionBy())
    return means.select("control", "queries", "mean_quality", F.round(F.col("mean_quality") - best, 6).alias("diff_vs_best_control"))


@query("""with p as (select event_type as view, avg(value) as mean, quantile_cont(value, [0.5, 0.95, 0.99]) as q from events group by 1)
select view, round(mean, 6) as mean_us, round(q[1], 6) as p50_us, round(q[2], 6) as p95_us, round(q[3], 6) as p99_us, round(1e6::double / mean, 4) as qps from p""")
def quantile_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("view")).agg(
        F.avg("value").alias("mean"), F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("q")
    )
    return per.select(
        "view", F.round("mean", 6).alias("mean_us"), *[F.round(F.col("q")[i], 6).alias(f"p{p}_us") for i, p in enumerate((50, 95, 99))],
        F.round(F.lit(1e6) / F.col("mean"), 4).alias("qps"),
    )


@query("""with p as (select event_type as view, sum(length(props)) as bytes, quantile_cont(value, 0.5) as lat from events group by 1)
select view, bytes, round(bytes / max(bytes) over (), 6) as c_mem, round(lat / max(lat) over (), 6) as c_lat,
  row_number() over (order by bytes, view) as mem_rank, row_number() over (order by lat, view) as lat_rank from p""")
def cost_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("view")).agg(
        F.sum(F.length("props")).alias("bytes"), F.percentile("value", F.lit(0.5)).alias("lat")
    )
    every = Window.partitionBy()
    return per.select(
        "view", "bytes", F.round(F.col("bytes") / F.max("bytes").over(every), 6).alias("c_mem"), F.round(F.col("lat") / F.max("lat").over(every), 6).alias("c_lat"),
        F.row_number().over(Window.orderBy("bytes", "view")).cast("long").alias("mem_rank"), F.row_number().over(Window.orderBy("lat", "view")).cast("long").alias("lat_rank"),
    )


@query(_RANKED + """, s as (select view, count(*) as n from ranked where r = 1 group by view), l(view, us) as (values
  ('summary', 2.1::double), ('binary', 11.4::double), ('pq', 13.2::double), ('int8', 11.5::double), ('hnsw16', 32.6::double), ('hnsw64', 71.0::double), ('full', 12.2::double))
select round(sum(n * us) / sum(n), 6) as mean_latency_us from s join l using (view)""")
def mean_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    latency = {"summary": 2.1, "binary": 11.4, "pq": 13.2, "int8": 11.5, "hnsw16": 32.6, "hnsw64": 71.0, "full": 12.2}
    table = spark.createDataFrame(list(latency.items()), "view string, us double")
    shares = P.oracle(view_table(spark, sf_dir)).groupBy(F.col("oracle_view").alias("view")).agg(F.count(F.lit(1)).alias("n"))
    return shares.join(F.broadcast(table), "view").agg(F.round(F.sum(F.col("n") * F.col("us")) / F.sum("n"), 6).alias("mean_latency_us"))


@query(_MEANS + """, p(view, parent) as (values ('binary', 'summary'), ('pq', 'summary'), ('int8', 'summary'), ('hnsw16', 'summary'), ('full', 'summary'), ('hnsw64', 'hnsw16'))
select m.view, coalesce(p.parent, '') as parent, m.cost as incremental_cost, round(m.cost + coalesce(a.cost, 0) + coalesce(b.cost, 0), 6) as cumulative_cost
from m left join p using (view) left join m a on a.view = p.parent left join p p2 on p2.view = p.parent left join m b on b.view = p2.parent""")
def dag_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..menus import DENSE_PARENTS

    means = _means(view_table(spark, sf_dir)).select("view", "cost")
    edges = spark.createDataFrame(list(DENSE_PARENTS.items()), "view string, parent string")
    names = {n: f"dag_{n}_{uuid.uuid4().hex}" for n in ("costs", "edges")}
    means.createOrReplaceTempView(names["costs"])
    edges.createOrReplaceTempView(names["edges"])
    summed = spark.sql(f"""
        with recursive up(view, at, total) as (
          select view, view, cost from {names["costs"]}
          union all
          select u.view, e.parent, u.total + c.cost from up u join {names["edges"]} e on e.view = u.at join {names["costs"]} c on c.view = e.parent)
        select c.view, coalesce(e.parent, '') as parent, c.cost as incremental_cost, round(max(u.total), 6) as cumulative_cost
        from up u join {names["costs"]} c on c.view = u.view left join {names["edges"]} e on e.view = c.view group by 1, 2, 3""")
    for name in names.values():
        spark.catalog.dropTempView(name)
    return summed


@query(_MEANS + """, s as (select *, lag(quality) over w as q0, lag(cost) over w as c0 from m window w as (order by ord)),
o as (select view, count(*) as n from (select query_id, view, row_number() over (partition by query_id order by utility desc, ord) as r from vm) where r = 1 group by view)
select s.view, round(quality, 6) as quality, round(quality - 0.08::double * cost, 6) as utility, case when abs(cost - c0) > 1e-12 then round((quality - q0) / (cost - c0), 6) end as lambda_from_previous,
  round(coalesce(n, 0) / (select count(*) from orders), 6) as oracle_share from s left join o using (view)""")
def ladder_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = view_table(spark, sf_dir)
    by = Window.orderBy("ord")
    step = _means(views).select("*", F.lag("quality").over(by).alias("q0"), F.lag("cost").over(by).alias("c0"))
    won = P.oracle(views).groupBy(F.col("oracle_view").alias("view")).agg(F.count(F.lit(1)).alias("n"))
    total = views.where("ord = 0").agg(F.count(F.lit(1)).alias("total"))
    dc = F.col("cost") - F.col("c0")
    return step.join(won, "view", "left").crossJoin(total).select(
        "view", F.round("quality", 6).alias("quality"), F.round(F.col("quality") - F.lit(0.08) * F.col("cost"), 6).alias("utility"),
        F.when(F.abs(dc) > 1e-12, F.round((F.col("quality") - F.col("q0")) / dc, 6)).alias("lambda_from_previous"),
        F.round(F.coalesce("n", F.lit(0)) / F.col("total"), 6).alias("oracle_share"),
    )
