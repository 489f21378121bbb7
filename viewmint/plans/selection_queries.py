"""Selection under uncertainty: gates over grids, repeated splits, budgets of
labels and perturbed prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import hash_unit
from ..operators import gates as G
from ..operators import policy as P
from ..operators import stats as T
from ..operators.splits import split_602020
from .fixtures import VM, view_table
from .policy_queries import _CE, _MEANS, _gains, _means
from .registry import query, read
from .stats_queries import _SPLIT

_AT7 = [0.05, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95]
_FOUR = ("summary", "pq", "int8", "full")


@query(f"""with {VM}, w as (select query_id, max(case when view = 'summary' then quality end) as m1, max(case when view = 'pq' then quality end) as m2, any_value(price) as m3, {", ".join(f"max(case when view = '{v}' then utility end) as u_{v}" for v in _FOUR)} from vm group by query_id),
a as (select round(unnest(quantile_cont(m1, {_AT7})), 9) as t1 from w), b as (select round(unnest(quantile_cont(m2, {_AT7})), 9) as t2 from w), c as (select round(unnest(quantile_cont(m3, {_AT7})), 9) as t3 from w),
an as (select *, row_number() over () as i from a), bn as (select *, row_number() over () as j from b), cn as (select *, row_number() over () as k from c)
select t1, t2, t3, round(avg(case when m1 > t1 then u_summary when m2 > t2 then u_pq when m3 > t3 then u_int8 else u_full end), 6) as utility from w, an, bn, cn group by i, j, k, t1, t2, t3""")
def gate_three(spark, sf_dir):
    """Three margins, seven quantiles each."""
    at = lambda v, c: F.max(F.when(F.col("view") == v, F.col(c)))
    w = view_table(spark, sf_dir).groupBy("query_id").agg(at("summary", "quality").alias("m1"), at("pq", "quality").alias("m2"), F.max("price").alias("m3"), *[at(v, "utility").alias(f"u_{v}") for v in _FOUR])
    return G.margin_grid(w, ["m1", "m2", "m3"], [f"u_{v}" for v in _FOUR], _AT7)


@query(_CE + """, e as (select quantile_cont(score, 0.33) as lo, quantile_cont(score, 0.67) as hi from g),
x as (select case when score <= lo then 'low' when score >= hi then 'high' else 'middle' end as bucket, gain from g, e)
select bucket, count(*) as n, round(avg((gain > 0.0464::double)::int::double), 6) as worth_share, round(avg(gain), 6) as mean_gain from x group by bucket""")
def hard_buckets(spark, sf_dir):
    rows = _gains(view_table(spark, sf_dir))
    lo, hi = T.quantiles(rows, "score", [0.33, 0.67])
    bucket = F.when(F.col("score") <= lo, "low").when(F.col("score") >= hi, "high").otherwise("middle")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("gain") > 0.0464).cast("double")), 6).alias("worth_share"), F.round(F.avg("gain"), 6).alias("mean_gain"))


@query("""with e as (select quantile_cont(o_totalprice, [0.3333333333333333, 0.6666666666666666]) as q from orders),
t as (select o_orderstatus, o_totalprice, case when o_totalprice <= q[1] then 0 when o_totalprice <= q[2] then 1 else 2 end as tertile from orders, e)
select tertile::int as tertile, o_orderstatus, count(*) as n, round(avg(o_totalprice), 4) as mean_price from t group by all""")
def tertile_grid(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_orderstatus", "o_totalprice")
    lo, hi = T.quantiles(o, "o_totalprice", [1 / 3, 2 / 3])
    tertile = F.when(F.col("o_totalprice") <= lo, 0).when(F.col("o_totalprice") <= hi, 1).otherwise(2)
    return o.groupBy(tertile.alias("tertile"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


_SEEDS = 20


def _splits(group: str) -> str:
    return f"""k as (select seed, {group} as g, view, ord, utility, ('0x' || substr(md5(seed::varchar || ':' || query_id::varchar), 1, 8))::bigint % 5 = 0 as held from vm, (select unnest(range({_SEEDS})) as seed)),
fx as (select seed, view from (select seed, view, ord, round(avg(utility), 9) as u from k where not held group by all) qualify row_number() over (partition by seed order by u desc, ord) = 1),
ow as (select seed, g, view from (select seed, g, view, ord, round(avg(utility), 9) as u from k where not held group by all) qualify row_number() over (partition by seed, g order by u desc, ord) = 1),
sf as (select k.seed, avg(utility) as fixed from k join fx on k.seed = fx.seed and k.view = fx.view where held group by k.seed), sa as (select k.seed, avg(utility) as adaptive from k join ow on k.seed = ow.seed and k.g = ow.g and k.view = ow.view where held group by k.seed),
sp as (select seed, round(fixed, 6) as fixed, round(adaptive, 6) as adaptive, round(adaptive - fixed, 6) as delta from sf join sa using (seed))"""


_SUM = "select count(*) as splits, round(avg(delta), 6) as delta, round(quantile_cont(delta, 0.025), 6) as lo, round(quantile_cont(delta, 0.975), 6) as hi, round(avg((delta > 0)::int::double), 6) as positive from sp"
_RANDOM = "('0x' || substr(md5('group:' || query_id::varchar), 1, 8))::bigint % 5"


@query(f"with {VM}, {_splits('dataset')} select seed::int as seed, fixed, adaptive, delta from sp")
def repeat_split(spark, sf_dir):
    """Reseeded fifths: the best view of each dataset over the best fixed view."""
    return P.repeated_splits(view_table(spark, sf_dir), "dataset", _SEEDS)


@query(f"with {VM}, {_splits('dataset')} {_SUM}")
def repeat_summary(spark, sf_dir):
    return P.split_summary(P.repeated_splits(view_table(spark, sf_dir), "dataset", _SEEDS))


@query(f"""with a as (with {VM}, {_splits('dataset')} {_SUM}), b as (with {VM}, {_splits(_RANDOM)} {_SUM}), t as (select a.*, b.delta as control_delta, a.delta > 0.015::double as delta_passes, a.lo > 0 as interval_passes, a.positive >= 0.9::double as share_passes, a.delta > b.delta as beats_control from a, b)
select *, delta_passes and interval_passes and share_passes and beats_control as success from t""")
def success_gate(spark, sf_dir):
    """Datasets as groups, against groups at random."""
    views = view_table(spark, sf_dir)
    h = F.conv(F.substring(F.md5(F.concat(F.lit("group:"), F.col("query_id").cast("string"))), 1, 8), 16, 10).cast("long") % 5
    sums = P.split_sums(views.withColumn("_random", h), ("dataset", "_random"), _SEEDS)
    real, control = (P.split_summary(P.splits_of(sums, g)) for g in ("dataset", "_random"))
    return P.success(real, control)


@query(_MEANS + """, r as (select unnest(range(1000)) as rep),
u as (select rep, view, ord, round(quality - 0.08::double * cost * (0.8::double + 0.4::double *
  (('0x' || substr(md5(rep::varchar || ':' || view), 1, 8))::bigint / 4294967296.0::double)), 9) as u from m, r),
base as (select view from m order by round(quality - 0.08::double * cost, 9) desc, ord limit 1),
w as (select rep, view, u from u qualify row_number() over (partition by rep order by u desc, ord) = 1),
g as (select w.rep, w.view, round(w.u - u.u, 9) as regret from w join u on u.rep = w.rep join base on base.view = u.view),
t as (select round(avg((g.view <> base.view)::int::double), 6) as change_rate, round(avg(regret), 9) as mean_regret, round(quantile_cont(regret, 0.9), 9) as p90_regret from g, base)
select g.view, count(*) as n, round(count(*) / 1000.0::double, 6) as share, g.view <> base.view as changed, change_rate, mean_regret, p90_regret from g, base, t group by g.view, base.view, change_rate, mean_regret, p90_regret""")
def perturb_boot(spark, sf_dir):
    """Prices up or down by a fifth: which view wins, how often that isn't the
    one chosen at the menu's prices, and what it costs to have kept that."""
    means = _means(view_table(spark, sf_dir))
    reps = spark.range(1000).select(F.col("id").alias("rep"))
    factor = F.lit(0.8) + F.lit(0.4) * hash_unit(F.concat(F.col("rep").cast("string"), F.lit(":"), F.col("view")))
    drawn = means.crossJoin(reps).withColumn("utility", F.round(F.col("quality") - F.lit(0.08) * F.col("cost") * factor, 9))
    base = P.with_utility(means).agg(P.best_by("utility").alias("b")).select(F.col("b.view").alias("base"))
    kept = F.max(F.when(F.col("view") == F.col("base"), F.col("utility")))
    won = drawn.crossJoin(F.broadcast(base)).groupBy("rep", "base").agg(P.best_by("utility", "utility").alias("b"), kept.alias("kept"))
    won = won.select("rep", "base", F.col("b.view").alias("view"), F.round(F.col("b.utility") - F.col("kept"), 9).alias("regret"))
    whole = won.agg(F.round(F.avg((F.col("view") != F.col("base")).cast("double")), 6).alias("change_rate"), F.round(F.avg("regret"), 9).alias("mean_regret"), F.round(F.percentile("regret", F.lit(0.9)), 9).alias("p90_regret"))
    per = won.groupBy("view", "base").agg(F.count(F.lit(1)).alias("n"))
    return per.crossJoin(whole).select("view", "n", F.round(F.col("n") / 1000.0, 6).alias("share"), (F.col("view") != F.col("base")).alias("changed"), "change_rate", "mean_regret", "p90_regret")


_SHARES = [0.05, 0.1, 0.2]


@query(f"""with {VM}, w as (select query_id, price, max(case when view = 'pq' then quality end) as m, max(case when view = 'full' then quality end) as e from vm group by all),
z as (select query_id, -(m - avg(m) over ()) / stddev_pop(m) over () + (e - avg(e) over ()) / stddev_pop(e) over () + 0.5::double * (price - avg(price) over ()) / stddev_pop(price) over () as v, e - m as gain from w),
r as (select *, row_number() over (order by round(v, 9) desc, query_id) as k, count(*) over () as n from z), b as (select unnest({_SHARES}::double[]) as budget),
s as (select budget, seed, gain, ('0x' || substr(md5(seed::varchar || ':' || query_id::varchar), 1, 8))::bigint / 4294967296.0::double < budget as taken from r, b, (select unnest(range(50)) as seed)),
d as (select budget, seed, avg(gain) as g, count(*) as c from s where taken group by all)
select 'valued' as arm, budget, count(*)::double as labels, round(avg(gain), 6) as mean_gain, 0.0::double as spread from r, b where k <= floor(budget * n) group by budget
union all select 'random', budget, round(avg(c), 6), round(avg(g), 6), round(stddev_pop(g), 6) from d group by budget""")
def label_budget(spark, sf_dir):
    """Labels of the most promising rows against labels at random, 50 seeds."""
    wide = view_table(spark, sf_dir).groupBy("query_id", "price").pivot("view", ["pq", "full"]).agg(F.max("quality"))
    stats = wide.agg(*[f(c).alias(f"{n}_{c}") for c in ("pq", "full", "price") for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda c: (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")
    value = -z("pq") + z("full") + F.lit(0.5) * z("price")
    scored = wide.crossJoin(F.broadcast(stats)).select("query_id", F.round(value, 9).alias("v"), (F.col("full") - F.col("pq")).alias("gain"))
    n = scored.count()
    best = T.top_rows(scored, "v", "query_id", max(_SHARES))
    at = F.explode(F.array(*[F.lit(b) for b in _SHARES])).alias("budget")
    valued = best.select("gain", "place", at).where(F.col("place") <= F.floor(F.col("budget") * n)).groupBy("budget").agg(F.count(F.lit(1)).cast("double").alias("labels"), F.round(F.avg("gain"), 6).alias("mean_gain"))
    seeds = scored.select("query_id", "gain", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("seed"))
    u = hash_unit(F.concat_ws(":", F.col("seed").cast("string"), F.col("query_id").cast("string")))
    drawn = seeds.withColumn("u", u).where(F.col("u") < max(_SHARES)).select("gain", "seed", "u", at).where("u < budget")
    per = drawn.groupBy("budget", "seed").agg(F.avg("gain").alias("g"), F.count(F.lit(1)).alias("c"))
    random = per.groupBy("budget").agg(F.round(F.avg("c"), 6).alias("labels"), F.round(F.avg("g"), 6).alias("mean_gain"), F.round(F.stddev_pop("g"), 6).alias("spread"))
    return valued.select(F.lit("valued").alias("arm"), "budget", "labels", "mean_gain", F.lit(0.0).alias("spread")).unionByName(random.select(F.lit("random").alias("arm"), "budget", "labels", "mean_gain", "spread"))


_BOARD = {"all": ["summary", "binary", "pq", "int8", "hnsw16", "hnsw64", "full"], "cheap": ["summary", "binary", "pq"], "two": ["summary", "full"]}


def _board_sql() -> str:
    parts = []
    for name, allowed in _BOARD.items():
        views = ", ".join(f"'{v}'" for v in allowed)
        parts.append(f"""select '{name}' as menu, p.policy, count(*) as queries, round(avg(u), 6) as utility, round(avg(o - u), 6) as regret from (
  select query_id, max(utility) as o, max(case when view = fx then utility end) as uf, max(case when view = coalesce(ow, fx) then utility end) as ug from (
    select t.query_id, t.view, t.utility, f.view as fx, g.view as ow from sv t left join (select dataset, view from (select dataset, view, ord, round(avg(utility), 9) as m from sv where split = 'train' and view in ({views}) group by all) qualify row_number() over (partition by dataset order by m desc, ord) = 1) g using (dataset),
    (select view from (select view, ord, round(avg(utility), 9) as m from sv where split = 'train' and view in ({views}) group by all) order by m desc, ord limit 1) f where t.split = 'test' and t.view in ({views})) group by query_id) q,
  lateral (select unnest(['fixed', 'grouped', 'oracle']) as policy, unnest([uf, ug, o]) as u) p group by p.policy""")
    return " union all ".join(parts)


@query(f"with {VM}, {_SPLIT}, sv as (select vm.*, split.split from vm join split on o_orderkey = query_id) {_board_sql()}")
def split_driver(spark, sf_dir):
    """Fixed, grouped and oracle policies of one split under three menus."""
    views = view_table(spark, sf_dir)
    split = split_602020(read(spark, sf_dir, "orders", "o_orderkey"), "o_orderkey", 7).withColumnRenamed("o_orderkey", "query_id")
    return P.split_board(views, split, "dataset", _BOARD)
