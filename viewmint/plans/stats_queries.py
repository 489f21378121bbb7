"""Splits, gates, learners, resampling and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..menus import MENUS
from ..operators import gates as G
from ..operators import policy as P
from ..operators import splits as S
from ..operators import stats as T
from ..operators.lineage import cut
from .fixtures import VM, view_table
from .registry import query, read


def _key(seed: int, column: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {column}::varchar), 1, 8))::bigint"


_SPLIT = f"""r as (select o_orderkey, o_orderpriority, row_number() over (order by {_key(7, 'o_orderkey')}, o_orderkey) as k, count(*) over () as n from orders),
split as (select o_orderkey, o_orderpriority, case when k <= floor(0.6::double * n) then 'train' when k <= floor(0.6::double * n) + floor(0.2::double * n) then 'dev' else 'test' end as split from r)"""


@query(f"with {_SPLIT} select o_orderkey, split from split")
def split_602020(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_602020(read(spark, sf_dir, "orders", "o_orderkey"), "o_orderkey", 7)


@query(f"""with r as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by {_key(5, 'o_orderkey')}, o_orderkey) as k, count(*) over (partition by o_orderpriority) as n from orders)
select o_orderkey, o_orderpriority, case when k <= greatest(1, round_even(0.6::double * n, 0)) then 'train' when k <= greatest(1, round_even(0.6::double * n, 0)) + greatest(1, round_even(0.2::double * n, 0)) then 'dev' else 'test' end as split from r""")
def split_strat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_stratified(read(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 5).select("o_orderkey", "o_orderpriority", "split")


@query(f"select fold::int as fold, count(*) as n, count(distinct o_custkey) as groups from (select o_custkey, {_key(0, 'o_custkey')} % 5 as fold from orders) group by fold")
def split_groupkfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.folds(read(spark, sf_dir, "orders", "o_custkey"), "o_custkey", 5).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("groups"))


@query(f"""with r as (select o_orderkey, row_number() over (order by {_key(9, 'o_orderkey')}, o_orderkey) - 1 as a, count(*) over () as n from orders)
select o_orderkey, (case when a < (n % 7) * (n // 7 + 1) then a // (n // 7 + 1) else n % 7 + (a - (n % 7) * (n // 7 + 1)) // greatest(n // 7, 1) end)::int as fold from r""")
def split_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven shuffled folds of equal sizes."""
    return S.shuffled_folds(read(spark, sf_dir, "orders", "o_orderkey"), "o_orderkey", 7, 9)


_WIDE = f"""{VM}, wide as (select query_id, any_value(price) as price, max(case when view = 'summary' then quality end) as margin,
  max(case when view = 'summary' then utility end) as u_summary, max(case when view = 'pq' then utility end) as u_pq, max(case when view = 'full' then utility end) as u_full from vm group by query_id)"""


def _gate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda v, c: F.max(F.when(F.col("view") == v, F.col(c)))
    return view_table(spark, sf_dir).groupBy("query_id").agg(
        F.max("price").alias("price"), at("summary", "quality").alias("margin"), *[at(v, "utility").alias(f"u_{v}") for v in ("summary", "pq", "full")]
    )


_AT = [0.1, 0.25, 0.5, 0.75, 0.9]
_GRID = f"""with {_WIDE}, th as (select 'margin' as feature, unnest(quantile_cont(margin, {_AT})) as t from wide union all select 'price', unnest(quantile_cont(price, {_AT})) from wide),
tt as (select feature, round(t, 9) as threshold from th), w(direction) as (values ('above'), ('below')),
g as (select feature, direction, threshold, round(avg(case when (case when feature = 'margin' then margin else price end > threshold) = (direction = 'above') then u_full else u_summary end), 9) as utility
  from wide, tt, w group by all)"""


@query(_GRID + " select distinct feature, direction, threshold, round(utility, 6) as utility from g")
def gate_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _gate_rows(spark, sf_dir)
    return G.gate_grid(rows, G.quantile_thresholds(rows, ["margin", "price"], _AT), "summary", "full").withColumn("utility", F.round("utility", 6)).distinct()


@query(_GRID + " select feature, direction, threshold, round(utility, 6) as utility from g order by g.utility desc, feature desc, direction desc, threshold limit 1")
def gate_rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _gate_rows(spark, sf_dir)
    grid = G.gate_grid(rows, G.quantile_thresholds(rows, ["margin", "price"], _AT), "summary", "full")
    return G.best_gate(grid).withColumn("utility", F.round("utility", 6))


@query(f"""with {_WIDE}, a as (select unnest([0.0, 0.2, 0.4, 0.6, 0.8]::double[]) as t1), b as (select unnest([100000.0, 200000.0, 300000.0, 400000.0]::double[]) as t2),
g as (select t1, t2, round(avg(case when margin > t1 then u_summary when price > t2 then u_pq else u_full end), 9) as u from wide, a, b group by all)
select t1, t2, round(u, 6) as utility from g""")
def gate_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary if its margin passes, else PQ if the price does, else full."""
    cells = [(a, b) for a in (0.0, 0.2, 0.4, 0.6, 0.8) for b in (1e5, 2e5, 3e5, 4e5)]
    gate = lambda a, b: F.when(F.col("margin") > a, F.col("u_summary")).when(F.col("price") > b, F.col("u_pq")).otherwise(F.col("u_full"))
    wide = _gate_rows(spark, sf_dir).agg(*[F.round(F.avg(gate(a, b)), 6).alias(f"g{i}") for i, (a, b) in enumerate(cells)])
    rows = F.array(*[F.struct(F.lit(a).alias("t1"), F.lit(b).alias("t2"), F.col(f"g{i}").alias("utility")) for i, (a, b) in enumerate(cells)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


@query(f"""with {_WIDE}, {_SPLIT}, tr as (select margin as x, u_full - u_pq as y from wide join split on o_orderkey = query_id where split = 'train'),
s as (select count(*) + 1e-9::double as n, sum(x) as sx, sum(x * x) + 1 as sxx, sum(y) as sy, sum(x * y) as sxy from tr), w as (select (sy * sxx - sx * sxy) / (n * sxx - sx * sx) as w0, (n * sxy - sx * sy) / (n * sxx - sx * sx) as w1 from s),
g as (select query_id, round(w0 + w1 * margin, 9) as gain from wide join split on o_orderkey = query_id, w where split = 'test')
select query_id, round(gain, 6) as gain, case when gain > 0.02::double then 'full' else 'pq' end as view from g""")
def gate_margin_ce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full where the gain over PQ that the train part predicts from the margin
    is above 0.02; routes of the test part."""
    _, train, test = _learning(spark, sf_dir)
    return G.predicted_gain_gate(train, test, ["margin"], "full", "pq", 0.02)


@query("select o_orderkey as query_id, case when o_orderpriority = '1-URGENT' then 'full' when o_totalprice > 300000 then 'int8' when o_orderstatus = 'O' then 'pq' else 'summary' end as route from orders")
def router_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = F.when(F.col("o_orderpriority") == "1-URGENT", "full").when(F.col("o_totalprice") > 300000, "int8").when(F.col("o_orderstatus") == "O", "pq").otherwise("summary")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), route.alias("route"))


@query(f"""with {VM}, f as (select *, {_key(0, 'query_id')} % 5 as fold from vm),
m as (select dataset, view, ord, round(avg(utility), 9) as u from f where fold <> 0 group by all), w as (select view, ord, round(avg(utility), 9) as u from f where fold <> 0 group by all)
(select dataset, view, round(u, 6) as utility from m qualify row_number() over (partition by dataset order by u desc, ord) = 1)
union all (select null, view, round(u, 6) from w order by u desc, ord limit 1)""")
def bandit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bandit(S.folds(view_table(spark, sf_dir), "query_id", 5).where("fold != 0"), "dataset")


_FEATURES = ["margin", "scaled_price"]


#: What routers choose from, by place on the menu.
_OFFERED = {v: (i, c) for i, (v, c) in enumerate(MENUS["dense"]) if v in ("summary", "pq", "full")}


def _featured(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"margin": F.col("q_summary"), "scaled_price": F.col("price") / 5e5})


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a query: price, best utility, and each offered view's columns."""
    at = lambda v, c: F.max(F.when(F.col("view") == v, F.col(c)))
    return view_table(spark, sf_dir).groupBy("query_id").agg(
        F.max("price").alias("price"), F.max("utility").alias("best_utility"), *[at(v, "utility").alias(f"u_{v}") for v in _OFFERED], *[at(v, "quality").alias(f"q_{v}") for v in _OFFERED]
    )


def _learning(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that routers learn from and are judged by, their train part and
    their test part.  Learners read the rows many times, so they are computed
    once."""
    rows = _featured(S.split_in_place(cut(_wide(spark, sf_dir)), "query_id", 7))
    return rows, rows.where("split = 'train'"), rows.where("split = 'test'")


def _offers() -> Column:
    """An array of the views that a row of ``_learning`` may be sent to."""
    return F.array(*[
        F.struct(F.lit(v).alias("view"), F.lit(i).alias("ord"), F.lit(float(c)).alias("cost"), F.col(f"q_{v}").alias("quality"), F.col(f"u_{v}").alias("utility")) for v, (i, c) in _OFFERED.items()
    ])


def _judged(routes: DataFrame, rows: DataFrame, costly: str = "ce") -> DataFrame:
    """Means of what routes of some of ``rows`` give."""
    return P.evaluate_offered(routes, rows.select("query_id", "best_utility", _offers().alias("offers")), costly)


@query()
def router_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-form ridge of the views' utilities; argmax routes the test part."""
    _, train, test = _learning(spark, sf_dir)
    views = ["summary", "pq", "full"]
    w = G.ridge_fit(train, _FEATURES, [f"u_{v}" for v in views])
    cells = F.array(*[F.struct(F.lit(v).alias("view"), F.lit(i).alias("ord"), G.linear(w[:, i], _FEATURES).alias("prediction")) for i, v in enumerate(views)])
    long = test.select("query_id", F.explode(cells).alias("c")).select("query_id", "c.*")
    return _judged(G.route_argmax(long, "ridge"), test)


@query()
def router_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, train, test = _learning(spark, sf_dir)
    made = G.tree_predictions(train, test, _FEATURES, {v: f"u_{v}" for v in ("summary", "pq", "full")})
    return _judged(G.route_argmax(made, "forest"), test)


@query()
def router_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, train, test = _learning(spark, sf_dir)
    made = G.tree_predictions(train, test, _FEATURES, {v: f"u_{v}" for v in ("pq", "full")}, "boosted")
    return _judged(G.route_argmax(made, "boosted"), test)


@query()
def router_selective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full when a classifier holds it likelier than not to beat PQ."""
    label = (F.col("u_full") > F.col("u_pq")).cast("double")
    _, train, test = _learning(spark, sf_dir)
    scored = G.classifier_probability(train.withColumn("y", label), test.withColumn("y", label), _FEATURES, "y", "forest")
    return _judged(G.apply_gate(scored, F.col("p"), F.lit(0.5), "pq", "full", "selective"), test)


@query()
def router_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum over the other views of the chance to beat them, by logistic models."""
    _, train, test = _learning(spark, sf_dir)
    views = ["summary", "pq", "full"]
    out = test.select("query_id", *_FEATURES, *[f"u_{v}" for v in views], *[F.lit(0.0).alias(f"s_{v}") for v in views])
    for i, a in enumerate(views):
        for b in views[i + 1 :]:
            y = (F.col(f"u_{a}") > F.col(f"u_{b}")).cast("double")
            out = G.classifier_probability(train.withColumn("y", y), out.withColumn("y", y), _FEATURES, "y")
            out = out.withColumns({f"s_{a}": F.col(f"s_{a}") + F.col("p"), f"s_{b}": F.col(f"s_{b}") + 1 - F.col("p")}).drop("p", "y")
    cells = F.array(*[F.struct(F.lit(v).alias("view"), F.lit(i).alias("ord"), F.col(f"s_{v}").alias("prediction")) for i, v in enumerate(views)])
    long = out.select("query_id", F.explode(cells).alias("c")).select("query_id", "c.*")
    return _judged(G.route_argmax(long, "pairwise"), test)


_REPS = 1000


def _mix(x: str, name: str, source: str) -> str:
    """``source`` with the 32-bit mixer of ``x`` as a column more."""
    low = "4294967295"
    first = f"(select *, ({x}) & {low} as _a from {source})"
    second = f"(select *, (xor(_a, _a >> 16) * 2146121005) & {low} as _b from {first})"
    return f"(select * exclude (_a, _b, _c), xor(_c, _c >> 16) as {name} from (select *, (xor(_b, _b >> 15) * 73244475) & {low} as _c from {second}))"


@query(f"""with {_WIDE}, d as (select h, v, rep from {_mix("xor(query_id, 11 * 1000003)", "h", "(select query_id, u_full - u_pq as v from wide)")}, (select unnest(range({_REPS})) as rep)),
u as (select rep, v, g & 65535 as u from {_mix("h + rep * 40503", "g", "d")}),
w as (select rep, v, {" + ".join(f"(u >= {c})::int" for c in T.POISSON)} as w from u),
m as (select rep, sum(w * v) / sum(w) as m from w group by rep)
select (select round(avg(u_full - u_pq), 6) from wide) as mean, round(quantile_cont(m, 0.025), 6) as lo, round(quantile_cont(m, 0.975), 6) as hi, round(avg((m > 0)::int::double), 6) as positive, count(*) as reps from m""")
def boot_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired differences of two views' utilities, query by query."""
    paired = _wide(spark, sf_dir).select("query_id", (F.col("u_full") - F.col("u_pq")).alias("value"))
    return T.bootstrap_ci(paired, "value", _REPS, index="query_id")


@query("""with f as (select event_type as policy, user_id % 5 as fold, avg(value) as v from events group by all)
select policy, count(v) as n, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as sd, round(case when count(v) = 5 then 2.776::double else 1.96::double end * stddev_samp(v) / sqrt(count(v)), 6) as half from f group by policy""")
def fold_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("policy"), (F.col("user_id") % 5).alias("fold")).agg(F.avg("value").alias("v"))
    return T.fold_ci(per, "policy", "v")


_P = "p as (select l.doc_id, quality as y, least(n_chars / 5000.0::double, 1.0::double) as p from labels l join documents d using (doc_id))"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "n_chars")
    return read(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("y"), F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("p"))


@query(f"with {_P}, b as (select least(floor(p * 10), 9) as bin, count(*) as n, avg(p) as mp, avg(y) as my from p group by 1) select round(sum(n * abs(mp - my)) / sum(n), 6) as ece from b")
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ece(_scored(spark, sf_dir), "p", "y")


_AUC = f"""with {_P}, g as (select p, sum(y)::bigint as pos, count(*) - sum(y)::bigint as neg, count(*) as n from p group by p),
w as (select *, coalesce(sum(neg) over (order by p rows between unbounded preceding and 1 preceding), 0) as under, sum(pos) over (order by p desc) as tp, sum(n) over (order by p desc) as called from g)"""


@query(_AUC + " select round(sum(pos * (under + neg / 2)) / (sum(pos) * sum(neg)), 6) as auc from w")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.auc(_scored(spark, sf_dir), "p", "y")


@query(_AUC + f", b as (select round(avg(y), 6) as prevalence, round(avg((p - y) * (p - y)), 6) as brier, round(avg((p > 0.5::double)::int), 6) as buy_rate from p) select prevalence, brier, buy_rate, (select round(sum(pos * tp / called) / sum(pos), 6) from w) as auprc from b")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    y = F.col("y").cast("double")
    basic = rows.agg(F.round(F.avg(y), 6).alias("prevalence"), F.round(F.avg(F.pow(F.col("p") - y, 2)), 6).alias("brier"), F.round(F.avg((F.col("p") > 0.5).cast("int")), 6).alias("buy_rate"))
    return basic.crossJoin(T.average_precision(rows, "p", "y"))


@query("""with r as (select rank() over (order by o_totalprice) + (count(*) over (partition by o_totalprice) - 1) / 2 as ra, rank() over (order by o_custkey) + (count(*) over (partition by o_custkey) - 1) / 2 as rb from orders)
select round(corr(ra, rb), 6) as spearman from r""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.spearman(read(spark, sf_dir, "orders"), "o_totalprice", "o_custkey")


@query("""with t as (select n_nationkey as k, avg(c_acctbal) as a, count(*)::double as b from customer join nation on c_nationkey = n_nationkey group by 1),
p as (select sign(x.a - y.a) * sign(x.b - y.b) as s from t x join t y on x.k < y.k) select round(sum(s) / sum(abs(s)), 6) as kendall from p""")
def kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("a"), F.count(F.lit(1)).cast("double").alias("b"))
    return T.kendall(per, "a", "b", "k")


@query("""with r as (select s_suppkey, (rank() over (order by s_acctbal) + (count(*) over (partition by s_acctbal) - 1) / 2) / count(*) over () as pct,
  (s_acctbal - min(s_acctbal) over ()) / (max(s_acctbal) over () - min(s_acctbal) over ()) as mm, (s_acctbal - avg(s_acctbal) over ()) / stddev_pop(s_acctbal) over () as z from supplier)
select s_suppkey, round(pct, 6) as pct_rank, round(mm, 6) as minmax, round(z, 6) as zscore from r""")
def pct_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    stats = s.agg(F.count(F.lit(1)).alias("n"), F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"), F.avg("s_acctbal").alias("m"), F.stddev_pop("s_acctbal").alias("sd"))
    return T.with_average_rank(s, "s_acctbal", "r").crossJoin(stats).select(
        "s_suppkey", F.round(F.col("r") / F.col("n"), 6).alias("pct_rank"), F.round((F.col("s_acctbal") - F.col("lo")) / (F.col("hi") - F.col("lo")), 6).alias("minmax"),
        F.round((F.col("s_acctbal") - F.col("m")) / F.col("sd"), 6).alias("zscore"),
    )


@query("with w as (select l_orderkey, arg_min(l_returnflag, (l_extendedprice, l_returnflag)) as winner from lineitem group by 1) select winner, count(*) as wins, round(count(*) / sum(count(*)) over (), 6) as rate from w group by winner")
def winner_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_returnflag", F.struct("l_extendedprice", "l_returnflag")).alias("winner"))
    n = won.groupBy("winner").agg(F.count(F.lit(1)).alias("wins"))
    return n.withColumn("rate", F.round(F.col("wins") / F.sum("wins").over(Window.partitionBy()), 6))


@query("select c_custkey, ('0x' || substr(sha256(c_name), 1, 2))::int % 2 as label from customer")
def rng_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", (F.conv(F.substring(F.sha2("c_name", 256), 1, 2), 16, 10).cast("int") % 2).alias("label"))


@query("""with s as (select avg(o_totalprice) as m, greatest(stddev_pop(o_totalprice), 1e-6::double) as sd from orders where o_orderkey % 5 <> 0)
select o_orderkey, round((o_totalprice - m) / sd, 6) as z from orders, s""")
def feat_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    stats = o.where("o_orderkey % 5 != 0").agg(F.avg("o_totalprice").alias("m"), F.greatest(F.stddev_pop("o_totalprice"), F.lit(1e-6)).alias("sd"))
    return o.crossJoin(stats).select("o_orderkey", F.round((F.col("o_totalprice") - F.col("m")) / F.col("sd"), 6).alias("z"))


@query("select event_id, (event_type = 'signup')::int as is_signup, (event_type = 'click')::int as is_click, (event_type = 'view')::int as is_view, regexp_extract(props, '\"k\": *([0-9]+)', 1)::int as k from events")
def feat_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        "event_id", *[(F.col("event_type") == v).cast("int").alias(f"is_{v}") for v in ("signup", "click", "view")], F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("int").alias("k")
    )


@query(f"with {VM} select query_id, view, round(price / 500000, 9) as price, cost, ord, (view = 'pq')::int as is_pq, (view = 'full')::int as is_full from vm")
def feat_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view_table(spark, sf_dir).select(
        "query_id", "view", F.round(F.col("price") / 500000, 9).alias("price"), "cost", "ord", (F.col("view") == "pq").cast("int").alias("is_pq"), (F.col("view") == "full").cast("int").alias("is_full")
    )
