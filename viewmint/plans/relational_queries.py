"""One query for each relational category, over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query, read


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [read(spark, sf_dir, n) for n in names]


@query("select c_custkey as q_key, c_name as q_name, round(c_acctbal * 2, 4) as q_double from customer")
def proj_rename(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.round(F.col("c_acctbal") * 2, 4).alias("double")).withColumnsRenamed({"c_custkey": "q_key", "c_name": "q_name", "double": "q_double"})


@query("select o_orderkey, o_totalprice from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_totalprice > 200000 and o_orderdate >= timestamp '1996-01-01'")
def filter_isin(spark, sf_dir):
    return read(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_totalprice") > 200000) & (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))).select("o_orderkey", "o_totalprice")


@query("select c_custkey, coalesce(nullif(c_nationkey, 0), -1) as nation, case when c_acctbal < 0 then null else round(c_acctbal, 2) end as balance from customer")
def null_handling(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", F.coalesce(F.nullif("c_nationkey", F.lit(0)), F.lit(-1)).alias("nation"), F.when(F.col("c_acctbal") >= 0, F.round("c_acctbal", 2)).alias("balance"))


@query("select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
def equi_join(spark, sf_dir):
    o, c, n = _t(spark, sf_dir, "orders", "customer", "nation")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@query("select c_custkey, count(o_orderkey) as orders, round(coalesce(sum(o_totalprice), 0), 2) as total from customer left join orders on o_custkey = c_custkey group by c_custkey")
def left_join(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer", "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"))


@query("""with a as (select s_nationkey as k, count(*) as suppliers from supplier group by 1), b as (select c_nationkey as k, count(*) as customers from customer where c_acctbal > 9000 group by 1)
select coalesce(a.k, b.k) as nation, coalesce(suppliers, 0) as suppliers, coalesce(customers, 0) as customers from a full join b on a.k = b.k""")
def outer_join(spark, sf_dir):
    s, c = _t(spark, sf_dir, "supplier", "customer")
    a = s.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    b = c.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    return a.join(b, "nation", "full").na.fill(0, ["suppliers", "customers"])


@query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def semi_join(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer", "orders")
    return c.join(o.where("o_totalprice > 400000"), c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def anti_join(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer", "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


@query("select a.s_suppkey, count(*) as richer from supplier a join supplier b on b.s_acctbal > a.s_acctbal and b.s_nationkey <> a.s_nationkey group by a.s_suppkey")
def theta_join(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    a, b = s.alias("a"), s.alias("b")
    return a.join(b, (F.col("b.s_acctbal") > F.col("a.s_acctbal")) & (F.col("b.s_nationkey") != F.col("a.s_nationkey"))).groupBy(F.col("a.s_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("richer"))


@query("""select o_orderkey, count(*) as near from orders join (select o_orderkey as k, o_custkey as c, o_orderdate as d from orders) on o_custkey = c and k <> o_orderkey
  and d between o_orderdate - interval 30 day and o_orderdate + interval 30 day group by o_orderkey""")
def range_join(spark, sf_dir):
    """An interval join, as an equi-join on months: each order meets its own
    month and the two beside it."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("d"))
    bucket = F.floor(F.datediff("d", F.lit("1970-01-01").cast("date")) / 30)
    left = o.withColumn("b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    right = o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey"), F.col("d").alias("e"), bucket.alias("b"))
    met = left.join(right, ["o_custkey", "b"]).where((F.col("k") != F.col("o_orderkey")) & (F.abs(F.datediff("d", "e")) <= 30))
    return met.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("near"))


@query("""with p as (select event_id, user_id, ts, value from events where event_type = 'purchase'), c as (select user_id, ts, value from events where event_type = 'click')
select event_id, (select c.value from c where c.user_id = p.user_id and c.ts <= p.ts order by c.ts desc limit 1) as last_click from p""")
def asof_join(spark, sf_dir):
    """Each purchase with the last click before it, by one window."""
    last = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") == "purchase").rowsBetween(Window.unboundedPreceding, 0)
    e = read(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "click"))
    clicked = F.last(F.when(F.col("event_type") == "click", F.col("value")), ignorenulls=True).over(last)
    return e.withColumn("last_click", clicked).where("event_type = 'purchase'").select("event_id", "last_click")


@query("""select n_name, s_suppkey, s_acctbal from nation, lateral (select s_suppkey, s_acctbal from supplier where s_nationkey = n_nationkey order by s_acctbal desc, s_suppkey limit 2)""")
def lateral_topn(spark, sf_dir):
    s, n = _t(spark, sf_dir, "supplier", "nation")
    best = Window.partitionBy("s_nationkey").orderBy(F.col("s_acctbal").desc(), "s_suppkey")
    return s.withColumn("r", F.row_number().over(best)).where("r <= 2").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "s_suppkey", "s_acctbal")


@query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n
from lineitem where l_shipdate <= timestamp '2000-09-02' group by 1, 2""")
def group_agg(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"),
    )


@query("select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers from lineitem group by 1")
def distinct_agg(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@query()
def approx_distinct(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")).alias("parts"))


_DIMS = "from orders join customer on o_custkey = c_custkey"


@query(f"select coalesce(o_orderstatus, 'all') as status, round(sum(o_totalprice), 1) as total, count(*) as n from orders group by grouping sets ((), (o_orderstatus))")
def grouping_sets(spark, sf_dir):
    return read(spark, sf_dir, "orders").rollup("o_orderstatus").agg(F.round(F.sum("o_totalprice"), 1).alias("total"), F.count(F.lit(1)).alias("n")).select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), "total", "n")


@query(f"select o_orderstatus, c_mktsegment, grouping_id(o_orderstatus, c_mktsegment)::bigint as g, count(*) as n, round(avg(o_totalprice), 4) as mean {_DIMS} group by cube (o_orderstatus, c_mktsegment)")
def cube(spark, sf_dir):
    o, c = _t(spark, sf_dir, "orders", "customer")
    return o.join(c, o.o_custkey == c.c_custkey).cube("o_orderstatus", "c_mktsegment").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query(f"select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as f, count(*) filter (where o_orderstatus = 'O') as o, count(*) filter (where o_orderstatus = 'P') as p from orders group by 1")
def pivot(spark, sf_dir):
    wide = read(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return wide.withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


@query("select l_orderkey, l_linenumber, l_partkey, unnest(['discount', 'tax']) as name, unnest([l_discount, l_tax]) as value from lineitem")
def unpivot(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return l.unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["discount", "tax"], "name", "value")


@query("select event_type, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from events group by 1")
def value_counts(spark, sf_dir):
    n = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("select p_type, arg_max(p_partkey, (p_retailprice, p_partkey)) as dearest, arg_min(p_partkey, (p_retailprice, p_partkey)) as cheapest from part group by 1")
def argmax_group(spark, sf_dir):
    key = F.struct("p_retailprice", "p_partkey")
    return read(spark, sf_dir, "part").groupBy("p_type").agg(F.max_by("p_partkey", key).alias("dearest"), F.min_by("p_partkey", key).alias("cheapest"))


@query("select l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) as q25, round(quantile_cont(l_extendedprice, 0.5), 4) as q50, round(quantile_cont(l_extendedprice, 0.9), 4) as q90 from lineitem group by 1")
def quantiles(spark, sf_dir):
    q = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_extendedprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.9))).alias("q"))
    return q.select("l_returnflag", *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("q25", "q50", "q90"))])


@query("""select event_id, row_number() over w as rn, dense_rank() over (partition by user_id order by event_type) as dr, ntile(4) over w as nt, round(value - lag(value) over w, 4) as delta, lead(event_type) over w as next_type,
  first_value(event_type) over w as first_type from events window w as (partition by user_id order by ts, event_id)""")
def window_rank(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    long = lambda c: c.cast("long")
    return read(spark, sf_dir, "events").select(
        "event_id", long(F.row_number().over(w)).alias("rn"), long(F.dense_rank().over(Window.partitionBy("user_id").orderBy("event_type"))).alias("dr"), long(F.ntile(4).over(w)).alias("nt"),
        F.round(F.col("value") - F.lag("value").over(w), 4).alias("delta"), F.lead("event_type").over(w).alias("next_type"), F.first("event_type").over(w).alias("first_type"),
    )


@query("""select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 2 preceding and 2 following), 6) as smooth, round(max(value) over (partition by user_id order by ts, event_id), 6) as peak,
  count(*) over (partition by user_id order by ts range between interval 1 day preceding and current row) as last_day from events""")
def window_frames(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-86_400_000_000, 0)
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", F.round(F.avg("value").over(w.rowsBetween(-2, 2)), 6).alias("smooth"), F.round(F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("peak"), F.count(F.lit(1)).over(micros).alias("last_day"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def top_k(spark, sf_dir):
    return read(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("select s_suppkey as k, s_acctbal as b, 's' as side from supplier union all select c_custkey, c_acctbal, 'c' from customer")
def union_all(spark, sf_dir):
    s, c = _t(spark, sf_dir, "supplier", "customer")
    return s.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("b"), F.lit("s").alias("side")).unionByName(c.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("b"), F.lit("c").alias("side")))


@query("""(select 'both' as side, k from (select s_nationkey as k from supplier intersect select c_nationkey from customer)) union all (select 'customer only', k from (select c_nationkey as k from customer except select s_nationkey from supplier))""")
def set_ops(spark, sf_dir):
    s, c = (d.select(F.col(k).alias("k")) for d, k in zip(_t(spark, sf_dir, "supplier", "customer"), ("s_nationkey", "c_nationkey")))
    return s.intersect(c).select(F.lit("both").alias("side"), "k").unionByName(c.exceptAll(s.distinct()).distinct().join(s, "k", "left_anti").select(F.lit("customer only").alias("side"), "k"))


@query("""select c_mktsegment, c_custkey from customer qualify row_number() over (partition by c_mktsegment order by md5('3:' || c_custkey::varchar), c_custkey) <= 10""")
def stratified_sample(spark, sf_dir):
    order = Window.partitionBy("c_mktsegment").orderBy(F.md5(F.concat(F.lit("3:"), F.col("c_custkey").cast("string"))), "c_custkey")
    return read(spark, sf_dir, "customer").withColumn("r", F.row_number().over(order)).where("r <= 10").select("c_mktsegment", "c_custkey")


@query("select p_partkey, upper(p_name) as up, length(p_name) as len, replace(p_name, ' ', '_') as snake, split_part(p_name, ' ', 1) as head, substr(p_brand, 7) as brand_no, contains(p_name, 'ring') as has_ring, lpad(p_size::varchar, 4, '0') as padded from part")
def string_functions(spark, sf_dir):
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.upper("p_name").alias("up"), F.length("p_name").cast("long").alias("len"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("snake"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("head"),
        F.substring("p_brand", 7, 100).alias("brand_no"), F.contains("p_name", F.lit("ring")).alias("has_ring"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"),
    )


@query("select c_custkey, md5(c_name) as m, sha256(c_name) as s, sha1(c_name) as s1 from customer")
def hash_functions(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", F.md5("c_name").alias("m"), F.sha2("c_name", 256).alias("s"), F.sha1("c_name").alias("s1"))


@query("select l_orderkey, l_linenumber, l_partkey, round(ln(l_quantity), 6) as ln, round(log2(l_quantity + 1), 6) as lg, round(sqrt(l_extendedprice), 6) as rt, round(tanh(l_discount), 6) as th, round_even(l_quantity / 4, 0) as rn, greatest(0.02, least(0.06, l_discount))::double as clipped from lineitem")
def math_functions(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(F.log("l_quantity"), 6).alias("ln"), F.round(F.log2(F.col("l_quantity") + 1), 6).alias("lg"), F.round(F.sqrt("l_extendedprice"), 6).alias("rt"),
        F.round(F.tanh("l_discount"), 6).alias("th"), F.rint(F.col("l_quantity") / 4).alias("rn"), F.greatest(F.lit(0.02), F.least(F.lit(0.06), F.col("l_discount"))).alias("clipped"),
    )


@query("""with a as (select l_orderkey, list(distinct l_suppkey) as s, list(l_quantity) as q from lineitem group by 1)
select l_orderkey, len(s) as suppliers, list_contains(s, 1) as has_one, round(list_sum(q), 2) as total, list_max(q) as top, len(list_filter(q, lambda x: x > 25)) as large from a""")
def array_functions(spark, sf_dir):
    a = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s"), F.collect_list("l_quantity").alias("q"))
    return a.select("l_orderkey", F.size("s").cast("long").alias("suppliers"), F.array_contains("s", 1).alias("has_one"), F.round(F.aggregate("q", F.lit(0.0), lambda x, y: x + y), 2).alias("total"), F.array_max("q").alias("top"), F.size(F.filter("q", lambda x: x > 25)).cast("long").alias("large"))


@query("with m as (select l_orderkey, l_linenumber, max(l_quantity) as q from lineitem group by 1, 2) select l_orderkey, l_linenumber::varchar as key, q as value from m where q > 40")
def map_functions(spark, sf_dir):
    m = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    scores = m.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("l_linenumber").cast("string"), "q"))).alias("m"))
    return scores.select("l_orderkey", F.explode(F.map_filter("m", lambda _, v: v > 40)).alias("key", "value"))


@query("select event_id, (props->>'$.k')::int as k, (props->>'$.k')::int >= 50 as large from events")
def json_functions(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select("event_id", k.alias("k"), (k >= 50).alias("large"))


@query("select o_orderkey, year(o_orderdate)::int as y, month(o_orderdate)::int as m, strftime(o_orderdate, '%Y%m%d') as compact, date_diff('day', o_orderdate, timestamp '1999-01-01')::int as days from orders")
def date_functions(spark, sf_dir):
    d = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.date_format(d, "yyyyMMdd").alias("compact"), F.datediff(F.lit("1999-01-01").cast("date"), d.cast("date")).alias("days"))


@query("select time_bucket(interval 6 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def tumbling_window(spark, sf_dir):
    w = read(spark, sf_dir, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("select time_bucket(interval 3 hour, ts) - to_hours(3 * k) as start, count(*) as n from events, (select unnest([0, 1]) as k) group by all")
def sliding_window(spark, sf_dir):
    w = read(spark, sf_dir, "events").groupBy(F.window("ts", "6 hours", "3 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), "n")


@query("""with g as (select *, (ts >= lag(ts) over w + interval 12 hour or lag(ts) over w is null)::int as fresh from events window w as (partition by user_id order by ts)),
s as (select *, sum(fresh) over (partition by user_id order by ts) as sid from g) select user_id, min(ts) as start, count(*) as n, round(sum(value), 4) as total from s group by user_id, sid""")
def session_window(spark, sf_dir):
    w = read(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select("user_id", F.col("w.start").alias("start"), "n", "total")


@query("""with recursive chain as (select n_nationkey as root, n_nationkey as spot, 0 as depth from nation union all select root, (spot * 7 + 3) % 25, depth + 1 from chain where depth < 6)
select root, count(distinct spot) as reached, max(depth)::int as depth from chain group by root""")
def recursive_query(spark, sf_dir):
    read(spark, sf_dir, "nation").createOrReplaceTempView("nation_chain")
    return spark.sql("""with recursive chain as (select n_nationkey as root, n_nationkey as at, 0 as depth from nation_chain union all select root, (at * 7 + 3) % 25, depth + 1 from chain where depth < 6)
        select root, count(distinct at) as reached, max(depth) as depth from chain group by root""")


@query("""with x as (select c_nationkey as k, avg(c_acctbal) as m, stddev_samp(c_acctbal) / sqrt(count(*)) as se from customer group by 1), a as (select m, se from x where k = 0)
select k, round(x.m - a.m, 4) as delta, greatest(x.m - 1.96::double * x.se, a.m - 1.96::double * a.se) <= least(x.m + 1.96::double * x.se, a.m + 1.96::double * a.se) as overlaps from x, a""")
def ci_overlap(spark, sf_dir):
    half = F.lit(1.96) * F.stddev_samp("c_acctbal") / F.sqrt(F.count(F.lit(1)).cast("double"))
    x = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("m"), half.alias("h"))
    a = x.where("k = 0").select(F.col("m").alias("am"), F.col("h").alias("ah"))
    low, high = F.greatest(F.col("m") - F.col("h"), F.col("am") - F.col("ah")), F.least(F.col("m") + F.col("h"), F.col("am") + F.col("ah"))
    return x.crossJoin(a).select("k", F.round(F.col("m") - F.col("am"), 4).alias("delta"), (low <= high).alias("overlaps"))
