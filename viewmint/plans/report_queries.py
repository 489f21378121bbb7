"""Reports as JSON texts that are made of the tables, flattened and joined."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import core as C
from ..operators import metrics as M
from ..operators import reports as R
from .collection_queries import _LINES, _NORM, _lines
from .fixtures import VM, view_table
from .registry import query, read

# SQL that means the same here and in DuckDB.
_REPORT = """concat('{"lambda": 0.', o_orderkey % 9, case when o_orderkey % 3 = 0 then '' else ', "cost_profile": "C_mem"' end, ', "best_fixed": {"name": "', o_orderstatus, '", "utility": 0.', o_orderkey % 1000 + 1000, '}',
  case when o_orderkey % 4 = 0 then ', "best_restricted_pipeline": null' else concat(', "best_restricted_pipeline": {"name": "r', o_orderkey % 5, '", "utility": 0.5}') end, ', "joint_oracle": {"utility": 0.9', o_orderkey % 10, '}',
  case o_orderkey % 5 when 0 then concat(', "repeated_602020": {"best_learned_minus_best_fixed_mean": 0.0', o_orderkey % 7, ', "best_learned_minus_best_fixed_ci": [0.001, 0.2], "positive_split_share": 0.95, "n_splits": 20}')
    when 1 then ', "repeat_summary": {"learned_minus_best_fixed_mean": -0.01, "ci95": [-0.03, 0.01], "positive_share": 0.4, "n_repeats": 10}' when 2 then ', "repeats": {"delta_mean": 0.02, "n": 5}' else '' end, '}')"""
_REPORTS = f"reports as (select o_orderkey::varchar as name, {_REPORT} as raw from orders)"


def _reports(spark, sf_dir):
    return read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").select(F.col("o_orderkey").cast("string").alias("name"), F.expr(_REPORT).alias("raw"))


def _num(path: str) -> str:
    return f"try_cast(raw->>'$.{path}' as double)"


@query(f"""with {_REPORTS} select name, coalesce(raw->>'$.cost_profile', 'C_op') as cost_profile, {_num("lambda")} as "lambda", raw->>'$.best_fixed.name' as best_fixed, {_num("best_fixed.utility")} as best_fixed_utility,
  raw->>'$.best_restricted_pipeline.name' as best_restricted, {_num("best_restricted_pipeline.utility")} as best_restricted_utility, raw->>'$.best_joint_learner.name' as best_learner, {_num("best_joint_learner.utility")} as best_learner_utility,
  {_num("joint_oracle.utility")} as oracle_utility, {_num("repeated_602020.best_learned_minus_best_fixed_mean")} as repeat_delta, {_num("repeated_602020.positive_split_share")} as positive_share from reports""")
def regime_rows(spark, sf_dir):
    return R.headline(_reports(spark, sf_dir))


@query(f"""with {_REPORTS} select name, try_cast(coalesce(raw->>'$.repeat_summary.n_repeats', raw->>'$.repeated_602020.n_splits', raw->>'$.repeats.n') as int) as repeats,
  coalesce({_num("repeat_summary.learned_minus_best_fixed_mean")}, {_num("repeated_602020.best_learned_minus_best_fixed_mean")}, {_num("repeats.delta_mean")}) as delta,
  coalesce({_num("repeat_summary.ci95[0]")}, {_num("repeated_602020.best_learned_minus_best_fixed_ci[0]")}) as lo, coalesce({_num("repeat_summary.ci95[1]")}, {_num("repeated_602020.best_learned_minus_best_fixed_ci[1]")}) as hi,
  coalesce({_num("repeat_summary.positive_share")}, {_num("repeated_602020.positive_split_share")}) as positive_share from reports""")
def repeat_index(spark, sf_dir):
    return R.repeats(_reports(spark, sf_dir))


_LEARNER = "concat(case p_size % 6 when 0 then 'Random forest ' when 1 then 'GBDT ' when 2 then 'ridge_' when 3 then 'fixed ' when 4 then 'MLP ' else 'other ' end, p_size)"


@query(f"""with r as (select p_brand as report, p_partkey as place, {_LEARNER} as learner, round(p_retailprice / 10000, 6) as utility, case when p_partkey % 2 = 0 then p_size / 100.0::double end as lo, (p_size + 3) / 100.0::double as hi, p_size % 10 / 10.0::double as a, 1 - p_size % 10 / 10.0::double as b from part),
f as (select * from r qualify row_number() over (partition by report, learner order by place) = 1)
select report, learner, case when lower(learner) like '%gbdt%' then 'boosting' when lower(learner) like '%forest%' then 'forest' when lower(learner) like '%ridge%' then 'linear' when lower(learner) like '%mlp%' then 'neural' when lower(learner) like '%fixed%' then 'fixed' else 'other' end as family,
  utility, case when lo is not null then '[' || printf('%.4f', lo) || ', ' || printf('%.4f', hi) || ']' else '' end as ci,
  case when b = 0 then 'full ' || printf('%.1f', a * 100) || '%' when a = 0 then 'pq ' || printf('%.1f', b * 100) || '%' when a >= b then 'full ' || printf('%.1f', a * 100) || '%; pq ' || printf('%.1f', b * 100) || '%' else 'pq ' || printf('%.1f', b * 100) || '%; full ' || printf('%.1f', a * 100) || '%' end as choices from f""")
def learner_table(spark, sf_dir):
    a = F.col("p_size") % 10 / F.lit(10.0)
    rows = read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("report"), F.col("p_partkey").alias("place"), F.expr(_LEARNER).alias("learner"), F.round(F.col("p_retailprice") / 10000, 6).alias("utility"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") / F.lit(100.0)).alias("lo"), ((F.col("p_size") + 3) / F.lit(100.0)).alias("hi"), F.create_map(F.lit("full"), a, F.lit("pq"), 1 - a).alias("shares"),
    )
    return R.learner_rows(rows)


_PROFILE = """concat('{"task": "t', p_size % 4, '"', case when p_size % 3 = 0 then '' else concat(', "dataset": "', p_brand, '"') end, ', "rows": [', case when p_size % 5 = 0 then '' else concat('{"view": "pq", "C_op": 0.2, "bytes_touched": ', p_partkey, '}, {"view": "full", "p95_us": 1.5}, {"view": "a"}, {"view": "b"}') end, ']}')"""


@query(f"""with p as (select p_partkey::varchar as name, {_PROFILE} as raw from part) select name, raw->>'$.task' as task, raw->>'$.dataset' as dataset, json_array_length(raw, '$.rows')::int as rows,
  case when json_array_length(raw, '$.rows') = 0 then '[]' else '[{{"view":"pq","C_op":0.2,"bytes_touched":' || name || '}},{{"view":"full","p95_us":1.5}},{{"view":"a"}}]' end as views from p""")
def cost_smoke(spark, sf_dir):
    return R.cost_smoke(read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), F.expr(_PROFILE).alias("raw")))


@query(f"""with {VM}, m as (select dataset, view, ord, round(avg(utility), 9) as utility from vm group by all), a as (select dataset, ord, utility from m where view <> 'full'), b as (select o_orderpriority as dataset, ord, round(avg(o_totalprice) / 1e6, 9) as utility from orders, (select distinct ord from m) group by all),
j as (select dataset, ord, a.utility as x, b.utility as y from a join b using (dataset, ord)) select dataset, ord, 'flow' as family, x as utility, 0.0::double as delta from j union all select dataset, ord, 'context', y, round(y - x, 8) from j""")
def tag_family_fallback(spark, sf_dir):
    """Two families that are there, and one that isn't."""
    m = view_table(spark, sf_dir).groupBy("dataset", "view", "ord").agg(F.round(F.avg("utility"), 9).alias("utility"))
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("dataset")).agg(F.round(F.avg("o_totalprice") / 1e6, 9).alias("utility"))
    b = o.crossJoin(F.broadcast(m.select("ord").distinct()))
    return R.joined_families({"flow": m.where("view != 'full'"), "transformer": None, "context": b}, ["dataset", "ord"], "utility")


@query(f"""with {VM} select 'row count' as "check", count(*) = (select count(*) * 7 from orders) as passed from vm union all select 'no missing figures', count(*) = count(quality) and count(*) = count(cost) from vm
union all select 'top baseline', (select view from (select view, round(avg(utility), 9) as u from vm group by view) order by u desc, view desc limit 1) = 'summary'""")
def claim_checks(spark, sf_dir):
    return R.claim_checks(view_table(spark, sf_dir), 7 * read(spark, sf_dir, "orders").count(), "view", "utility", "summary", ["quality", "cost"])


@query("""with p as (select event_type as pass, sum(length(props)) as bytes, sum(value) as seconds, count(*) as lines from events group by 1), n as (select count(distinct user_id) as n from events),
a as (select * from p union all select 'all', sum(bytes), sum(seconds), sum(lines) from p) select pass, bytes, round(seconds, 4) as seconds, lines, case when seconds > 0 then round(bytes / seconds / 1e6::double, 9) end as mb_s, round(seconds / n, 9) as s_per_query from a, n""")
def systems_profile(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    passes = e.select(F.col("event_type").alias("pass"), F.length("props").cast("long").alias("bytes"), F.col("value").alias("seconds"), F.lit(1).cast("long").alias("lines"))
    return R.systems_profile(passes, e.select("user_id").distinct().count())


_CASE = "case when p_size % 6 = 0 then p_name else concat('budget_', p_size, '_', p_type, ':', p_brand, ':', p_partkey, case when p_size % 2 = 0 then ':x' else '' end) end"


@query(f"""with c as (select p_partkey, {_CASE} as case_id from part), m as (select *, regexp_matches(case_id, '^budget_\\d+_[^:]+:[^:]+:\\d+') as ok from c)
select p_partkey, case_id, case when ok then regexp_extract(case_id, '^budget_(\\d+)_([^:]+):([^:]+):(\\d+)', 1)::bigint else -1 end as budget_id, case when ok then regexp_extract(case_id, '^budget_(\\d+)_([^:]+):([^:]+):(\\d+)', 2) else 'unknown' end as budget_name,
  case when ok then regexp_extract(case_id, '^budget_(\\d+)_([^:]+):([^:]+):(\\d+)', 3) else 'unknown' end as family, case when ok then regexp_extract(case_id, '^budget_(\\d+)_([^:]+):([^:]+):(\\d+)', 4)::bigint else -1 end as seed, length(case_id) as case_len from m""")
def feat_case(spark, sf_dir):
    return R.case_features(read(spark, sf_dir, "part").select("p_partkey", F.expr(_CASE).alias("case_id")), "case_id")


_TIERS = R.tier_slices(3, 20, 6, 6, 6)


@query("with e as (select vec_id, list_transform(embedding[1:41], lambda x: x::double) as v from embeddings) " + " union all ".join(f"select vec_id, '{t}' as tier, {len(p)} as n, round(list_sum([v[i + 1] for i in {p}]), 6) as total from e" for t, p in _TIERS.items()))
def tier_slices(spark, sf_dir):
    """Features of each legality tier."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 41).cast("array<double>").alias("v"))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    cells = F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(len(p)).alias("n"), F.round(add(R.sliced(F.col("v"), p)), 6).alias("total")) for t, p in _TIERS.items()])
    return e.select("vec_id", F.explode(cells).alias("c")).select("vec_id", "c.*")


@query("""with l as (select l_orderkey as o, list(l_linenumber - 1 order by l_extendedprice desc, l_linenumber) as ord, list_distinct(list(l_linenumber - 1) filter (where l_returnflag = 'R')) as rel from lineitem group by 1),
g as (select o, ord, coalesce(rel, []) as rel from l)
select o, case when len(rel) = 0 then 0 else round(list_sum([case when list_contains(rel, ord[i]) then 1 / log2(i + 1) else 0 end for i in range(1, least(len(ord), 3) + 1)]) / list_sum([1 / log2(i + 1) for i in range(1, least(len(rel), 3) + 1)]), 6) end as ndcg from g""")
def ndcg_order(spark, sf_dir):
    """Binary NDCG of positions: lines by price, relevant are those returned."""
    at = (F.col("l_linenumber") - 1).alias("at")
    per = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("l_extendedprice")).alias("p"), at))), lambda s: s["at"]).alias("order"),
        F.array_distinct(F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber") - 1))).alias("rel"),
    )
    return per.select("o", M.ndcg_order(F.col("order"), F.col("rel"), 3).alias("ndcg"))


@query(f"""with {_LINES}, t as (select o, {_NORM.format("p_brand")} as t, min(n) as first from l group by all), s as (select * from t qualify row_number() over (partition by o order by first, t) <= 3),
g as (select distinct o, unnest([{_NORM.format("p_brand")}, {_NORM.format("p_type")}]) as g from l where n % 3 <> 0), n as (select o, count(*) as n from g group by o), h as (select s.o, count(*) as shown, count(g.g) as hits from s left join g on g.o = s.o and g.g = s.t group by s.o),
p as (select h.o, coalesce(hits / n, 0) as r, hits / shown as p from h left join n using (o))
select 'o' || o::varchar as id, round(r, 6) as recall, round(p, 6) as precision, round(2 * p * r / greatest(p + r, 1e-12::double), 6) as f1 from p""")
def endpoint_f1(spark, sf_dir):
    """Recall and F1 of the first three titles against evidence endpoints."""
    brands = F.transform(F.array_sort(F.transform("l", lambda x: F.struct(x["n"].alias("n"), C.norm_title(x["p_brand"]).alias("t")))), lambda s: s["t"])
    ends = F.filter("l", lambda x: x["n"] % 3 != 0)
    gold = F.array_distinct(F.concat(F.transform(ends, lambda x: C.norm_title(x["p_brand"])), F.transform(ends, lambda x: C.norm_title(x["p_type"]))))
    return _lines(spark, sf_dir).select(F.concat(F.lit("o"), F.col("o").cast("string")).alias("id"), M.title_metrics(brands, gold, 3).alias("m")).select("id", "m.*")
