"""Queries on indexes: control titles by degree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import draws as W
from .registry import query, read

_NEAREST, _SEED = 64, 13


@query(f"""with recursive deg as (select p_partkey as title, count(l_orderkey) as degree from part left join lineitem on l_partkey = p_partkey group by 1),
asked as (select l_orderkey as qid, list(l_partkey order by l_linenumber, l_partkey) as sources from lineitem group by 1),
size as (select {_NEAREST} + 2 * max(len(sources)) as n from asked),
pools as (select d, list(title order by place) as pool from (
  select d, title, row_number() over (partition by d order by abs(degree - d), title) as place from deg, (select distinct degree as d from deg)), size
  where place <= n group by d),
draws as (select qid, sources, 0 as i, []::bigint[] as chosen from asked
  union all
  select qid, sources, i + 1, case when len(u) = 0 then chosen else list_append(chosen, u[1 + ('0x' || substr(md5('{_SEED}:' || qid::varchar || ':' || i::varchar), 1, 8))::bigint % len(u)]) end from (
    select qid, sources, i, chosen, list_filter(pool, lambda t: not list_contains(chosen, t) and not list_contains(sources, t))[1:{_NEAREST}] as u
    from draws join deg on deg.title = sources[i + 1] join pools on d = degree where i < len(sources)))
select qid, unnest(range(len(chosen)))::int as draw, unnest(chosen) as title from draws where i = len(sources)""")
def ctl_degree_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as titles, lines as their degree: for each part of every order a
    random part of a near degree."""
    line = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber")
    held = line.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("degree"))
    index = read(spark, sf_dir, "part", "p_partkey").join(held, F.col("p_partkey") == F.col("l_partkey"), "left").select(F.col("p_partkey").alias("title"), F.coalesce("degree", F.lit(0)).alias("degree"))
    listed = line.groupBy(F.col("l_orderkey").alias("qid")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("p"))
    asked = listed.select("qid", F.transform("p", lambda s: s["l_partkey"]).alias("sources")).withColumn("excluded", F.col("sources"))
    return W.degree_matched(asked, index, _SEED, _NEAREST)
