"""Queries through registered Python functions and a solver's file."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registered as R
from .registry import query, read

_SOLVER = Path(__file__).resolve().parent.parent / "solvers" / "weighted_centre.py"


@query("""with l as (select l_orderkey, l_extendedprice as s, l_quantity as t from lineitem), n as (select l_orderkey, row_number() over () as i, s, t from l)
select l_orderkey, round(count(*) filter ((a.s - b.s) * (a.t - b.t) < 0) / count(*)::double, 9) as discordance
from n a join n b using (l_orderkey) where a.i < b.i and a.s <> b.s and a.t <> b.t group by l_orderkey
union all select l_orderkey, null from l group by l_orderkey having l_orderkey not in (
  select l_orderkey from n a join n b using (l_orderkey) where a.i < b.i and a.s <> b.s and a.t <> b.t)""")
def udaf_discordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the lines of each order rank otherwise by price than by quantity."""
    R.register(spark)
    line = read(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice", "l_quantity")
    return line.groupBy("l_orderkey").agg(F.round(F.call_function("discordance", "l_extendedprice", "l_quantity"), 9).alias("discordance"))


@query("""with l as (select l_orderkey, l_returnflag, row_number() over (partition by l_orderkey order by l_linenumber, case l_returnflag when 'R' then 0 when 'A' then 1 else 2 end) - 1 as i from lineitem)
select l_orderkey, '$.lines[' || i || '].' || case l_returnflag when 'R' then 'Gold-Label' else 'gold label' end as path from l where l_returnflag <> 'N'
union all select l_orderkey, '$.meta.oracle_view' from (select distinct l_orderkey from l) where l_orderkey % 4 = 0""")
def udtf_leak_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forbidden keys in nested texts made of orders, by the table function."""
    R.register(spark)
    one = F.col("l_returnflag")
    made = F.when(one == "R", F.to_json(F.struct("l_linenumber", F.lit(1).alias("Gold-Label")))).when(one == "A", F.to_json(F.struct("l_linenumber", F.lit(1).alias("gold label")))).otherwise(F.to_json(F.struct("l_linenumber", F.lit(1).alias("shown"))))
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", made.alias("j")))).alias("p"))
    meta = F.when(F.col("l_orderkey") % 4 == 0, F.lit('{"oracle_view": 1}')).otherwise(F.lit('{"view": 1}'))
    text = F.concat(F.lit('{"meta": '), meta, F.lit(', "lines": ['), F.array_join(F.transform("p", lambda x: x["j"]), ", "), F.lit("]}"))
    return spark.sql("select l_orderkey, f.path from {rows} as r, lateral leak_paths(r.text, array('gold_label', 'oracle_view')) as f", rows=lines.select("l_orderkey", text.alias("text")))


@query("""with c as (select l_orderkey as cell_id, sum(l_quantity * l_tax) / nullif(sum(l_tax), 0) as x, sum(l_discount * l_tax) / nullif(sum(l_tax), 0) as y, sum(l_tax) as w from lineitem group by 1)
select cell_id, round(x, 9) as x, round(y, 9) as y, case when w > 0 then null else 'ValueError: no weight' end as error from c""")
def solver_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cells, solved by a file with a user's function."""
    line = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    point = F.struct("l_linenumber", F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax")]).alias("p"))
    cells = line.groupBy(F.col("l_orderkey").alias("cell_id")).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(point)), lambda s: s["p"]).alias("points"))).alias("cell"))
    answer = F.from_json("answer", "cell_id long, x double, y double")
    return R.solved(cells, str(_SOLVER)).withColumn("a", answer).select("cell_id", F.round("a.x", 9).alias("x"), F.round("a.y", 9).alias("y"), "error")
