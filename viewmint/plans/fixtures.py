"""Tables of this domain's shape, made of the given ones.

Queries are orders and views are line numbers: a view's quality is the largest
quantity of such a line, as a share of 50, and 0 if there is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..menus import LAMBDA, MENUS
from ..operators.policy import with_utility
from .registry import read

VIEWS = 7


def view_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, dataset, price, view, ord, cost, quality, utility.

    An order meets its lines once, and its views are unfolded afterwards, so
    that a query's rows stay together and nothing is shuffled a row a view.
    """
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_totalprice")
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    best = lines.groupBy("l_orderkey").agg(*[(F.max(F.when(F.col("l_linenumber") == i + 1, F.col("l_quantity"))) / 50).alias(f"q{i}") for i in range(VIEWS)])
    met = orders.join(best, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    cells = F.array(*[
        F.struct(F.lit(v).alias("view"), F.lit(i).alias("ord"), F.lit(float(c)).alias("cost"), F.coalesce(f"q{i}", F.lit(0.0)).alias("quality"))
        for i, (v, c) in enumerate(MENUS["dense"][:VIEWS])
    ])
    each = met.select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("dataset"), F.col("o_totalprice").alias("price"), cells.alias("cells"))
    return with_utility(each.select("query_id", "dataset", "price", F.inline("cells")))


_VALUES = ", ".join(f"('{v}', {i}, {c}::double)" for i, (v, c) in enumerate(MENUS["dense"][:VIEWS]))

VM = f"""
menu(view, ord, cost) as (values {_VALUES}),
best as (select l_orderkey, l_linenumber, max(l_quantity) / 50 as quality from lineitem group by 1, 2),
vm as (select o_orderkey as query_id, o_orderpriority as dataset, o_totalprice as price, view, ord, cost,
    coalesce(quality, 0.0::double) as quality, round(coalesce(quality, 0.0::double) - {LAMBDA}::double * cost, 9) as utility
  from orders cross join menu left join best on l_orderkey = o_orderkey and l_linenumber = ord + 1)"""
