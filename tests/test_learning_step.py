"""The step that routers share: one row a query, computed once, and its judging."""

from __future__ import annotations

from pyspark.sql import functions as F

from viewmint.operators import policy as P
from viewmint.operators import splits as S
from viewmint.plans import stats_queries as Q
from viewmint.plans.fixtures import view_table

SMALL = "/root/testdata/sf0.001"


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_views_of_a_query_stay_together(spark):
    """Orders and lines are shuffled once; grouping the views by query adds nothing."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _exchanges(view_table(spark, SMALL).groupBy("query_id").agg(F.max("utility"))) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_that_learners_read_hold_no_shuffle(spark):
    rows, train, _ = Q._learning(spark, SMALL)
    assert _exchanges(train) == 0 and rows.count() == spark.read.parquet(f"{SMALL}/orders.parquet").count()


def test_split_in_place_is_the_split(spark):
    for n in (0, 1, 2, 4, 5, 7, 1003):
        rows = spark.range(n).union(spark.range(0).limit(0))
        pair = lambda df: sorted((r["id"], r["split"]) for r in df.collect())
        assert pair(S.split_in_place(rows, "id", 7)) == pair(S.split_602020(rows, "id", 7))


def test_offers_are_judged_like_views(spark):
    rows, _, test = Q._learning(spark, SMALL)
    views = view_table(spark, SMALL)
    pick = F.when(F.col("query_id") % 3 == 0, "summary").when(F.col("query_id") % 3 == 1, "pq").otherwise("full")
    for of in (rows, test):
        routes = of.select("query_id", F.lit("some").alias("policy"), pick.alias("view"))
        assert Q._judged(routes, of, "full").collect() == P.evaluate(routes, views, "full").collect()


def test_grouped_router_shuffles_no_row_of_its_routes(spark):
    """Routes stand beside the rows that judge them: only the means are shuffled."""
    from viewmint.plans import QUERIES

    plan = QUERIES["router_proxy"](spark, SMALL)
    assert _exchanges(plan) == 1 and plan.count() == 2


def test_routes_are_judged_beside_their_rows(spark):
    rows, _, _ = Q._learning(spark, SMALL)
    offered = F.when(F.col("query_id") % 5 != 0, F.col("u_pq"))  # some aren't offered PQ
    rows = rows.withColumn("u_pq", offered)
    pick = F.when(F.col("query_id") % 3 == 0, "summary").when(F.col("query_id") % 3 == 1, "pq").otherwise("full")
    routes = rows.select("query_id", F.lit("some").alias("policy"), pick.alias("view"))
    beside = rows.select("query_id", F.lit("some").alias("policy"), pick.alias("view"), "best_utility", Q._offers().alias("offers"))
    views = view_table(spark, SMALL).where("view != 'pq' or query_id % 5 != 0").drop("best_utility")
    best = view_table(spark, SMALL).groupBy("query_id").agg(F.max("utility").alias("best_utility"))
    met = routes.join(views, ["query_id", "view"]).join(best, "query_id")
    assert P.evaluate_beside(beside, "full").collect() == P._means(met, "full").collect()
