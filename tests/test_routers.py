"""Routers on a planted rule: each must find it through its own query."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from viewmint.functions import core as C
from viewmint.menus import menu
from viewmint.operators.policy import with_utility
from viewmint.plans import QUERIES, lab_queries, stats_queries

SMALL = "/root/testdata/sf0.001"

#: Any constant route of these views has 0.51 at most; the best routes have 0.85 and 0.62.
OF_THREE = ("router_ridge", "router_tree", "router_pairwise", "router_expanded", "router_ce", "router_fitted_q", "router_deferral", "router_proxy")
OF_TWO = ("router_boosted", "router_selective", "router_selective_reg")


@pytest.fixture(scope="module")
def planted(spark):
    """Up to a margin of a half full is best, beyond it it's worth nothing and
    summary, whose quality is the margin, or PQ is."""
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    margin = C.hash_unit(F.concat(F.lit("planted:"), F.col("o_orderkey").cast("string")))
    every = orders.select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("dataset"), F.col("o_totalprice").alias("price"), margin.alias("m")).crossJoin(F.broadcast(menu(spark, "dense", 7)))
    quality = F.when(F.col("view") == "summary", F.col("m")).when(F.col("view") == "full", (F.col("m") <= 0.5).cast("double")).when(F.col("view") == "pq", 0.3).otherwise(0.0)
    return with_utility(every.withColumn("quality", quality).drop("m")).persist()


@pytest.mark.parametrize("name", OF_THREE + OF_TWO)
def test_the_rule_is_found(spark, planted, monkeypatch, name):
    for module in (stats_queries, lab_queries):
        monkeypatch.setattr(module, "view_table", lambda spark, sf_dir: planted)
    rows = QUERIES[name](spark, SMALL).collect()
    assert rows and min(r["mean_utility"] for r in rows) > (0.8 if name in OF_THREE else 0.57)
