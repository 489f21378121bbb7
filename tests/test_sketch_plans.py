"""Sketches of cells: nothing that grows with the cells goes through the driver."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from viewmint.operators import lab as L
from viewmint.plans import QUERIES, lab_queries

SMALL = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sketches_broadcast_nothing(spark):
    assert "Broadcast" not in _plan(QUERIES["sketches"](spark, SMALL))


def test_view_choice_broadcasts_rows_of_families_only(spark):
    """A row a family: its first curve, that curve's sketch and its parts."""
    plan = _plan(QUERIES["view_choice"](spark, SMALL))
    assert "LeftOuter" not in plan and len(re.findall(r"SortMergeJoin \[cell#\d+L\], \[cell#\d+L\], Inner", plan)) == 1


def test_points_of_curves_are_made_by_many_tasks(spark):
    cells = spark.range(2000).coalesce(1).select(F.col("id").alias("cell"), F.lit("trend").alias("family"))
    made = L.curves(cells, 120)
    assert made.rdd.getNumPartitions() == -(-2000 * 120 // L.TASK_POINTS)


def test_shares_of_a_cell_are_whole(spark):
    rows = lab_queries.L.sketch(spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, 1.0), (1, 1.0, 1.0), (2, 3.0, 3.0), (None, 0.0, 0.0)], "cell long, x double, y double"))
    assert sorted(map(tuple, rows.collect())) == [(1, 0, 0, 0.333333), (1, 3, 3, 0.666667), (2, 0, 0, 1.0)]
