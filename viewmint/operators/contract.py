"""Menus against costs, keys, visibility and scoring of rows; the rules of
submitted routes are in ``routes``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..menus import LAMBDA


def duplicates(rows: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(line).alias("first_line")).where("n > 1")


def last_wins(rows: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(line)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in others])


def key_differences(manifest: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys only one of the two has."""
    one = lambda a, b, name: a.join(b, keys, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "n")
    return one(manifest, reference, "manifest_only").unionByName(one(reference, manifest, "reference_only"))


def menu_errors(views: DataFrame, costs: DataFrame) -> DataFrame:
    """(view_id, error) of a view menu against a cost menu; '' if there's none."""
    twice = F.count(F.lit(1)).over(Window.partitionBy("view_id")) > 1
    met = views.withColumn("_twice", twice).join(costs, "cost_key", "left")
    error = F.when(F.col("_twice"), "view named twice").when(F.col("cost").isNull(), "no cost").when(F.col("cost") < 0, "negative cost").otherwise("")
    return met.select("view_id", error.alias("error"))


def visible(rows: DataFrame, public: list[str], hidden: list[str]) -> DataFrame:
    """The public columns; hidden ones are refused when the plan is made."""
    shown = set(public) & set(hidden)
    if shown:
        raise ValueError(f"hidden fields can't be shown: {sorted(shown)}")
    return rows.select(*public)


def score(routes: DataFrame, reference: DataFrame, lam: float = LAMBDA) -> DataFrame:
    """Quality, cost, utility and regret of each route (query_id, route).

    ``reference``: query_id, view, score, cost.  A route without a score has
    quality and cost 0; a query without reference has no row.
    """
    best = reference.groupBy("query_id").agg(F.max(F.round(F.col("score") - lam * F.col("cost"), 9)).alias("best"))
    got = reference.select("query_id", F.col("view").alias("route"), "score", "cost")
    met = routes.join(best, "query_id").join(got, ["query_id", "route"], "left")
    quality, cost = F.coalesce("score", F.lit(0.0)), F.when(F.col("score").isNotNull(), F.col("cost")).otherwise(0.0)
    gained = quality - lam * cost
    return met.select(
        "query_id", F.round(quality, 6).alias("quality"), F.round(cost, 6).alias("cost"), F.round(gained, 6).alias("utility"),
        F.round(F.greatest(F.lit(0.0), F.col("best") - gained), 6).alias("regret"),
    )


def score_summary(rows: DataFrame) -> DataFrame:
    """Means of rows that are rounded already, rounded again."""
    means = [F.round(F.avg(c), 6).alias(c) for c in ("quality", "cost", "utility", "regret")]
    return rows.agg(F.count(F.lit(1)).alias("rows"), *means)


def forbid(rows: DataFrame, names: set[str]) -> DataFrame:
    """``rows``, if no column has a forbidden name."""
    bad = [c for c in rows.columns if c.lower() in names]
    return reduce(lambda d, c: d.drop(c), bad, rows)
