"""Connected components of a graph of any size, by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, stored


def spanning_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) for the links a-b."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[ia], label[ib]
        least = np.minimum(la, lb)
        new = label.copy()
        for at in (ia, ib, la, lb):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    leaf = label != np.arange(len(nodes))
    return nodes[leaf], nodes[label[leaf]]


def _star(edges: DataFrame, rows: int, large: bool) -> DataFrame:
    """One star step on ``rows`` edges (a > b); large: over all neighbours,
    towards the smallest, of larger ones only; small: over smaller neighbours."""
    seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        seen = seen.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = seen.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    joined = hot_join(seen, "u", least, "u", "n", 2 * rows if large else rows)  # a hub may have any share of the edges
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        # (v, m) for each smaller neighbour, and (u, m) as the edge to m itself
        out = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))
    return out.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b), longs; root is the
    smallest node that can be reached."""
    edges = stored(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links"
    )
    while True:
        large = stored(_star(edges, edges.count(), large=True), "large")
        stars = stored(_star(large, large.count(), large=False), "stars")
        # done when every node but the roots has one edge, and no root has one
        over = stars.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        deep = over or stars.select(F.col("b").alias("a")).distinct().join(stars.select("a"), "a", "left_semi").limit(1).count()
        edges = stars
        if not deep:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
