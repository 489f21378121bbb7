"""Trees on binned features: histogram boosting and extremely random trees.

Features are put into bins once, and rows that share all their bins become one
row with their number and their sum of targets, so that few features make few
rows, whatever the input's size.  A level of trees needs one aggregate: sums of
gradients by (tree, node, feature, bin), combined on the map side; the driver
gets that many rows at most, and chooses the splits.
Trees are arrays in heap order (children of node n are 2n and 2n + 1), so rows
find their nodes by an expression and nothing is joined or kept between levels.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import core as C
from .lineage import cut


@dataclass
class Tree:
    """Per node: the feature that splits it (-1: none), the last bin that goes
    left, and the node's value."""

    feature: list[int]
    last: list[int]
    value: list[float]

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 1 << (depth + 1)
        return cls([-1] * n, [0] * n, [0.0] * n)


@dataclass
class Forest:
    features: list[str]
    edges: list[list[float]]
    depth: int
    trees: list[Tree] = field(default_factory=list)
    base: float = 0.0

    def values(self, bins: Column) -> Column:
        """array<double>: each tree's value of a row with these bins."""
        node = _nodes(self.trees, self.depth, bins)
        value = _nested([t.value for t in self.trees], "double")
        return F.transform(node, lambda n, t: F.get(F.get(value, t), n))

    def total(self, bins: Column) -> Column:
        if not self.trees:
            return F.lit(self.base)
        return F.aggregate(self.values(bins), F.lit(self.base), lambda s, v: s + v)


def _nested(values: list[list], kind: str) -> Column:
    return F.from_json(F.lit(str(values)), f"array<array<{kind}>>")


def _nodes(trees: list[Tree], depth: int, bins: Column) -> Column:
    """array<int>: each tree's lowest node that a row gets to."""
    feature, last = _nested([t.feature for t in trees], "int"), _nested([t.last for t in trees], "int")

    def walk(t: Column) -> Column:
        def step(n: Column, _: Column) -> Column:
            f = F.get(F.get(feature, t), n)
            return F.when(f < 0, n).otherwise(2 * n + (F.get(bins, f) > F.get(F.get(last, t), n)).cast("int"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), step)

    return F.transform(F.sequence(F.lit(0), F.lit(len(trees) - 1)), walk)


def bin_edges(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Upper edges of each feature's bins, at approximate quantiles, ascending."""
    at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    clean = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features]
    found = rows.agg(*[F.percentile_approx(c, at, 10_000).alias(f"_{i}") for i, c in enumerate(clean)]).first()
    return [sorted(set(e or [])) for e in found]


def binned(features: list[str], edges: list[list[float]]) -> Column:
    """array<int>: each feature's bin, 0 for null and NaN, else 1 plus the
    number of edges below the value."""

    def of(name: str, edge: list[float]) -> Column:
        x = F.col(name).cast("double")
        below = F.size(F.filter(F.from_json(F.lit(str(edge)), "array<double>"), lambda e: e < x))
        return F.when(x.isNull() | F.isnan(x), 0).otherwise(1 + below)

    return F.array(*[of(n, e) for n, e in zip(features, edges)])


def _held(rows: DataFrame, features: list[str], edges: list[list[float]], target: str) -> DataFrame:
    """(_b, _n, _s): how many rows have these bins, and the sum of their targets;
    rows without a target are left out."""
    put = rows.where(F.col(target).isNotNull()).select(binned(features, edges).alias("_b"), F.col(target).cast("double").alias("_y"))
    return cut(put.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_s")))


#: (tree, node) -> {feature: {bin: (rows, gradients, hessians)}}
Histograms = dict[tuple[int, int], dict[int, dict[int, tuple[float, float, float]]]]


def _histograms(rows: DataFrame, trees: list[Tree], depth: int, level: int) -> Histograms:
    """Sums over ``rows`` (_b, _n, _g, _h) of the nodes of a level."""
    at = rows.select("_b", "_n", "_g", "_h", F.posexplode(_nodes(trees, depth, F.col("_b"))).alias("tree", "node")).where(F.col("node") >= 1 << level)
    each = at.select("tree", "node", "_n", "_g", "_h", F.posexplode("_b").alias("feature", "bin"))
    sums = each.groupBy("tree", "node", "feature", "bin").agg(F.sum("_n").alias("n"), F.sum("_g").alias("g"), F.sum("_h").alias("h"))
    out: Histograms = {}
    for r in sums.collect():  # trees x nodes x features x bins at most
        out.setdefault((r["tree"], r["node"]), {}).setdefault(r["feature"], {})[r["bin"]] = (r["n"], r["g"], r["h"])
    return out


def _parts(bins: dict[int, tuple[float, float, float]], last: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the bins up to ``last``, and of the others."""
    left = sum((np.array(v, float) for b, v in sorted(bins.items()) if b <= last), np.zeros(3))
    return left, sum((np.array(v, float) for b, v in sorted(bins.items()) if b > last), np.zeros(3))


def _best_split(held: dict[int, dict[int, tuple[float, float, float]]], least_rows: int, l2: float):
    """(gain, feature, last bin, left, right) of the largest gain; ties to the
    smaller feature and bin; None if no split gains."""
    best = None
    worth = lambda s: s[1] * s[1] / (s[2] + l2)
    for f in sorted(held):
        for last in sorted(held[f])[:-1]:
            left, right = _parts(held[f], last)
            gain = round(worth(left) + worth(right) - worth(left + right), 9)
            if min(left[0], right[0]) >= least_rows and gain > 0 and (best is None or gain > best[0]):
                best = (gain, f, last, left, right)
    return best


def boosted_histograms(
    rows: DataFrame,
    features: list[str],
    target: str,
    loss: str = "squared",
    trees: int = 20,
    depth: int = 3,
    rate: float = 0.1,
    bins: int = 32,
    least_rows: int = 10,
    l2: float = 0.1,
) -> Forest:
    """Gradient boosting with second-order gains over histograms.

    ``loss`` is ``squared`` or ``logistic`` (targets 0 and 1; totals are log
    odds).  Rows without a target are left out; null and NaN features are a bin
    of their own below all others.  Without rows, or where nothing splits, the
    forest is its base.
    """
    if loss not in ("squared", "logistic"):
        raise ValueError(f"no loss {loss}")
    edges = bin_edges(rows, features, bins)
    held = _held(rows, features, edges, target)
    mean = held.agg(F.sum("_s") / F.sum("_n")).first()[0]
    forest = Forest(features, edges, depth)
    if mean is None:
        return forest
    p = min(max(mean, 1e-6), 1 - 1e-6)
    forest.base = math.log(p / (1 - p)) if loss == "logistic" else mean
    for _ in range(trees):
        total = forest.total(F.col("_b"))
        if loss == "logistic":
            scored = held.withColumn("_p", 1 / (1 + F.exp(-total))).select("_b", "_n", (F.col("_n") * F.col("_p") - F.col("_s")).alias("_g"), (F.col("_n") * F.col("_p") * (1 - F.col("_p"))).alias("_h"))
        else:
            scored = held.select("_b", "_n", (F.col("_n") * total - F.col("_s")).alias("_g"), F.col("_n").cast("double").alias("_h"))
        tree = Tree.empty(depth)
        for level in range(depth):
            grown = False
            for (_, node), sums in _histograms(scored, [tree], depth, level).items():
                split = _best_split(sums, least_rows, l2)
                if split:
                    grown = True
                    _, tree.feature[node], tree.last[node], *ends = split
                    for side, s in enumerate(ends):
                        tree.value[2 * node + side] = float(-rate * s[1] / (s[2] + l2))
            if not grown:
                break
        if tree.feature[1] < 0:
            break
        forest.trees.append(tree)
    return forest


def _drawn(*key) -> float:
    """A number in [0, 1) from a hash of the key."""
    return int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:8], 16) / 2**32


def extra_trees(
    rows: DataFrame,
    features: list[str],
    target: str,
    trees: int = 16,
    depth: int = 5,
    bins: int = 64,
    least_rows: int = 2,
    seed: int = 21,
) -> Forest:
    """Trees on all rows whose cuts are drawn, not searched.

    Of each node, the root of the number of features are drawn, and for each a
    cut between the node's least and greatest bin; the cut with the largest drop
    of variance (for a target of 0 and 1, of impurity) splits it.  All trees
    grow a level by one aggregate.  A forest's value is the mean of its trees';
    rows without a target are left out, nulls as in :func:`boosted_histograms`.
    """
    edges = bin_edges(rows, features, bins)
    held = _held(rows, features, edges, target).select("_b", "_n", F.col("_s").alias("_g"), F.col("_n").cast("double").alias("_h"))
    forest = Forest(features, edges, depth, [Tree.empty(depth) for _ in range(trees)])
    few = max(1, int(math.sqrt(len(features))))
    for level in range(depth):
        grown = False
        for (t, node), sums in _histograms(held, forest.trees, depth, level).items():
            tree, best = forest.trees[t], None
            for f in sorted(sorted(sums, key=lambda f: (_drawn(seed, t, node, f), f))[:few]):
                low, high = min(sums[f]), max(sums[f])
                last = low + int(_drawn(seed, t, node, f, "cut") * (high - low))
                left, right = _parts(sums[f], last)
                if level == 0:
                    whole = left + right
                    tree.value[node] = float(whole[1] / whole[0] / trees)
                if min(left[0], right[0]) >= least_rows:
                    drop = round(left[1] ** 2 / left[0] + right[1] ** 2 / right[0] - (left[1] + right[1]) ** 2 / (left[0] + right[0]), 9)
                    if drop > 0 and (best is None or drop > best[0]):
                        best = (drop, f, last, left, right)
            if best:
                grown = True
                _, tree.feature[node], tree.last[node], *ends = best
                for side, s in enumerate(ends):
                    tree.value[2 * node + side] = float(s[1] / s[0] / trees)
        if not grown:
            break
    return forest


def predicted(rows: DataFrame, forest: Forest, name: str = "prediction") -> DataFrame:
    """``rows`` with a forest's total."""
    if not forest.trees:
        return rows.withColumn(name, F.lit(forest.base))
    return rows.withColumn(name, C.bound(binned(forest.features, forest.edges), forest.total))
