"""Boosting and random trees against brute force on the same bins."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewmint.operators import trees as Tr
from viewmint.plans import QUERIES

SMALL = "/root/testdata/sf0.001"
NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(7)
    x = np.round(draw.normal(size=(700, 4)), 2)
    y = 2.0 * (x[:, 0] > 0.3) + x[:, 1] ** 2 + 0.1 * draw.normal(size=700)
    out = [(i, *[None if (i + j) % 53 == 0 else float("nan") if (i + j) % 59 == 0 else float(v) for j, v in enumerate(r)], float(t), float(t > 1.2)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame([*out, (1000, 0.0, 0.0, 0.0, 0.0, None, None)], "id long, a double, b double, c double, d double, y double, z double").repartition(5)


def _bins(rows, edges):
    found = sorted(rows.collect())
    put = lambda v, e: 0 if v is None or math.isnan(v) else 1 + sum(x < v for x in e)
    return found, np.array([[put(r[c], e) for c, e in zip(NAMES, edges)] for r in found])


def _boosted(b, y, loss, n_trees, depth, rate, least, l2):
    mean = y.mean()
    total = np.full(len(y), math.log(mean / (1 - mean)) if loss == "logistic" else mean)
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-total))
        g, h = (p - y, p * (1 - p)) if loss == "logistic" else (total - y, np.ones(len(y)))
        add, todo = np.zeros(len(y)), [(np.arange(len(y)), 0)]
        while todo:
            at, level = todo.pop()
            best = None
            for f in range(b.shape[1]):
                for cut in sorted(set(b[at, f]))[:-1]:
                    left, right = at[b[at, f] <= cut], at[b[at, f] > cut]
                    worth = lambda s: g[s].sum() ** 2 / (h[s].sum() + l2)
                    gain = round(worth(left) + worth(right) - worth(at), 9)
                    if min(len(left), len(right)) >= least and gain > 0 and (best is None or gain > best[0]):
                        best = (gain, left, right)
            if best:
                for side in best[1:]:
                    add[side] = -rate * g[side].sum() / (h[side].sum() + l2)
                    if level + 1 < depth:
                        todo.append((side, level + 1))
        total = total + add
    return total


@pytest.mark.parametrize("loss,target", [("squared", "y"), ("logistic", "z")])
def test_boosting_is_that_of_brute_force(rows, loss, target):
    forest = Tr.boosted_histograms(rows, NAMES, target, loss, trees=4, depth=3, rate=0.3, bins=8, least_rows=10, l2=0.1)
    found, b = _bins(rows.where("y is not null"), forest.edges)
    want = _boosted(b, np.array([r[target] for r in found]), loss, 4, 3, 0.3, 10, 0.1)
    got = {r["id"]: r["prediction"] for r in Tr.predicted(rows, forest).collect()}
    assert len(got) == 701
    assert [got[r["id"]] for r in found] == pytest.approx(want.tolist(), abs=1e-7)


def test_extra_trees_draw_their_cuts(rows):
    n_trees, depth, seed = 3, 3, 5
    forest = Tr.extra_trees(rows, NAMES, "y", n_trees, depth, bins=16, least_rows=2, seed=seed)
    found, b = _bins(rows.where("y is not null"), forest.edges)
    y = np.array([r["y"] for r in found])
    want = np.zeros(len(y))
    for t in range(n_trees):
        todo = [(np.arange(len(y)), 1)]
        while todo:
            at, node = todo.pop()
            best = None
            for f in sorted(sorted(range(4), key=lambda f: (Tr._drawn(seed, t, node, f), f))[:2]):
                low, high = b[at, f].min(), b[at, f].max()
                cut = low + int(Tr._drawn(seed, t, node, f, "cut") * (high - low))
                left, right = at[b[at, f] <= cut], at[b[at, f] > cut]
                if min(len(left), len(right)) >= 2:
                    drop = round(y[left].sum() ** 2 / len(left) + y[right].sum() ** 2 / len(right) - y[at].sum() ** 2 / len(at), 9)
                    if drop > 0 and (best is None or drop > best[0]):
                        best = (drop, left, right)
            if best and node < 1 << depth:
                todo += [(best[1], 2 * node), (best[2], 2 * node + 1)]
            else:
                want[at] += y[at].mean() / n_trees
    got = {r["id"]: r["prediction"] for r in Tr.predicted(rows, forest).collect()}
    assert [got[r["id"]] for r in found] == pytest.approx(want.tolist(), abs=1e-9)


def test_learners_beat_the_mean_on_held_out_rows(rows):
    train, test = rows.where("id % 3 != 0"), rows.where("id % 3 = 0 and y is not null")
    error = lambda f: Tr.predicted(test, f).agg(F.avg(F.pow(F.col("prediction") - F.col("y"), 2))).first()[0]
    plain = test.agg(F.var_pop("y")).first()[0]
    assert error(Tr.boosted_histograms(train, NAMES, "y", trees=15, rate=0.3)) < 0.35 * plain
    assert error(Tr.extra_trees(train, NAMES, "y", trees=8)) < 0.6 * plain


@pytest.mark.parametrize("learn", [Tr.boosted_histograms, Tr.extra_trees])
def test_levels_read_a_row_for_equal_bins(rows, monkeypatch, learn):
    """Thirty copies of the rows make no more rows for the levels to read."""
    held = []
    monkeypatch.setattr(Tr, "cut", lambda df: held.append(df) or df)
    copied = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(30)))).drop("_copy")
    learn(copied, NAMES[:2], "z", trees=1, depth=1, bins=8)
    assert [df.count() <= 81 for df in held] == [True]


def test_rows_that_teach_nothing(spark, rows):
    for learn in (Tr.boosted_histograms, Tr.extra_trees):
        none = learn(rows.limit(0), NAMES, "y")
        assert {r["prediction"] for r in Tr.predicted(rows, none).collect()} == {0.0}
        same = learn(rows.withColumn("y", F.lit(4.0)), NAMES, "y")
        assert {round(r["prediction"], 9) for r in Tr.predicted(rows, same).collect()} == {4.0}
    with pytest.raises(ValueError):
        Tr.boosted_histograms(rows, NAMES, "y", "hinge")


def test_headroom_query_has_both(spark):
    got = {r["learner"]: r["accuracy"] for r in QUERIES["learners_extra"](spark, SMALL).collect()}
    assert set(got) == {"logistic", "forest", "boosted", "neural", "extra_trees", "histogram"}
    assert min(got["extra_trees"], got["histogram"]) >= min(got[k] for k in ("logistic", "forest", "boosted")) - 0.05
