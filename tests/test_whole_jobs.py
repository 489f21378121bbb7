"""Queries that judge, sketch and score all there is."""

from __future__ import annotations

import numpy as np
import pytest

from viewmint.plans import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_all_vectors_of_a_label_are_judged(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").toPandas()
    same = rows.label.to_numpy()[:, None] == rows.label.to_numpy()[None]
    np.fill_diagonal(same, False)
    n = same.sum(axis=1)
    assert n.max() > 10
    got = QUERIES["qrel_bias"](spark, SMALL).first()
    assert got["mean_qrels"] == pytest.approx(n.mean(), abs=1e-6) and got["median_qrels"] == np.median(n)
    x = np.where(np.stack(rows.embedding.to_numpy()) >= 0, 1.0, -1.0)
    score = np.round(x @ x.T / x.shape[1], 9)
    np.fill_diagonal(score, -np.inf)
    ids = rows.vec_id.to_numpy()
    order = np.stack([np.lexsort((ids, -s)) for s in score])[:, : min(200, len(rows) - 1)]
    hits = np.take_along_axis(same, order, axis=1).sum(axis=1)
    assert got["candidate_recall"] == pytest.approx((hits / np.maximum(n, 1)).mean(), abs=1e-6)
    assert got["candidate_density"] == pytest.approx(hits.sum() / order.size, abs=1e-6)


def test_sketches_have_the_local_graph_of_each_cell(spark):
    """The radius is the cell's own: a curve that is drawn larger has the same graph."""
    from pyspark.sql import functions as F

    from viewmint.operators import lab as L

    rows = {r["cell"]: r for r in QUERIES["sketches"](spark, SMALL).collect()}
    assert {"density", "parts_share", "near", "apart", "norm", "skew", "kurt"} <= set(next(iter(rows.values())).asDict())
    rng = np.random.default_rng(5)
    p = np.r_[rng.normal(size=(40, 2)), rng.normal(size=(30, 2)) + 50]
    made, large = L.local_features(p), L.local_features(p * 8)
    assert all(made[k] == large[k] for k in ("parts", "largest", "density", "skew"))
    d = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    knn = np.sort(d, axis=1)[:, :8]
    linked = d <= np.quantile(knn[:, 5], 0.65)
    seen, parts = set(), []
    for i in range(len(p)):
        stack = [] if i in seen else [i]
        parts += [0] if stack else []
        seen |= set(stack)
        while stack:
            parts[-1] += 1
            more = [int(v) for v in np.flatnonzero(linked[stack.pop()]) if int(v) not in seen]
            seen |= set(more)
            stack += more
    assert (made["parts"], made["largest"]) == (len(parts), max(parts)) and made["density"] == pytest.approx(linked.mean(), abs=1e-6)
    assert made["near"] == pytest.approx(np.quantile(knn, [0.1, 0.25, 0.5, 0.75, 0.9]), abs=1e-6)
    assert made["apart"] == pytest.approx(np.quantile(d[np.isfinite(d)], [0.1, 0.25, 0.5, 0.75, 0.9]), abs=1e-6)
    few = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (2, 3.0, 4.0), (None, 1.0, 1.0)], "cell long, x double, y double")
    got = {r["cell"]: r for r in L.graph_sketch(few).select("cell", "parts", "density", F.col("near")[0].alias("near")).collect()}
    assert got[1]["parts"] == 1 and got[1]["near"] is None and got[2]["parts"] == 1 and got[2]["near"] == 25.0 and len(got) == 2


def test_solvers_are_compared_where_a_cell_stands(spark):
    """A row for each pair of points, six times over, was a table of 8,100 rows a cell and side."""
    from viewmint.operators import geometry as Geo
    from viewmint.operators import lab as L
    from viewmint.plans.lab_queries import _curves

    assert "Join" not in QUERIES["solvers"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    points = _curves(spark, SMALL, 30).drop("family")
    solvers = {"template": L.moment_gaussian, "blind": L.blind_search}
    got = {(r["cell"], r["solver"]): r["chamfer"] for r in L.solver_distances(points, solvers).collect()}
    for name, solve in solvers.items():
        want = {(r["cell"], name): r["chamfer"] for r in Geo.chamfer(L.solve_cells(points, solve), points).collect()}
        assert want == pytest.approx({k: v for k, v in got.items() if k[1] == name}, abs=2e-6)


@pytest.mark.parametrize("kind", ["plain", "signs", "equal", "missing", "huge"])
def test_single_precision_only_narrows_the_search(kind):
    """What is found is what double precision ranks first; where single precision doesn't hold, it isn't asked."""
    from viewmint.operators import search as S

    rng = np.random.default_rng(3)
    x = rng.normal(size=(20_000, 32))
    x = {"plain": x, "signs": np.sign(x) / np.sqrt(32), "equal": np.repeat(x[:1], len(x), axis=0), "missing": np.where(rng.random(x.shape) < 1e-4, np.nan, x), "huge": x * 1e100}[kind]
    x[50:60] = x[40:50] * (1 + 1e-9)  # closer together than single precision tells
    did = rng.permutation(len(x))
    scale = 1e200 if kind == "huge" else 1.0
    row, column, score = S.best_products(x[:30], x, did[:30], did, 10)
    full = np.nan_to_num(x[:30] @ x.T, nan=-np.inf)
    full[np.arange(30), np.arange(30)] = -np.inf
    for i in range(30):
        want = np.lexsort((did, -np.round(full[i], S.DIGITS)))[: min(10, int((full[i] > -np.inf).sum()))]
        assert score[row == i] / scale == pytest.approx(np.round(full[i][want], S.DIGITS) / scale, abs=2e-9)
        if kind != "huge":
            assert list(column[row == i]) == list(want)


def test_most_products_are_of_single_precision(monkeypatch):
    from viewmint.operators import search as S

    made = []
    monkeypatch.setattr(S.np, "partition", lambda m, *a, _p=np.partition, **b: made.append(m.dtype) or _p(m, *a, **b))
    x = np.random.default_rng(4).normal(size=(2000, 16))
    S.best_products(x[:20], x, np.arange(20), np.arange(2000), 10)
    assert made and set(made) == {np.dtype(np.float32)}
