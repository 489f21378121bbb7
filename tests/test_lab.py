"""Queries that SQL can't express, against brute force or what must hold."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewmint.operators import gates, lab, metrics, policy, reports, search, stats, terrain, text
from viewmint.plans import QUERIES

SMALL = "/root/testdata/sf0.001"


def _rows(spark, name):
    return QUERIES[name](spark, SMALL).collect()


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").where("embedding is not null").collect()
    return {r["vec_id"]: np.array(r["embedding"], float) for r in rows}


def test_farthest_points(spark):
    from viewmint.plans.geometry_queries import _sides

    points: dict = {}
    for r in _sides(spark, SMALL)[0].collect():
        points.setdefault(r["cell"], []).append((r["idx"], r["x"], r["y"]))
    got: dict = {}
    for r in _rows(spark, "fps"):
        got.setdefault(r["cell"], {})[r["place"]] = (r["x"], r["y"])
    assert set(got) == set(points)
    for cell, rows in points.items():
        p = np.array([(x, y) for _, x, y in sorted(rows)])
        chosen = np.array([got[cell][k] for k in range(min(8, len(p)))])
        for k in range(1, len(chosen)):
            far = ((p[:, None] - chosen[None, :k]) ** 2).sum(axis=2).min(axis=1)
            assert ((chosen[k] - chosen[:k]) ** 2).sum(axis=1).min() == pytest.approx(far.max())


def test_product_codes_come_near_the_vectors(spark, vectors):
    got = {r["vec_id"]: np.array(r["embedding"]) for r in _rows(spark, "pq_recon")}
    assert set(got) == set(vectors)
    sims = [float(got[i] @ v / np.linalg.norm(v)) for i, v in vectors.items()]
    assert np.mean(sims) > 0.5  # of unrelated vectors: 0
    for part in range(8):
        directions = {tuple(np.round(v[part * 8 : part * 8 + 8] / np.linalg.norm(v[part * 8 : part * 8 + 8]), 6)) for v in got.values()}
        assert len(directions) <= 16
    assert all(np.linalg.norm(v) == pytest.approx(1) for v in got.values())


def test_inverted_file_holds_every_vector(spark, vectors):
    cells = _rows(spark, "ivf_train")
    assert sum(r["n"] for r in cells) == len(vectors) and 1 < len(cells) <= 16


def test_probes_rank_what_they_find(spark, vectors):
    found: dict = {}
    for r in _rows(spark, "knn_ivfpq"):
        found.setdefault(r["qid"], []).append((r["rank"], r["score"], r["did"]))
    for q, rows in found.items():
        rows.sort()
        assert [k for k, _, _ in rows] == list(range(1, len(rows) + 1)) and q not in {d for _, _, d in rows}
        assert [(-s, d) for _, s, d in rows] == sorted((-s, d) for _, s, d in rows)


def test_deeper_probes_are_better(spark):
    depth = {r["view"]: r["ndcg"] for r in _rows(spark, "ann_depth")}
    assert depth["nprobe1"] <= depth["nprobe2"] <= depth["nprobe4"] <= depth["nprobe8"] <= depth["full"] == 1.0


ROUTERS = ("router_ridge", "router_tree", "router_boosted", "router_selective", "router_pairwise", "router_expanded", "router_ce", "router_fitted_q", "router_selective_reg", "router_deferral", "router_proxy")


@pytest.mark.parametrize("name", ROUTERS)
def test_routers_stay_between_the_worst_and_the_best(spark, name):
    from viewmint.plans.fixtures import view_table

    ends = view_table(spark, SMALL).groupBy("query_id").agg(F.max("utility").alias("hi"), F.min("utility").alias("lo")).agg(F.max("hi"), F.min("lo")).first()
    rows = _rows(spark, name)
    assert rows
    for r in rows:
        assert ends[1] <= r["mean_utility"] <= ends[0] and r["mean_regret"] >= 0 and r["queries"] > 0 and 0 <= r["buy_share"] <= 1
    if name == "router_proxy":
        assert {r["queries"] for r in rows} == {1500}


def test_ridge_is_that_of_the_normal_equations(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(60, 3)), rng.normal(size=(60, 2))
    rows = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(x, y)], "a double, b double, c double, u double, v double")
    one = np.c_[np.ones(60), x]
    want = np.linalg.solve(one.T @ one + np.diag([1e-9, 2, 2, 2]), one.T @ y)
    assert np.allclose(gates.ridge_fit(rows, ["a", "b", "c"], ["u", "v"], 2.0), want)


def test_learners_find_a_rule(spark):
    rows = spark.range(400).select(F.col("id").alias("query_id"), (F.col("id") % 20 / 20.0).alias("margin"), F.lit(0.5).alias("other")).withColumn("y", (F.col("margin") > 0.5).cast("double"))
    for kind in ("logistic", "forest", "boosted", "neural"):
        p = gates.classifier_probability(rows, rows, ["margin", "other"], "y", kind).select(F.avg(((F.col("p") > 0.5).cast("double") == F.col("y")).cast("double"))).first()[0]
        assert p > 0.85, kind
    routed = rows.withColumns({"u_a": 1 - F.col("y"), "u_b": F.col("y")})
    made = {r["query_id"]: r["view"] for r in gates.best_view_classifier(routed, routed, ["margin", "other"], ["a", "b"]).collect()}
    assert sum(made[i] == ("b" if i % 20 > 10 else "a") for i in made) > 380
    split = routed.withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("dev"), F.lit("test")), (F.col("query_id") % 3 + 1).cast("int"))).withColumn("gain", F.col("u_b") - F.col("u_a"))
    picked = {r["query_id"]: r["view"] for r in gates.selective_regression(split, ["margin", "other"], "gain", "a", "b").collect()}
    assert set(picked) == {i for i in range(400) if i % 3 == 2} and sum(picked[i] == ("b" if i % 20 > 10 else "a") for i in picked) > 0.9 * len(picked)


def test_what_carries_the_target_matters_most(spark):
    rows = spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 37 % 101 / 101.0).alias("a"), (F.col("id") * 53 % 97 / 97.0).alias("b")).withColumn("t", 3 * F.col("a"))
    got = {r["dealt"]: r for r in gates.cross_validated_importance(rows, "k", ["a", "b"], "t", folds=3, repeats=2, trees=10).collect()}
    assert got["none"]["worse"] == 0 and got["a"]["worse"] > 5 * abs(got["b"]["worse"]) and got["none"]["corr"] > 0.9
    dealt = gates.dealt_anew(rows, "k", "a", "s").collect()
    assert Counter(r["a"] for r in dealt) == Counter(r["a"] for r in rows.collect()) and [r["b"] for r in sorted(dealt)] == [r["b"] for r in sorted(rows.collect())]


def test_reconstructions_keep_the_summary(spark):
    rows = _rows(spark, "recon_methods")
    assert {r["method"] for r in rows} == set(lab.METHODS)
    last = max(r.asDict().get("step", r.asDict().get("iteration", 0)) for r in rows)
    assert last > 0


def test_sketches_share_out_all_points(spark):
    total: Counter = Counter()
    for r in _rows(spark, "sketches"):
        total[r["cell"]] += r["share"]
        assert 0 <= r["i"] < 4 and 0 <= r["j"] < 4 and r["parts"] >= 1
    assert len(total) == len(lab.FAMILIES) and all(v == pytest.approx(1, abs=1e-4) for v in total.values())


def test_a_choice_is_another_family(spark):
    rows = _rows(spark, "view_choice")
    assert len(rows) == len(lab.FAMILIES) and all(r["cell"] != r["chosen"] and round(r["utility"], 2) in (-0.28, 0.72) for r in rows)


def test_solvers_come_nearer_than_chance(spark):
    far: dict = {}
    for r in _rows(spark, "solvers"):
        far.setdefault(r["solver"], []).append(r["chamfer"])
    assert set(far) == {"template", "blind", "random"} and all(len(v) == len(lab.FAMILIES) and min(v) >= 0 for v in far.values())


def test_assignments_are_least_cost_matchings(spark):
    import itertools

    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 6):
        cost = rng.random((n, n))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert cost[np.arange(n), lab.assignment(cost)].sum() == pytest.approx(best)
    by: dict = {}
    for r in _rows(spark, "assign"):
        by.setdefault(r["cell"], []).append(r["target"])
    assert all(sorted(v) == list(range(60)) for v in by.values()) and len(by) == len(lab.FAMILIES)


def test_probing_looks_at_more_and_more(spark):
    rows = sorted((r["cap"], r["dev"], r["test"], r["gap"]) for r in _rows(spark, "probing"))
    assert [r[0] for r in rows] == [1, 3, 10] and rows[0][1] <= rows[1][1] <= rows[2][1]
    assert all(gap == pytest.approx(dev - test, abs=2e-6) for _, dev, test, gap in rows)


def test_hashed_components_are_unit_vectors(spark):
    rows = _rows(spark, "hash_svd")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(rows) == len(texts) == 200 and all(len(r["vector"]) == 16 and np.linalg.norm(r["vector"]) == pytest.approx(1) for r in rows if len(texts[r["doc_id"]] or "") > 1)


def test_sketched_counts_are_near(spark):
    true = {r[0]: r[1] for r in spark.read.parquet(f"{SMALL}/lineitem.parquet").groupBy("l_returnflag").agg(F.countDistinct("l_partkey")).collect()}
    for r in _rows(spark, "approx_distinct"):
        assert abs(r["parts"] - true[r["l_returnflag"]]) <= 0.05 * true[r["l_returnflag"]]


def test_archetypes_are_clusters_of_runs(spark):
    rows = _rows(spark, "archetype_clusters")
    users = spark.read.parquet(f"{SMALL}/events.parquet").select("user_id").distinct().count()
    assert len(rows) == users and 1 < len({r["cluster"] for r in rows}) <= 4
    assert np.var([r["pc1"] for r in rows]) >= np.var([r["pc2"] for r in rows])
    assert terrain.run_archetypes(spark.createDataFrame([(1, 2.0)], "cell long, a double"), ["a"], "cell").count() == 1


def test_hooks_are_called_with_texts(spark):
    import hashlib

    rows = {r["item_id"]: r["embedding"] for r in _rows(spark, "encode_texts")}
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        import re

        v = np.zeros(32)
        for w in re.findall("[a-z0-9]+", r["text"].lower()):
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
            v[h % 32] += 1 if h >> 63 else -1
        assert rows[r["item_id"]] == pytest.approx(v / max(np.linalg.norm(v), 1e-12), abs=1e-6)
    pool = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "qid long, did long")
    docs = spark.createDataFrame([(1, "cat"), (2, "cat dog"), (3, None)], "did long, text string")
    got = search.rerank_pairs(pool, spark.createDataFrame([(1, "Cat dog")], "qid long, text string"), docs, search.overlap_scorer, 2).collect()
    assert [(r["rank"], r["did"], r["score"]) for r in got] == [(1, 2, 1.0), (2, 1, 0.5)]
    assert len(_rows(spark, "rerank_scorer")) <= 400


def test_exact_quantiles(spark):
    rng = np.random.default_rng(4)
    for values in (rng.normal(size=700), rng.integers(0, 5, 300).astype(float), np.array([3.0])):
        rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        assert stats.quantiles(rows, "v", [0.0, 0.1, 1 / 3, 0.5, 0.975, 1.0]) == pytest.approx(np.quantile(values, [0.0, 0.1, 1 / 3, 0.5, 0.975, 1.0]).tolist())
    assert stats.quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == []
    top = stats.top_rows(spark.createDataFrame([(i, float(i % 7)) for i in range(50)], "k long, v double"), "v", "k", 0.3).collect()
    assert [r["k"] for r in sorted(top, key=lambda r: r["place"])] == sorted(range(50), key=lambda i: (-(i % 7), i))[:15]


def test_bootstrap_covers_the_mean(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.normal(1.0, 2.0, 900))], "i long, v double")
    r = stats.bootstrap_ci(rows, "v", 500).first()
    half = 1.96 * 2 / math.sqrt(900)
    assert r["lo"] < r["mean"] < r["hi"] and r["reps"] == 500 and r["hi"] - r["lo"] == pytest.approx(2 * half, rel=0.2) and r["positive"] == 1.0


def test_paths_are_counted(spark):
    rng = np.random.default_rng(7)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 12, (60, 2)) if a != b}
    pool = [(q, n, bool(rng.integers(0, 2))) for q in range(2) for n in rng.choice(12, 9, replace=False).tolist()]
    got = {(r["qid"], r["node"]): r["two"] for r in text.two_hop_scores(spark.createDataFrame(pool, "qid long, node long, anchor boolean"), spark.createDataFrame(sorted(edges), "src long, dst long")).collect()}
    for q, n, _ in pool:
        own = {m: a for p, m, a in pool if p == q}
        ins = [(a, b) for a, b in edges if a in own and b in own]
        one = sum(own[a] for a, b in ins if b == n) + 0.75 * sum(own[b] for a, b in ins if a == n)
        paths = sum(1 for a, m in ins if own[a] for x, y in ins if x == m and y == n)
        assert got[q, n] == pytest.approx(one + 0.5 * paths + 0.05 * sum((a == n) + (b == n) for a, b in ins), abs=1e-6)


def test_holders_are_all_found(spark):
    docs = [(1, "the quick brown fox jumps over it"), (2, "prefix the quick brown fox jumpsuit"), (3, "short"), (4, None), (5, "x quick\nbrown fox jumps y")]
    passages = [(1, "quick brown fox jumps"), (2, "e quick brown fox jumps o"), (3, "ort"), (4, "absent words that are not here"), (5, None)]
    got = {tuple(r) for r in text.holders(spark.createDataFrame(docs, "did long, text string"), spark.createDataFrame(passages, "qid long, text string")).collect()}
    assert got == {(q, d) for q, p in passages for d, t in docs if p and t and p in t}


def test_metrics_of_orders_and_titles(spark):
    row = spark.createDataFrame([([2, 0, 1], [1, 2], ["a", "b", "a", "c"], ["b", "z"])], "o array<int>, r array<int>, t array<string>, g array<string>")
    got = row.select(metrics.ndcg_order(F.col("o"), F.col("r"), 2).alias("n"), metrics.title_metrics(F.col("t"), F.col("g"), 2).alias("m")).first()
    assert got["n"] == pytest.approx(1 / (1 + 1 / math.log2(3)), abs=1e-6) and tuple(got["m"]) == (0.5, 0.5, 0.5)


def test_success_needs_all_four(spark):
    real = spark.createDataFrame([(20, 0.02, 0.01, 0.03, 0.95)], "splits long, delta double, lo double, hi double, positive double")
    weak = real.withColumn("delta", F.lit(0.001))
    assert policy.success(real, weak).first()["success"] and not policy.success(weak, real).first()["success"] and not policy.success(real, real).first()["beats_control"]


def test_missing_families_are_left_out(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.6)], "k long, u double")
    got = {(r["k"], r["family"]): r["delta"] for r in reports.joined_families({"x": a, "gone": None, "y": a.where("k = 1").withColumn("u", F.lit(0.7))}, ["k"], "u").collect()}
    assert got == {(1, "x"): 0.0, (1, "y"): 0.2}
    with pytest.raises(ValueError):
        reports.joined_families({"gone": None}, ["k"], "u")
