"""Indexes of vectors against brute force: a neighbour graph, residual codes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from viewmint.operators import coded, graph_index
from viewmint.plans import QUERIES

SMALL = "/root/testdata/sf0.001"


def _table(spark, x):
    return spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x.astype("float32")))}))


def _clustered(n):
    """Unit vectors in clusters of 40 or so."""
    draw = np.random.default_rng(n)
    centre = draw.normal(size=(n // 40, 32))
    x = centre[draw.integers(0, len(centre), n)] + 0.35 * draw.normal(size=(n, 32))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("float32").astype(float)


def _recall(found, x, asked, k):
    """Share of the exact nearest that were found, and distances a query."""
    got, distances = {}, {}
    for r in found.collect():
        got.setdefault(r["qid"], set()).add(r["did"])
        distances[r["qid"]] = r["distances"]
    hits = 0
    for q in asked:
        score = np.round(x @ x[q], 9)
        score[q] = -np.inf
        hits += len(got[q] & set(np.lexsort((np.arange(len(x)), -score))[:k].tolist()))
    return hits / (k * len(asked)), float(np.mean(list(distances.values())))


def test_graph_query_finds_what_flat_search_finds(spark):
    rows = QUERIES["knn_hnsw"](spark, SMALL)
    e = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    x = np.array([e[i] for i in sorted(e)])
    asked = [i for i in sorted(e) if i % 20 == 0]
    recall, _ = _recall(rows, x, asked, 10)
    assert recall >= 0.9
    by_query = {}
    for r in rows.collect():
        by_query.setdefault(r["qid"], []).append((r["rank"], r["score"], r["did"]))
        assert r["score"] == pytest.approx(float(e[r["qid"]] @ e[r["did"]]), abs=1e-8)
    for q, found in by_query.items():
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, 11)) and q not in {d for _, _, d in found}
        assert [(-s, d) for _, s, d in found] == sorted((-s, d) for _, s, d in found)


def test_graph_search_grows_slower_than_the_rows(spark):
    seen = {}
    for n in (1500, 6000):
        x = _clustered(n)
        base = _table(spark, x)
        asked = list(range(0, n, n // 50))
        found = graph_index.graph_search(graph_index.layered_graph(base), base.where(F.col("vec_id").isin(asked)), 10, 64)
        recall, seen[n] = _recall(found, x, asked, 10)
        assert recall >= 0.9
    assert seen[6000] < 6000 / 10
    assert seen[6000] < 2 * seen[1500]  # rows grow four times


def test_graph_of_odd_rows(spark):
    same = [1.0, 0.0, 0.0]
    rows = [(i, same) for i in range(40)] + [(100, [0.0, 1.0, 0.0]), (101, [0.6, 0.8, 0.0]), (102, None), (103, [])]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    graph = graph_index.layered_graph(base, copies=4)
    assert graph.nodes.count() == 3 and graph.copies.count() == 6
    found = {(r["qid"], r["rank"]): r["did"] for r in graph_index.graph_search(graph, base, 3, 8).collect()}
    assert [found[39, k] for k in (1, 2, 3)] == [0, 1, 2] and [found[0, k] for k in (1, 2, 3)] == [1, 2, 3]
    assert [found[100, k] for k in (1, 2, 3)] == [101, 0, 1]
    assert not {102, 103} & {q for q, _ in found}
    assert graph_index.graph_search(graph_index.layered_graph(base.limit(0)), base, 3, 8).count() == 0


def test_large_shards_are_split(spark, monkeypatch):
    monkeypatch.setattr(graph_index, "SHARD_ROWS", 64)
    x = _clustered(1000)
    base = _table(spark, x)
    asked = list(range(0, 1000, 40))
    recall, _ = _recall(graph_index.graph_search(graph_index.layered_graph(base), base.where(F.col("vec_id").isin(asked)), 10, 64), x, asked, 10)
    assert recall >= 0.9


def test_pivots_are_the_nearest_of_their_shards(spark, monkeypatch):
    """Both sides of a shard are split; a node meets all of its pivots' members."""
    monkeypatch.setattr(graph_index, "SHARD_ROWS", 32)
    x = _clustered(400)
    nodes = _table(spark, x).select(F.col("vec_id").alias("did"), F.col("embedding").alias("vector"))
    near = nodes.select("did", F.explode(F.array(F.col("did") % 4, F.lit(4).cast("long"))).alias("pivot"))  # two pivots a node
    shards = nodes.where("did % 3 = 0").select("did", F.when(F.col("did") % 2 == 0, F.col("did") % 4).otherwise(4).cast("long").alias("pivot"))
    got = {}
    for r in graph_index._pivots_below(nodes, near, shards, 3).collect():
        got.setdefault(r["did"], set()).add(r["pivot"])
    for q in range(400):
        held = np.array([i for i in range(0, 400, 3) if (i % 4 if i % 2 == 0 else 4) in (q % 4, 4)])
        score = np.round(x[held] @ x[q], 9)
        assert got[q] == set(held[np.lexsort((held, -score))[:3]].tolist())


def test_building_scores_no_pairs_by_joins(spark, monkeypatch):
    """Vectors go down the layers through shards; only queries are searched for."""
    monkeypatch.setattr(graph_index, "beams", lambda *a, **k: pytest.fail("a search while building"))
    graph = graph_index.layered_graph(_table(spark, _clustered(1200)))
    assert graph.layers == 2 and {r["layer"] for r in graph.links.select("layer").distinct().collect()} == {0, 1, 2}


@pytest.fixture(scope="module")
def file(spark):
    base = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    return base, coded.coded_file(base, 16, 8, 16)


def test_codes_are_the_nearest_of_the_residuals(spark, file):
    base, made = file
    cells = {r["cell"]: np.array(r["centre"]) for r in made.cells.collect()}
    codes = {r["did"]: (r["cell"], r["codes"]) for r in made.codes.collect()}
    books = [np.array(b) for b in made.books]
    assert made.codes.columns == ["did", "cell", "codes"]
    for r in base.collect():
        x, (cell, own) = np.array(r["embedding"], float), codes[r["vec_id"]]
        assert np.linalg.norm(x - cells[cell]) == pytest.approx(min(np.linalg.norm(x - c) for c in cells.values()))
        rest = (x - cells[cell]).reshape(8, -1)
        for p in range(8):
            assert np.linalg.norm(rest[p] - books[p][own[p]]) == pytest.approx(np.linalg.norm(rest[p] - books[p], axis=1).min())


def test_scores_are_those_of_decoded_vectors(spark, file):
    base, made = file
    k, nprobe = 7, 5
    queries = base.where("vec_id % 20 = 0")
    plan = coded.coded_search(made, queries, k, nprobe)
    assert "embedding" not in plan._jdf.queryExecution().optimizedPlan().toString()
    whole = {r["did"]: np.array(r["vector"]) for r in coded.decoded(made).collect()}
    cells = {r["cell"]: np.array(r["centre"]) for r in made.cells.collect()}
    cell_of = {r["did"]: r["cell"] for r in made.codes.collect()}
    got = {}
    for r in plan.collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["did"], r["score"]))
    for r in queries.collect():
        q = np.array(r["embedding"], float)
        near = sorted(cells, key=lambda c: (-round(float(q @ cells[c]), 9), c))[:nprobe]
        want = sorted(((-float(q @ v), d) for d, v in whole.items() if cell_of[d] in near and d != r["vec_id"]))[:k]
        found = sorted(got[r["vec_id"]])
        assert [s for _, _, s in found] == pytest.approx([-s for s, _ in want], abs=1e-8)
        assert len({d for _, d, _ in found}) == k


def test_codes_of_odd_rows(spark):
    rows = [(i, [float(i % 3), 1.0, 0.0, float(i % 5)]) for i in range(30)] + [(98, None), (99, [])]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    made = coded.coded_file(base, 2, 2, 4)
    assert made.codes.count() == 30
    assert {r["qid"] for r in coded.coded_search(made, base, 3, 1).collect()} == set(range(30))
    with pytest.raises(ValueError):
        coded.coded_file(base, 2, 3, 4)
    empty = coded.coded_file(base.limit(0), 2, 2, 4)
    assert coded.coded_search(empty, base, 3, 1).count() == 0


def _drawn(asked, index, seed, nearest):
    """The sequential draw, title by title."""
    import hashlib

    out = []
    for qid, sources, excluded in asked:
        unused = {t: d for t, d in index.items() if t not in (excluded or [])}
        draw = 0
        for i, degree in enumerate([index.get(s, 0) for s in sources or []] or [0]):
            near = sorted(unused, key=lambda t: (abs(unused[t] - degree), t))[:nearest]
            if near:
                h = int(hashlib.md5(f"{seed}:{qid}:{i}".encode()).hexdigest()[:8], 16)
                out.append((qid, draw, near[h % len(near)]))
                del unused[out[-1][2]]
                draw += 1
    return sorted(out)


def test_degree_matched_titles(spark):
    import random

    from viewmint.operators.draws import degree_matched

    draw = random.Random(4)
    index = {f"t{i}": int(draw.paretovariate(0.7)) for i in range(300)} | {f"same{i}": 3 for i in range(400)}
    titles = sorted(index)
    asked = [(q, draw.choices([*titles, "gone"], k=draw.randint(0, 9)), draw.choices(titles, k=draw.randint(0, 20))) for q in range(40)]
    asked += [(100, None, None), (101, ["t1"], None)]
    rows = spark.createDataFrame(asked, "qid long, sources array<string>, excluded array<string>")
    table = spark.createDataFrame(list(index.items()), "title string, degree long")
    found = sorted(tuple(r) for r in degree_matched(rows, table, 5, 16).collect())
    assert found == _drawn(asked, index, 5, 16)
    assert len({(q, t) for q, _, t in found}) == len(found)  # no title twice a query
    few = {"a": 1, "b": 2, "c": 9}
    some = spark.createDataFrame(list(few.items()), "title string, degree long")
    asked = [(1, ["a", "b", "c", "d", "a"], ["c"]), (2, ["x"], ["a", "b", "c"])]
    rows = spark.createDataFrame(asked, "qid long, sources array<string>, excluded array<string>")
    assert sorted(tuple(r) for r in degree_matched(rows, some, 5, 16).collect()) == _drawn(asked, few, 5, 16)
    assert degree_matched(rows, some.limit(0), 5).count() == 0 and degree_matched(rows.limit(0), some, 5).count() == 0


def test_products_of_runs_are_the_best_of_all():
    """The k-th best is found from runs of products: ties, rows of their own and unfit vectors must not change it."""
    import numpy as np

    from viewmint.operators import search as S

    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(40_000, 4)), 1)
    x[::7] = x[0]
    x[11] = np.nan
    q, did = x[:50].copy(), np.arange(40_000)[::-1].copy()
    row, column, score = S.best_products(q, x, did[:50], did, 10)
    for i in range(50):
        every = np.round(x @ q[i], S.DIGITS)
        every[np.isnan(every)], every[i] = -np.inf, -np.inf
        want = [c for c in np.lexsort((did, -every))[:10] if every[c] > -np.inf]
        assert list(column[row == i]) == want and list(score[row == i]) == list(every[want])


def test_search_copies_vectors_a_block_not_a_query(spark):
    """What travels is the stored vector, not four wider views of it, once a block of many queries."""
    from viewmint.operators import search as S

    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert S.BLOCK_ROWS >= 20_000 and S.SHARD_ROWS >= 100_000
    assert "transform(" not in S.top_k_views(e, e, 10, list(S.VIEWS))._jdf.queryExecution().optimizedPlan().toString()


def test_probes_of_all_cells_are_exact(spark):
    from viewmint.operators import search as S

    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(200).localCheckpoint()
    got = S.probes(e, e, 5, 6, [1, 6]).collect()
    exact = {(r["qid"], r["rank"]): r["did"] for r in S.top_k(e, e, 5).collect()}
    assert {(r["qid"], r["rank"]): r["did"] for r in got if r["view"] == "nprobe6"} == exact
    assert {r["view"] for r in got} == {"nprobe1", "nprobe6"}
