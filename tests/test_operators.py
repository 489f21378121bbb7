"""Hand-made goldens, invariants, sources and streams."""

from __future__ import annotations

import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewmint.functions import core as C
from viewmint.menus import MENUS, depth_cost
from viewmint.operators import contract, geometry, metrics, policy, routes, stats, text
from viewmint.sources import files


def test_ndcg_by_hand(spark):
    ranked = spark.createDataFrame([("q", "v", 1, 10), ("q", "v", 2, 11), ("q", "v", 3, 12)], "qid string, view string, rank long, did long")
    rel = spark.createDataFrame([("q", 11, 2.0), ("q", 12, 1.0)], "qid string, did long, rel double")
    got = metrics.ndcg(ranked, rel, 3).first()["ndcg"]
    assert got == pytest.approx((3 / math.log2(3) + 1 / 2) / (3 + 1 / math.log2(3)), abs=1e-6)
    s = metrics.set_metrics(ranked, rel, 3).first()
    assert (s["recall"], s["hit"], s["mrr"]) == (1.0, 1, 0.5) and s["f1"] == pytest.approx(0.8)


def test_bm25_by_hand(spark):
    qs = spark.createDataFrame([(1, "cat cat dog")], "qid int, text string")
    pool = spark.createDataFrame([(1, 1, "cat sat"), (1, 2, "the dog and the cat"), (1, 3, "nothing")], "qid int, did int, text string")
    docs = {1: ["cat", "sat"], 2: ["the", "dog", "and", "the", "cat"], 3: ["nothing"]}
    avg = 8 / 3
    want = {}
    for d, t in docs.items():
        want[d] = sum(
            math.log(1 + (3 - df + 0.5) / (df + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / avg))
            for w in ("cat", "cat", "dog")
            for df in [sum(w in x for x in docs.values())]
        )
    got = {r["did"]: r["score"] for r in text.bm25_local(qs, pool).collect()}
    assert got == {d: pytest.approx(s, abs=1e-6) for d, s in want.items()}


def test_oracle_beats_every_fixed_view_and_ties_go_to_menu_order(spark):
    rows = [(q, v, i, c, ((q * 7 + i * 3) % 10) / 10) for q in range(20) for i, (v, c) in enumerate(MENUS["2wiki"])] + [(99, "summary", 0, 0.0, 0.5), (99, "one_hop", 1, 0.0, 0.5)]
    views = policy.with_utility(spark.createDataFrame(rows, "query_id long, view string, ord int, cost double, quality double"))
    best = {r["query_id"]: r for r in policy.oracle(views).collect()}
    assert best[99]["oracle_view"] == "summary"
    scored = policy.evaluate(policy.fixed_routes(views), views).collect()
    top = sum(r["oracle_utility"] for r in best.values()) / len(best)
    assert all(r["mean_regret"] >= 0 and r["mean_utility"] <= top + 0.05 for r in scored)
    shares = policy.view_shares(policy.fixed_routes(views)).groupBy("policy").agg(F.sum("share").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in shares)


def test_controls_are_permutations(spark):
    scores = spark.range(30).select((F.col("id") % 3).alias("qid"), F.col("id").alias("did"), (F.col("id") * 1.5).alias("score"))
    dealt = text.shuffled_within(scores, 1, "x")
    of = lambda d: sorted((r["qid"], r["score"]) for r in d.collect())
    assert of(dealt) == of(scores)


def test_leaks_at_any_depth(spark):
    rows = [(1, json.dumps({"a": [{"Oracle View": 1}], "b": {"c": {"target": 2}}})), (2, "{}"), (3, None), (4, "{broken")]
    found = routes.leaks(spark.createDataFrame(rows, "id long, j string"), "id", "j", {"oracle_view", "target"})
    assert sorted(map(tuple, found.collect())) == [(1, "$.a[0].Oracle View"), (1, "$.b.c.target"), (4, "$")]


def test_hidden_columns_are_refused(spark):
    with pytest.raises(ValueError):
        contract.visible(spark.range(1), ["id"], ["id"])


def test_actions(spark):
    rows = [(1, '{"route": "pq"}'), (2, '{"ranked_views": ["full"], "abstain": false}'), (3, '{"abstain": true}'), (4, '{"route": "pq", "abstain": true}'), (5, "{}"), (6, '{"view_set": ["a"]}'), (7, '{"route": "", "ranked_views": ["a"]}')]
    v = F.try_parse_json("raw")
    got = {r[0]: (r[1], r[2]) for r in spark.createDataFrame(rows, "line long, raw string").select("line", routes.primary_actions(v), routes.selected_view(v)).collect()}
    assert got == {1: (["route"], "pq"), 2: (["ranked_views"], "full"), 3: (["abstain"], "abstain"), 4: (["route", "abstain"], "abstain"), 5: ([], "abstain"), 6: (["view_set"], None), 7: ([], "a")}
    with pytest.raises(Exception, match="sets of views"):
        spark.createDataFrame(rows, "line long, raw string").select(routes.selected_view(v, strict=True)).collect()


MENU = json.dumps({"menu_id": "m", "allowed_tiers": ["C0", "C1"], "hidden_evaluator_fields": ["Gold Rank"], "views": [{"view_id": v, "cost_key": v, "forbidden_before_purchase": ["ce_score_margin"] if v == "ce" else []} for v in ("summary", "pq", "full", "ce")]})
COSTS = json.dumps({"cost_menu": "C_op", "view_costs": {}})
GOOD = {"query_id": "q1", "cell_id": "c1", "tier": "C1", "cost_menu": "C_op", "route": "pq", "method": "x", "runtime_s": 0.1, "diagnostics": {"margin": 1}}


def _faults(spark, rows, manifest=None, **options):
    raw = spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)], "line long, raw string")
    if manifest is not None:
        manifest = spark.createDataFrame([(i, *m) for i, m in enumerate(manifest)], "line long, query_id string, cell_id string, tier string, cost_menu string, declared_views array<string>")
    return sorted((r["line"], r["error"]) for r in routes.faults(raw, routes.Rules.of(spark, MENU, COSTS, **options), manifest).collect())


def test_valid_routes_have_no_fault(spark):
    manifest = [("q1", "c1", "C1", "C_op", ["pq", "summary"]), ("q2", "c1", None, None, None)]
    second = {**GOOD, "query_id": "q2", "route": None, "ranked_views": ["full", "pq"]}
    assert _faults(spark, [GOOD, second], manifest) == []
    assert _faults(spark, []) == []


def test_leaking_diagnostics_are_a_fault(spark):
    found = _faults(spark, [{**GOOD, "diagnostics": {"ce_score_margin": 0.2}}, {**GOOD, "query_id": "q2", "diagnostics": [{"gold-rank!": 1}, {"Target": {}}]}])
    assert found == [(0, "forbidden keys: $.diagnostics.ce_score_margin"), (1, "forbidden keys: $.diagnostics[0].gold-rank!, $.diagnostics[1].Target")]


def test_escaped_keys_leak_too(spark):
    raw = json.dumps(GOOD)[:-1] + ', "d": {"t\\u0061rget": 1}}'
    assert ("$.d.target" in _faults(spark, [raw.replace("\\\\", "\\")], strict=False)[0][1])


def test_every_fault_of_a_row_is_named(spark):
    bad = {"query_id": "", "cell_id": 3, "tier": "C9", "cost_menu": "x", "route": "zoom", "ranked_views": ["pq", "pq"], "view_set": "full", "abstain": 1, "runtime_s": -1, "note": 1}
    errors = [e for _, e in _faults(spark, [bad])]
    assert errors == sorted(["unknown keys: note", "no string in query_id", "no string in cell_id", "tier isn't allowed: C9", "cost menu isn't the declared one: x", "not one primary action: route, view_set", "no rule for sets of views",
        "route isn't declared: zoom", "ranked_views names a view twice", "view_set is no list of names", "abstain is no boolean", "runtime_s is no number from 0 up"])
    assert _faults(spark, ["nope", "[]", GOOD, GOOD]) == [(0, "not a JSON object"), (1, "not a JSON object"), (3, "the pair was submitted before")]
    found = _faults(spark, [GOOD, {**GOOD, "query_id": "q3"}, {**GOOD, "query_id": "q4"}, {**GOOD, "query_id": "q5"}], [("q1", "c1", "C0", "C_op", ["summary"]), ("q4", "c1", None, None, []), ("q5", "c1", None, None, ["zoom"])])
    assert found == [(0, "route isn't declared: pq"), (0, "tier differs from the manifest's: C0"), (1, "not in the manifest"), (2, "the manifest's declared views are no list of names"), (3, "route isn't declared: pq"), (3, "the manifest's declared views aren't in the menu")]


def test_calibration_and_ranks(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.9, 1), (1.0, 1)], "p double, y int")
    assert stats.auc(rows, "p", "y").first()["auc"] == pytest.approx(5.5 / 6, abs=1e-6)
    assert stats.average_precision(rows, "p", "y").first()["auprc"] == pytest.approx((1 / 3) * (1 + 1 + 3 / 4), abs=1e-6)
    assert stats.ece(rows, "p", "y").first()["ece"] == pytest.approx((0.1 * 1 + 0.1 * 2 + 0.05 * 2) / 5, abs=1e-6)


def test_affine_match_gives_the_moments(spark):
    pts = spark.createDataFrame([(1, i, float(i % 5), float((i * i) % 7)) for i in range(20)], "cell long, idx long, x double, y double")
    want = spark.createDataFrame([(1, 3.0, -1.0, 2.0, 1.0, 0.5)], "cell long, mx double, my double, vxx double, vyy double, vxy double")
    m = geometry.moments(geometry.affine_match(pts, want)).first()
    assert [m[c] for c in ("mx", "my", "vxx", "vyy", "vxy")] == pytest.approx([3, -1, 2, 1, 0.5])
    assert geometry.farthest_points(pts, 4).count() == 4


def test_depth_costs():
    assert depth_cost(32, 32) == pytest.approx(0.2) and depth_cost(16, 128, "ef") == pytest.approx(0.1375)


def test_normal_forms(spark):
    row = spark.createDataFrame([("  A_b  c ", " Oracle-View! ")], "t string, k string").select(C.norm_title(F.col("t")).alias("t"), C.norm_key(F.col("k")).alias("k")).first()
    assert tuple(row) == ("a b c", "oracle_view")


def test_jsonl(spark, tmp_path):
    p = tmp_path / "rows.jsonl"
    p.write_text('{"a": 1}\n\n[1]\n{"a": 2, "b": 3}\nnope\n')
    schema = T.StructType([T.StructField("a", T.LongType())])
    rows = files.read_jsonl(spark, str(p), schema, strict=False).collect()
    assert sorted((r["bad"], r["a"]) for r in rows if not r["bad"]) == [(False, 1), (False, 2)] and sum(r["bad"] for r in rows) == 2
    with pytest.raises(Exception, match="not a JSON object"):
        files.read_jsonl(spark, str(p), schema).collect()
    files.write_jsonl(spark.createDataFrame([(2, "x")], "b int, a string"), str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":"x","b":2}']


def test_csv_prices_and_tables(spark, tmp_path):
    files.write_csv([spark.createDataFrame([(1,)], "b int"), spark.createDataFrame([(2, "z")], "b int, a string")], str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["a", "b"]
    rows = [("S", "2020-01-01", "PX_LAST", "1,000.5", 1), ("S", "2020-01-01", "PX_LAST", "7", 2), ("S", "2020-01-02", "PX_LAST", "-1", 3), ("S", "2020-01-03", "PX_LAST", "x", 4)]
    long = spark.createDataFrame(rows, "security string, date string, field string, value string, line int")
    assert [tuple(r) for r in files.prices(long).collect()] == [("S", "2020-01-01", 7.0)]
    assert "S|PX_LAST" in files.wide_panel(long, ["S|PX_LAST"]).columns
    lines = [r["text"] for r in files.markdown(spark.createDataFrame([("a|b", 0.5)], "n string, v double"), [F.col("n")]).orderBy("line").collect()]
    assert lines == ["| n | v |", "| --- | --- |", r"| a\|b | 0.5 |"]


def test_archives(tmp_path):
    good, bad = tmp_path / "g.zip", tmp_path / "b.zip"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("x/y.txt", "1")
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../z.txt", "1")
    assert files.unzip_safely(str(good), str(tmp_path / "o")) == ["x/y.txt"]
    with pytest.raises(ValueError):
        files.unzip_safely(str(bad), str(tmp_path / "o"))


def test_packs_and_collections(spark):
    pack = files.synthetic_pack(spark, 10, 3, list(MENUS["dense"]))
    assert pack.count() == 80 and pack.exceptAll(files.synthetic_pack(spark, 10, 3, list(MENUS["dense"]))).count() == 0
    docs = spark.range(20).select(F.col("id").alias("did"))
    queries = spark.range(5).select(F.col("id").alias("qid"))
    rel = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 0.0)], "qid long, did long, rel double")
    kept, judged, among = files.select_collection(docs, queries, rel, 6, 10, 1)
    assert kept.count() == 6 and judged.count() == 2 and among.count() == 2


def test_streams_match_batches(spark, tmp_path):
    from viewmint.streaming import streams

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "e"))
    whole = {(r["start"], r["event_type"]): r["n"] for r in streams.windowed(events.withColumn("ts", F.col("ts").cast("timestamp")), "1 day", "6 hours").collect()}
    got = {(r["start"], r["event_type"]): r["n"] for r in streams.replay(streams.windowed(streams.event_stream(spark, str(tmp_path / "e"), 10), "1 day", "6 hours"), "tumbling", "complete").collect()}
    assert got == whole
    stream = streams.event_stream(spark, str(tmp_path / "e"), 10)
    assert streams.replay(streams.deduplicated(stream, ["event_id"], "40 days"), "once").count() == events.count()
    reference = spark.createDataFrame([(u, "click", 0.5, 0.1) for u in range(10)], "query_id long, view string, score double, cost double")
    scored = []
    routes = stream.select(F.col("user_id").alias("query_id"), F.col("event_type").alias("route"))
    streams.score_submissions(routes, reference, lambda d, n: scored.append((n, d.count())), str(tmp_path / "cp")).awaitTermination()
    assert scored and scored[0][1] > 0


def test_collections_as_published(spark, tmp_path):
    from viewmint.sources import collections as S

    def read(schema, *rows):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.jsonl"
        path.write_text("\n".join(json.dumps(r) for r in rows))
        return spark.read.schema(schema).json(str(path))

    two = S.load_2wiki(read(S.RAW_2WIKI, {"_id": "a", "type": "t", "question": "q", "answer": "x", "context": [["ignored"]], "supporting_facts": [["Some_Title", 0], [3, "Other  title"], []], "evidences": [["A_b", "r", "C"], ["too", "short"]]})).first()
    assert two["support_titles"] == ["other title", "some title"] and two["evidence_entities"] == ["a b", "c"]
    hot = S.load_hotpot(read(S.RAW_HOTPOT, {"question": "q", "context": {"title": ["T"], "sentences": [["s1", "s2"]]}, "supporting_facts": {"title": ["T", " "], "sent_id": [1, 0]}}, {"id": "none", "supporting_facts": {"title": [], "sent_id": []}})).collect()
    assert len(hot) == 1 and hot[0]["id"].startswith("hotpot_") and [tuple(p) for p in hot[0]["support_pairs"]] == [("t", 1)] and hot[0]["answer"] == ""
    para = [{"title": "T", "paragraph_text": " x ", "is_supporting": True}, {"idx": 5, "title": "", "paragraph_text": "y", "is_supporting": True}]
    mus = S.load_musique(read(S.RAW_MUSIQUE, {"id": "3hop1__z", "question": "q", "answerable": True, "paragraphs": para, "question_decomposition": [{"question": " "}, {"question": "w", "answer": "v", "paragraph_support_idx": 0}]}, {"id": "no", "answerable": False, "paragraphs": para}, {"id": "m", "answerable": True, "paragraphs": para})).collect()
    assert [(r["type"], r["decomp_questions"], r["support_idx"], len(r["paragraphs"])) for r in mus] == [("3hop1", ["w"], [0], 1), ("1support", [], [0], 1)]
    fev = S.load_fever(read(S.RAW_FEVER, {"id": 7, "claim": "c", "evidence": [[[1, 2, "T", 3], [1, 2, None, 3], [1, 2, "T", 3]], [[1, 2, "A", 0], [1]]]}, {"id": 8, "evidence": [[[1, None, None, None]]]})).collect()
    assert [(r["id"], [tuple(h) for h in r["evidence_handles"]], r["evidence_titles"]) for r in fev] == [("7", [("T", 3), ("A", 0)], ["A", "T"])]
    stq = S.load_strategyqa(read(S.RAW_STRATEGYQA, {"qid": "1", "question": "q", "facts": [" f ", ""], "decomposition": ["", "d "]}, {"qid": "2", "facts": [" "]})).collect()
    assert [(r["facts"], r["decomposition"], r["answer"]) for r in stq] == [(["f"], ["d"], False)]
    doc = {"doc_id": "d", "split": "dev", "title": "T", "sents": [["Ann", "met", "Bob", "."], ["She", "left"]], "vertexSet": [[{"name": "Ann"}, {"name": "Anny"}, {"name": "Anna"}], [{"name": "Bob"}]], "labels": [{"h": 0, "t": 1, "r": "P9", "evidence": [0, 5, 0]}, {"h": 0, "t": 7, "r": "P9", "evidence": []}]}
    rel = S.load_docred(read(S.RAW_DOCRED, doc, {"doc_id": "short", "sents": [["x"]], "labels": [{"h": 0, "t": 0, "r": "P", "evidence": [0]}]}), spark.createDataFrame([("P9", "met with")], "r string, name string")).collect()
    assert len(rel) == 1 and (rel[0]["head"], rel[0]["tail"], rel[0]["relevant_local"]) == ("Anny", "Bob", [0])
    assert rel[0]["query_text"] == "T: evidence for relation met with between Anny and Bob" and rel[0]["summary_scores"] == pytest.approx([2.0 + 0.25 * 0.5, -0.001])


def test_documents_and_inventories(spark, tmp_path):
    files.write_json(spark.createDataFrame([(2, "y"), (1, "x")], "b int, a string"), str(tmp_path / "doc"))
    assert [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "doc")).collect()] == [[{"a": "x", "b": 1}, {"a": "y", "b": 2}]]
    root = tmp_path / "tree"
    for name in ("top.md", "reports/r.json", "docs/d.md", "docs/x_cache/skip.bin"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    got = {r["path"]: (r["role"], r["bytes"], r["sha256"] == files.sha256_of(str(root / r["path"]))) for r in files.inventory(spark, str(root), [("/", "entry"), ("reports/", "report")], [r"_cache/"]).collect()}
    assert got == {"top.md": ("entry", 6, True), "reports/r.json": ("report", 14, True), "docs/d.md": ("file", 9, True)}
    catalog = spark.createDataFrame([("a", 1)], "name string, n int")
    assert files.lookup(catalog, "name", "a")["n"] == 1
    with pytest.raises(KeyError):
        files.lookup(catalog, "name", "b")


def test_logs_are_appended_once(spark, tmp_path):
    from viewmint.streaming import streams

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.where("event_id % 2 = 0").write.mode("append").parquet(str(tmp_path / "in"))
    rows = streams.event_stream(spark, str(tmp_path / "in"), 10).select("event_id")
    for _ in range(2):
        streams.append_log(rows, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.json(str(tmp_path / "log")).count() == events.where("event_id % 2 = 0").count()
    events.where("event_id % 2 = 1").write.mode("append").parquet(str(tmp_path / "in"))
    streams.append_log(rows, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.json(str(tmp_path / "log")).count() == events.count()


def test_tasks_by_name(spark):
    from viewmint.operators import tasks

    truth = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, label string")
    got = tasks.evaluate("diagnosis", spark.createDataFrame([(1, "a"), (3, "a")], "id long, label string"), truth).first()
    assert tuple(got) == (3, pytest.approx(1 / 3, abs=1e-6), 0.25)
    views = truth.withColumnRenamed("label", "view")
    assert tasks.evaluate("interpretation", views, views).first()["agreement"] == 1.0
    points = spark.createDataFrame([(1, i, float(i), float(i % 3)) for i in range(6)], "cell long, idx long, x double, y double")
    r = tasks.evaluate("recovery", points, points).first()
    assert r["chamfer"] == 0 and r["iou"] == 1 and r["coverage"] == 1
    ranked = spark.createDataFrame([(1, "v", 1, 5)], "qid long, view string, rank long, did long")
    assert tasks.evaluate("retrieval", ranked, spark.createDataFrame([(1, 5, 1.0)], "qid long, did long, rel double")).first()["ndcg"] == 1.0
    with pytest.raises(KeyError):
        tasks.evaluate("other", truth, truth)


def test_a_mean_midway_is_rounded_up_in_any_order(spark):
    """19.87525 / 500: sums of doubles fall on either side, by the order of their rows."""
    from viewmint.operators import policy as P

    values = [0.075497] * 250 + [0.004004] * 250
    assert round(sum(values), 9) == 19.87525
    views = spark.createDataFrame([(i, "v", 0, 0.0, v, v) for i, v in enumerate(values)], "query_id int, view string, ord int, cost double, quality double, utility double")
    for parts in (1, 3, 7):
        r = P.evaluate(P.fixed_routes(views), views.repartition(parts)).first()
        assert r["mean_utility"] == r["mean_quality"] == 0.039751


def test_links_travel_once_with_their_queries(spark):
    """A link was copied for each query of its node before the other node was looked at."""
    import itertools

    from viewmint.operators import text as T

    pool = {(q, n): (q + n) % 3 == 0 for q in range(4) for n in range(12) if (q * n) % 5 != 1}
    links = {(a, b) for a, b in itertools.product(range(20), repeat=2) if (a * 7 + b * 3) % 4 == 0}
    p = spark.createDataFrame([(q, n, a) for (q, n), a in pool.items()], "qid long, node long, anchor boolean")
    e = spark.createDataFrame(sorted(links), "src long, dst long")
    inside = [(q, a, b) for q in range(4) for a, b in links if (q, a) in pool and (q, b) in pool]
    ways = {k: sum(pool[q, a] for q, a, b in inside if (q, b) == k) for k in pool}
    one = {(q, n): (ways[q, n] + 0.75 * sum(pool[x, b] for x, a, b in inside if (x, a) == (q, n)), sum((x, a) == (q, n) for x, a, _ in inside), sum((x, b) == (q, n) for x, _, b in inside)) for q, n in pool}
    scored = T.one_hop_scores(p, e)
    assert "LeftSemi" in scored._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["qid"], r["node"]): (r["one"], r["out_degree"], r["in_degree"]) for r in scored.collect()} == one
    two = {k: round(one[k][0] + 0.5 * sum(ways[q, a] for q, a, b in inside if (q, b) == k) + 0.05 * (one[k][1] + one[k][2]), 6) for k in pool}
    assert {(r["qid"], r["node"]): r["two"] for r in T.two_hop_scores(p, e).collect()} == pytest.approx(two)
    got = {(r["qid"], r["node"]) for r in T.neighbours(p.where("anchor"), e).collect()}
    assert got == {(q, b) for (q, n), a in pool.items() if a for s, b in links if s == n}


def test_splits_are_drawn_once(spark):
    """What reads the sums of splits must not hash every query anew."""
    from viewmint.operators import policy as P

    views = spark.createDataFrame([(q, "ab"[q % 2], v, i, float((q * 7 + i) % 5)) for q in range(200) for i, v in enumerate("xyz")], "query_id int, dataset string, view string, ord int, utility double")
    one = P.repeated_splits(views, "dataset", 4)
    assert "md5" not in one._jdf.queryExecution().optimizedPlan().toString()
    both = P.split_sums(views.withColumn("other", views["query_id"] % 3), ("dataset", "other"), 4)
    assert sorted(P.splits_of(both, "dataset").collect()) == sorted(one.collect())


def test_distances_of_a_cell_are_made_block_by_block(spark, monkeypatch):
    """Pairs of a cell's points were rows, and its distances one state of an aggregate."""
    import numpy as np

    from viewmint.operators import geometry as G

    rng = np.random.default_rng(5)
    for p in (rng.integers(0, 9, (700, 2)).astype(float), rng.normal(size=(601, 2)), np.zeros((3, 2)), np.array([[0.0, 0.0], [3.0, 4.0]])):
        d = ((p[:, None, :] - p[None, :, :]) ** 2).sum(axis=2)
        want = np.median(d[d > 0]) if (d > 0).any() else np.nan
        for most in (10, 1000, 4_000_000):
            assert G._middle(p, most) == pytest.approx(want, nan_ok=True)
    p = rng.normal(size=(600, 2))
    points = spark.createDataFrame([(7, i, float(x), float(y)) for i, (x, y) in enumerate(p)] + [(8, 0, 1.0, 1.0), (9, 0, 0.0, 0.0), (9, 1, 3.0, 4.0)], "cell int, idx long, x double, y double")
    near = G.mean_nearest(points, 5)
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["cell"], r["idx"]): r["m"] for r in near.collect()}
    d = np.sqrt(((p[:, None, :] - p[None, :, :]) ** 2).sum(axis=2))
    assert got == pytest.approx({(7, i): np.sort(d[i])[1:6].mean() for i in range(600)} | {(9, 0): 5.0, (9, 1): 5.0})
    assert "Join" not in G.rbf_mmd(points, points)._jdf.queryExecution().optimizedPlan().toString()
