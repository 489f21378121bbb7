"""Corpus scans: odd lines, what is decoded, and the profile."""

from __future__ import annotations

import json

from pyspark.sql import Observation
from pyspark.sql import functions as F

from viewmint.sources import corpus

LINES = [
    json.dumps({"id": "1", "title": "A Title", "sentences": ["One.", "Two."], "mentions": [{"ref_url": "Other_Page"}, {"ref_url": "other page"}, {"ref_url": " "}, {"ref_url": "B"}]}),
    json.dumps({"id": 2, "title": "Édith \"Ünal\""}),
    json.dumps({"id": 3, "title": "Édith \"Ünal\""}, ensure_ascii=False),
    '{"id": "4", "title": "A Title", "sentences": [',
    '{"id": "5", "name": "no title"}',
    '{"id": "6", "title": "a  title", "mentions": null, "sentences": null}',
    '{"id": "7", "title": "unwanted", "sentences": ["x"]}',
    '{"id": "8", "title": ""}',
    "",
    "not json",
    '{"id": "9", "title": "broken \\u12 escape"}',
]
NEEDED = ["A_title", "édith \"ünal\"", "never there", None]


def test_odd_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(LINES), encoding="utf-8")
    lines = corpus.corpus_lines(spark, str(tmp_path))
    needed = spark.createDataFrame([(t, 1) for t in NEEDED], "title string, id int")
    profile = Observation("scan")
    rows = {r["id"]: r for r in corpus.scan_titles(lines, needed, profile).collect()}
    assert set(rows) == {"1", "2", "3", "6"}
    assert rows["1"]["links"] == ["b", "other page"] and rows["1"]["degree"] == 2 and rows["1"]["text"] == "One. Two."
    assert rows["6"]["links"] == [] and rows["6"]["sentences"] == [] and rows["2"]["norm_title"] == rows["3"]["norm_title"]
    assert profile.get["lines"] == len(LINES) and profile.get["bytes"] == sum(len(x.encode()) for x in LINES)
    assert 5 <= profile.get["passed"] <= 6  # the broken line of a needed title, too
    assert corpus.scan_titles(lines, needed.limit(0)).count() == 0
    assert corpus.scan_titles(lines.limit(0), needed).count() == 0


def test_only_lines_that_pass_are_decoded(spark):
    lines = spark.range(5000).select(F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.concat(F.lit("Title "), F.col("id")).alias("title"))).alias("value"))
    needed = spark.range(0, 5000, 100).select(F.concat(F.lit("title_"), F.col("id")).alias("title"))
    profile = Observation("few")
    found = corpus.scan_titles(lines, needed, profile)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    decoded = next(i for i, x in enumerate(plan.splitlines()) if "from_json(StructField(id" in x)
    assert any("passes" in x and "Filter" in x for x in plan.splitlines()[decoded:])  # below the decode
    assert sorted(int(r["id"]) for r in found.collect()) == list(range(0, 5000, 100))
    assert 50 <= profile.get["passed"] < 100 and profile.get["lines"] == 5000


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(corpus, "MOST_BITS", 64)
    lines = spark.range(300).select(F.to_json(F.struct(F.concat(F.lit("t"), F.col("id")).alias("title"))).alias("value"))
    needed = spark.range(0, 300, 2).select(F.concat(F.lit("t"), F.col("id")).alias("title"))
    assert {r["title"] for r in corpus.scan_titles(lines, needed).collect()} == {f"t{i}" for i in range(0, 300, 2)}
