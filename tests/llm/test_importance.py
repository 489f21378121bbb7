"""Importance resampling against SQL and brute force, and odd rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("viewmint.llm")

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _runs(text, ngrams):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(ngrams[0], ngrams[1] + 1) for i in range(len(words) - n + 1)]


def _brute(rows, target, buckets=10_000, ngrams=(1, 1), percent=10, least=20, seed=2024):
    bucket = lambda w: zlib.crc32(w.encode()) % buckets
    each = [(k, *_runs(t, ngrams)) for k, t in rows]
    s = Counter(bucket(w) for _, _, runs in each for w in runs)
    t = Counter(bucket(w) for x in target for w in _runs(x, ngrams)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for k, n, runs in each:
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(w)] for w in runs)
        out.append([k, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    out.sort(key=lambda r: (not r[4], -r[3], r[0] is None, r[0]))
    drawn = sum(r[4] for r in out) * percent // 100
    return sorted(((*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(out)), key=str)


def _rows(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=str)


def test_query_against_sql_and_brute_force(spark):
    import duckdb

    from viewmint.llm.queries import QUERIES
    from viewmint.llm.sql import ORACLES

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = QUERIES["op12_importance"](spark, SMALL)
    assert df.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    found = _rows(df)
    docs, items = (con.execute(q).fetchall() for q in ("select doc_id, text from documents", "select text from benchmark"))
    assert found == _brute(docs, [x for (x,) in items])
    assert found == sorted(con.execute(f"select doc_id, n_features, weight, score, rank from ({ORACLES['op12_importance']})").fetchall(), key=str)


LONG = "word " * 30_000
ODD = [None, "", " ", "1 2 3", "A b", "É é İ ı", "x\x00y", "a" * 100_000, LONG, LONG, *["Some words of a text that goes on and on, to be long enough for the draw %d times over, and over, and over" % (i % 7) for i in range(60)]]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [*enumerate(ODD), (65, ODD[65]), (65, ODD[65]), (65, "another " * 25), *[(None, LONG)] * 20, (None, None)]
    # columns of the names that the operator uses and returns
    return rows, spark.createDataFrame([(k, t, "x", 1, 2, 3) for k, t in rows], "doc_id long, text string, score string, rank int, _id int, _buckets int").repartition(4)


def test_odd_rows(spark, odd):
    from viewmint.llm.importance import draw_documents, importance_scores

    rows, df = odd
    target = spark.createDataFrame([("go on", 1), (None, 2), ("", 3), (LONG, 4)], "text string, _words int")
    texts = ["go on", None, "", LONG]
    assert _rows(importance_scores(df, target)) == _brute(rows, texts)
    assert _rows(importance_scores(df, target, buckets=64, ngrams=(1, 3), percent=40, least_words=3, seed=5)) == _brute(rows, texts, 64, (1, 3), 40, 3, 5)
    assert _rows(importance_scores(df, target, ngrams=(2, 2))) == _brute(rows, texts, ngrams=(2, 2))
    assert _rows(importance_scores(df, target.limit(0))) == _brute(rows, [])
    assert importance_scores(df.limit(0), target).count() == 0
    drawn = draw_documents(df, target)
    best = {r[0] for r in _brute(rows, texts) if r[4]}
    assert drawn.columns == df.columns and {r["doc_id"] for r in drawn.collect()} == best


def test_equal_rows_are_dealt_apart(spark):
    from pyspark.sql import functions as F

    from viewmint.llm.importance import _in_order

    same = spark.range(0, 40_000, 1, 8).select(F.lit(1).alias("s"), F.col("id").alias("_row"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these rows are few
    try:
        placed = _in_order(same, [F.desc("s"), F.asc("_row")])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert placed.groupBy("_part").count().agg(F.max("count")).first()[0] < 20_000
    assert placed.agg(F.countDistinct("_place"), F.max("_place"), F.min("_place")).first()[:] == (40_000, 40_000, 1)
    assert placed.where((F.col("_place") - 1) != F.col("_row")).count() == 0
