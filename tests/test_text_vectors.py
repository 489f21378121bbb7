"""Text vectors against NumPy's decomposition of a matrix counted by hand."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from viewmint.operators import text_vectors as V
from viewmint.plans import QUERIES

SMALL = "/root/testdata/sf0.001"
BUCKETS = 4096


def _bucket(run):
    h = 2166136261
    for c in run:
        h = ((h ^ ord(c)) * 16777619) % 2**32
    return (h ^ (h >> 15)) % BUCKETS


def _matrix(texts):
    counted = []
    for t in texts:
        t = (t or "").lower()
        counted.append(Counter(_bucket(t[i : i + n]) for n in (2, 3, 4) for i in range(len(t) - n + 1)))
    seen = Counter(b for c in counted for b in c)
    x = np.zeros((len(texts), BUCKETS))
    for r, c in enumerate(counted):
        for b, n in c.items():
            x[r, b] = (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + seen[b])) + 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def test_query_has_the_singular_vectors_of_numpy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    x = _matrix([texts[i] for i in sorted(texts)])
    want = np.linalg.svd(x, compute_uv=False)[:16]
    rows = V.weighted_runs(V.hashed_runs(docs))
    made = V.truncated_svd(rows, BUCKETS, 16)
    assert made.values == pytest.approx(want, rel=0.01)
    got = {r["doc_id"]: np.array(r["vector"]) for r in QUERIES["hash_svd"](spark, SMALL).collect()}
    assert sorted(got) == sorted(texts)
    # the same cosines as in the leading directions, where signs and turns don't matter
    y = np.array([got[i] for i in sorted(got)])
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    z = u[:, :16] * s[:16]
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    assert np.abs(y @ y.T - z @ z.T).mean() < 0.02


def test_odd_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (4, "ab"), (4, "ab"), (None, "abc abc"), (5, "É漢字👩" * 3), (6, "x" * 200_000)], "doc_id long, text string")
    got = [(r["doc_id"], np.array(r["vector"])) for r in V.text_vectors(rows, 3).collect()]
    assert len(got) == 8 and all(len(v) == 3 for _, v in got)
    assert all(np.linalg.norm(v) == pytest.approx(0 if i in (1, 2, 3) else 1, abs=1e-6) for i, v in got if i in (1, 2, 3, 4))
    assert V.text_vectors(rows.limit(0), 3).count() == 0
