"""Vectors of texts without a model: hashed character runs, weighted, and their
truncated singular value decomposition by block power iteration.

Rows stay sparse and stay where they are.  An iteration sends a block of as
many columns as dimensions are wanted to the rows and sums what they give back
by bucket; its size is set by parameters and doesn't grow with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Rows that are held densely at a time.
BLOCK = 256
#: Columns of the block beyond the wanted ones, and iterations at most.
SPARE, MOST_ITERATIONS = 16, 30
#: Relative change of all wanted singular values that ends the iteration.
TOLERANCE = 1e-4


def _buckets_of(text: str, runs: tuple[int, int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of all character runs of the lower-cased text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    found = []
    for n in range(runs[0], runs[1] + 1):
        if len(points) >= n:
            h = np.full(len(points) - n + 1, 2166136261, np.uint32)  # FNV-1a over code points
            for i in range(n):
                h = (h ^ points[i : len(points) - n + 1 + i]) * np.uint32(16777619)
            found.append((h ^ (h >> np.uint32(15))) % np.uint32(buckets))
    return np.unique(np.concatenate(found) if found else np.zeros(0, np.uint32), return_counts=True)


def hashed_runs(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 4096, runs: tuple[int, int] = (2, 4)) -> DataFrame:
    """(id, bucket, count), arrays: character runs of each whole text by bucket.
    Null and empty texts have none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_buckets_of(t or "", runs, buckets) for t in batch.column(1).to_pylist()]
            arrays = [pa.array([f[i] for f in found], kind) for i, kind in ((0, pa.list_(pa.int32())), (1, pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", "bucket", "count"])

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"id {kind}, bucket array<int>, count array<long>")


def weighted_runs(rows: DataFrame) -> DataFrame:
    """(id, bucket, weight): logarithms of counts times inverse document
    frequencies, of length 1 a row."""
    n = rows.count()
    seen = rows.select(F.explode("bucket").alias("b")).groupBy("b").agg((F.log((1.0 + n) / (1.0 + F.count(F.lit(1)))) + 1.0).alias("idf"))
    found = dict(seen.collect())  # a row a bucket
    idf = np.array([found.get(b, 0.0) for b in range(max(found, default=0) + 1)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, count = batch.column(1), batch.column(2)
            begin = bucket.offsets.to_numpy().astype(np.int64)
            index = bucket.values.to_numpy()[begin[0] : begin[-1]]
            raw = (1 + np.log(count.values.to_numpy()[count.offsets[0].as_py() : count.offsets[-1].as_py()])) * idf[index]
            squares = np.concatenate([[0], np.cumsum(raw * raw)])[begin - begin[0]]
            raw /= np.repeat(np.sqrt(np.maximum(np.diff(squares), 1e-24)), np.diff(begin))
            weight = pa.ListArray.from_arrays(pa.array((begin - begin[0]).astype(np.int32)), pa.array(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), bucket, weight], ["id", "bucket", "weight"])

    return rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, bucket array<int>, weight array<double>")


@dataclass(frozen=True)
class Decomposition:
    """Singular values, descending, and their right vectors as columns."""

    values: np.ndarray
    vectors: np.ndarray


def _blocks(batch: pa.RecordBatch, at: int, buckets: int) -> Iterator[np.ndarray]:
    """Dense rows of a batch's arrays (bucket, weight) from column ``at`` on."""
    (begin, index), (_, weight) = (_flat(batch.column(at + i)) for i in (0, 1))
    for a in range(0, batch.num_rows, BLOCK):
        ends = begin[a : a + BLOCK + 1]
        dense = np.zeros((len(ends) - 1, buckets))
        held = slice(ends[0], ends[-1])
        dense[np.repeat(np.arange(len(ends) - 1), np.diff(ends)), index[held]] = weight[held]
        yield dense


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Where a column's arrays begin and end, and all their values."""
    ends = column.offsets.to_numpy().astype(np.int64)
    return ends - ends[0], column.values.to_numpy()[ends[0] : ends[-1]]


def truncated_svd(rows: DataFrame, buckets: int, k: int, seed: int = 7) -> Decomposition:
    """The ``k`` largest singular values of the sparse matrix of ``rows``.

    Each iteration multiplies the block by the matrix and its transpose where
    the rows are; Rayleigh-Ritz values of the block are compared with those
    before.  The driver holds ``buckets x (k + 16)`` numbers.
    """
    width = min(buckets, k + SPARE)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(buckets, width)))[0]
    names = [f"c{i}" for i in range(width)]
    before = np.zeros(k)
    for _ in range(MOST_ITERATIONS):
        def work(batches: Iterator[pa.RecordBatch], v: np.ndarray = block) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(v)
            for batch in batches:
                for dense in _blocks(batch, 0, buckets):
                    total += dense.T @ (dense @ v)
            some = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, i]) for i in range(width))], ["b", *names])

        made = rows.select("bucket", "weight").mapInArrow(work, "b long, " + ", ".join(f"{c} double" for c in names))
        product = np.zeros_like(block)
        for r in made.groupBy("b").agg(*[F.sum(c).alias(c) for c in names]).collect():  # a row a bucket
            product[r["b"]] = r[1:]
        values, turn = np.linalg.eigh(block.T @ product)
        order = np.argsort(-values)
        ritz, found = np.sqrt(np.maximum(values[order], 0)), block @ turn[:, order]
        if np.allclose(ritz[:k], before, rtol=TOLERANCE, atol=1e-12):
            break
        before = ritz[:k]
        block = np.linalg.qr(product)[0]
    vectors = found[:, :k]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return Decomposition(ritz[:k], vectors * np.where(sign == 0, 1, sign))


def reduced(rows: DataFrame, made: Decomposition) -> DataFrame:
    """(id, vector): every row in the decomposition's directions, of length 1;
    rows without runs are zeros."""
    v = made.vectors

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([d @ v for d in _blocks(batch, 1, len(v))]) if batch.num_rows else np.zeros((0, v.shape[1]))
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["id", "vector"])

    return rows.select("id", "bucket", "weight").mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, vector array<double>")


def text_vectors(texts: DataFrame, k: int = 16, id_col: str = "doc_id", text_col: str = "text", buckets: int = 4096, runs: tuple[int, int] = (2, 4), seed: int = 7) -> DataFrame:
    """(``id_col``, vector): ``k`` numbers a text.

    Whole texts count; null and empty ones are zeros.  Every row has its own
    vector, also where ids repeat or are null.
    """
    rows = cut(weighted_runs(cut(hashed_runs(texts, id_col, text_col, buckets, runs))))
    return reduced(rows, truncated_svd(rows, buckets, k, seed)).select(F.col("id").alias(id_col), "vector")
