"""Exact and compressed vector search.

Search is a product of blocks: shards of the base and blocks of the queries,
both of bounded size, meet once; each meeting keeps its best ``k`` a query.
Vectors travel as they are stored, and views of them are made where they meet,
so that what is shuffled is a copy of the base a block and ``k`` rows a shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import core as C

#: Rows of a shard of the base, and of a block of queries.  A small search has
#: smaller blocks, ``LEAST_BLOCKS`` in all, so that many tasks share it.
SHARD_ROWS, BLOCK_ROWS = 100_000, 20_000
LEAST_BLOCKS, LEAST_ROWS = 24, 500
#: Digits that scores are rounded to before they are ranked.
DIGITS = 9
#: Queries and rows that are multiplied at a time within a meeting, and rows of a
#: run; a long list of best rows has shorter runs.
_Q, _X, _RUN = 256, 16_384, 64
#: A tile that has one near product in so many, or more, is multiplied anew as a
#: whole; and near products that are held before all but the best are dropped.
_DENSE, _HELD = 64, 1 << 20

#: Compressed views of a vector, by name.
VIEWS = {
    "binary": C.binary_view,
    "int8": C.int8_view,
    "trunc32": lambda a: C.truncated_view(a, 32),
    "full": lambda a: F.transform(a, lambda x: x.cast("double")),
}


def _renormed(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(length == 0, 1.0, length)


def _binary(x: np.ndarray, null: np.ndarray) -> np.ndarray:
    unit = 1 / np.sqrt(x.shape[1])
    return np.where((x >= 0) | (np.isnan(x) & ~null), unit, -unit)


#: :data:`VIEWS` of the rows of a matrix, and of where it is null.
MATRIX_VIEWS = {
    "binary": _binary,
    "int8": lambda x, null: _renormed(np.where(np.isnan(x), 127.0, np.clip(np.rint(x * 127.0), -127.0, 127.0)) / 127.0),
    "trunc32": lambda x, null: _renormed(x[:, :32]),
    "full": lambda x, null: x,
}


def _matrix(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A column of vectors as a matrix of doubles, and where it is null."""
    flat = pa.concat_arrays([c.flatten() for c in vectors.chunks])
    shape = (len(vectors), -1)
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(shape), flat.is_null().to_numpy(zero_copy_only=False).reshape(shape)


def best_of(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``k`` highest scores above minus infinity,
    best first, ties by column.  Only what reaches the k-th score is sorted."""
    k = min(k, score.shape[1])
    least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    row, column = np.nonzero((score >= least[:, None]) & (score > -np.inf))
    order = np.lexsort((column, -score[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _kept(row: np.ndarray, column: np.ndarray, score: np.ndarray, did: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each row, best first, ties by ``did``."""
    order = np.lexsort((did[column], -score, row))
    row, column, score = row[order], column[order], score[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], column[kept], score[kept]


def _slack(q: np.ndarray, x: np.ndarray) -> np.ndarray | None:
    """By how much a product of single precision may be off, for each row of
    ``q``; none where single precision doesn't hold the numbers."""
    with np.errstate(over="ignore", invalid="ignore"):
        longest, own = (np.sqrt((m * m).sum(axis=1)) for m in (x, q))
        most = longest.max(initial=0.0)
        off = (q.shape[1] + 8) * np.finfo(np.float32).eps * own * most + 1e-12
    return off if most < 1e15 and own.max(initial=0.0) < 1e15 else None  # not for nan either


def best_products(q: np.ndarray, x: np.ndarray, qid: np.ndarray, did: np.ndarray, k: int, x32: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of each query's ``k`` highest products, rounded, best
    first, ties by ``did``; a row doesn't find itself.

    Products are first made in single precision (``x32``, if it is at hand, is
    ``x`` in it).  Of each run of them the highest is taken; the ``k + 1``-th of
    all these is reached by that many rows, so only what comes within the error
    of it is multiplied in double precision, which alone decides.
    """
    slack = _slack(q, x)
    single = slack is not None
    q32, x32 = (q.astype(np.float32), x.astype(np.float32) if x32 is None else x32) if single else (q, x)
    margin = (2 * slack if single else np.zeros(len(q))) + 2 * 10.0**-DIGITS
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    top = np.full((len(q), k + 1), -np.inf, q32.dtype)
    for a in range(0, len(x), _X):
        score = q32 @ x32[a : a + _X].T
        if not single:
            np.copyto(score, -np.inf, where=np.isnan(score))
        runs = min(score.shape[1], max(-(-score.shape[1] // _RUN), 8 * (k + 1)))
        if score.shape[1] % runs:
            score = np.pad(score, ((0, 0), (0, -score.shape[1] % runs)), constant_values=-np.inf)
        cut = score.reshape(len(q), -1, runs)  # a run is every ``runs``-th column
        high = cut.max(axis=1)
        top = np.concatenate([top, high], axis=1)
        top = np.partition(top, top.shape[1] - k - 1, axis=1)[:, -k - 1 :]
        least = top.min(axis=1).astype(np.float64) - margin
        row, run = np.nonzero(high >= least[:, None])
        near = cut[row, :, run] >= least[row, None]
        at, step = np.nonzero(near)
        row, column = row[at], a + step * runs + run[at]
        fine = column < min(len(x), a + _X)
        row, column = row[fine], column[fine]
        if not single:
            value = score[row, column - a]
        elif len(row) > score.size // _DENSE:
            value = (q @ x[a : a + _X].T)[row, column - a]
        else:
            value = np.einsum("ij,ij->i", q[row], x[column])
        kept = (qid[row] != did[column]) & (value > -np.inf)
        found.append((row[kept], column[kept], np.round(value[kept], DIGITS)))
        if sum(len(f[0]) for f in found) > _HELD:
            found = [_kept(*(np.concatenate(c) for c in zip(*found)), did, k)]
    return _kept(*(np.concatenate(c) for c in zip(*found)), did, k)


def _meet(k: int, views: list[str], keys: tuple[str, ...] = ()):
    """What meets, as (``keys`` of the query, qid, view, did, score)."""

    def run(base: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [queries.column(n).to_numpy()[:0]] for n in keys} | {"qid": [np.zeros(0, np.int64)], "view": [], "did": [np.zeros(0, np.int64)], "score": [np.zeros(0)]}
        if base.num_rows and queries.num_rows:
            did, qid = base.column("_id").to_numpy(), queries.column("_id").to_numpy()
            carried = {n: queries.column(n).to_numpy() for n in keys}
            raw, asked = _matrix(base.column("_e")), _matrix(queries.column("_e"))
            for v in views:
                x, q = MATRIX_VIEWS[v](*raw), MATRIX_VIEWS[v](*asked)
                with np.errstate(over="ignore"):
                    x32 = x.astype(np.float32)
                for a in range(0, len(q), _Q):
                    row, column, score = best_products(q[a : a + _Q], x, qid[a : a + _Q], did, k, x32)
                    for n, c in carried.items():
                        out[n].append(c[a : a + _Q][row])
                    out["qid"].append(qid[a : a + _Q][row])
                    out["view"] += [v] * len(row)
                    out["did"].append(did[column])
                    out["score"].append(score)
        return pa.table({n: pa.array(c, pa.string()) if n == "view" else np.concatenate(c) for n, c in out.items()})

    return run


def _side(d: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    return d.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_e"), *more)


def top_k_views(base: DataFrame, queries: DataFrame, k: int, views: list[str], id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(qid, view, rank, did, score): inner-product top ``k`` under each view,
    all of which meet at once.

    A row doesn't find itself.  Ties go to the smaller id.
    """
    n = queries.count()
    shards = max(1, -(-base.count() // SHARD_ROWS))
    blocks = max(1, -(-n // BLOCK_ROWS), min(LEAST_BLOCKS, -(-n // LEAST_ROWS)))
    b = _side(base, id_col, vector_col).select("*", F.pmod(F.xxhash64("_id"), F.lit(shards)).cast("int").alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))
    q = _side(queries, id_col, vector_col).select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_s"), F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int").alias("_b"))
    met = b.groupBy("_s", "_b").cogroup(q.groupBy("_s", "_b")).applyInArrow(_meet(k, views), "qid long, view string, did long, score double")
    by = Window.partitionBy("qid", "view").orderBy(F.col("score").desc(), "did")
    return met.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k).select("qid", "view", "rank", "did", "score")


def top_k(base: DataFrame, queries: DataFrame, k: int, view: str = "full", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """:func:`top_k_views` under one view."""
    return top_k_views(base, queries, k, [view], id_col, vector_col)


def ranked(scores: DataFrame, k: int, view: str) -> DataFrame:
    by = Window.partitionBy("qid").orderBy(F.col("score").desc(), "did")
    return (
        scores.withColumn("rank", F.row_number().over(by))
        .where(F.col("rank") <= k)
        .select("qid", F.lit(view).alias("view"), F.col("rank").cast("long").alias("rank"), "did", "score")
    )


def centroids(base: DataFrame, cell: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(cell, c): mean vector of each cell, normed."""
    parts = base.select(cell.alias("cell"), F.posexplode(vector_col).alias("i", "x"))
    means = parts.groupBy("cell", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("cell").agg(C.renormed(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])).alias("c"))


def centroid_search(base: DataFrame, queries: DataFrame, k: int, cell: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Cells by their centroid's score, and in a cell its most central rows.

    The score of a row is its cell's.  Cells are few: their table is broadcast
    after a check of its size by the planner.
    """
    mean = centroids(base, cell, id_col, vector_col)
    held = base.select(F.col(id_col).alias("did"), cell.alias("cell"), F.col(vector_col).alias("e")).join(mean, "cell")
    central = Window.partitionBy("cell").orderBy(F.col("sim").desc(), "did")
    reps = held.select("cell", "did", F.round(C.dot(F.col("e"), F.col("c")), DIGITS).alias("sim")).withColumn("rep", F.row_number().over(central)).where(F.col("rep") <= max(k, 8) + 1)
    scored = queries.select(F.col(id_col).alias("qid"), F.col(vector_col).alias("e")).crossJoin(mean).select(
        "qid", "cell", F.round(C.dot(F.col("e"), F.col("c")), DIGITS).alias("score")
    )
    near = scored.withColumn("cell_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "cell"))).where(F.col("cell_rank") <= 4)
    order = Window.partitionBy("qid").orderBy("cell_rank", "rep")
    return (
        near.join(reps, "cell").where("qid != did").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("qid", F.lit("summary").alias("view"), F.col("rank").cast("long").alias("rank"), "did", "score")
    )


def rerank(pool: DataFrame, base: DataFrame, queries: DataFrame, k: int, view: str, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A shared pool (qid, did), ranked anew by another view of the vectors."""
    encode = VIEWS[view]
    b = base.select(F.col(id_col).alias("did"), encode(F.col(vector_col)).alias("_d"))
    q = queries.select(F.col(id_col).alias("qid"), encode(F.col(vector_col)).alias("_q"))
    scores = pool.select("qid", "did").join(b, "did").join(q, "qid").select("qid", "did", F.round(C.dot(F.col("_q"), F.col("_d")), DIGITS).alias("score"))
    return ranked(scores, k, view)


def product_quantized(base: DataFrame, parts: int, codes: int, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, embedding): each vector rebuilt from its nearest code in every part.

    A codebook is a k-means of one slice of the dimensions.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    first = base.select(F.size(vector_col).alias("n")).first()
    if first is None:
        return base.select(F.col(id_col), F.col(vector_col).cast("array<double>").alias(vector_col))
    width = first["n"] // parts
    out = base.select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("_e"))
    rebuilt = []
    for p in range(parts):
        out = out.withColumn("_v", array_to_vector(F.slice("_e", p * width + 1, width)))
        model = KMeans(k=codes, featuresCol="_v", predictionCol=f"_c{p}", seed=seed, maxIter=8).fit(out)
        out = model.transform(out).drop("_v")
        book = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
        rebuilt.append(F.get(book, F.col(f"_c{p}")))
    return out.select(id_col, C.renormed(F.concat(*rebuilt)).alias(vector_col))


def inverted_file(base: DataFrame, cells: int, seed: int = 7, vector_col: str = "embedding"):
    """(rows with ``cell``, model): k-means cells by cosine distance."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    with_vector = base.withColumn("_v", array_to_vector(F.col(vector_col).cast("array<double>")))
    model = KMeans(k=cells, featuresCol="_v", predictionCol="cell", seed=seed, maxIter=10, distanceMeasure="cosine").fit(with_vector)
    return model.transform(with_vector).drop("_v"), model


def _nearest_cells(queries: DataFrame, centres: list, count: int, id_col: str, vector_col: str) -> DataFrame:
    """(_id, _e, cell, _near): each query once for each of its ``count`` nearest
    cells, the nearest numbered 1, ties to the smaller cell."""
    book = np.asarray(centres, dtype=np.float64)

    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            score = np.nan_to_num(_matrix(t.column("_e"))[0] @ book.T, nan=-np.inf)
            cell = np.argsort(-score, axis=1, kind="stable")[:, :count].astype(np.int32)
            at = np.repeat(np.arange(t.num_rows), cell.shape[1])
            met = t.take(pa.array(at)).append_column("cell", pa.array(cell.ravel())).append_column("_near", pa.array(np.tile(np.arange(1, cell.shape[1] + 1, dtype=np.int32), t.num_rows)))
            yield from met.to_batches()

    asked = _side(queries, id_col, vector_col)
    return asked.mapInArrow(run, f"_id long, _e {asked.schema['_e'].dataType.simpleString()}, cell int, _near int")


def probes(base: DataFrame, queries: DataFrame, k: int, cells: int, depths: list[int], view: str = "full", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(qid, view, rank, did, score): top ``k`` within the nearest cells of an
    inverted file, for each number of cells in ``depths``.

    The file is trained once and each query meets a cell once, whatever the
    depths.  Cells of many rows, or that many queries probe, meet in parts.
    """
    held, model = inverted_file(base.where(F.col(vector_col).isNotNull()), cells, vector_col=vector_col)
    rows = _side(held, id_col, vector_col, "cell")
    asked = _nearest_cells(queries, model.clusterCenters(), max(depths), id_col, vector_col)
    parts = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int").alias("_parts"))
    blocks = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int").alias("_blocks"))
    split = parts.join(blocks, "cell")  # a row a cell
    of = lambda n: F.pmod(F.xxhash64("_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    b = rows.join(F.broadcast(split), "cell").select("_id", "_e", "cell", of("_parts").alias("_s"), every("_blocks").alias("_b"))
    q = asked.join(F.broadcast(split), "cell").select("_id", "_e", "_near", "cell", every("_parts").alias("_s"), of("_blocks").alias("_b"))
    met = b.groupBy("cell", "_s", "_b").cogroup(q.groupBy("cell", "_s", "_b")).applyInArrow(_meet(k, [view], ("_near",)), "_near int, qid long, view string, did long, score double")
    depth = F.explode(F.filter(F.array(*[F.lit(d) for d in depths]), lambda d: d >= F.col("_near"))).alias("_d")
    by = Window.partitionBy("qid", "_d").orderBy(F.col("score").desc(), "did")
    deep = met.select("qid", "did", "score", depth).withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k)
    return deep.select("qid", F.concat(F.lit("nprobe"), F.col("_d").cast("string")).alias("view"), "rank", "did", "score")


def probe(base: DataFrame, queries: DataFrame, k: int, cells: int, nprobe: int, view: str = "full", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """:func:`probes` at one depth."""
    return probes(base, queries, k, cells, [nprobe], view, id_col, vector_col)


def encoded(texts: DataFrame, encoder, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, embedding): texts under ``encoder``, a function of a list of texts
    that gives a matrix, called batch by batch where the texts are."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            made = np.asarray(encoder([t or "" for t in batch.column(1).to_pylist()]), dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(made), pa.list_(pa.float64()))], [id_col, "embedding"])

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, embedding array<double>")


def hashed_encoder(dims: int):
    """An encoder without a model: signed counts of hashed words, normed."""

    def encode(texts: list[str]):
        import hashlib
        import re

        import numpy as np

        out = np.zeros((len(texts), dims))
        for i, text in enumerate(texts):
            for w in re.findall("[a-z0-9]+", text.lower()):
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                out[i, h % dims] += 1.0 if h >> 63 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def rerank_pairs(pool: DataFrame, queries: DataFrame, docs: DataFrame, scorer, k: int, view: str = "ce") -> DataFrame:
    """A pool (qid, did) ranked anew by ``scorer``, a function of two lists of
    texts (queries, documents) that gives a score a pair, called batch by batch."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            q, d = ([t or "" for t in batch.column(c).to_pylist()] for c in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.asarray(scorer(q, d), dtype=np.float64))], ["qid", "did", "score"])

    pairs = pool.join(queries.select("qid", F.col("text").alias("_q")), "qid").join(docs.select("did", F.col("text").alias("_d")), "did").select("qid", "did", "_q", "_d")
    fields = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("qid", "did"))
    return ranked(pairs.mapInArrow(run, f"{fields}, score double"), k, view)


def overlap_scorer(queries: list[str], docs: list[str]) -> list[float]:
    """A scorer without a model: share of the query's words in the document."""
    import re

    words = lambda t: set(re.findall("[a-z0-9]+", t.lower()))
    return [round(len(words(q) & words(d)) / max(1, len(words(q))), 9) for q, d in zip(queries, docs)]
