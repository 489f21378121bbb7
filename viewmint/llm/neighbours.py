"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of a few tables cuts projections on Gaussian (2-stable) directions
into cells; a vector is filed in every table under its cell, its bucket.
Projections of two points at distance r differ by a Gaussian of deviation r,
which tells for every perturbed cell how likely a near neighbour lies there.  A
query's probes are a table's most likely cells, generated in that order from
the query alone, without a look at which cells are occupied.  Probes meet
buckets where the buckets are; distances are computed for what is filed there
and for nothing else, and the tables' candidates are merged and ranked.

How many projections a cell has and how many probes a query makes is fitted to
the true neighbours, among all vectors, of a bounded sample of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_join, stored

#: Width of a cell in distances to a near neighbour.
WIDTH = 2.4
#: Tables, projections of a cell, and most probes of a table that the fit
#: chooses from.
TABLES, HASHES, MOST_PROBES = (2, 4, 8), (4, 8, 12, 16), 1024
#: Vectors of the sample on average, those of it whose neighbours are looked
#: up, and the share of these neighbours that the probes have to meet.
SAMPLE_ROWS, SAMPLE_QUERIES, AIM = 4096, 48, 0.97
#: Vectors that a part of the index holds, and groups of cells of a table by
#: their first projections, which parts are made of.
PART_ROWS, GROUPS, GROUP_HASHES = 4096, 1024, 6
#: Queries that share a part of the index before the part is copied.
PART_QUERIES = 50_000
#: Cells to either side that a projection is perturbed by.
_STEPS = np.arange(-2, 3)
_FAR = 1 << 52

_ERF = np.vectorize(erf, otypes=[float])


@dataclass(frozen=True)
class Hashing:
    """Directions and offsets of all tables; reach: distance of a near
    neighbour; probes: cells that a query visits in each table."""

    directions: np.ndarray  # tables, hashes, dimensions
    offsets: np.ndarray  # tables, hashes
    reach: float
    probes: int

    def places(self, x: np.ndarray, t: int) -> np.ndarray:
        """Projections of table ``t``, in cells."""
        with np.errstate(all="ignore"):
            at = x @ self.directions[t].T / (WIDTH * self.reach) + self.offsets[t]
        return np.clip(np.nan_to_num(at), -_FAR, _FAR)

    def _named(self, cells: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, group) of cells; equal buckets are of one group."""
        c = cells.astype(np.int64).view(np.uint64)
        odd = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(cells.shape[-1])], np.uint64)
        first = (c[..., :GROUP_HASHES] * odd[:GROUP_HASHES]).sum(axis=-1, dtype=np.uint64)
        rest = (c[..., GROUP_HASHES:] * odd[GROUP_HASHES:]).sum(axis=-1, dtype=np.uint64)
        group = ((first ^ (first >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(54)
        return (first + rest) ^ np.uint64(t), group.astype(np.int64) + t * GROUPS

    def filed(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        return self._named(np.floor(self.places(x, t)), t)

    def probed(self, q: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, group) of each query's probes, the likeliest first.

        A cell's log chance is the sum of its projections', so the best sums
        over the first projections lead to the best over one more.
        """
        at = self.places(q, t)
        home = np.floor(at)
        low = (_STEPS - (at - home)[..., None]) * (WIDTH / sqrt(2))
        cost = -np.log(np.maximum((_ERF(low + WIDTH / sqrt(2)) - _ERF(low)) / 2, 1e-15))
        best, steps = np.zeros((len(q), 1)), np.zeros((len(q), 1), np.int64)
        for h in range(at.shape[1]):
            best = (best[:, :, None] + cost[:, None, h, :]).reshape(len(q), -1)
            steps = (steps[:, :, None] * len(_STEPS) + np.arange(len(_STEPS))).reshape(len(q), -1)
            if best.shape[1] > self.probes:
                keep = np.argpartition(best, self.probes - 1, axis=1)[:, : self.probes]
                best, steps = np.take_along_axis(best, keep, 1), np.take_along_axis(steps, keep, 1)
        steps = np.take_along_axis(steps, np.argsort(best, axis=1, kind="stable"), 1)
        cells = np.empty((*steps.shape, at.shape[1]))
        for h in range(at.shape[1] - 1, -1, -1):
            cells[..., h] = home[:, h : h + 1] + _STEPS[steps % len(_STEPS)]
            steps = steps // len(_STEPS)
        return self._named(cells, t)


def _turns(probes: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """At which of a query's probes each bucket is visited; ``MOST_PROBES``: at none."""
    order = np.argsort(probes, kind="stable")
    at = order[np.minimum(np.searchsorted(probes[order], buckets), len(probes) - 1)]
    return np.where(probes[at] == buckets, at, MOST_PROBES)


def fit(sample: np.ndarray, queries: np.ndarray, near: list[np.ndarray], rows: int, k: int, seed: int = 6) -> Hashing | None:
    """The hashing that meets ``AIM`` of ``near``, the true neighbours of
    ``queries``, at the least cost; None if none does.

    The cost of a query is its probes and the distances they lead to, to as
    many of ``rows`` as of ``sample``; tables that meet a vector count it each.
    """
    rng = np.random.default_rng(seed)
    far = [float(np.sqrt(((n - q) ** 2).sum(axis=1)).max()) for q, n in zip(queries, near) if len(n)]
    reach = max(float(np.median(far)) if far else 1.0, 1e-150)
    found: tuple[float, Hashing] | None = None
    for hashes in HASHES:
        directions = rng.normal(size=(max(TABLES), hashes, sample.shape[1]))
        widest = Hashing(directions, rng.uniform(0, 1, directions.shape[:2]), reach, MOST_PROBES)
        met, seen = [], []  # by table: at which probe a neighbour, a sampled vector is met
        for t in range(max(TABLES)):
            probes, base = widest.probed(queries, t)[0], widest.filed(sample, t)[0]
            met.append(np.concatenate([_turns(p, widest.filed(n, t)[0]) for n, p in zip(near, probes) if len(n)] or [np.zeros(0, np.int64)]))
            seen.append(np.concatenate([_turns(p, base) for p in probes]))
        for tables in TABLES:
            ranks = np.min(met[:tables], axis=0)
            need = int(np.quantile(ranks, AIM, method="higher")) if len(ranks) else 0
            if need < MOST_PROBES:
                cost = tables * (need + 1) + rows * float((np.array(seen[:tables]) <= need).mean() * tables)
                if found is None or cost < found[0]:
                    found = cost, Hashing(directions[:tables], widest.offsets[:tables], reach, need + 1)
    return found[1] if found else None


def usable(vector: Column) -> Column:
    """Not null, not zero, all components there and finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


def _spread(x: np.ndarray) -> np.ndarray:
    """A number of each vector, to deal vectors by."""
    total = (x.view(np.uint64) * np.uint64(0x94D049BB133111EB)).sum(axis=1, dtype=np.uint64)
    return ((total * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


def _nearest(queries: np.ndarray, k: int):
    """Each task's ``k`` nearest of few queries, themselves left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros((0, queries.shape[1]))) for _ in queries]
        for batch in batches:
            x = _matrix(batch.column("_x"), queries.shape[1])
            for i, q in enumerate(queries):
                far = np.sqrt(((x - q) ** 2).sum(axis=1))
                pick = np.flatnonzero(far > 0)
                pick = pick[np.argsort(far[pick], kind="stable")[:k]]
                d, v = np.concatenate([best[i][0], far[pick]]), np.concatenate([best[i][1], x[pick]])
                order = np.argsort(d, kind="stable")[:k]
                best[i] = d[order], v[order]
        for i, (d, v) in enumerate(best):
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(d), pa.int32()), pa.array(d), pa.array(list(v))], ["q", "far", "_x"])

    return run


def _fitted(nodes: DataFrame, rows: int, dims: int, k: int) -> Hashing | None:
    span = 1 << 40
    bound = span if rows <= SAMPLE_ROWS else int(span * (SAMPLE_ROWS / rows))
    picked = nodes.where(F.pmod(F.xxhash64("_x"), F.lit(span)) < bound).select("_x").collect()  # SAMPLE_ROWS on average
    if not picked:
        return None
    sample = np.array([r["_x"] for r in picked], float)
    sample = sample[np.lexsort(sample.T)]
    asks = sample[np.random.default_rng(1).permutation(len(sample))[:SAMPLE_QUERIES]]
    each = nodes.select("_x").mapInArrow(_nearest(asks, k), "q int, far double, _x array<double>")
    order = Window.partitionBy("q").orderBy("far", "_x")
    best = each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).collect()  # k for each of the sample's
    near = [np.array([r["_x"] for r in best if r["q"] == i], float).reshape(-1, dims) for i in range(len(asks))]
    return fit(sample, asks, near, rows, k)


@dataclass(frozen=True)
class _Parts:
    """Where the vectors of a group are: ``salts`` parts from ``first`` on."""

    first: np.ndarray
    salts: np.ndarray

    @classmethod
    def of(cls, counts: dict[int, int]) -> _Parts:
        first, salts = np.zeros(max(TABLES) * GROUPS, np.int64), np.ones(max(TABLES) * GROUPS, np.int64)
        number, held = 0, 0
        for group in range(max(TABLES) * GROUPS):
            n = counts.get(group, 0)
            if held and held + n > PART_ROWS:
                number, held = number + 1, 0
            first[group], salts[group] = number, -(-n // PART_ROWS) or 1
            held += n
            if n > PART_ROWS:
                number, held = number + int(salts[group]), 0
        return cls(first, salts)


_ROW = "part int, asks byte, ids array<long>, x binary, keys binary"


def _entries(part: list, asks: int, ids: list, x: list, keys: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array([asks] * len(part), pa.int8()), pa.array(ids, pa.list_(pa.int64())), pa.array(x, pa.binary()), pa.array(keys, pa.binary())],
        [f.split()[0] for f in _ROW.split(", ")],
    )


def _counted(hashing: Hashing, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("_x"), dims)
            found = np.concatenate([hashing.filed(x, t)[1] for t in range(len(hashing.offsets))])
            groups, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(groups), pa.array(n.astype(np.int64))], ["g", "n"])

    return run


def _filed(hashing: Hashing, parts: _Parts, dims: int, kind: str):
    """The index: a row a vector and table, in its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 4096):
                batch = whole.slice(a, 4096)
                x = _matrix(batch.column("_x"), dims)
                ids, raw = batch.column("ids").to_pylist(), [v.tobytes() for v in x.astype(kind)]
                for t in range(len(hashing.offsets)):
                    bucket, group = hashing.filed(x, t)
                    part = parts.first[group] + _spread(x) % parts.salts[group]
                    yield _entries(part.tolist(), 0, ids, raw, [k.tobytes() for k in bucket])

    return run


def _asked(hashing: Hashing, parts: _Parts, dims: int, kind: str):
    """The probes: a row a query and part that some of its probes are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 128):
                batch = whole.slice(a, 128)
                q, names = _matrix(batch.column("_x"), dims), batch.column("_q").to_pylist()
                raw = [v.tobytes() for v in q.astype(kind)]
                rows: tuple[list, list, list, list] = ([], [], [], [])
                for t in range(len(hashing.offsets)):
                    bucket, group = hashing.probed(q, t)
                    first = parts.first[group]
                    for i, name in enumerate(names):
                        order = np.lexsort((bucket[i], first[i]))
                        own, keys = first[i][order], bucket[i][order]
                        edges = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1, len(own)]
                        for lo, hi in zip(edges[:-1], edges[1:]):
                            for salt in range(int(parts.salts[group[i][order[lo]]])):
                                for column, value in zip(rows, (int(own[lo]) + salt, [name], raw[i], keys[lo:hi].tobytes())):
                                    column.append(value)
                yield _entries(rows[0], 1, *rows[1:])

    return run


def _searched(dims: int, kind: str, k: int):
    """Meetings of a partition that is sorted by part, vectors before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting = None, ([], [], [])  # ids, vectors, buckets of the part's vectors
        x = ids = owner = bucket = np.zeros(0)
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for at, asks, names, raw, keys in zip(*[c.to_pylist() for c in batch.columns]):
                if at != part:
                    part, waiting, x = at, ([], [], []), None
                if not asks:
                    for column, value in zip(waiting, (names, raw, keys)):
                        column.append(value)
                    continue
                if not waiting[0]:
                    continue
                if x is None:
                    x = np.frombuffer(b"".join(waiting[1]), kind).astype(float).reshape(-1, dims)
                    bucket = np.frombuffer(b"".join(waiting[2]), np.uint64)
                    order = np.argsort(bucket, kind="stable")
                    x, bucket = x[order], bucket[order]
                    ids = [waiting[0][i] for i in order]
                q = np.frombuffer(raw, kind).astype(float)
                if keys is None:  # such a query visits every bucket
                    some = np.arange(len(x))
                else:
                    probes = np.frombuffer(keys, np.uint64)
                    lo, hi = np.searchsorted(bucket, probes), np.searchsorted(bucket, probes, side="right")
                    n = hi - lo
                    some = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                if not len(some):
                    continue
                far = np.sqrt(((x[some] - q) ** 2).sum(axis=1))
                # k + 1 vectors have as many ids or more, unless ids repeat
                best = _least(far, some, ids, k + 1)
                for column, values in zip(out, ([names[0]] * len(best), [i for _, i in best], [d for d, _ in best], [len(some)] + [0] * (len(best) - 1))):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.int64())],
                ["_q", "id", "score", "compared"],
            )

    return run


def _least(far: np.ndarray, some: np.ndarray, ids: list, most: int) -> list[tuple[float, int]]:
    """The ``most`` smallest (distance, id), each id once."""
    take = most
    while True:
        limit = np.partition(far, take - 1)[take - 1] if take < len(far) else np.inf
        pick = np.flatnonzero(far <= limit)
        best: dict[int, float] = {}
        for d, i in sorted((float(far[j]), i) for j in pick for i in ids[some[j]]):
            best.setdefault(i, d)
        if len(best) >= most or take >= len(far):
            return [(d, i) for i, d in list(best.items())[:most]]
        take *= 2


def _met(rows: DataFrame, dims: int, kind: str, k: int) -> DataFrame:
    """(_q, found: up to k + 1 of (score, id), compared) of index and probes."""
    dealt = rows.repartition("part").sortWithinPartitions("part", "asks")
    met = dealt.mapInArrow(_searched(dims, kind, k), "_q long, id long, score double, compared long")
    each = met.groupBy("_q", "id").agg(F.min("score").alias("score"), F.sum("compared").alias("compared"))
    total = Window.partitionBy("_q")
    ranked = each.select(
        "_q", "id", "score", F.sum("compared").over(total).alias("compared"), F.row_number().over(total.orderBy("score", "id")).alias("r")
    )
    return ranked.where(F.col("r") <= k + 1).groupBy("_q").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("found"), F.first("compared").alias("compared"))


def _copied(index: DataFrame, probes: DataFrame) -> DataFrame:
    """Index and probes in one; of a part that very many queries visit there
    are several copies, each for a share of the queries."""
    busy = probes.groupBy("part").count().where(F.col("count") > PART_QUERIES)
    copies = {r["part"]: -(-r["count"] // PART_QUERIES) for r in busy.collect()}  # fewer than there are parts
    if copies:
        many = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in copies.items() for v in pair]), F.col("part")), F.lit(1))
        step = max(copies.values())
        nth = F.explode(F.sequence(F.lit(0), (many - 1).cast("int")))
        index = index.withColumn("_nth", nth).withColumn("part", F.col("part") * step + F.col("_nth")).drop("_nth")
        probes = probes.withColumn("part", F.col("part") * step + F.pmod(F.xxhash64("ids"), many).cast("int"))
    return index.unionByName(probes)


def _of_one_length(rows: DataFrame, dims: int, kind: str, k: int) -> DataFrame:
    """Neighbours among distinct ``rows`` (_id, _x, _asks) of ``dims`` components."""
    first = Window.partitionBy("_x").orderBy("_id")
    # of equal vectors, the k + 1 smallest ids come before all others
    nodes = stored(
        rows.select("_x", "_id", F.row_number().over(first).alias("_r")).where(F.col("_r") <= k + 1).groupBy("_x").agg(F.sort_array(F.collect_list("_id")).alias("ids")),
        "nodes",
    )
    asking = rows.where("_asks")
    queries = stored(asking.groupBy("_x").agg(F.count(F.lit(1)).alias("_n")).withColumn("_q", F.monotonically_increasing_id()), "asked")
    n_nodes, n_ids = nodes.count(), rows.select("_id").distinct().count()
    hashing = _fitted(nodes, n_nodes, dims, k)
    want = min(k + 1, n_ids)
    found = None
    if hashing is not None:
        counts = nodes.select("_x").mapInArrow(_counted(hashing, dims), "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
        parts = _Parts.of({r["g"]: r["n"] for r in counts.collect()})  # GROUPS a table at most
        probes = stored(queries.select("_q", "_x").mapInArrow(_asked(hashing, parts, dims, kind), _ROW), "probes")
        found = stored(_met(_copied(nodes.mapInArrow(_filed(hashing, parts, dims, kind), _ROW), probes), dims, kind, k), "met")
        short = queries.join(found.where(F.size("found") >= want).select("_q"), "_q", "left_anti")
    else:
        short = queries
    short = stored(short.select("_q", "_x"), "short")
    if short.limit(1).count():
        # too few candidates: such queries meet all vectors, shard by shard
        shards = -(-n_nodes // PART_ROWS)
        base = nodes.mapInArrow(_sharded(shards, dims, kind), _ROW)
        asks = short.mapInArrow(_everywhere(shards, dims, kind), _ROW)
        exact = _met(_copied(base, stored(asks, "everywhere")), dims, kind, k)
        found = exact if found is None else found.where(F.size("found") >= want).unionByName(exact)
    members = hot_join(asking.select("_id", "_x"), "_x", queries.select("_x", "_q", F.col("_n")), "_x", "_n", rows.count())
    sizes = found.join(queries.select("_q", "_n"), "_q")
    answered = hot_join(members.select("_id", "_q"), "_q", sizes.select("_q", "found", "compared", "_n"), "_q", "_n", rows.count())
    others = F.slice(F.filter("found", lambda f: f["id"] != F.col("_id")), 1, k)
    each = answered.select(F.col("_id").alias("query_id"), "compared", F.posexplode(others).alias("_at", "_hit"))
    return each.select(
        "query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_hit.id").alias("vec_id"), F.col("_hit.score").alias("score"), "compared"
    )


def _sharded(shards: int, dims: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("_x"), dims)
            yield _entries((_spread(x) % shards).tolist(), 0, batch.column("ids").to_pylist(), [v.tobytes() for v in x.astype(kind)], [b"\0" * 8] * len(x))

    return run


def _everywhere(shards: int, dims: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [[n] for n in batch.column("_q").to_pylist()]
            raw = [v.tobytes() for v in _matrix(batch.column("_x"), dims).astype(kind)]
            for shard in range(shards):
                yield _entries([shard] * len(raw), 1, names, raw, [None] * len(raw))

    return run


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Each query's ``k`` nearest rows found, by Euclidean distance.

    Queries are the rows of ``is_query``; all rows but a query's own id are
    candidates.  Vectors that are null, zero, or hold a null or non-finite
    component take no part; vectors of different lengths have no distance, so
    each is searched among those of its length.  Equal distances go to the
    smaller id.  Rows that repeat an id and its vector count once; of one id's
    different vectors the nearest counts, and an id that asks with several gets
    the neighbours of its smallest.  Equal vectors are searched once, whatever
    their number.  Null ids take no part.  A query whose probes meet fewer than
    ``k`` is answered exactly.  Other columns are ignored.  An empty table gives
    an empty result.

    Returns ``query_id, rank, vec_id, score`` and ``compared``, the number of
    distances that were computed for the query's vector.
    """
    # vectors travel as they are stored; distances are of doubles always
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    x = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    fine = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("_id"), x.alias("_x"), F.coalesce(is_query, F.lit(False)).alias("_asks")
    )
    once = fine.repartition("_id").groupBy("_id", "_x").agg(F.max("_asks").alias("_asks"))
    nth = F.row_number().over(Window.partitionBy("_id").orderBy(F.size("_x"), "_x"))
    rows = stored(once.select("_id", "_x", (F.col("_asks") & (nth == 1)).alias("_asks")), "vectors")
    spark = vectors.sparkSession
    lengths = [r["n"] for r in rows.groupBy(F.size("_x").alias("n")).agg(F.max("_asks").alias("a")).where("a").collect()]
    made = None
    for dims in sorted(lengths):  # one, but for odd tables
        found = _of_one_length(rows.where(F.size("_x") == dims), dims, "<f4" if single else "<f8", k)
        made = found if made is None else made.unionByName(found)
    if made is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, compared long")
    return made
