"""A layered neighbour graph of vectors, and beam search in rounds of joins.

Every vector is in layer 0; one in ``fanout`` of a layer's vectors, told by a
hash of the id, is in the next one, up to a layer of a few dozen.  Layers are
linked from the top down: the members of a layer know their nearest ``pivots``
in the layer above, members that share a pivot are a shard, and each member's
links are the best of its shards' members, in both directions.  All vectors go
down together: a vector meets the shards of its pivots, and the nearest members
it finds there are its pivots for the next layer.  So a vector travels once a
pivot and layer, not once a comparison.

A search keeps a beam a query.  A round joins the beam's best unexpanded nodes
with their links, the links not seen before with their vectors, and merges the
scores into the beam.  Vectors are as near as their inner product is large.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import core as C
from .lineage import cut
from .search import DIGITS, best_of

#: Rows of a shard that are compared with each other at once; larger shards are split by hash.
SHARD_ROWS = 1024
#: Rounds of a search in the lowest layer, at most, and in the layers above.
MOST_ROUNDS, UPPER_ROUNDS = 24, 2

_BEAM = "array<struct<far:double,did:bigint,done:boolean>>"


@dataclass(frozen=True)
class Graph:
    """``nodes`` (did, layer, vector): distinct vectors and their highest
    layer.  ``links`` (layer, did, near).  ``copies`` (did, copy, place): rows
    of each distinct vector, the first ones by id."""

    nodes: DataFrame
    links: DataFrame
    copies: DataFrame
    layers: int
    #: A search's beam in the layers above the lowest.
    upper_beam: int


def _layer(id_col: Column, fanout: int, layers: int) -> Column:
    """Highest layer of an id: each layer keeps one of ``fanout`` at random."""
    u = C.hash_unit(F.concat(F.lit("layer:"), id_col.cast("string")))
    return F.least(F.floor(-F.log(1 - u) / F.log(F.lit(float(fanout)))), F.lit(layers)).cast("int")


def _spread(score: np.ndarray, row: np.ndarray, column: np.ndarray, links: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, slot): of the candidates of each row, nearest first, those
    nearer to the row than to any one chosen before, at most ``links``."""
    place = np.arange(len(row)) - np.searchsorted(row, row)
    chosen, n = np.full((len(score), links), -1), np.zeros(len(score), int)
    for at in range(int(place.max(initial=-1)) + 1):
        r, c = row[place == at], column[place == at]
        mates = chosen[r]
        nearer = (np.where(mates >= 0, score[c[:, None], mates], -np.inf) >= score[r, c][:, None]).any(axis=1)
        good = ~nearer & (n[r] < links)
        chosen[r[good], n[r[good]]] = c[good]
        n[r[good]] += 1
    r, slot = np.nonzero(chosen >= 0)
    return r, chosen[r, slot], slot


def _matrix(rows: pa.Table) -> np.ndarray:
    return rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).astype(float)


def _nearest(pivots: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(asked: pa.Table, shard: pa.Table) -> pa.Table:
        if not len(asked) or not len(shard):
            return pa.table({"did": np.zeros(0, int), "pivot": np.zeros(0, int), "score": np.zeros(0)})
        score = np.round(_matrix(asked) @ _matrix(shard).T, DIGITS)
        row, column = best_of(score, pivots)
        return pa.table({"did": asked.column("did").to_numpy()[row], "pivot": shard.column("did").to_numpy()[column], "score": score[row, column]})

    return run


def _pivots_below(nodes: DataFrame, near: DataFrame, shards: DataFrame, pivots: int) -> DataFrame:
    """(did, pivot): of the members of the ``shards`` (did, pivot) of its pivots
    in ``near`` (did, pivot), the nearest ``pivots`` of every node.

    Both sides of a shard are split by hash, so that a task compares
    ``SHARD_ROWS`` rows with as many, about.
    """
    parts = lambda rows, name: rows.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARD_ROWS)).cast("int").alias(name))
    sized = parts(near, "asks").join(parts(shards, "holds"), "pivot")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("did"), F.col(n)).cast("int")
    vectors = nodes.select("did", "vector")
    asked = near.join(sized, "pivot").select("did", "pivot", own("asks").alias("ask"), every("holds").alias("hold")).join(vectors, "did")
    held = shards.join(sized, "pivot").select("did", "pivot", every("asks").alias("ask"), own("holds").alias("hold")).join(vectors, "did")
    held, by = held.toDF(*held.columns), ["pivot", "ask", "hold"]
    found = asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(_nearest(pivots), "did long, pivot long, score double")
    best = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("far"), "pivot"))), 1, pivots)  # as many squared, and parts
    return found.groupBy("did").agg(best.alias("best")).select("did", F.explode("best.pivot").alias("pivot"))


def _linked(links: int) -> Callable[[pa.Table], pa.Table]:
    def run(shard: pa.Table) -> pa.Table:
        did = shard.column("did").to_numpy()
        order = np.argsort(did)
        x = _matrix(shard)[order]
        did, score = did[order], np.round(x @ x.T, DIGITS)
        np.fill_diagonal(score, -np.inf)
        row, column = best_of(score, 8 * links)
        near = np.arange(len(row)) - np.searchsorted(row, row) < links
        apart = _spread(score, row, column, links)
        row, column, slot = np.concatenate([row[near], apart[0]]), np.concatenate([column[near], apart[1]]), np.concatenate([np.full(near.sum(), -1), apart[2]])
        return pa.table({"did": did[row], "near": did[column], "score": score[row, column], "slot": slot})

    return run


def _linked_layer(members: DataFrame, pivots: DataFrame, links: int) -> DataFrame:
    """(did, near): links of ``members`` (did, vector) over shards (did, pivot).

    Half of them are the nearest rows, half rows in different directions, which
    lead from cluster to cluster; and what links to a row, as many, nearest
    first.
    """
    sized = pivots.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARD_ROWS)).cast("int").alias("parts"))
    dealt = pivots.join(sized, "pivot").withColumn("part", F.pmod(F.xxhash64("did"), F.col("parts")))
    found = dealt.join(members, "did").groupBy("pivot", "part").applyInArrow(_linked(links // 2), "did long, near long, score double, slot long")
    found = found.groupBy("did", "near", (F.col("slot") < 0).alias("plain")).agg(F.max("score").alias("score"), F.min("slot").alias("slot"))

    def first(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
        return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)

    out = first(found, ["did", "plain"], [F.asc("slot"), F.desc("score"), F.asc("near")], links // 2)
    back = out.select(F.col("near").alias("did"), F.col("did").alias("near"), "plain", "score")
    both = out.select("did", "near").unionByName(first(back, ["did", "plain"], [F.desc("score"), F.asc("near")], links // 2).select("did", "near"))
    return both.groupBy("did").agg(F.array_sort(F.collect_set("near")).alias("near"))


def layered_graph(
    base: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    links: int = 16,
    fanout: int = 16,
    top: int = 64,
    pivots: int = 6,
    copies: int = 16,
) -> Graph:
    """The graph of all vectors of ``base``; null and empty vectors are left out.

    Equal vectors are one node, so that a vector which many rows share makes no
    cluster of its own; ``copies`` of its rows, by id, can be found.  Shards are
    bounded: one of more than ``SHARD_ROWS`` members is split.
    """
    vector = F.col(vector_col)
    if base.schema[vector_col].dataType.simpleString() != "array<float>":  # floats stay floats: they are as exact and half as large
        vector = F.transform(vector, lambda x: x.cast("double"))
    rows = base.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).select(F.col(id_col).cast("long").alias("copy"), vector.alias("vector"))
    first = cut(rows.groupBy("vector").agg(F.min("copy").alias("did")))
    n = first.count()
    layers = 0
    while n / fanout**layers > top:
        layers += 1
    place = F.row_number().over(Window.partitionBy("did").orderBy("copy"))
    held = rows.join(first, "vector").withColumn("place", place).where(F.col("place") <= copies)
    nodes = cut(first.select("did", _layer(F.col("did"), fanout, layers).alias("layer"), "vector"))
    near, made = nodes.select("did", F.lit(0).cast("long").alias("pivot")), []  # above the top all share a pivot
    for layer in range(layers, -1, -1):
        members = nodes.where(F.col("layer") >= layer)
        shards = near.join(members.select("did"), "did", "left_semi")
        made.append(cut(_linked_layer(members.select("did", "vector"), shards, links).select(F.lit(layer).alias("layer"), "did", "near")))
        if layer:
            near = cut(_pivots_below(nodes, near, shards, pivots))
    return Graph(nodes, reduce(DataFrame.unionByName, made), cut(held.select("did", "copy", "place")), layers, max(16, 2 * pivots))


def _scored(pairs: DataFrame, asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, fresh): candidates of ``pairs`` (qid, did), nearest first."""
    met = pairs.join(nodes.select("did", "vector"), "did").join(asked.select("qid", "q"), "qid")
    entry = F.struct((-F.round(C.dot(F.col("q"), F.col("vector")), DIGITS)).alias("far"), "did", F.lit(False).alias("done"))
    return met.groupBy("qid").agg(F.array_sort(F.collect_list(entry)).alias("fresh"))  # as many as links were followed


def _round(state: DataFrame, asked: DataFrame, nodes: DataFrame, links: DataFrame, beam: int, step: int) -> DataFrame:
    """One round: the ``step`` best unexpanded nodes of each beam are expanded."""
    front = F.slice(F.filter("beam", lambda b: ~b["done"]), 1, step)
    reached = state.select("qid", F.explode(front).alias("b")).select("qid", F.col("b.did").alias("did")).join(links, "did")
    found = reached.groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("found"))
    state = state.join(found, "qid", "left").withColumn("new", F.array_except(F.coalesce("found", F.array().cast("array<bigint>")), "seen"))
    state = cut(state.withColumn("front", F.transform(front, lambda b: b["did"])).drop("found"))
    scored = _scored(state.select("qid", F.explode("new").alias("did")), asked, nodes)
    old = F.transform("beam", lambda b: F.struct(b["far"].alias("far"), b["did"].alias("did"), (b["done"] | F.array_contains("front", b["did"])).alias("done")))
    merged = F.slice(F.array_sort(F.concat(old, F.coalesce("fresh", F.array().cast(_BEAM)))), 1, beam)
    return state.join(scored, "qid", "left").select("qid", merged.alias("beam"), F.concat("seen", "new").alias("seen"), (F.col("distances") + F.size("new")).alias("distances"))


def beams(graph: Graph, asked: DataFrame, beam: int, to_layer: int = 0, step: int = 8, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(qid, beam, distances): the nearest nodes that a descent to ``to_layer``
    finds for ``asked`` (qid, q), and how many distances that took.

    The top layer, a few dozen nodes, is compared whole.  A search ends when all
    nodes of its beam are expanded, or after ``most_rounds``.
    """
    top = graph.nodes.where(F.col("layer") >= graph.layers)
    entries = asked.select("qid").join(F.broadcast(top.select("did")))  # the top layer has ``top`` nodes or so
    state = asked.select("qid").join(_scored(entries, asked, top), "qid", "left")
    keep = graph.upper_beam if to_layer < graph.layers else max(beam, graph.upper_beam)
    start = F.coalesce("fresh", F.array().cast(_BEAM))
    state = state.select("qid", F.slice(start, 1, keep).alias("beam"), F.transform(start, lambda b: b["did"]).alias("seen"), F.size(start).alias("distances"))
    for layer in range(graph.layers - 1, to_layer - 1, -1):
        links = graph.links if graph.links is None else graph.links.where(F.col("layer") == layer).select("did", "near")
        lowest = layer == to_layer
        # a node of the layer above has other links here
        state = cut(state.withColumn("beam", F.transform("beam", lambda b: F.struct(b["far"].alias("far"), b["did"].alias("did"), F.lit(False).alias("done")))))
        for i in range(most_rounds if lowest else UPPER_ROUNDS):
            if lowest and i and not state.where(F.exists("beam", lambda b: ~b["done"])).limit(1).count():
                break
            state = cut(_round(state, asked, graph.nodes, links, beam if lowest else graph.upper_beam, step if lowest else graph.upper_beam))
    return state.select("qid", "beam", "distances")


def graph_search(graph: Graph, queries: DataFrame, k: int, beam: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(qid, rank, did, score, distances): the nearest ``k`` rows found for each
    query, with a beam of ``beam`` nodes.

    A row doesn't find itself; ties go to the smaller id.  Rows of equal vectors
    follow their node, as many as the graph keeps.  Queries without a vector
    find nothing.
    """
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    asked = cut(queries.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).select(F.col(id_col).cast("long").alias("qid"), vector.alias("q")))
    found = beams(graph, asked, max(beam, k + 1)).select("qid", "distances", F.explode("beam").alias("b"))
    rows = found.select("qid", "distances", (-F.col("b.far")).alias("score"), F.col("b.did").alias("did")).join(graph.copies, "did").where(F.col("qid") != F.col("copy"))
    by = Window.partitionBy("qid").orderBy(F.desc("score"), "copy")
    return rows.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k).select("qid", "rank", F.col("copy").alias("did"), "score", "distances")
