"""Control titles: seeded draws without replacement among the nearest degrees."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import md5
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .lineage import cut


def nearest_pools(index: DataFrame, degrees: DataFrame, size: int) -> DataFrame:
    """(wanted, pool): for each of ``degrees`` (wanted) the ``size`` titles of
    ``index`` (title, degree) with the nearest degrees, ties by title.

    Degrees are put in order once; a wanted degree looks at those around it, as
    far as ``size`` titles reach, and of each at its first ``size`` titles.  The
    windows without partitions run over distinct degrees only.
    """
    first = Window.partitionBy("degree").orderBy("title")
    titled = index.select("title", "degree").withColumn("place", F.row_number().over(first)).where(F.col("place") <= size).select("title", "degree")
    held = index.groupBy("degree").agg(F.count(F.lit(1)).alias("n")).unionByName(degrees.select(F.col("wanted").alias("degree"), F.lit(0).cast("long").alias("n")))
    order = held.groupBy("degree").agg(F.sum("n").alias("n")).withColumn("at", F.row_number().over(Window.orderBy("degree")))
    order = cut(order)
    # every degree around has a title, but for those that are only wanted
    around = degrees.join(order.select(F.col("degree").alias("wanted"), "at"), "wanted").withColumn("at", F.explode(F.sequence(F.col("at") - 2 * size, F.col("at") + 2 * size)))
    apart = F.abs(F.col("degree") - F.col("wanted"))
    nearer = Window.partitionBy("wanted").orderBy("apart").rangeBetween(Window.unboundedPreceding, -1)
    near = around.join(order.where("n > 0"), "at").withColumn("apart", apart).withColumn("before", F.coalesce(F.sum("n").over(nearer), F.lit(0))).where(F.col("before") < size)
    by = Window.partitionBy("wanted").orderBy("apart", "title")
    ranked = near.select("wanted", "degree", "apart").join(titled, "degree").withColumn("place", F.row_number().over(by)).where(F.col("place") <= size)
    listed = ranked.groupBy("wanted").agg(F.array_sort(F.collect_list(F.struct("place", "title"))).alias("p"))  # ``size`` at most
    return listed.select("wanted", F.transform("p", lambda s: s["title"]).alias("pool"))


def degree_matched(asked: DataFrame, index: DataFrame, seed: int, nearest: int = 64) -> DataFrame:
    """(qid, draw, title): for every source title of a query one title of a near
    degree, none twice and none that is excluded.

    ``asked`` has (qid, sources, excluded), arrays of titles; ``index`` has
    (title, degree).  The draws of a query follow its sources in order: each
    takes one of the ``nearest`` unused titles by degree, ties by title, chosen
    by a hash of the seed, the query and the draw.  A source that isn't in the
    index has degree 0, and a query without sources draws once at degree 0.
    Draws that find the index used up are left out.  Null arrays are empty.

    Draws and exclusions are at most as many as the longest ``sources`` and
    ``excluded``, so the ``nearest`` unused titles are among that many more of
    the nearest ones: a pool a distinct degree is enough.  The pools go to the
    queries, not with each of their sources.
    """
    none = F.slice("sources", 1, 0)
    asked = asked.select("qid", F.coalesce("sources", F.array().cast(asked.schema["sources"].dataType)).alias("sources"), F.coalesce("excluded", none, F.array().cast(asked.schema["excluded"].dataType)).alias("excluded"))
    most = asked.agg(F.coalesce(F.max(F.size("sources")), F.lit(0)), F.coalesce(F.max(F.size("excluded")), F.lit(0))).first()
    size = nearest + max(1, most[0]) + most[1]
    drawn = asked.select("qid", F.posexplode_outer("sources").alias("i", "source"))
    drawn = drawn.join(index.select(F.col("title").alias("source"), "degree"), "source", "left").select("qid", F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("degree", F.lit(0)).cast("long").alias("wanted"))
    drawn = cut(drawn)
    # a row a distinct degree, so at most the root of twice the sum of degrees
    pools = {r["wanted"]: r["pool"] for r in nearest_pools(index, drawn.select("wanted").distinct(), size).collect()}
    steps = drawn.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("i", "wanted"))).alias("s"))
    name = F.concat_ws(":", F.lit(str(seed)), F.col("qid").cast("string")).alias("name")
    met = asked.select("qid", "excluded").join(steps, "qid").select("qid", name, "excluded", F.col("s.i").alias("i"), F.col("s.wanted").alias("wanted"))
    kind = to_arrow_type(index.schema["title"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in range(1, 5)])
            chosen = [_drawn(name, excluded, zip(i, wanted), pools, nearest) for name, excluded, i, wanted in rows]
            of = np.repeat(np.arange(len(chosen)), [len(c) for c in chosen])
            draw = np.concatenate([np.arange(len(c), dtype=np.int32) for c in chosen]) if chosen else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(draw), pa.array([t for c in chosen for t in c], kind)], ["qid", "draw", "title"])

    fields = f"qid {asked.schema['qid'].dataType.simpleString()}, draw int, title {index.schema['title'].dataType.simpleString()}"
    return met.mapInArrow(run, fields)


def _drawn(name: str, excluded: list, steps: Iterable[tuple[int, int]], pools: dict[int, list], nearest: int) -> list:
    """The titles of a query's draws, in order; a null is neither drawn nor
    known to be unused, so a query that excludes one draws nothing."""
    used, chosen = set(excluded), []
    for i, wanted in steps:
        unused = list(islice((t for t in pools.get(wanted, ()) if t is not None and t not in used), nearest))
        if unused and None not in used:
            chosen.append(unused[int(md5(f"{name}:{i}".encode()).hexdigest()[:8], 16) % len(unused)])
            used.add(chosen[-1])
    return chosen
