"""Seeded splits that depend on ids and a seed only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices of the hash order; only counts are ranged over as a whole.
SLICES = 4096


def order_key(id_col: Column, seed: int) -> Column:
    """32 bits of a hash of seed and id: the shuffled order."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string"))), 1, 8), 16, 10).cast("long")


def shuffled_rank(rows: DataFrame, id_col: str, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``_rank`` from 1 in the shuffled order and ``_n`` (of each group).

    Ranks are counted slice by slice of the hash order, so that no task holds a
    whole group.
    """
    keyed = rows.withColumn("_u", order_key(F.col(id_col), seed)).withColumn("_slice", F.shiftright("_u", 20).cast("int"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    counts = keyed.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_c")).select(
        *by, "_slice", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"), F.sum("_c").over(every).alias("_n")
    )
    within = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy("_u", id_col))
    return keyed.withColumn("_r", within).join(counts, [*by, "_slice"]).withColumn("_rank", F.col("_start") + F.col("_r")).drop("_u", "_slice", "_start", "_r")


def _named(rank: Column, n: Column, head: Column, middle: Column) -> Column:
    return F.when(rank <= head, "train").when(rank <= head + middle, "dev").otherwise("test")


def split_602020(rows: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Adds ``split``: the first int(.6 n), the next int(.2 n), the rest."""
    r = shuffled_rank(rows, id_col, seed)
    head, middle = F.floor(0.6 * F.col("_n")), F.floor(0.2 * F.col("_n"))
    return r.withColumn("split", _named(F.col("_rank"), F.col("_n"), head, middle)).drop("_rank", "_n")


def split_in_place(rows: DataFrame, id_col: str, seed: int) -> DataFrame:
    """As :func:`split_602020` for ids that are unique; rows stay where they are.

    The parts end at two ids.  Counts of slices tell in which slices these are,
    and only those slices' ids are put in order.
    """
    keyed = rows.select(order_key(F.col(id_col), seed).alias("_u"), F.col(id_col).alias("_id")).withColumn("_slice", F.shiftright("_u", 20).cast("int"))
    counts = sorted(((r["_slice"], r["count"]) for r in keyed.groupBy("_slice").count().collect()), key=lambda c: (c[0] is not None, c[0]))  # SLICES at most
    n = sum(c for _, c in counts)

    def up_to(rank: int) -> Column:
        """The row is among the first ``rank``."""
        before = 0
        for at, c in counts:
            if before < rank <= before + c and at is not None:
                end = keyed.where(F.col("_slice") == at).orderBy("_u", "_id").offset(rank - before - 1).limit(1).first()
                u = order_key(F.col(id_col), seed)
                return (u < end["_u"]) | ((u == end["_u"]) & (F.col(id_col) <= F.lit(end["_id"])))
            before += c
        return F.lit(False)

    head, middle = math.floor(0.6 * n), math.floor(0.2 * n)
    return rows.where(F.col(id_col).isNotNull()).withColumn("split", F.when(up_to(head), "train").when(up_to(head + middle), "dev").otherwise("test"))


def split_stratified(rows: DataFrame, id_col: str, by: str, seed: int) -> DataFrame:
    """The same per group, with rounded sizes of one row at least."""
    r = shuffled_rank(rows, id_col, seed, (by,))
    head, middle = F.greatest(F.lit(1), F.rint(0.6 * F.col("_n"))), F.greatest(F.lit(1), F.rint(0.2 * F.col("_n")))
    return r.withColumn("split", _named(F.col("_rank"), F.col("_n"), head, middle)).drop("_rank", "_n")


def folds(rows: DataFrame, group_col: str, k: int) -> DataFrame:
    """Adds ``fold``: groups, whole, by their hash (not balanced by size)."""
    return rows.withColumn("fold", F.pmod(order_key(F.col(group_col), 0), F.lit(k)).cast("int"))


def shuffled_folds(rows: DataFrame, id_col: str, k: int, seed: int) -> DataFrame:
    """Adds ``fold``: ``k`` runs of the shuffled order whose sizes differ by one
    at most, the larger ones first; of fewer than ``k`` rows each is its own."""
    r = shuffled_rank(rows, id_col, seed)
    size, more, at = F.floor(F.col("_n") / F.lit(k)), F.col("_n") % k, F.col("_rank") - 1
    head = more * (size + 1)
    fold = F.when(at < head, F.floor(at / (size + 1))).otherwise(more + F.floor((at - head) / F.greatest(size, F.lit(1))))
    return r.withColumn("fold", fold.cast("int")).drop("_rank", "_n")
