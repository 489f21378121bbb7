"""Sharding by weighted rendezvous hashing.

Every shard draws an exponential time with its weight as rate from a hash of
the record's key and the shard's number; the earliest shard gets the record.
One more shard draws a time of its own and changes no other, so it takes
records only into itself, in proportion to its weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, with_rank

#: Hexadecimal digits of a row's hash that deal a shard's rows into chunks.
CHUNK_DIGITS = 3


def _key(id_col: Column) -> Column:
    return F.coalesce(id_col.cast("string"), F.lit("null"))


def draw(key: Column, shard: int, weight: float) -> Column:
    """The time that ``shard`` draws for ``key``."""
    digits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{shard}"))), 1, 13), 16, 10).cast("double")
    return -F.log((digits + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(weight))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """struct(time, shard) of the earliest shard; ties to the smaller number."""
    if any(w <= 0 for w in weights) or not weights:
        raise ValueError("shards need positive weights")
    drawn = [F.struct(draw(key, i, w).alias("time"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return drawn[0] if len(drawn) == 1 else F.least(*drawn)


def shard_records(
    docs: DataFrame,
    shards: int = 24,
    weights: list[float] | None = None,
    grown_weight: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Shard and gapless slot of every row, and its shard with one more.

    A row's shard depends on its id and the shards' weights alone, so the law
    is ``key``.  A null text has no bytes (size 8, checksum 0); a null id is a
    key of its own; rows that repeat an id share a shard and get slots of their
    own.  An empty table gives an empty result.

    Returns ``id_col, size, text_crc32, law, shard, slot, grown_shard``.
    """
    weights = [1.0] * shards if weights is None else list(weights)
    if len(weights) != shards:
        raise ValueError("one weight a shard is asked for")
    key = _key(F.col(id_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    placed = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        key.alias("_key"),
        rendezvous(key, weights).alias("_best"),
        draw(key, shards, grown_weight).alias("_next"),
    ).select(
        "_id",
        "size",
        "text_crc32",
        # by all of a row, as rows that repeat an id or have none share a shard
        F.substring(F.md5(F.concat_ws("/", "_key", "size", "text_crc32")), 1, CHUNK_DIGITS).alias("_chunk"),
        F.col("_best.shard").cast("int").alias("shard"),
        F.when(F.col("_next") < F.col("_best.time"), F.lit(shards)).otherwise(F.col("_best.shard")).cast("int").alias("grown_shard"),
    )
    slots = with_rank(
        stored(placed, "shards"), ["shard"], "_chunk", [F.col("_id"), F.col("size"), F.col("text_crc32")], "slot"
    )
    return slots.select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", **options) -> None:
    """``docs`` as one Parquet folder a shard, records placed by their key.

    A shard's rows are written by as many tasks as had some, so that none has
    to hold a whole shard.
    """
    weights = options.get("weights") or [1.0] * shards
    best = rendezvous(_key(F.col(id_col)), weights)
    docs.withColumn("shard", best["shard"]).write.partitionBy("shard").parquet(path)
