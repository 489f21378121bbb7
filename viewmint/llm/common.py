"""What the operators share: the contract's text rules, tables on shared
storage, and ranks within groups that no single task has to hold."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space and words, as Java and Python patterns.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark from wherever it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only where it is unset and the session is local (a test) a temporary folder
    is made and set; executors of a cluster wouldn't see it, so there it is an
    error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="viewmint-")
        spark.sparkContext.setCheckpointDir(where)
    return where


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of so many rows for Python workers, in what is run inside: texts
    are held twice, by the executor and by its worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the
    application ends."""
    path = f"{shared_dir(spark)}/viewmint/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    This cuts the lineage: what follows reads files that outlive any executor.
    The files go when the application ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of ids up to which a list of them is broadcast, after it was counted
#: (16 MB or so); a longer one is joined by a shuffle.
BROADCAST_ROWS = 1 << 20


def sized(ids: DataFrame, name: str) -> DataFrame:
    """A stored list of ids, marked for broadcast if it is short enough."""
    kept = stored(ids, name)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def row_key(id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart, also where ids repeat or are null: the id and a
    hash of the text."""
    return [F.col(id_col).alias("_key_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_key_text")]


def without(rows: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``rows`` whose :func:`row_key` isn't in ``gone`` (``_key_id, _key_text``)."""
    names = sized(gone.distinct(), "gone")
    text = F.xxhash64(F.coalesce(rows[text_col], F.lit("")))
    return rows.join(names, rows[id_col].eqNullSafe(names["_key_id"]) & (text == names["_key_text"]), "left_anti")


#: Keys that a hot join broadcasts at most, and the fewest rows of a hot key.
HOT_KEYS, HOT_ROWS = 2048, 512


def hot_join(many: DataFrame, key: str, one: DataFrame, one_key: str, weight: str, rows: int) -> DataFrame:
    """``many`` with the row of ``one`` that has its key, null where none has.

    ``one`` has a row a key and, in ``weight``, how many of the ``rows`` rows of
    ``many`` have it.  Keys of more than a 2048th of all rows are at most 2048,
    so theirs are broadcast and no task gets all rows of a hot key; the others
    meet by a shuffle, in which rows of hot keys are dealt at random.
    """
    values = [c for c in one.columns if c not in (one_key, weight)]
    limit = max(HOT_ROWS, rows // HOT_KEYS)
    packed = one.select(F.col(one_key).alias("_k"), F.struct(*values).alias("_v"), F.col(weight).alias("_w"))
    hot = F.broadcast(packed.where(F.col("_w") > limit).select(F.col("_k").alias("_hot_k"), F.col("_v").alias("_hot")))
    cold = packed.where(F.col("_w") <= limit).select(F.col("_k").alias("_cold_k"), F.lit(0).alias("_cold_s"), F.col("_v").alias("_cold"))
    columns = many.columns
    met = many.join(hot, many[key].eqNullSafe(hot["_hot_k"]), "left")
    salt = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(1 << 20)).cast("int"))
    met = met.withColumn("_salt", salt)
    met = met.join(cold, met[key].eqNullSafe(cold["_cold_k"]) & (met["_salt"] == cold["_cold_s"]), "left")
    found = F.coalesce("_hot", "_cold")
    return met.select(*[F.col(c) for c in columns], *[found[v].alias(v) for v in values])


def with_rank(df: DataFrame, group: list[str], chunk: str, order: list[Column], name: str) -> DataFrame:
    """Gapless ranks from 0 within ``group``, by ``chunk`` and then ``order``.

    A group may hold any share of the rows: its rows are ranked chunk by chunk
    and each chunk starts where the chunks before it end.  Only the counts per
    group and chunk are ranged over as a whole.  ``df`` is read twice, so it
    should be a stored table.
    """
    keys = [*group, chunk]
    before = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    within = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_at", F.row_number().over(within) - 1)
    return ranked.join(starts, keys).withColumn(name, (F.col("_start") + F.col("_at")).cast("long")).drop("_start", "_at")
