"""Windows over event streams, and scoring of submissions as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.contract import score


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of events as they appear; ``ts`` is the event time."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, late: str, size: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows; rows later
    than ``late`` are left out."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    grouped = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, late: str, gap: str) -> DataFrame:
    w = F.session_window("ts", gap)
    grouped = events.withWatermark("ts", late).groupBy(w.alias("w"), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def score_submissions(routes: DataFrame, reference: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Scores each batch of routes (query_id, route) against the reference and
    hands it to ``sink``; a batch that is replayed has the same number."""

    def each(batch: DataFrame, number: int) -> None:
        sink(score(batch.dropDuplicates(["query_id"]), reference), number)

    return routes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_log(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream's rows to a log of JSON lines, each once: the log's
    commits and the checkpoint tell what was written, also after a restart."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def replay(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and gives the rows it wrote."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
