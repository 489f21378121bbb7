"""Tasks of the evaluation, by name: what each takes and what it is scored by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import geometry as G
from . import metrics as M


def recovery(made: DataFrame, target: DataFrame) -> DataFrame:
    """(cell, chamfer, iou, coverage) of points (cell, idx, x, y)."""
    return G.chamfer(made, target).join(G.raster_overlap(made, target).select("cell", "iou"), "cell").join(G.coverage(made, target), "cell")


def diagnosis(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(n, accuracy, balanced_accuracy) of labels (id, label); an id without a
    prediction is wrong."""
    met = truth.join(predicted.select("id", F.col("label").alias("_p")), "id", "left").withColumn("hit", F.coalesce(F.col("label") == F.col("_p"), F.lit(False)).cast("double"))
    per = met.groupBy("label").agg(F.avg("hit").alias("r"), F.sum("hit").alias("h"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("n"), F.round(F.sum("h") / F.sum("n"), 6).alias("accuracy"), F.round(F.avg("r"), 6).alias("balanced_accuracy"))


def interpretation(chosen: DataFrame, truth: DataFrame) -> DataFrame:
    """(n, agreement) of chosen views (id, view) with the best ones."""
    met = truth.join(chosen.select("id", F.col("view").alias("_c")), "id", "left")
    return met.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(F.col("view") == F.col("_c"), F.lit(False)).cast("double")), 6).alias("agreement"))


def retrieval(ranked: DataFrame, judged: DataFrame) -> DataFrame:
    """(qid, view, ndcg) of rankings against judgements."""
    return M.ndcg(ranked, judged, 10)


TASKS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"recovery": recovery, "diagnosis": diagnosis, "interpretation": interpretation, "retrieval": retrieval}


def evaluate(task: str, made: DataFrame, truth: DataFrame) -> DataFrame:
    """What a task's submission scores; a ``KeyError`` for tasks there aren't."""
    return TASKS[task](made, truth)
