"""Ranked-retrieval metrics of rankings (qid, view, rank, did) against
judgements (qid, did, rel)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gain(rel: Column) -> Column:
    return F.pow(F.lit(2.0), rel) - 1


def discount(rank: Column) -> Column:
    return F.log2(rank.cast("double") + 1)


def _met(rankings: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    return rankings.where(F.col("rank") <= k).join(qrels, ["qid", "did"], "left")


def _ideal(qrels: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.col("rel").desc(), "did")
    best = qrels.withColumn("_r", F.row_number().over(order))
    return best.groupBy("qid").agg(
        F.sum(F.when(F.col("_r") <= k, gain(F.col("rel")) / discount(F.col("_r")))).alias("ideal"), F.count(F.lit(1)).alias("relevant")
    )


def ndcg(rankings: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(qid, view, ndcg): graded gains; 0 for a query without judgements."""
    dcg = _met(rankings, qrels, k).groupBy("qid", "view").agg(F.coalesce(F.sum(gain(F.col("rel")) / discount(F.col("rank"))), F.lit(0.0)).alias("dcg"))
    return dcg.join(_ideal(qrels, k), "qid", "left").select(
        "qid", "view", F.round(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0), 6).alias("ndcg")
    )


def set_metrics(rankings: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(qid, view, recall, hit, mrr, f1) at ``k``; repeated items count once."""
    n = qrels.groupBy("qid").agg(F.countDistinct("did").alias("relevant"))
    found = F.count_distinct(F.when(F.col("rel") > 0, F.col("did")))
    per = _met(rankings, qrels, k).groupBy("qid", "view").agg(
        found.alias("found"), F.count(F.lit(1)).alias("shown"), F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first")
    )
    joined = per.join(n, "qid", "left").withColumn("p", F.col("found") / F.greatest(F.lit(1), F.col("shown")))
    joined = joined.withColumn("r", F.when(F.col("relevant") > 0, F.col("found") / F.col("relevant")).otherwise(0.0))
    return joined.select(
        "qid", "view", F.round("r", 6).alias("recall"), (F.col("found") > 0).cast("long").alias("hit"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(2 * F.col("p") * F.col("r") / F.greatest(F.col("p") + F.col("r"), F.lit(1e-12)), 6).alias("f1"),
    )


def mean_average_precision(rankings: DataFrame, qrels: DataFrame) -> DataFrame:
    """(view, map, recall_1, recall_5) over whole rankings."""
    upto = Window.partitionBy("qid", "view").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hit = (F.coalesce("rel", F.lit(0)) > 0).cast("int")
    seen = rankings.join(qrels, ["qid", "did"], "left").withColumn("hit", hit).withColumn("so_far", F.sum("hit").over(upto))
    per = seen.groupBy("qid", "view").agg(
        (F.sum(F.when(F.col("hit") == 1, F.col("so_far") / F.col("rank")).otherwise(0.0)) / F.greatest(F.sum("hit"), F.lit(1))).alias("ap"),
        F.max(F.when(F.col("rank") <= 1, F.col("hit")).otherwise(0)).alias("r1"),
        F.max(F.when(F.col("rank") <= 5, F.col("hit")).otherwise(0)).alias("r5"),
    )
    return per.groupBy("view").agg(F.round(F.avg("ap"), 6).alias("map"), F.round(F.avg("r1"), 6).alias("recall_1"), F.round(F.avg("r5"), 6).alias("recall_5"))


def class_report(rows: DataFrame, truth: str, predicted: str, labels: list) -> DataFrame:
    """(label, precision, recall, f1, support) for a fixed list of labels, 0
    where a division would be by 0."""
    table = rows.sparkSession.createDataFrame([(x,) for x in labels], f"label {rows.schema[truth].dataType.simpleString()}")
    t = rows.groupBy(F.col(truth).alias("label")).agg(F.count(F.lit(1)).alias("support"), F.sum((F.col(truth) == F.col(predicted)).cast("long")).alias("tp"))
    p = rows.groupBy(F.col(predicted).alias("label")).agg(F.count(F.lit(1)).alias("called"))
    whole = table.join(t, "label", "left").join(p, "label", "left").na.fill(0)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = ratio(F.col("tp"), F.col("called")), ratio(F.col("tp"), F.col("support"))
    return whole.select(
        "label", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"),
        F.round(ratio(2 * precision * recall, precision + recall), 6).alias("f1"), "support",
    )


def score_features(rankings: DataFrame) -> DataFrame:
    """(qid, view, top, margin, mean, std, span, entropy) of ranked scores."""
    top = F.max("score").over(Window.partitionBy("qid", "view"))
    weighed = rankings.withColumn("_w", F.exp(F.col("score") - top))
    total = F.sum("_w").over(Window.partitionBy("qid", "view"))
    shares = weighed.withColumn("_p", F.col("_w") / total)
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    return shares.groupBy("qid", "view").agg(
        F.round(at(1), 6).alias("top"), F.round(F.coalesce(at(1) - at(2), F.lit(0.0)), 6).alias("margin"), F.round(F.avg("score"), 6).alias("mean"),
        F.round(F.stddev_pop("score"), 6).alias("std"), F.round(F.max("score") - F.min("score"), 6).alias("span"),
        F.round(-F.sum(F.col("_p") * F.log(F.col("_p") + 1e-12)), 6).alias("entropy"),
    )


def overlap_features(rankings: DataFrame, a: str, b: str) -> DataFrame:
    """(qid, share_a, share_b, jaccard, top1_same, same_rank) of two views."""
    lists = rankings.where(F.col("view").isin(a, b)).groupBy("qid").pivot("view", [a, b]).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "did"))), lambda s: s["did"])
    ).select("qid", F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    both = F.size(F.array_intersect("x", "y"))
    same = F.size(F.filter(F.zip_with("x", "y", lambda s, t: s == t), lambda e: e))
    return lists.select(
        "qid", F.round(both / F.size("x"), 6).alias("share_a"), F.round(both / F.size("y"), 6).alias("share_b"),
        F.round(both / F.size(F.array_union("x", "y")), 6).alias("jaccard"),
        (F.get("x", F.lit(0)) == F.get("y", F.lit(0))).alias("top1_same"), F.round(same / F.least(F.size("x"), F.size("y")), 6).alias("same_rank"),
    )


def ndcg_order(order: Column, relevant: Column, k: int) -> Column:
    """Binary NDCG of an array of positions against the set of relevant ones; 0
    if there are none."""
    # gains by place; ideal: as many places as are relevant, ``k`` at most
    places = F.transform(F.slice(order, 1, k), lambda x, i: F.when(F.array_contains(relevant, x), 1.0 / F.log2(i + F.lit(2.0))).otherwise(0.0))
    best = F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.size(relevant), F.lit(k)), F.lit(1))), lambda i: 1.0 / F.log2(i + F.lit(1.0)))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(relevant) > 0, F.round(add(places) / add(best), 6)).otherwise(0.0)


def title_metrics(ranked: Column, gold: Column, k: int) -> Column:
    """struct(recall, precision, f1) of the first ``k`` distinct titles of a
    ranking against a set of gold titles; all 0 without gold."""
    shown = F.array_distinct(F.slice(F.array_distinct(ranked), 1, k))
    hits = F.size(F.array_intersect(shown, gold))
    recall = F.when(F.size(gold) > 0, hits / F.size(gold)).otherwise(0.0)
    precision = F.when(F.size(shown) > 0, hits / F.size(shown)).otherwise(0.0)
    f1 = 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))
    return F.struct(F.round(recall, 6).alias("recall"), F.round(precision, 6).alias("precision"), F.round(f1, 6).alias("f1"))
