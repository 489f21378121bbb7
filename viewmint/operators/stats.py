"""Resampling, calibration and rank statistics."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import mix32


#: Chances of at most 0, 1, 2 and so on of a Poisson variable of
#: mean 1, in 65536ths, rounded.
POISSON = (24109, 48219, 60273, 64292, 65296, 65497, 65531, 65535)


def bootstrap_ci(values: DataFrame, value: str, reps: int, seed: int = 11, index: str = "i") -> DataFrame:
    """(mean, lo, hi, positive, reps): percentile interval of resampled means,
    and the share of them above 0.

    Rows are drawn by Poisson weights that a hash of seed, draw and ``index`` (a
    whole number) gives, so that every row draws for itself: one pass, in which
    only a sum and a weight a draw leave a task.  For paired differences
    ``value`` is the difference.
    """
    own = mix32(F.col(index).cast("long").bitwiseXOR(F.lit(seed).cast("long") * 1000003))
    drawn = values.select(F.col(value).alias("_v"), own.alias("_h")).select("_v", "_h", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    hashed = drawn.select("_v", "rep", mix32(F.col("_h") + F.col("rep") * F.lit(40503).cast("long")).bitwiseAND(F.lit(65535)).alias("_u")).where(F.col("_u") >= POISSON[0])
    weight = sum((F.when(F.col("_u") >= c, 1).otherwise(0) for c in POISSON), F.lit(0))
    sums = hashed.select("rep", "_v", weight.alias("_w")).groupBy("rep").agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("m"))
    ends = sums.agg(
        F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.avg((F.col("m") > 0).cast("double")).alias("p"), F.count(F.lit(1)).alias("reps")
    )
    return values.agg(F.round(F.avg(value), 6).alias("mean")).crossJoin(ends).select("mean", F.round(F.col("q")[0], 6).alias("lo"), F.round(F.col("q")[1], 6).alias("hi"), F.round("p", 6).alias("positive"), "reps")


def fold_ci(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, sample deviation and 95 % half width (t for 5 folds, else normal)."""
    n = F.count(value)
    t = F.when(n == 5, 2.776).otherwise(1.96)
    return rows.groupBy(group).agg(
        n.alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("sd"),
        F.round(t * F.stddev_samp(value) / F.sqrt(n.cast("double")), 6).alias("half"),
    )


def calibration_bins(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, mean_y): equal widths, the last bin closed."""
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))


def ece(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    b = calibration_bins(rows, p, y, bins)
    return b.agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n"), 6).alias("ece"))


#: Ranges of values that running totals are counted over.
RANGES = 256


def running(rows: DataFrame, key: str, sums: list[str], descending: bool = False) -> DataFrame:
    """Adds ``<c>_before`` for each column of ``sums``: its total over the rows
    before this one in the order of a numeric ``key`` without ties.

    Rows are cut into ranges of about equal size; only the totals of ranges are
    ranged over as a whole, so that no task holds all rows.
    """
    edges = rows.approxQuantile(key, [i / RANGES for i in range(1, RANGES)], 1 / (4 * RANGES))
    at = F.size(F.filter(F.array(*[F.lit(float(e)) for e in sorted(set(edges))]), lambda e: e <= F.col(key))) if edges else F.lit(0)
    order = (lambda c: F.col(c).desc()) if descending else F.col
    cut = rows.withColumn("_range", at)
    ahead = Window.orderBy(order("_range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("_range").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums)])
    starts = totals.select("_range", *[F.coalesce(F.sum(f"_t{i}").over(ahead), F.lit(0)).alias(f"_s{i}") for i in range(len(sums))])
    within = Window.partitionBy("_range").orderBy(order(key)).rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_i{i}") for i, c in enumerate(sums)])
    joined = inside.join(starts, "_range")
    return joined.select(*[F.col(c) for c in rows.columns], *[(F.col(f"_s{i}") + F.col(f"_i{i}")).alias(f"{c}_before") for i, c in enumerate(sums)])


def quantiles_of(rows: DataFrame, columns: list[str], at: list[float]) -> dict[str, list[float]]:
    """Exact quantiles of numeric columns, interpolated between neighbours;
    nulls are passed over, and a column without values has none.

    Values are counted by range; only the ranges that a quantile falls into are
    looked at value by value, and only its neighbours come to the driver.
    """
    held = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).persist()  # read three times, and let go below
    try:
        return _quantiles_of(held, columns, at)
    finally:
        held.unpersist()


def _quantiles_of(rows: DataFrame, columns: list[str], at: list[float]) -> dict[str, list[float]]:
    cut = [sorted(set(e)) for e in rows.approxQuantile(columns, [i / RANGES for i in range(1, RANGES)], 1 / (4 * RANGES))]
    range_of = lambda c, edges: F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col(c))) if edges else F.lit(0)
    cells = [F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v"), range_of(c, cut[i]).alias("r")) for i, c in enumerate(columns)]
    long = rows.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("v is not null")
    counts = sorted((r["c"], r["r"], r["n"]) for r in long.groupBy("c", "r").agg(F.count(F.lit(1)).alias("n")).collect())  # columns x RANGES at most
    places, before, wanted = {}, {}, {}
    for i in range(len(columns)):
        total = sum(n for c, _, n in counts if c == i)
        places[i] = [a * (total - 1) for a in at] if total else []
        need = {int(x) for p in places[i] for x in (math.floor(p), math.ceil(p))}
        start = 0
        for c, r, n in counts:
            if c == i:
                for w in need:
                    if start <= w < start + n:
                        wanted.setdefault((i, r), []).append(w)
                before[i, r], start = start, start + n
    if not wanted:
        return {c: [] for c in columns}
    some = long.where(reduce(lambda a, b: a | b, [(F.col("c") == c) & (F.col("r") == r) for c, r in wanted]))
    seen = F.sum("n").over(Window.partitionBy("c", "r").orderBy("v"))
    runs = some.groupBy("c", "r", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", seen)
    hit = reduce(lambda a, b: a | b, [(F.col("c") == c) & (F.col("r") == r) & (F.col("upto") > w - before[c, r]) & (F.col("upto") - F.col("n") <= w - before[c, r]) for (c, r), ws in wanted.items() for w in ws])
    value = {}
    for row in runs.where(hit).collect():  # two a quantile and column at most
        for w in wanted[row["c"], row["r"]]:
            if row["upto"] - row["n"] <= w - before[row["c"], row["r"]] < row["upto"]:
                value[row["c"], w] = row["v"]
    low = lambda i, p: value[i, math.floor(p)]
    return {c: [low(i, p) + (value[i, math.ceil(p)] - low(i, p)) * (p - math.floor(p)) for p in places[i]] for i, c in enumerate(columns)}


def quantiles(rows: DataFrame, column: str, at: list[float]) -> list[float]:
    return quantiles_of(rows, [column], at)[column]


def top_rows(rows: DataFrame, value: str, key: str, share: float) -> DataFrame:
    """Adds ``place``, from 1, in the order of ``value`` (highest first) and
    ``key``, and keeps the first ``share`` of all rows."""
    n = rows.count()
    counts = rows.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    before = running(counts, "_v", ["_n"], descending=True).select("_v", "_n_before")
    within = F.row_number().over(Window.partitionBy(value).orderBy(key))
    placed = rows.withColumn("_w", within).join(before, F.col(value) == F.col("_v")).withColumn("place", F.col("_n_before") + F.col("_w"))
    return placed.where(F.col("place") <= math.floor(share * n)).drop("_v", "_w", "_n_before")


def with_average_rank(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the 1-based rank of a numeric value, ties averaged.  Equal values
    are counted once, however many they are."""
    counts = rows.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranks = running(counts, "_v", ["_n"]).select("_v", (F.col("_n_before") + (F.col("_n") + 1) / 2).alias(name))
    return rows.join(ranks, F.col(value) == F.col("_v")).drop("_v")


def auc(rows: DataFrame, p: str, y: str) -> DataFrame:
    """Mann-Whitney; null if a class is missing.  Counts go by distinct score,
    so ties, however many, are one row."""
    per = rows.groupBy(p).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))
    both = F.sum("pos").cast("double") * F.sum("neg")
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    return running(per, p, ["neg"]).agg(F.when(both > 0, F.round(wins / both, 6)).alias("auc"))


def average_precision(rows: DataFrame, p: str, y: str) -> DataFrame:
    per = rows.groupBy(p).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    seen = running(per, p, ["pos", "n"], descending=True)
    at = (F.col("pos_before") + F.col("pos")) / (F.col("n_before") + F.col("n"))
    return seen.agg(F.round(F.sum(F.col("pos") * at) / F.sum("pos"), 6).alias("auprc"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    ranked = with_average_rank(with_average_rank(rows.select(a, b), a, "ra"), b, "rb")
    return ranked.agg(F.round(F.corr("ra", "rb"), 6).alias("spearman"))


def kendall(rows: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """(C - D) / (C + D) over pairs, ties skipped; for tables of summaries."""
    x, y = rows.alias("x"), rows.alias("y")
    sign = F.signum(F.col(f"x.{a}") - F.col(f"y.{a}")) * F.signum(F.col(f"x.{b}") - F.col(f"y.{b}"))
    pairs = x.join(y, F.col(f"x.{key}") < F.col(f"y.{key}")).select(sign.alias("s"))
    return pairs.agg(F.round(F.sum("s") / F.sum(F.abs("s")), 6).alias("kendall"))
