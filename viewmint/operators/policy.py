"""Utility, oracle, regret and policies over the long table of views.

The table has a row for each query and view: ``query_id, view, ord, quality,
cost`` and whatever else; ``utility`` is added by :func:`with_utility`.  A
route is a table (query_id, policy, view).  Ties go to the smaller ``ord``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..menus import LAMBDA
from .lineage import cut


def with_utility(views: DataFrame, lam: float | Column = LAMBDA) -> DataFrame:
    lam = F.lit(float(lam)) if not isinstance(lam, Column) else lam
    return views.withColumn("utility", F.round(F.col("quality") - lam * F.col("cost"), 9))


def best_by(value: str, *carried: str) -> Column:
    """struct of the row of the highest value, first in menu order on ties."""
    return F.max_by(F.struct("view", "ord", *carried), F.struct(F.col(value), -F.col("ord")))


def oracle(views: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Each query's view of the highest utility."""
    best = views.groupBy(*keys).agg(best_by("utility", "quality", "cost", "utility").alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(f"oracle_{c}") for c in ("view", "quality", "cost", "utility")])


def fixed_routes(views: DataFrame) -> DataFrame:
    """Every view as a policy of its own, for every query that has it."""
    return views.select("query_id", F.concat(F.lit("fixed_"), F.col("view")).alias("policy"), "view")


def _mean(value: Column) -> Column:
    """The mean to six digits, from a sum of decimals: a mean that lies midway
    between two results is rounded up in whatever order rows are added."""
    return F.round(F.sum(value.cast("decimal(26,12)")).cast("double") / F.count(value), 6)


def evaluate(routes: DataFrame, views: DataFrame, costly: str = "ce") -> DataFrame:
    """One row a policy: means of what its views give, regret and buy share."""
    best = views.groupBy("query_id").agg(F.max("utility").alias("best_utility"))
    return _means(routes.join(views.drop("policy"), ["query_id", "view"]).join(best, "query_id"), costly)


def evaluate_offered(routes: DataFrame, offered: DataFrame, costly: str = "ce") -> DataFrame:
    """As :func:`evaluate`, where ``offered`` has a row a query: ``query_id``,
    ``best_utility`` and ``offers``, an array of (view, quality, cost, utility)
    of all views that routes may name; those without a utility aren't offered."""
    return evaluate_beside(routes.join(offered.select("query_id", "best_utility", "offers"), "query_id"), costly)


def evaluate_beside(routes: DataFrame, costly: str = "ce") -> DataFrame:
    """As :func:`evaluate_offered`, where ``best_utility`` and ``offers`` stand
    beside each route, so that nothing is joined.

    The chosen offer is unfolded, not filtered for: a filter would be pushed
    below the route and make a learner's prediction twice.
    """
    chosen = F.slice(F.filter("offers", lambda o: (o["view"] == F.col("view")) & o["utility"].isNotNull()), 1, 1)
    return _means(routes.select("policy", "best_utility", F.inline(chosen)), costly)


def _means(met: DataFrame, costly: str) -> DataFrame:
    regret = F.greatest(F.lit(0.0), F.col("best_utility") - F.col("utility"))
    return met.groupBy("policy").agg(
        F.count(F.lit(1)).alias("queries"),
        _mean(F.col("utility")).alias("mean_utility"),
        _mean(F.col("quality")).alias("mean_quality"),
        _mean(F.col("cost")).alias("mean_cost"),
        _mean(regret).alias("mean_regret"),
        F.round(F.avg((F.col("view") == costly).cast("double")), 6).alias("buy_share"),
    )


def view_shares(routes: DataFrame) -> DataFrame:
    """Share of the queries that a policy sends to each view."""
    n = F.sum("n").over(Window.partitionBy("policy"))
    return routes.groupBy("policy", "view").agg(F.count(F.lit(1)).alias("n")).select("policy", "view", "n", F.round(F.col("n") / n, 6).alias("share"))


def gap_closed(summary: DataFrame, oracle_utility: float | Column, floor: float = 1e-9) -> DataFrame:
    """How far each policy comes from the best fixed one to the oracle."""
    every = Window.partitionBy()
    best = F.max(F.when(F.col("policy").startswith("fixed_"), F.col("mean_utility"))).over(every)
    top = oracle_utility if isinstance(oracle_utility, Column) else F.lit(oracle_utility)
    return summary.withColumn("gap_closed", F.round((F.col("mean_utility") - best) / F.greatest(top - best, F.lit(floor)), 6))


def lambda_star(means: DataFrame) -> DataFrame:
    """Price at which a view and the next one on the menu break even."""
    nxt = Window.orderBy("ord")
    d_quality = F.lead("quality").over(nxt) - F.col("quality")
    d_cost = F.lead("cost").over(nxt) - F.col("cost")
    steps = means.select("view", "ord", F.lead("view").over(nxt).alias("next_view"), d_quality.alias("dq"), d_cost.alias("dc"))
    ratio = F.when(F.abs("dc") > 1e-12, F.round(F.col("dq") / F.col("dc"), 6))
    return steps.where("next_view is not null").select("view", "next_view", ratio.alias("lambda_star"))


def lambda_sweep(views: DataFrame, grid: list[float]) -> DataFrame:
    """Best fixed view and oracle at each price of a grid."""
    priced = with_utility(views.withColumn("lam", F.explode(F.array(*[F.lit(float(g)) for g in grid]))), F.col("lam"))
    fixed = priced.groupBy("lam", "view", "ord").agg(F.round(F.avg("utility"), 9).alias("utility"))
    best = fixed.groupBy("lam").agg(best_by("utility", "utility").alias("b"))
    top = priced.groupBy("lam", "query_id").agg(F.max("utility").alias("u")).groupBy("lam").agg(F.avg("u").alias("u"))
    return best.join(top, "lam").select(
        "lam", F.col("b.view").alias("best_fixed"), F.round("b.utility", 6).alias("best_fixed_utility"), F.round("u", 6).alias("oracle_utility")
    )


def oracle_shares(views: DataFrame, by: str) -> DataFrame:
    """Share of queries that each view is best for, in all and in each group."""
    best = views.groupBy("query_id", by).agg(best_by("utility").alias("b")).select(by, F.col("b.view").alias("view"))
    n = Window.partitionBy(by)
    sets = best.rollup(by, "view").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    per = sets.where("g = 0").select(by, "view", "n")
    whole = best.groupBy("view").agg(F.count(F.lit(1)).alias("n")).select(F.lit("all").alias(by), "view", "n")
    return per.unionByName(whole).select(by, "view", "n", F.round(F.col("n") / F.sum("n").over(n), 6).alias("share"))


def tie_breakdown(views: DataFrame, a: str, b: str, eps: float = 1e-8) -> DataFrame:
    """Shares of queries where ``b`` is strictly better, tied or worse than ``a``."""
    wide = views.where(F.col("view").isin(a, b)).groupBy("query_id").pivot("view", [a, b]).agg(F.max("quality"))
    d = F.col(b) - F.col(a)
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return wide.where(d.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), share(d > eps).alias("better"), share(F.abs(d) <= eps).alias("tie"), share(d < -eps).alias("worse")
    )


def weighted_means(rows: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    return rows.groupBy(group).agg(F.round(F.sum(F.col(value) * F.col(weight)) / F.sum(weight), 6).alias(f"weighted_{value}"))


def restricted_menus(views: DataFrame, menus: dict[str, list[str]]) -> DataFrame:
    """Best fixed view and oracle within parts of the menu."""
    def one(name: str, kept: list[str]) -> DataFrame:
        part = views.where(F.col("view").isin(*kept))
        fixed = part.groupBy("view", "ord").agg(F.round(F.avg("utility"), 9).alias("utility"))
        best = fixed.agg(best_by("utility", "utility").alias("b"))
        top = part.groupBy("query_id").agg(F.max("utility").alias("u")).agg(F.avg("u").alias("u"))
        return best.crossJoin(top).select(
            F.lit(name).alias("menu"), F.col("b.view").alias("best_fixed"), F.round("b.utility", 6).alias("best_fixed_utility"), F.round("u", 6).alias("oracle_utility")
        )

    return reduce(DataFrame.unionByName, [one(n, k) for n, k in menus.items()])


def pareto(points: DataFrame, eps: float = 1e-12) -> DataFrame:
    """(view, cost, benefit) -> is each dominated, and by which, in name order."""
    a, b = points.alias("a"), points.alias("b")
    at_least = (F.col("b.cost") <= F.col("a.cost") + eps) & (F.col("b.benefit") >= F.col("a.benefit") - eps)
    strictly = (F.col("b.cost") < F.col("a.cost") - eps) | (F.col("b.benefit") > F.col("a.benefit") + eps)
    met = a.join(b, (F.col("a.view") != F.col("b.view")) & at_least & strictly, "left")
    out = met.groupBy(F.col("a.view").alias("view"), F.col("a.cost").alias("cost"), F.col("a.benefit").alias("benefit")).agg(
        F.array_join(F.array_sort(F.collect_list("b.view")), ";").alias("dominated_by")
    )
    return out.withColumn("dominated", F.col("dominated_by") != "")


def winner_grid(means: DataFrame, lambdas: DataFrame, multipliers: DataFrame) -> DataFrame:
    """Which view wins at each price and multiple of all costs; shares."""
    grid = means.crossJoin(lambdas).crossJoin(multipliers)
    grid = grid.withColumn("utility", F.round(F.col("quality") - F.col("lam") * F.col("mult") * F.col("cost"), 9))
    won = grid.groupBy("lam", "mult").agg(best_by("utility").alias("b"))
    n = F.sum("n").over(Window.partitionBy())
    return won.groupBy(F.col("b.view").alias("view")).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.round(F.col("n") / n, 6))


def decision_curve(rows: DataFrame, thresholds: list[float], price: float) -> DataFrame:
    """Buying the costly view when ``score`` passes a threshold.

    ``rows``: score, gain (quality gained by buying); buying costs ``price``.
    """
    grid = rows.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    buy, worth = F.col("score") > F.col("threshold"), F.col("gain") > price
    num = lambda c: c.cast("double")
    out = grid.groupBy("threshold").agg(
        F.round(F.avg(num(buy)), 6).alias("buy_rate"),
        F.round(F.avg(F.when(buy, F.col("gain") - price).otherwise(0.0)), 6).alias("net_gain"),
        F.round(F.avg(F.greatest(F.lit(0.0), F.col("gain") - price) - F.when(buy, F.col("gain") - price).otherwise(0.0)), 6).alias("regret"),
        F.sum(num(buy & worth)).alias("hit"),
        F.sum(num(buy)).alias("bought"),
        F.sum(num(worth)).alias("worth"),
    )
    return out.select(
        "threshold", "buy_rate", "net_gain", "regret",
        F.round(F.col("hit") / F.greatest(F.lit(1.0), "bought"), 6).alias("precision"),
        F.round(F.col("hit") / F.greatest(F.lit(1.0), "worth"), 6).alias("recall"),
        F.round((F.col("bought") - F.col("hit")) / F.greatest(F.lit(1.0), "bought"), 6).alias("false_buy"),
    )


def split_sums(views: DataFrame, groups: tuple[str, ...], seeds: int, parts: int = 5) -> DataFrame:
    """(seed, held, *groups, view, ord, u, n): sums of utility of ``seeds``
    reseeded splits, one part in ``parts`` held out by a hash of seed and query.

    A query is hashed once a seed, whatever its views.  The sums, a few for each
    seed, are kept, so that what reads them several times doesn't split again.
    """
    h = lambda s: F.conv(F.substring(F.md5(F.concat_ws(":", s.cast("string"), F.col("query_id").cast("string"))), 1, 8), 16, 10).cast("long")
    of = views.groupBy("query_id", *groups).agg(F.collect_list(F.struct("view", "ord", "utility")).alias("_v"))
    drawn = of.select(*groups, "_v", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(seeds - 1)), lambda s: h(s) % parts == 0)).alias("seed", "held"))
    drawn = drawn.select(*groups, "seed", "held", F.explode("_v").alias("v"))
    keys = [F.col(f"v.{c}").alias(c) for c in ("view", "ord")]
    return cut(drawn.groupBy("seed", "held", *groups, *keys).agg(F.sum("v.utility").alias("u"), F.count(F.lit(1)).alias("n")))


def repeated_splits(views: DataFrame, group: str, seeds: int, parts: int = 5) -> DataFrame:
    """(seed, fixed, adaptive, delta) of ``seeds`` reseeded splits.

    One part in ``parts`` is held out by a hash of seed and query.  The fixed
    policy buys the view that is best on the rest, the adaptive one the view
    that is best there in the query's ``group``; both are scored on what is held
    out.  Only sums a seed, side, group and view leave the rows.
    """
    return splits_of(split_sums(views, (group,), seeds, parts), group)


def splits_of(sums: DataFrame, group: str) -> DataFrame:
    """:func:`repeated_splits` by one of the groups of :func:`split_sums`."""
    sums = sums.groupBy("seed", "held", F.col(group).alias("_g"), "view", "ord").agg(F.sum("u").alias("u"), F.sum("n").alias("n"))
    train, held = sums.where("not held"), sums.where("held").select("seed", "_g", "view", "u", "n")
    mean = F.round(F.sum("u") / F.sum("n"), 9).alias("utility")
    fixed = train.groupBy("seed", "view", "ord").agg(mean).groupBy("seed").agg(best_by("utility").alias("b")).select("seed", F.col("b.view").alias("view"))
    own = train.groupBy("seed", "_g", "view", "ord").agg(mean).groupBy("seed", "_g").agg(best_by("utility").alias("b")).select("seed", "_g", F.col("b.view").alias("view"))
    score = lambda met, name: met.groupBy("seed").agg((F.sum("u") / F.sum("n")).alias(name))
    both = score(held.join(fixed, ["seed", "view"]), "fixed").join(score(held.join(own, ["seed", "_g", "view"]), "adaptive"), "seed")
    return both.select("seed", F.round("fixed", 6).alias("fixed"), F.round("adaptive", 6).alias("adaptive"), F.round(F.col("adaptive") - F.col("fixed"), 6).alias("delta"))


def split_summary(splits: DataFrame) -> DataFrame:
    """(splits, delta, lo, hi, positive): mean, 95 % percentile interval and
    share above 0 of the splits' ``delta``."""
    q = F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975)))
    return splits.agg(F.count(F.lit(1)).alias("splits"), F.round(F.avg("delta"), 6).alias("delta"), F.round(F.get(q, F.lit(0)), 6).alias("lo"), F.round(F.get(q, F.lit(1)), 6).alias("hi"), F.round(F.avg((F.col("delta") > 0).cast("double")), 6).alias("positive"))


def success(real: DataFrame, control: DataFrame, least: float = 0.015, share: float = 0.9) -> DataFrame:
    """Whether summaries of real and of control splits make a success: a delta
    above ``least``, an interval above 0, nearly all splits positive, and the
    control below."""
    c = control.select(F.col("delta").alias("control_delta"))
    tests = {"delta_passes": F.col("delta") > least, "interval_passes": F.col("lo") > 0, "share_passes": F.col("positive") >= share, "beats_control": F.col("delta") > F.col("control_delta")}
    met = real.crossJoin(c).withColumns(tests)
    return met.withColumn("success", reduce(lambda a, b: a & b, [F.col(t) for t in tests]))


def split_board(views: DataFrame, split: DataFrame, group: str, menus: dict[str, list[str]]) -> DataFrame:
    """(menu, policy, queries, utility, regret) of one split, on its test part.

    ``split`` has (query_id, split).  Under each menu, which restricts the views,
    the fixed policy buys the view that is best on the train part, the grouped
    one the view that is best there in the query's ``group`` (the fixed one for
    groups that the train part lacks), and the oracle each query's best.
    """
    parts = views.join(split.select("query_id", "split"), "query_id")
    out = []
    for name, allowed in menus.items():
        some = parts.where(F.col("view").isin(*allowed))
        train, test = some.where("split = 'train'"), some.where("split = 'test'")
        mean = F.round(F.avg("utility"), 9).alias("utility")
        fixed = train.groupBy("view", "ord").agg(mean).agg(best_by("utility").alias("b")).select(F.col("b.view").alias("_fixed"))
        own = train.groupBy(group, "view", "ord").agg(mean).groupBy(group).agg(best_by("utility").alias("b")).select(F.col(group).alias("_g"), F.col("b.view").alias("_own"))
        bought = lambda v: F.max(F.when(F.col("view") == v, F.col("utility")))
        met = test.join(own, F.col(group).eqNullSafe(F.col("_g")), "left").crossJoin(F.broadcast(fixed)).groupBy("query_id").agg(
            bought(F.col("_fixed")).alias("fixed"), bought(F.coalesce("_own", "_fixed")).alias("grouped"), F.max("utility").alias("oracle")
        )
        cells = F.array(*[F.struct(F.lit(p).alias("policy"), F.col(p).alias("u")) for p in ("fixed", "grouped", "oracle")])
        long = met.select("oracle", F.explode(cells).alias("c"))
        out.append(long.groupBy(F.lit(name).alias("menu"), F.col("c.policy").alias("policy")).agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("c.u"), 6).alias("utility"), F.round(F.avg(F.col("oracle") - F.col("c.u")), 6).alias("regret")))
    return reduce(DataFrame.unionByName, out)
