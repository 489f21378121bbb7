"""Lab and learner queries that SQL can't express, with their outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import gates as G
from ..operators import geometry as Geo
from ..operators import lab as L
from ..operators import policy as P
from ..operators import text_vectors as V
from ..operators import trees as Tr
from .fixtures import view_table  # noqa: F401  (the source of what routers learn from)
from .registry import query, read
from .stats_queries import _FEATURES, _OFFERED, _featured, _judged, _learning, _offers, _wide


_N = 120


def _z(axis: str, at: str) -> str:
    half = lambda k: f"(('0x' || substr(md5(cell::varchar || ':{axis}{k}:' || ({at})::varchar), 1, 8))::bigint / 4294967296.0::double)"
    return f"sqrt(-2 * ln({half('r')} + 1e-12::double)) * cos(2 * pi() * {half('a')})"


_VOLATILE = " + ".join(f"case when i + {k} between 0 and {_N - 1} then (0.05::double + case when sin(5 * pi() * (i + {k}) / {_N - 1}) > 0 then 0.22::double else 0 end) * ({_z('v', f'i + {k}')}) else 0 end" for k in range(-2, 3))
_SHAPES = {
    "trend": ("t", "0.15 * sin(6 * pi() * t) + 0.9 * t"),
    "bubble-crash": ("t", "0.25 * t + 0.9 * exp(-pow((t - 0.58) * 10, 2)) - 1.8 * greatest(t - 0.62, 0)"),
    "regime-shift": ("t", "0.25 * sin(4 * pi() * t) + case when t < 0.5 then -0.35 else 0.45 end + 0.08 * sign(t - 0.5)"),
    "volatility-clustering": ("t", f"({_VOLATILE}) / 5"),
    "mean-reversion": ("t", "0.5 * sin(10 * pi() * t) * exp(-0.4 * t)"),
    "star": tuple(f"(0.5 + 0.25 * sign(sin(10 * pi() * u))) * {f}(2 * pi() * u)" for f in ("cos", "sin")),
    "spiral": tuple(f"(0.05 + 0.75 * t) * {f}(0.2 + (4 * pi() - 0.2) * t)" for f in ("cos", "sin")),
    "double-loop": ("sin(2 * pi() * t)", "sin(2 * pi() * t) * cos(2 * pi() * t)"),
    "ring-hole": tuple(f"(0.75 + 0.02 * {_z('r', 'i')}) * {f}(2 * pi() * u)" for f in ("cos", "sin")),
    "s-curve": ("2 * t - 1", "tanh(2.2 * (2 * t - 1))"),
}
_CURVES = f"with p as (select s_suppkey as cell, i, i / {_N - 1}.0::double as t, i / {_N}.0::double as u from supplier, (select unnest(range({_N})) as i)) " + " union all ".join(
    f"select cell, '{n}' as family, i as idx, round({x} + 0.01 * {_z('x', 'i')}, 5) as x, round({y} + 0.01 * {_z('y', 'i')}, 5) as y from p where cell % {len(_SHAPES)} = {k}" for k, (n, (x, y)) in enumerate(_SHAPES.items())
)


def _curves(spark, sf_dir: str, points: int) -> DataFrame:
    """A curve for every supplier, of the family that its number says."""
    names = F.array(*[F.lit(n) for n in L.FAMILIES])
    key = F.col("s_suppkey")
    return L.curves(read(spark, sf_dir, "supplier", "s_suppkey").select(key.alias("cell"), F.get(names, (key % len(L.FAMILIES)).cast("int")).alias("family")), points)


@query(_CURVES)
def families(spark, sf_dir):
    """Points of a curve for every supplier, of ten families."""
    return _curves(spark, sf_dir, _N).select("cell", "family", "idx", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query()
def recon_methods(spark, sf_dir):
    """Every method's course on every supplier's curve."""
    points = _curves(spark, sf_dir, 90)
    return reduce(DataFrame.unionByName, [L.reconstruct(points, m).withColumn("method", F.lit(m)) for m in L.METHODS])


@query()
def sketches(spark, sf_dir):
    """Coarse histogram of every curve, beside its local graph and its
    higher-order features."""
    points = _curves(spark, sf_dir, 120)
    return L.sketch(points).join(L.graph_sketch(points).hint("merge"), "cell")  # both grow with the cells: neither is broadcast


@query()
def view_choice(spark, sf_dir):
    """Of the first curve of each family, another than itself, the nearest to
    every curve by coarse sketch, and if it has as many parts: a correct pick
    minus its price."""
    points = _curves(spark, sf_dir, 120)
    share = lambda k: F.coalesce(F.sum(F.when((F.col("i") == k % 4) & (F.col("j") == k // 4), F.col("share"))), F.lit(0.0))
    s = L.sketch(points).groupBy("cell").agg(F.array(*[share(k) for k in range(16)]).alias("s"))
    first = points.select("cell", "family").groupBy("family").agg(F.min("cell").alias("other")).select("other")  # a row a family
    firsts = points.join(F.broadcast(first), F.col("cell") == F.col("other"), "semi")
    o = L.sketch(firsts).groupBy(F.col("cell").alias("other")).agg(F.array(*[share(k) for k in range(16)]).alias("os"))
    apart = F.aggregate(F.zip_with("s", "os", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda t, x: t + x)
    far = s.crossJoin(F.broadcast(o)).where("cell != other").select("cell", "other", F.round(apart, 6).alias("d"))
    best = far.groupBy("cell").agg(F.min_by("other", F.struct("d", "other")).alias("chosen"), F.min("d").alias("d"))
    theirs = L.graph_components(firsts, 0.2).select(F.col("cell").alias("chosen"), F.col("parts").alias("theirs"))
    met = best.join(L.graph_components(points, 0.2).select("cell", "parts").hint("merge"), "cell").join(F.broadcast(theirs), "chosen")
    return met.select("cell", "chosen", "d", ((F.col("parts") == F.col("theirs")).cast("double") - 0.28).alias("utility"))


@query()
def solvers(spark, sf_dir):
    """Chamfer distance of three solvers' clouds to the curves."""
    points = _curves(spark, sf_dir, 90).drop("family")
    return L.solver_distances(points, {"template": L.moment_gaussian, "blind": L.blind_search, "random": L.random_support})


@query()
def assign(spark, sf_dir):
    """Least-cost matching of each curve's points to its moment-matched cloud."""
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf.sort_values("idx")[["x", "y"]].to_numpy(float)
        p = L.moment_gaussian(pdf)[["x", "y"]].to_numpy(float)
        to = L.assignment(L._pairwise(p, t))
        return pd.DataFrame({"cell": pdf.cell.iloc[0], "idx": np.arange(len(t)), "target": to, "d": np.sqrt(((p - t[to]) ** 2).sum(axis=1))})

    return _curves(spark, sf_dir, 60).groupBy("cell").applyInPandas(run, "cell long, idx long, target long, d double")


@query()
def router_expanded(spark, sf_dir):
    """One model on (query, view) rows: features, view, its cost and order."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rows, _, test = _learning(spark, sf_dir)
    long = rows.select("query_id", "margin", "scaled_price", "split", F.inline(_offers())).where("utility is not null")
    long = VectorAssembler(inputCols=["margin", "scaled_price", "cost", "ord"], outputCol="_f").transform(long)
    model = RandomForestRegressor(featuresCol="_f", labelCol="utility", numTrees=20, maxDepth=6, seed=3).fit(long.where("split = 'train'"))
    made = model.transform(long.where("split = 'test'")).select("query_id", "view", "ord", "prediction")
    return _judged(G.route_argmax(made, "expanded"), test)


@query()
def router_ce(spark, sf_dir):
    """Buys the dear view where a forest predicts a net gain."""
    _, train, test = _learning(spark, sf_dir)
    made = G.tree_predictions(train.withColumn("net", F.col("u_full") - F.col("u_summary")), test, _FEATURES, {"full": "net"})
    routes = made.select("query_id", F.lit("net_gain").alias("policy"), F.when(F.col("prediction") > 0, "full").otherwise("summary").alias("view"))
    return _judged(routes, test, costly="full")


@query()
def router_fitted_q(spark, sf_dir):
    """A boosted model an action, judged on groups that it hasn't seen."""
    rows, _, _ = _learning(spark, sf_dir)
    from ..operators.splits import folds

    grouped = folds(rows.drop("split"), "query_id", 5)
    made = G.tree_predictions(grouped.where("fold != 0"), grouped.where("fold = 0"), _FEATURES, {v: f"u_{v}" for v in ("summary", "pq", "full")}, "boosted")
    return _judged(G.route_argmax(made, "fitted_q"), grouped.where("fold = 0"))


@query()
def probing(spark, sf_dir):
    """Best of 1, 3 or 10 submitted gates by the dev part, and on the test part."""
    rows, _, _ = _learning(spark, sf_dir)
    cuts = [round(0.05 + 0.09 * i, 2) for i in range(10)]
    gate = lambda c: F.when(F.col("margin") > c, F.col("u_summary")).otherwise(F.col("u_full"))
    means = rows.where("split != 'train'").groupBy("split").agg(*[F.round(F.avg(gate(c)), 9).alias(f"g{i}") for i, c in enumerate(cuts)])
    long = means.select("split", F.posexplode(F.array(*[F.col(f"g{i}") for i in range(len(cuts))])).alias("k", "u"))
    wide = long.groupBy("k").pivot("split", ["dev", "test"]).agg(F.max("u"))
    capped = wide.withColumn("cap", F.explode(F.array(F.lit(1), F.lit(3), F.lit(10)))).where("k < cap")
    best = capped.groupBy("cap").agg(F.max_by(F.struct("dev", "test"), F.struct("dev", -F.col("k"))).alias("b"))
    return best.select("cap", F.round("b.dev", 6).alias("dev"), F.round("b.test", 6).alias("test"), F.round(F.col("b.dev") - F.col("b.test"), 6).alias("gap"))


@query()
def hash_svd(spark, sf_dir):
    """Character runs of whole documents, hashed, weighted and reduced to 16 dimensions."""
    return V.text_vectors(read(spark, sf_dir, "documents"))


@query()
def router_selective_reg(spark, sf_dir):
    """Full where a forest predicts a gain over PQ above a threshold that is
    chosen on the dev part."""
    rows, _, test = _learning(spark, sf_dir)
    made = G.selective_regression(rows.withColumn("gain", F.col("u_full") - F.col("u_pq")), _FEATURES, "gain", "pq", "full")
    return _judged(made, test, costly="full")


@query()
def router_deferral(spark, sf_dir):
    """A classifier of each query's best view."""
    _, train, test = _learning(spark, sf_dir)
    return _judged(G.best_view_classifier(train, test, _FEATURES, ["summary", "pq", "full"]), test, costly="full")


@query()
def router_proxy(spark, sf_dir):
    """Routers by order date: no date is in two folds; missing features are
    imputed by the median of the training folds."""
    day = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.to_date("o_orderdate").cast("string").alias("day"))
    rows = _featured(_wide(spark, sf_dir)).join(day, "query_id").drop("price").withColumn("scaled_price", F.when(F.col("query_id") % 10 != 0, F.col("scaled_price")))
    judged_by = ("best_utility", *[f"{c}_{v}" for v in _OFFERED for c in ("q", "u")])
    routes = G.grouped_router(rows, "day", _FEATURES, ["summary", "pq", "full"], ("tree", "forest"), 3, judged_by)
    return P.evaluate_beside(routes.withColumn("offers", _offers()), costly="full")


@query()
def learners_extra(spark, sf_dir):
    """Headroom of classifiers of "full beats PQ": accuracy on the test part."""
    y = (F.col("u_full") > F.col("u_pq")).cast("double")
    _, train, test = _learning(spark, sf_dir)
    train, test = train.withColumn("y", y), test.withColumn("y", y)
    scored = {kind: G.classifier_probability(train, test, _FEATURES, "y", kind) for kind in ("logistic", "forest", "boosted", "neural")}
    scored["extra_trees"] = Tr.predicted(test, Tr.extra_trees(train, _FEATURES, "y"), "p")
    odds = Tr.predicted(test, Tr.boosted_histograms(train, _FEATURES, "y", "logistic"), "odds")
    scored["histogram"] = odds.withColumn("p", 1 / (1 + F.exp(-F.col("odds"))))
    right = F.avg(((F.col("p") > 0.5).cast("double") == F.col("y")).cast("double"))
    return reduce(DataFrame.unionByName, [p.agg(F.lit(kind).alias("learner"), F.round(right, 6).alias("accuracy")) for kind, p in scored.items()])


@query()
def hardness_model(spark, sf_dir):
    """Forest of a path's last value from its shape, cross-validated: errors and
    correlation, and how much worse it gets when a feature is dealt anew."""
    from .geometry_queries import _paths

    paths = _paths(spark, sf_dir)
    features = ["width", "height", "path", "turns"]
    rows = Geo.structure(paths).join(paths.groupBy("cell").agg(F.max_by("y", "idx").alias("target")), "cell").na.fill(0)
    return G.cross_validated_importance(rows, "cell", features, "target", folds=3, repeats=3)


@query()
def encode_texts(spark, sf_dir):
    """Passages under an encoder that is handed in: here hashed word vectors."""
    from ..operators import search as S

    texts = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return S.encoded(texts, S.hashed_encoder(32)).select(F.col("id").alias("item_id"), F.size("embedding").alias("dims"), F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@query()
def rerank_scorer(spark, sf_dir):
    """BM25's first ten, ranked anew by a scorer of (query, text) pairs."""
    from ..operators import search as S
    from ..operators import text as T
    from .text_queries import _pool

    qs, pool = _pool(spark, sf_dir)
    top = T.bm25_local(qs, pool).withColumn("rank", F.row_number().over(T.by_score())).where("rank <= 10").select("qid", "did")
    docs = pool.select("did", "text")
    return S.rerank_pairs(top, qs, docs, S.overlap_scorer, 10)
