"""Threshold gates, and learners that predict utilities."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .policy import best_by
from .stats import quantiles_of


def quantile_thresholds(rows: DataFrame, features: list[str], at: list[float]) -> list[tuple[str, float]]:
    """(feature, threshold) at exact quantiles; a list of bounded size."""
    found = quantiles_of(rows, features, at)
    return [(f, round(t, 9)) for f in features for t in found[f]]


def margin_grid(rows: DataFrame, margins: list[str], utilities: list[str], at: list[float]) -> DataFrame:
    """Mean utility of every gate of several margins: the first view whose
    margin is above its threshold is bought, else the last.

    ``utilities`` has a column more than ``margins``.  Thresholds are each
    margin's quantiles.  Rows are counted by how many thresholds each margin
    passes, so the grid is made of those cells and not of the rows.  Returns
    ``t1``, ``t2`` and so on and ``utility``.
    """
    found = quantiles_of(rows, margins, at)
    cuts = [[round(t, 9) for t in found[m]] for m in margins]
    passed = [sum((F.when(F.col(m) > t, 1).otherwise(0) for t in c), F.lit(0)).alias(f"b{i}") for i, (m, c) in enumerate(zip(margins, cuts))]
    cells = rows.select(*passed, *utilities).groupBy(*[f"b{i}" for i in range(len(margins))]).agg(*[F.sum(u).alias(u) for u in utilities], F.count(F.lit(1)).alias("n"))
    gates = cells.sparkSession.range(1).select(F.lit(0).alias("_one"))
    for i, c in enumerate(cuts):
        steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in enumerate(c)])
        gates = gates.withColumn(f"_g{i}", F.explode(steps)).withColumns({f"g{i}": F.col(f"_g{i}.k"), f"t{i + 1}": F.col(f"_g{i}.t")}).drop(f"_g{i}")
    bought = F.col(utilities[-1])
    for i in reversed(range(len(margins))):
        bought = F.when(F.col(f"b{i}") > F.col(f"g{i}"), F.col(utilities[i])).otherwise(bought)
    names = [f"t{i + 1}" for i in range(len(margins))]
    met = gates.crossJoin(F.broadcast(cells))  # cells: thresholds + 1 a margin at most
    return met.groupBy(*[f"g{i}" for i in range(len(margins))], *names).agg(F.round(F.sum(bought) / F.sum("n"), 6).alias("utility")).select(*names, "utility")


def gate_grid(rows: DataFrame, thresholds: list[tuple[str, float]], cheap: str, rich: str) -> DataFrame:
    """Mean utility of every one-feature gate, in both directions.

    ``rows`` has the features and ``u_<view>`` columns.  Each (feature,
    direction, threshold) is one aggregate over the rows: a single pass and no
    product with the rows.
    """
    sums, names = [], []
    for i, (f, t) in enumerate(thresholds):
        for way, passes in (("above", F.col(f) > t), ("below", F.col(f) <= t)):
            sums.append(F.avg(F.when(passes, F.col(f"u_{rich}")).otherwise(F.col(f"u_{cheap}"))).alias(f"g{len(names)}"))
            names.append((f, way, t))
    wide = rows.agg(*sums)
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(w).alias("direction"), F.lit(t).alias("threshold"), F.round(F.col(f"g{i}"), 9).alias("utility")) for i, (f, w, t) in enumerate(names)])
    return wide.select(F.explode(cells).alias("c")).select("c.*")


def best_gate(grid: DataFrame) -> DataFrame:
    order = F.struct(F.col("utility"), F.col("feature"), F.col("direction"), -F.col("threshold"))
    return grid.agg(F.max_by(F.struct("feature", "direction", "threshold", "utility"), order).alias("b")).select("b.*")


def apply_gate(rows: DataFrame, feature: Column, threshold: Column, cheap: str, rich: str, policy: str) -> DataFrame:
    view = F.when(feature > threshold, rich).otherwise(cheap)
    return rows.select("query_id", F.lit(policy).alias("policy"), view.alias("view"))


def route_argmax(predictions: DataFrame, policy: str) -> DataFrame:
    """(query_id, policy, view) of the highest ``prediction``, first on ties."""
    best = predictions.groupBy("query_id").agg(best_by("prediction").alias("b"))
    return best.select("query_id", F.lit(policy).alias("policy"), F.col("b.view").alias("view"))


def ridge_fit(rows: DataFrame, features: list[str], targets: list[str], alpha: float = 1.0) -> np.ndarray:
    """Weights (intercept first, unpenalised) of a ridge with many outputs.

    The normal equations are sums over the rows; only their matrix, whose size
    is that of the features, comes to the driver.
    """
    xs = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    sums = [F.sum(a * b) for i, a in enumerate(xs) for b in xs[i:]] + [F.sum(x * F.col(t)) for x in xs for t in targets]
    got = [v or 0.0 for v in rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
    n = len(xs)
    left = np.zeros((n, n))
    left[np.triu_indices(n)] = got[: n * (n + 1) // 2]
    left = left + np.triu(left, 1).T + alpha * np.diag([1e-9, *[1.0] * (n - 1)])
    return np.linalg.solve(left, np.array(got[n * (n + 1) // 2 :]).reshape(n, len(targets)))


def linear(weights: np.ndarray, features: list[str]) -> Column:
    terms = [F.lit(float(w)) * F.col(f) for w, f in zip(weights[1:], features)]
    return reduce(lambda a, b: a + b, terms, F.lit(float(weights[0])))


def predicted_gain_gate(train: DataFrame, test: DataFrame, features: list[str], rich: str, cheap: str, threshold: float, alpha: float = 1.0) -> DataFrame:
    """(query_id, gain, view) of the test rows: ``rich`` where a ridge of the
    train rows predicts that it gains more than ``threshold`` over ``cheap``.

    Only the train rows' utilities (``u_<rich>``, ``u_<cheap>``) are looked at.
    """
    w = ridge_fit(train.withColumn("_gain", F.col(f"u_{rich}") - F.col(f"u_{cheap}")), features, ["_gain"], alpha)
    gain = F.round(linear(w[:, 0], features), 9)
    return test.select("query_id", F.round(gain, 6).alias("gain"), F.when(gain > threshold, rich).otherwise(cheap).alias("view"))


def tree_predictions(train: DataFrame, test: DataFrame, features: list[str], targets: dict[str, str], kind: str = "forest", seed: int = 3) -> DataFrame:
    """(query_id, view, ord, prediction): one model a view, ``targets`` naming
    each view's utility column in menu order."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    make = VectorAssembler(inputCols=features, outputCol="_f", handleInvalid="keep")
    train, test = make.transform(train), make.transform(test)
    out = []
    for i, (view, column) in enumerate(targets.items()):
        args = {"featuresCol": "_f", "labelCol": column, "seed": seed}
        model = (RandomForestRegressor(numTrees=20, maxDepth=5, **args) if kind == "forest" else GBTRegressor(maxIter=10, maxDepth=3, **args)).fit(train)
        out.append(model.transform(test).select("query_id", F.lit(view).alias("view"), F.lit(i).alias("ord"), F.col("prediction")))
    return reduce(DataFrame.unionByName, out)


def classifier_probability(train: DataFrame, test: DataFrame, features: list[str], label: str, kind: str = "logistic", seed: int = 3) -> DataFrame:
    """``test`` with ``p``: probability that the label is 1."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    make = VectorAssembler(inputCols=features, outputCol="_f", handleInvalid="keep")
    args = {"featuresCol": "_f", "labelCol": label}
    model = {
        "logistic": lambda: LogisticRegression(regParam=0.01, **args),
        "forest": lambda: RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed, **args),
        "boosted": lambda: GBTClassifier(maxIter=10, maxDepth=3, seed=seed, **args),
        "neural": lambda: MultilayerPerceptronClassifier(layers=[len(features), 8, 2], maxIter=50, seed=seed, **args),
    }[kind]().fit(make.transform(train))
    scored = model.transform(make.transform(test)).withColumn("p", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.drop("_f", "rawPrediction", "probability", "prediction")


def bandit(log: DataFrame, cell: str) -> DataFrame:
    """(cell, view): best mean utility in each cell; the best over all cells
    under a null cell, for cells never seen."""
    per = log.groupBy(cell, "view", "ord").agg(F.round(F.avg("utility"), 9).alias("utility")).groupBy(cell).agg(best_by("utility", "utility").alias("b"))
    whole = log.groupBy("view", "ord").agg(F.round(F.avg("utility"), 9).alias("utility")).agg(best_by("utility", "utility").alias("b"))
    kind = log.schema[cell].dataType
    both = per.unionByName(whole.select(F.lit(None).cast(kind).alias(cell), "b"))
    return both.select(cell, F.col("b.view").alias("view"), F.round("b.utility", 6).alias("utility"))


def selective_regression(rows: DataFrame, features: list[str], gain: str, cheap: str, rich: str, seed: int = 3, at: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Routes of the test part: ``rich`` where a forest of the train part
    predicts a ``gain`` above the threshold that does best on the dev part.

    ``rows`` has ``split``, ``u_<cheap>`` and ``u_<rich>``.  Thresholds are 0 and
    quantiles of the dev part's predictions.
    """
    made = tree_predictions(rows.where("split = 'train'"), rows.where("split != 'train'"), features, {rich: gain}, seed=seed).select("query_id", F.col("prediction").alias("p"))
    scored = rows.where("split != 'train'").select("query_id", "split", f"u_{cheap}", f"u_{rich}").join(made, "query_id")
    dev = scored.where("split = 'dev'")
    cuts = [("p", 0.0), *quantile_thresholds(dev, ["p"], list(at))]
    best = gate_grid(dev, cuts, cheap, rich).where("direction = 'above'").agg(F.max_by("threshold", F.struct("utility", -F.col("threshold")))).first()[0]
    return apply_gate(scored.where("split = 'test'"), F.col("p"), F.lit(float(best or 0.0)), cheap, rich, "selective_reg")


def _best(views: list[str]) -> Column:
    """Index of the view of the highest ``u_<view>``, the first on ties."""
    top = F.greatest(*[F.col(f"u_{v}") for v in views])
    out = F.lit(float(len(views) - 1))
    for i in reversed(range(len(views) - 1)):
        out = F.when(F.col(f"u_{views[i]}") == top, F.lit(float(i))).otherwise(out)
    return out


def _named(index: Column, views: list[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in views]), index.cast("int"))


def best_view_classifier(train: DataFrame, test: DataFrame, features: list[str], views: list[str], policy: str = "deferral", kind: str = "forest", seed: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """Routes of ``test`` by a classifier of each row's best view, beside the
    columns ``keep``."""
    from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    make = VectorAssembler(inputCols=features, outputCol="_f", handleInvalid="keep")
    args = {"featuresCol": "_f", "labelCol": "_y", "predictionCol": "_p", "seed": seed}
    learner = DecisionTreeClassifier(maxDepth=4, **args) if kind == "tree" else RandomForestClassifier(numTrees=20, maxDepth=5, **args)
    model = learner.fit(make.transform(train.withColumn("_y", _best(views))))
    return model.transform(make.transform(test)).select("query_id", F.lit(policy).alias("policy"), _named(F.col("_p"), views).alias("view"), *keep)


def grouped_router(rows: DataFrame, group: str, features: list[str], views: list[str], kinds: tuple[str, ...], folds_: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Routes of all rows, each by a model of the other folds, of every kind; a
    group is in one fold.  Missing features get the median of the rows that are
    learnt from.

    Learners read the rows many times, so they and their folds are computed
    once.  Columns of ``keep`` stay beside a row's routes.
    """
    from pyspark.ml.feature import Imputer

    from .splits import folds

    parts = cut(folds(rows, group, folds_).drop(group))
    out = []
    for k in range(folds_):
        train, test = parts.where(F.col("fold") != k), parts.where(F.col("fold") == k)
        fill = Imputer(strategy="median", inputCols=features, outputCols=features).fit(train)
        out += [best_view_classifier(fill.transform(train), fill.transform(test), features, views, f"proxy_{kind}", kind, keep=keep) for kind in kinds]
    return reduce(DataFrame.unionByName, out)


#: Rows that a feature is dealt anew among, on average.
DEAL_ROWS = 10_000


def dealt_anew(rows: DataFrame, key: str, column: str, salt: str) -> DataFrame:
    """``rows`` with a column's values dealt anew, among groups of rows that a
    hash puts together, so that no task orders all rows."""
    from pyspark.sql import Window

    deals = max(1, rows.count() // DEAL_ROWS)
    h = lambda s: F.xxhash64(F.lit(f"{salt}:{s}"), F.col(key))
    cut = rows.withColumn("_g", F.pmod(h("group"), F.lit(deals)))
    to = cut.withColumn("_k", F.row_number().over(Window.partitionBy("_g").orderBy(key))).drop(column)
    of = cut.select("_g", F.col(column), F.row_number().over(Window.partitionBy("_g").orderBy(h("place"), key)).alias("_k"))
    return to.join(of, ["_g", "_k"]).select(*rows.columns)


def cross_validated_importance(rows: DataFrame, key: str, features: list[str], target: str, folds: int = 5, repeats: int = 3, trees: int = 50, seed: int = 3) -> DataFrame:
    """(dealt, mae, rmse, corr, worse) of a forest by cross-validation: for no
    feature (``none``), and for each dealt anew, means over the repeats."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    from .splits import folds as folded

    make = VectorAssembler(inputCols=features, outputCol="_f")
    parts = folded(rows, key, folds)
    made = []
    for k in range(folds):
        train, test = parts.where(F.col("fold") != k), parts.where(F.col("fold") == k).drop("fold")
        model = RandomForestRegressor(featuresCol="_f", labelCol=target, numTrees=trees, maxDepth=5, seed=seed).fit(make.transform(train))
        score = lambda d, name, r: model.transform(make.transform(d)).select(F.lit(name).alias("dealt"), F.lit(r).alias("r"), F.col(target).alias("t"), F.col("prediction").alias("p"))  # noqa: E731, B023
        made.append(score(test, "none", 0))
        made += [score(dealt_anew(test, key, f, f"{k}:{r}:{f}"), f, r) for f in features for r in range(repeats)]
    whole = reduce(DataFrame.unionByName, made).groupBy("dealt", "r").agg(
        F.avg(F.abs(F.col("t") - F.col("p"))).alias("mae"), F.sqrt(F.avg(F.pow(F.col("t") - F.col("p"), 2))).alias("rmse"), F.corr("t", "p").alias("corr")
    ).groupBy("dealt").agg(*[F.avg(c).alias(c) for c in ("mae", "rmse", "corr")])
    base = whole.where("dealt = 'none'").select(F.col("mae").alias("_b"))
    return whole.crossJoin(base).select("dealt", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "corr")], F.round(F.col("mae") - F.col("_b"), 6).alias("worse"))
