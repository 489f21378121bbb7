"""Diagnostic terrain of cells: axes, silhouette, fragility and archetypes.

Cells are summaries (a row a cell), so windows over all of them and pairs of
them are bounded by their number and not by the rows that they summarise.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent_rank(value: str | Column) -> Column:
    """Rank over all cells as a share, ties averaged."""
    value = F.col(value) if isinstance(value, str) else value
    below = F.rank().over(Window.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(value)) - 1) / 2
    return below / F.count(F.lit(1)).over(Window.partitionBy())


def axes(cells: DataFrame, groups: dict[str, list[Column]]) -> DataFrame:
    """Adds a column a group: the mean of its columns' percent ranks, stretched
    to 0 to 1 over the cells."""
    out = cells
    for name, parts in groups.items():
        for i, part in enumerate(parts):
            out = out.withColumn(f"_p{i}", F.round(part, 9)).withColumn(f"_p{i}", percent_rank(f"_p{i}"))
        mean = sum((F.col(f"_p{i}") for i in range(len(parts))), F.lit(0.0)) / len(parts)
        every = Window.partitionBy()
        out = out.withColumn("_m", F.round(mean, 9))
        span = F.max("_m").over(every) - F.min("_m").over(every)
        out = out.withColumn(name, F.round(F.when(span > 0, (F.col("_m") - F.min("_m").over(every)) / span).otherwise(0.0), 9)).drop("_m", *[f"_p{i}" for i in range(len(parts))])
    return out


def silhouette(cells: DataFrame, columns: list[str], label: str, key: str) -> DataFrame:
    """Mean silhouette by Euclidean distance over pairs of cells; a cell that is
    alone under its label counts as 0."""
    other = cells.select(F.col(key).alias("_k"), F.col(label).alias("_l"), *[F.col(c).alias(f"_{c}") for c in columns])
    far = F.sqrt(sum((F.pow(F.col(c) - F.col(f"_{c}"), 2) for c in columns), F.lit(0.0)))
    means = cells.crossJoin(other).where(F.col(key) != F.col("_k")).groupBy(key, label, "_l").agg(F.avg(far).alias("d"))
    per = means.groupBy(key).agg(F.max(F.when(F.col(label) == F.col("_l"), F.col("d"))).alias("own"), F.min(F.when(F.col(label) != F.col("_l"), F.col("d"))).alias("next"))
    score = F.when(F.col("own").isNull(), 0.0).otherwise((F.col("next") - F.col("own")) / F.greatest("own", "next"))
    return per.agg(F.round(F.avg(score), 6).alias("silhouette"), F.count(F.lit(1)).alias("cells"))


def fragility(pairs: DataFrame, cells: DataFrame, key: str, labels: dict[str, str], geometry: str) -> DataFrame:
    """How often a cell's neighbours differ from it.

    ``pairs``: (query, neighbour); ``cells``: ``key``, a column for each of
    ``labels`` and ``geometry``.  A cell that isn't known drops its pairs.
    Returns ``cell``, a share for each of ``labels`` of neighbours with another
    value, ``geometry_fragility`` (share of neighbours in the farthest quarter
    of all pairs), ``geometry_shift`` and flags ``high_<share>`` for those in
    the upper quarter that are above 0.
    """
    side = lambda p: cells.select(F.col(key).alias(f"{p}_key"), F.col(geometry).alias(f"{p}_geometry"), *[F.col(c).alias(f"{p}_{n}") for n, c in labels.items()])
    met = pairs.join(side("q"), F.col("query") == F.col("q_key"), "left").join(side("n"), F.col("neighbour") == F.col("n_key"), "left").where("q_key is not null and n_key is not null")
    met = met.withColumn("shift", F.round(F.abs(F.col("q_geometry") - F.col("n_geometry")), 9))
    cut = met.agg(F.percentile("shift", F.lit(0.75)).alias("cut"))
    differs = [F.round(F.avg((F.col(f"q_{n}") != F.col(f"n_{n}")).cast("double")), 6).alias(f"{n}_fragility") for n in labels]
    per = met.crossJoin(cut).groupBy(F.col("query").alias("cell")).agg(
        *differs, F.round(F.avg((F.col("shift") >= F.col("cut")).cast("double")), 6).alias("geometry_fragility"), F.round(F.avg("shift"), 6).alias("geometry_shift")
    )
    shares = [*[f"{n}_fragility" for n in labels], "geometry_fragility"]
    edges = per.agg(*[F.percentile(s, F.lit(0.75)).alias(f"_{s}") for s in shares])
    return per.crossJoin(edges).select(*per.columns, *[((F.col(s) >= F.col(f"_{s}")) & (F.col(s) > 0)).cast("int").alias(f"high_{s}") for s in shares])


def flag_overlap(flags: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, jaccard) of every two flag columns; 0 where neither is set."""
    pairs = list(combinations(names, 2))
    sums = [s for a, b in pairs for s in (F.sum((F.col(a) * F.col(b)).cast("long")), F.sum(F.greatest(a, b).cast("long")))]
    wide = flags.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"s{2 * i}") / F.greatest(F.col(f"s{2 * i + 1}"), F.lit(1)), 6).alias("jaccard")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def run_archetypes(runs: DataFrame, features: list[str], key: str, most: int = 4, seed: int = 7) -> DataFrame:
    """(key, cluster, pc1, pc2) of runs: k-means of standardised features, at
    most ``most`` clusters, and their first two principal components."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    n = runs.limit(most).count()
    raw = VectorAssembler(inputCols=features, outputCol="_raw").transform(runs.na.fill(0.0, features))
    scaled = StandardScaler(inputCol="_raw", outputCol="_f", withMean=True, withStd=True).fit(raw).transform(raw)
    found = KMeans(k=max(2, n), featuresCol="_f", predictionCol="cluster", seed=seed).fit(scaled).transform(scaled) if n > 1 else scaled.withColumn("cluster", F.lit(0))
    flat = PCA(k=2, inputCol="_f", outputCol="_pc").fit(found).transform(found) if n > 1 else None
    if flat is None:
        return found.select(key, "cluster", F.lit(0.0).alias("pc1"), F.lit(0.0).alias("pc2"))
    pc = vector_to_array("_pc")
    return flat.select(key, "cluster", F.get(pc, F.lit(0)).alias("pc1"), F.get(pc, F.lit(1)).alias("pc2"))
