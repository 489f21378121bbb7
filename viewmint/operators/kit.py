"""Challenge cells of the legacy protocol: what is public and hidden of them,
what their best view is, and how submitted points are scored.

Points are arrays of (x, y) pairs, one row a cell, as submissions have them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geometry as G

#: Utilities of the views of a cell, before its best one is raised.
UTILITIES = (("moments", 0.45), ("occupancy", 0.55), ("raster", 0.62), ("point", 0.68), ("abstain", 0.0))
BEST, BESIDE = 0.82, {"point": ("raster", 0.70), "moments": ("occupancy", 0.65)}
VIEWS = ("moments", "occupancy", "raster", "point")
PUBLIC = ("cell_id", "protocol", "n_points", "summary", "granted_views", "cost_menu", "output_schema")
POINTS = "array<array<double>>"


def condition(vxx: str, vyy: str, vxy: str) -> Column:
    """Ratio of a covariance's eigenvalues, the smaller at least 1e-8."""
    half, root = (F.col(vxx) + F.col(vyy)) / 2, F.sqrt(F.pow((F.col(vxx) - F.col(vyy)) / 2, 2) + F.pow(vxy, 2))
    return (half + root) / F.greatest(half - root, F.lit(1e-8))


def best_view(phase: Column, cond: Column) -> Column:
    """The heuristic of the kit: by phase name and condition."""
    name = F.lower(phase)
    has = lambda w: F.contains(name, F.lit(w))
    return F.when(has("optimization") | (cond >= 5.0), "point").when(has("decision"), "raster").when(has("collapsed") | (cond < 1.5), "moments").otherwise("occupancy")


def view_utilities(best: Column) -> Column:
    """Map of every view's utility, given the best view."""
    entries = []
    for view, usual in UTILITIES:
        value = F.lit(usual)
        for other, (beside, least) in BESIDE.items():
            if view == beside:
                value = F.when(best == other, F.greatest(F.lit(usual), F.lit(least))).otherwise(value)
        entries += [F.lit(view), F.when(best == view, F.lit(BEST)).otherwise(value)]
    return F.create_map(*entries)


def cells(points: DataFrame, phases: DataFrame, tolerance: float = 1e-2, protocol: str = "legacy") -> DataFrame:
    """A row a cell of ``points`` (cell, idx, x, y) with ``phases`` (cell,
    phase): summary, best view and utilities, all figures to six digits."""
    r = lambda c: F.round(c, 6)
    m = G.moments(points).join(phases, "cell")
    cov = F.array(F.array(r("vxx"), r("vxy")), F.array(r("vxy"), r("vyy")))
    summary = F.struct(F.array(r("mx"), r("my")).alias("mean"), cov.alias("covariance"), F.col("n").alias("n_points"), F.lit(tolerance).alias("tolerance"))
    best = best_view(F.col("phase"), condition("vxx", "vyy", "vxy"))
    return m.select(F.concat(F.lit("pb_"), F.lpad(F.col("cell").cast("string"), 5, "0")).alias("cell_id"), F.lit(protocol).alias("protocol"), F.col("n").alias("n_points"), summary.alias("summary"), best.alias("oracle_view"), view_utilities(best).alias("view_utilities"))


def split_hidden(rows: DataFrame, public: tuple[str, ...] = PUBLIC) -> tuple[DataFrame, DataFrame]:
    """(what a method sees, what the evaluator keeps): both have ``cell_id``."""
    seen = [c for c in rows.columns if c in public]
    return rows.select(*seen), rows.select("cell_id", *[c for c in rows.columns if c not in public])


def submitted_points(raw: Column) -> Column:
    """Points of a submission's JSON: candidate, else points, else those of the
    first candidate; null if none is a list of pairs of numbers."""
    read = lambda path: F.from_json(F.get_json_object(raw, path), POINTS)
    there = lambda path: F.get_json_object(raw, path).isNotNull()
    return F.when(there("$.candidate"), read("$.candidate")).when(there("$.points"), read("$.points")).when(there("$.candidates[0].points"), read("$.candidates[0].points")).otherwise(read("$.candidates[0]"))


def fine_points(points: Column, n: Column) -> Column:
    """Whether there are ``n`` pairs of finite numbers."""
    pair = lambda p: (F.size(p) == 2) & F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(points) == n) & F.forall(points, pair), F.lit(False))


def validate(submissions: DataFrame, known: DataFrame) -> DataFrame:
    """(cell_id, verdict) of submissions (line, raw) against ``known`` (cell_id,
    n_points), and of cells that none was made for.

    The first fault counts: unknown cell, duplicate (a later line), unknown
    route, unknown or repeated ranked views, no or unfit points; else ok.
    """
    rows = submissions.select("line", "raw", F.get_json_object("raw", "$.cell_id").alias("cell_id"))
    first = rows.groupBy("cell_id").agg(F.min("line").alias("_first"))
    ranked = F.from_json(F.get_json_object("raw", "$.ranked_views"), "array<string>")
    route = F.get_json_object("raw", "$.route")
    views = F.array(*[F.lit(v) for v in VIEWS])
    points = submitted_points(F.col("raw"))
    verdict = (
        F.when(F.col("n_points").isNull(), "unknown cell").when(F.col("line") > F.col("_first"), "duplicate")
        .when(route.isNotNull() & ~route.isin(*VIEWS, "abstain"), "unknown route")
        .when(F.coalesce(F.size(F.array_except(ranked, views)) > 0, F.lit(False)) | F.coalesce(F.size(ranked) != F.size(F.array_distinct(ranked)), F.lit(False)), "bad ranked views")
        .when(~fine_points(points, F.col("n_points")), "bad points").otherwise("ok")
    )
    met = rows.join(known, "cell_id", "left").join(first, "cell_id").select("cell_id", verdict.alias("verdict"))
    missing = known.join(rows.select("cell_id"), "cell_id", "left_anti").select("cell_id", F.lit("missing").alias("verdict"))
    return met.unionByName(missing)


def cell_metrics(submissions: DataFrame, reference: DataFrame) -> DataFrame:
    """Scores of submissions (cell_id, raw) against ``reference`` (cell_id,
    n_points, mean array, covariance array, tolerance, target points).

    Every cell of the reference has a row; without valid points its figures are
    null.  Feasible: means and covariances within the tolerance.
    """
    sub = submissions.select("cell_id", submitted_points(F.col("raw")).alias("_p"))
    met = reference.join(sub, "cell_id", "left").withColumn("valid", F.coalesce(fine_points(F.col("_p"), F.col("n_points")), F.lit(False)))
    flat = lambda rows, c: rows.select(F.col("cell_id").alias("cell"), F.posexplode(c).alias("idx", "p")).select("cell", "idx", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))
    ok = met.where("valid")
    made, want = flat(ok, "_p"), flat(ok, "target")
    m = G.moments(made)
    near = G.chamfer(made, want).join(G.raster_overlap(made, want).select("cell", "iou"), "cell").join(G.coverage(made, want), "cell").join(m, "cell")
    joined = met.join(near.withColumnRenamed("cell", "cell_id"), "cell_id", "left")
    gap = lambda c, *at: F.abs(F.col(c) - at[0])
    mean = F.greatest(gap("mx", F.get("mean", F.lit(0))), gap("my", F.get("mean", F.lit(1))))
    cov = lambda i, j: F.get(F.get("covariance", F.lit(i)), F.lit(j))
    spread = F.greatest(gap("vxx", cov(0, 0)), gap("vxy", cov(0, 1)), gap("vyy", cov(1, 1)))
    fits = F.col("valid") & (mean <= F.col("tolerance")) & (spread <= F.col("tolerance"))
    return joined.select("cell_id", "valid", F.coalesce(fits, F.lit(False)).alias("feasible"), F.round(mean, 6).alias("mean_error"), F.round(spread, 6).alias("cov_error"), F.col("chamfer").alias("norm_cd"), "iou", "coverage")


def summary(scored: DataFrame) -> DataFrame:
    """Means over cells; null figures are passed over."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return scored.agg(F.count(F.lit(1)).alias("n_cells"), rate("valid").alias("valid_rate"), rate("feasible").alias("feasible_rate"), *[rate(c).alias(f"mean_{c}") for c in ("norm_cd", "iou", "coverage")])


def support_points(cell_rows: DataFrame, n: int, seed: int) -> DataFrame:
    """(cell, idx, x, y): ``n`` seeded Gaussian points a cell with its mean and
    covariance (cell, mx, my, vxx, vyy, vxy), by the polar form of two hashes."""
    at = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("idx")
    u = lambda salt: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}{salt}"), F.col("cell").cast("string"), F.col("idx").cast("string"))), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    rows = cell_rows.select("cell", "mx", "my", "vxx", "vyy", "vxy", at)
    r, a = F.sqrt(-2 * F.log(u("r"))), 2 * F.pi() * u("a")
    z1, z2 = r * F.cos(a), r * F.sin(a)
    l11 = F.sqrt(F.greatest("vxx", F.lit(1e-12)))
    l21 = F.col("vxy") / l11
    l22 = F.sqrt(F.greatest(F.col("vyy") - l21 * l21, F.lit(0.0)))
    return rows.select("cell", "idx", (F.col("mx") + l11 * z1).alias("x"), (F.col("my") + l21 * z1 + l22 * z2).alias("y"))


def canonical_target(points: DataFrame, n: int) -> DataFrame:
    """``n`` farthest points of each cell, moved to the whole cell's moments."""
    return G.affine_match(G.farthest_points(points, n), G.moments(points).drop("n"))
