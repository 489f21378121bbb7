"""Evaluation packs: what methods may see of a cell, faults of a pack's rows,
and an audit of which decisions a summary hides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import routes as R

#: Fields of a cell that methods see, and those they must not.
PUBLIC_FIELDS = ("cell_id", "protocol", "n_points", "summary", "granted_views", "cost_menu", "output_schema")
HIDDEN_FIELDS = ("evaluator_only", "target_points", "family", "budget_id", "seed", "phase_name", "oracle_view", "view_utilities")


def refuse_hidden(cells: DataFrame) -> None:
    """An error that names the evaluator's fields among the columns."""
    shown = sorted(set(HIDDEN_FIELDS) & set(cells.columns))
    if shown:
        raise ValueError(f"cells that methods see hold the evaluator's fields {shown}")


def method_visible(cells: DataFrame, manifest: dict | None = None) -> DataFrame:
    """The public fields of cells and, given a manifest, the contract on what
    may be seen: its protocol and its rule on leaks, empty if it has none.

    Other columns, hidden or unknown, are left out; nothing else is added.
    """
    seen = cells.select(*[c for c in PUBLIC_FIELDS if c in cells.columns])
    if manifest is not None:
        rule = (manifest.get("visibility_contract") or {}).get("leakage_rule", "")
        seen = seen.withColumn("visibility_contract", F.struct(F.lit(manifest.get("protocol", "Protocol B")).alias("protocol"), F.lit(rule).alias("leakage_rule")))
    refuse_hidden(seen)
    return seen


def _parsed(rows: DataFrame) -> DataFrame:
    """(line, raw, v, good, q, c): the row as a variant and its string keys."""
    v = rows.select("line", "raw", F.try_parse_json("raw").alias("v"))
    v = v.withColumn("good", F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False)))
    return v.withColumns({n: F.when(F.col("good"), R.text_of(F.col("v"), k)) for n, k in (("q", "query_id"), ("c", "cell_id"))})


def _kind(path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get("v", path, "variant")), F.lit("VOID"))


def _side(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with keys, their distinct keys, faults of the keys)."""
    keyed = rows.where("q is not null and c is not null")
    odd = rows.where("q is null or c is null").select(F.lit(name).alias("side"), "line", F.when(F.col("good"), "query_id and cell_id must be strings").otherwise("not a JSON object").alias("error"))
    first = keyed.groupBy("q", "c").agg(F.min("line").alias("first"))
    twice = keyed.join(first, ["q", "c"]).where("line > first").select(F.lit(name).alias("side"), "line", F.concat(F.lit("key seen before: "), "q", F.lit(", "), "c").alias("error"))
    return keyed, first.select("q", "c"), odd.unionByName(twice)


def pack_faults(manifest: DataFrame, reference: DataFrame, forbidden: tuple[str, ...]) -> DataFrame:
    """(side, line, error): every fault of a pack's manifest and reference rows
    (line, raw), a row each.

    Rows must be JSON objects with string keys, each key once a side.  A
    manifest row must show no forbidden key among its ``visible_features``, at
    any depth, and declare some views; a reference row must hold
    ``view_scores``, an object with numbers alone (true and false count as
    such).  Keys that one side lacks are counted in a row without a line.
    """
    m_rows, r_rows = _parsed(manifest), _parsed(reference)
    (m, m_keys, m_odd), (r, r_keys, r_odd) = _side(m_rows, "manifest"), _side(r_rows, "reference")
    out = [m_odd, r_odd]

    def fault(rows: DataFrame, side: str, when: Column, error: Column | str) -> None:
        out.append(rows.where(when).select(F.lit(side).alias("side"), "line", (F.lit(error) if isinstance(error, str) else error).alias("error")))

    features = m.select("line", F.to_json(F.try_variant_get("v", "$.visible_features", "variant")).alias("shown"))
    leaking = R.leaks(features, "line", "shown", forbidden).groupBy("line").agg(F.array_sort(F.collect_list(F.concat(F.lit("$.visible_features"), F.expr("substr(path, 2)")))).alias("paths"))
    fault(leaking, "manifest", F.lit(True), F.concat(F.lit("forbidden features: "), F.array_join("paths", ", ")))
    fault(m, "manifest", ~F.startswith(_kind("$.declared_views"), F.lit("ARRAY")) | (F.size(F.try_variant_get("v", "$.declared_views", "array<variant>")) == 0), "declared_views must be a list that isn't empty")
    scores = F.try_variant_get("v", "$.view_scores", "map<string,variant>")
    has = F.startswith(_kind("$.view_scores"), F.lit("OBJECT")) & (F.size(scores) > 0)
    number = F.forall(F.map_values(scores), lambda x: F.coalesce(F.regexp_like(F.schema_of_variant(x), F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)")), F.lit(False)))
    fault(r, "reference", ~has, "view_scores must be an object that isn't empty")
    fault(r, "reference", has & ~number, "view_scores must be numbers")
    for name, a, b, error in (("manifest", m_keys, r_keys, " manifest keys lack a reference row"), ("reference", r_keys, m_keys, " reference keys aren't in the manifest")):
        n = a.join(b, ["q", "c"], "left_anti").agg(F.count(F.lit(1)).alias("n")).where("n > 0")
        out.append(n.select(F.lit(name).alias("side"), F.lit(None).cast("long").alias("line"), F.concat(F.col("n").cast("string"), F.lit(error)).alias("error")))
    made = out[0]
    for x in out[1:]:
        made = made.unionByName(x)
    return made


INDICATORS = ("topology", "geometry", "routing")


def label_shares(cells: DataFrame) -> DataFrame:
    """(label, n, topology, geometry, routing): of each label's cells, the share
    with each indicator."""
    return cells.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.col(c).cast("double")), 6).alias(c) for c in INDICATORS])


def pair_disagreement(cells: DataFrame, pairs: DataFrame, most_rank: int = 5) -> DataFrame:
    """(representation, n, topology, geometry, routing, gap): of cells that look
    alike by a representation, how many pairs differ in an indicator, and the
    mean gap of their gains.

    ``cells`` has (key, indicators, gain), ``pairs`` (representation, query,
    neighbor, rank); pairs beyond ``most_rank`` and of unknown cells don't count.
    """
    side = lambda name: cells.select(F.col("key").alias(name), F.struct(*INDICATORS, "gain").alias(f"_{name}"))
    met = pairs.where(F.col("rank") <= most_rank).join(side("query"), "query").join(side("neighbor"), "neighbor")
    differ = [F.round(F.avg((F.col(f"_query.{c}") != F.col(f"_neighbor.{c}")).cast("double")), 6).alias(c) for c in INDICATORS]
    gap = F.round(F.avg(F.abs(F.col("_query.gain") - F.col("_neighbor.gain"))), 6).alias("gap")
    return met.groupBy("representation").agg(F.count(F.lit(1)).alias("n"), *differ, gap)
