"""Rules that submitted routes and their menus have to meet, on JSON texts.

Rows are parsed to variants once; every rule is an expression over their fields
and their types, so a row's faults come out of one pass.  Only rows that may
hold a forbidden key below the top are walked key by key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import norm_key
from ..menus import FORBIDDEN, ROUTE_KEYS

_VIEW = "struct<view_id:string,cost_key:string,forbidden_before_purchase:array<string>>"
_MENU = f"struct<views:array<{_VIEW}>,hidden_evaluator_fields:array<string>,evaluator_only_fields:array<string>>"
_NUMBER = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


class Fields:
    """Fields of a JSON object that was parsed to a variant."""

    def __init__(self, v: Column):
        self.v = v

    def kind(self, key: str) -> Column:
        """Type name of a field: null if it isn't there, VOID if it is null."""
        return F.schema_of_variant(F.try_variant_get(self.v, f"$.{key}", "variant"))

    def shown(self, key: str) -> Column:
        return F.try_variant_get(self.v, f"$.{key}", "string")

    def text(self, key: str) -> Column:
        """A field that is a string, else null."""
        return F.when(self.kind(key) == "STRING", self.shown(key))

    def truthy(self, key: str) -> Column:
        """Whether a field is there and neither null, false, zero nor empty."""
        empty = F.when(self.kind(key) == "STRING", self.shown(key) == "").otherwise(self.shown(key).isin("[]", "{}", "0", "0.0", "false"))
        return F.coalesce((self.kind(key) != "VOID") & ~empty, F.lit(False))

    def names(self, key: str) -> Column:
        """A field that is a list of strings, the empty list included, else null."""
        nulls = (self.kind(key) == "ARRAY<VOID>") & (self.shown(key) != "[]")
        return F.when(self.kind(key).isin("ARRAY<STRING>", "ARRAY<VOID>") & ~nulls, F.try_variant_get(self.v, f"$.{key}", "array<string>"))


class ReadFields(Fields):
    """Fields whose types and texts were read into columns, once a row."""

    @staticmethod
    def columns(v: Column, keys: tuple[str, ...]) -> list[Column]:
        f = Fields(v)
        return [*[f.kind(k).alias(f"_kind_{k}") for k in keys], *[f.shown(k).alias(f"_text_{k}") for k in keys]]

    def kind(self, key: str) -> Column:
        return F.col(f"_kind_{key}")

    def shown(self, key: str) -> Column:
        return F.col(f"_text_{key}")


def text_of(v: Column, key: str) -> Column:
    return Fields(v).text(key)


def cost_menu_id(menu: Column) -> Column:
    """The first of a menu's names that is a string and not empty; else null."""
    v = F.try_parse_json(menu)
    return F.coalesce(*[F.nullif(text_of(v, k), F.lit("")) for k in ("cost_menu", "cost_menu_id", "menu_id", "profile_id")])


def declared_views(menu: Column) -> Column:
    """Distinct view names of a menu, sorted; null if it declares none."""
    names = F.array_sort(F.array_distinct(F.array_compact(F.transform(F.from_json(menu, _MENU)["views"], lambda x: x["view_id"]))))
    return F.when(F.size(names) > 0, names)


def forbidden_names(menu: Column) -> Column:
    """Normalised names that routes may not hold: the fixed ones, the menu's
    hidden fields and what its views forbid before purchase."""
    m, none = F.from_json(menu, _MENU), F.array().cast("array<string>")
    views = F.flatten(F.transform(F.coalesce(m["views"], F.array().cast(f"array<{_VIEW}>")), lambda x: F.coalesce(x["forbidden_before_purchase"], none)))
    named = F.concat(*[F.coalesce(m[k], none) for k in ("hidden_evaluator_fields", "evaluator_only_fields")], views)
    given = F.filter(F.transform(F.array_compact(named), norm_key), lambda k: k != "")
    return F.array_sort(F.array_distinct(F.concat(F.array(*[F.lit(k) for k in FORBIDDEN]), given)))


def allows_sets(menu: Column, costs: Column) -> Column:
    return Fields(F.try_parse_json(menu)).truthy("set_rule") | Fields(F.try_parse_json(costs)).truthy("set_rule")


def allows_abstaining(menu: Column, costs: Column) -> Column:
    m, c = Fields(F.try_parse_json(menu)), Fields(F.try_parse_json(costs))
    return m.truthy("abstain_rule") | c.truthy("abstain_rule") | c.kind("abstain_cost").isNotNull()


@dataclass(frozen=True)
class Rules:
    """What a menu and its costs ask of a route."""

    views: tuple[str, ...]
    cost_menu: str
    tiers: tuple[str, ...] = ()
    forbidden: tuple[str, ...] = FORBIDDEN
    sets: bool = False
    abstaining: bool = False
    strict: bool = True
    keys: tuple[str, ...] = field(default=ROUTE_KEYS)

    @classmethod
    def of(cls, spark, menu: str, costs: str, **options) -> Rules:
        """From the JSON texts of a view menu and a cost menu."""
        m, c = F.lit(menu), F.lit(costs)
        tiers = F.from_json(m, "struct<allowed_tiers:array<string>>")["allowed_tiers"]
        row = spark.range(1).select(declared_views(m), cost_menu_id(c), tiers, forbidden_names(m), allows_sets(m, c), allows_abstaining(m, c)).first()
        if row[0] is None or row[1] is None:
            raise ValueError("a view menu declares views and a cost menu has a name")
        return cls(tuple(row[0]), row[1], tuple(row[2] or ()), tuple(row[3]), row[4], row[5], **options)


def _actions(f: Fields) -> Column:
    route = f.kind("route")
    return F.array_compact(
        F.array(
            F.when(F.nullif(f.text("route"), F.lit("")).isNotNull(), F.lit("route")),
            F.when((route.isNull() | (route == "VOID")) & f.truthy("ranked_views"), F.lit("ranked_views")),
            F.when(f.truthy("view_set"), F.lit("view_set")),
            F.when((f.kind("abstain") == "BOOLEAN") & f.truthy("abstain"), F.lit("abstain")),
        )
    )


def primary_actions(v: Column) -> Column:
    """Names of the actions that a route row takes."""
    return _actions(Fields(v))


def selected_view(v: Column, strict: bool = False) -> Column:
    """The view that is scored: abstain, else the route, else the first ranked
    view.  A set of views alone has none: null, or an error if strict."""
    f = Fields(v)
    ranked = F.when(f.kind("ranked_views").startswith("ARRAY"), F.try_variant_get(v, "$.ranked_views[0]", "string"))
    sets = f.kind("view_set").startswith("ARRAY") & f.truthy("view_set")
    refused = F.raise_error(F.lit("sets of views aren't scored")).cast("string") if strict else F.lit(None).cast("string")
    return (
        F.when((f.kind("abstain") == "BOOLEAN") & f.truthy("abstain"), F.lit("abstain"))
        .when(F.nullif(f.text("route"), F.lit("")).isNotNull(), f.text("route"))
        .when(ranked.isNotNull(), ranked)
        .when(sets, refused)
        .otherwise(F.lit("abstain"))
    )


def forbidden_paths(text: str, banned: set[str]) -> Iterator[str]:
    """Paths of the forbidden keys in a JSON text; ``$`` if it isn't JSON."""
    import re

    def key(name: str) -> str:
        return re.sub(r"^_+|_+$", "", re.sub("[^a-z0-9_]+", "_", name.strip().lower()))

    def below(node, path: str) -> Iterator[str]:
        if isinstance(node, dict):
            for k, x in node.items():
                if key(k) in banned:
                    yield f"{path}.{k}"
                yield from below(x, f"{path}.{k}")
        elif isinstance(node, list):
            for i, x in enumerate(node):
                yield from below(x, f"{path}[{i}]")

    try:
        read = json.loads(text)
    except ValueError:
        yield "$"
        return
    yield from below(read, "$")


def _walk(banned: set[str], id_col: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, paths = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(forbidden_paths(text, banned))
                ids += [i] * len(found)
                paths += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(paths, pa.string())], [id_col, "path"])

    return scan


def leaks(rows: DataFrame, id_col: str, json_col: str, forbidden: set[str] | tuple[str, ...]) -> DataFrame:
    """(id, path) of each forbidden key at any depth of a JSON text; text that
    isn't JSON has the path ``$`` and is as bad.  Null has none.

    What may be a key (a quoted string before a colon) is compared in the JVM;
    only rows where one is forbidden, or is written with escapes, or that don't
    parse are walked in Python.
    """
    banned = {k for k in (str(f) for f in forbidden)}
    names = rows.sparkSession.createDataFrame([(k,) for k in sorted(banned)], "k string").select(norm_key(F.col("k")).alias("k"))
    normal = {r["k"] for r in names.collect()}  # the list that was given
    keys = F.transform(F.regexp_extract_all(json_col, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1)), norm_key)
    hit = F.arrays_overlap(keys, F.array(*[F.lit(k) for k in sorted(normal)])) if normal else F.lit(False)
    parses = F.try_parse_json(json_col).isNotNull()
    some = rows.where(F.col(json_col).isNotNull() & (hit | F.contains(json_col, F.lit("\\")) | ~parses)).select(id_col, json_col)
    return some.mapInArrow(_walk(normal, id_col), f"{id_col} {rows.schema[id_col].dataType.simpleString()}, path string")


def faults(rows: DataFrame, rules: Rules, manifest: DataFrame | None = None) -> DataFrame:
    """(line, error) of route rows (line, raw): one row for each fault.

    ``raw`` is a row's JSON text; one that doesn't parse to an object is a
    fault of its own and has no others.  ``manifest``, if given, has query_id,
    cell_id (a row each pair, or the last one counts by ``line``), tier,
    cost_menu (either may be null: not asked for) and declared_views (null: all).
    """
    parsed = rows.select("line", "raw", F.try_parse_json("raw").alias("v"))
    fine = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    odd = parsed.where(~fine).select("line", F.lit("not a JSON object").alias("error"))
    f = ReadFields(F.col("v"))
    ok = parsed.where(fine).select("line", "raw", "v", *ReadFields.columns(F.col("v"), ROUTE_KEYS)).withColumns({"q": f.text("query_id"), "c": f.text("cell_id")})
    known = F.array(*[F.lit(x) for x in rules.views])
    if manifest is None:
        met = ok.withColumns({"m": F.lit(None).cast("struct<tier:string,cost_menu:string,declared_views:array<string>>"), "asked": F.lit(False)})
    else:
        named = F.struct("tier", "cost_menu", "declared_views")
        last = manifest.groupBy(F.col("query_id").alias("mq"), F.col("cell_id").alias("mc")).agg(F.max_by(named, "line").alias("m"))
        met = ok.join(last, (ok["q"] == last["mq"]) & (ok["c"] == last["mc"]), "left").withColumn("asked", F.col("q").isNotNull() & F.col("c").isNotNull())
    narrowed = F.col("m.declared_views")
    bad_list = narrowed.isNotNull() & ((F.size(narrowed) == 0) | F.exists(narrowed, lambda x: F.coalesce(x == "", F.lit(True))))
    shared = F.array_intersect(known, narrowed)
    met = met.withColumn("views", F.when(narrowed.isNull() | bad_list, known).otherwise(shared)).withColumn("acts", _actions(f))
    extra = F.array_sort(F.array_except(F.json_object_keys("raw"), F.array(*[F.lit(k) for k in rules.keys])))
    found: list[Column] = []
    if rules.strict:
        found.append(F.when(F.size(extra) > 0, F.concat(F.lit("unknown keys: "), F.array_join(extra, ", "))))
    for key in ("query_id", "cell_id", "tier", "cost_menu"):
        found.append(F.when(F.coalesce(f.text(key), F.lit("")) == "", F.lit(f"no string in {key}")))
    tier, menu = f.text("tier"), f.text("cost_menu")
    if rules.tiers:
        found.append(F.when(tier.isNotNull() & ~tier.isin(*rules.tiers), F.concat(F.lit("tier isn't allowed: "), tier)))
    found.append(F.when(menu != rules.cost_menu, F.concat(F.lit("cost menu isn't the declared one: "), menu)))
    listed = F.col("m").isNotNull()
    found.append(F.when(F.col("asked") & ~listed, F.lit("not in the manifest")))
    for key, own in (("tier", tier), ("cost_menu", menu)):
        wanted = F.col(f"m.{key}")
        found.append(F.when(wanted.isNotNull() & ~wanted.eqNullSafe(own), F.concat(F.lit(f"{key} differs from the manifest's: "), wanted)))
    found.append(F.when(bad_list, F.lit("the manifest's declared views are no list of names")))
    found.append(F.when(narrowed.isNotNull() & ~bad_list & (F.size(shared) == 0), F.lit("the manifest's declared views aren't in the menu")))
    acts = F.col("acts")
    found.append(F.when(F.size(acts) != 1, F.concat(F.lit("not one primary action: "), F.when(F.size(acts) == 0, F.lit("none")).otherwise(F.array_join(acts, ", ")))))
    if not rules.sets:
        found.append(F.when(F.array_contains(acts, "view_set"), F.lit("no rule for sets of views")))
    if not rules.abstaining:
        found.append(F.when(F.array_contains(acts, "abstain"), F.lit("no rule for abstaining")))
    route, there = f.text("route"), f.kind("route")
    found.append(F.when(there.isNotNull() & (there != "VOID") & (F.coalesce(route, F.lit("")) == ""), F.lit("route is no name")))
    found.append(F.when((route != "") & ~F.array_contains("views", route), F.concat(F.lit("route isn't declared: "), route)))
    for key in ("ranked_views", "view_set"):
        is_, names = f.kind(key), f.names(key)
        other = F.array_sort(F.array_except(F.array_distinct(names), F.col("views")))
        twice = F.size(names) != F.size(F.array_distinct(names))
        found.append(F.when(is_.isNotNull() & (is_ != "VOID") & names.isNull(), F.lit(f"{key} is no list of names")))
        found.append(F.when(twice, F.lit(f"{key} names a view twice")))
        found.append(F.when(~twice & (F.size(other) > 0), F.concat(F.lit(f"{key} has undeclared views: "), F.array_join(other, ", "))))
    found.append(F.when(f.kind("abstain") != "BOOLEAN", F.lit("abstain is no boolean")))
    runtime, number = f.kind("runtime_s"), f.shown("runtime_s").try_cast("double")
    found.append(F.when(runtime.isNotNull() & (~runtime.rlike(_NUMBER) | (number < 0)), F.lit("runtime_s is no number from 0 up")))
    each = met.select("line", F.explode(F.array_compact(F.array(*found))).alias("error"))
    keyed = ok.where("q is not null and c is not null").select("line", "q", "c")
    first = keyed.groupBy("q", "c").agg(F.min("line").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = keyed.join(first, ["q", "c"]).where("line > first").select("line", F.lit("the pair was submitted before").alias("error"))
    below = leaks(ok.select("line", "raw"), "line", "raw", rules.forbidden).groupBy("line")
    leaking = below.agg(F.concat(F.lit("forbidden keys: "), F.array_join(F.array_sort(F.collect_list("path")), ", ")).alias("error"))
    return odd.unionByName(each).unionByName(again).unionByName(leaking)
