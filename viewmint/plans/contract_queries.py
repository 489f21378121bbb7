"""The contract of routes: menus, submissions and manifests as JSON texts that
are made of the tables, each rule broken by some of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..menus import FORBIDDEN, ROUTE_KEYS
from ..operators import contract as K
from ..operators import routes as R
from .registry import query, read

# SQL that means the same here and in DuckDB.
_MENU = """concat('{"views": [', case when p_partkey % 7 = 0 then '' else concat('{"view_id": "', p_brand, '", "cost_key": "', p_size, '", "forbidden_before_purchase": ["CE Margin!", "', p_type, '"]}, {"view_id": "full", "cost_key": "f"}, {"view_id": "full", "cost_key": "g"}') end,
  '], "hidden_evaluator_fields": ["', p_name, '", " Oracle-View "]', case when p_partkey % 3 = 0 then ', "evaluator_only_fields": ["gold", ""]' else '' end,
  case p_partkey % 5 when 0 then ', "cost_menu": "cm", "menu_id": "m"' when 1 then ', "cost_menu": "", "cost_menu_id": "ci"' when 2 then ', "cost_menu": 7, "menu_id": "m"' when 3 then ', "profile_id": "C_op"' else '' end,
  case p_size % 4 when 0 then ', "set_rule": "union"' when 1 then ', "set_rule": ""' when 2 then ', "abstain_rule": {"cost": 0}' else ', "abstain_rule": {}' end, '}')"""
_COSTS = """concat('{"a": 1', case p_size % 5 when 0 then ', "abstain_cost": 0' when 1 then ', "set_rule": true' else '' end, '}')"""
_MENUS = f"menus as (select p_partkey, {_MENU} as menu, {_COSTS} as costs from part)"
_DUCK_NORM = "regexp_replace(regexp_replace(lower(trim({})), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')"


def _menus(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.expr(_MENU).alias("menu"), F.expr(_COSTS).alias("costs"))


@query(f"""with {_MENUS}, named as (select p_partkey, unnest(cast(menu->'$.hidden_evaluator_fields' as varchar[])) as k from menus
  union all select p_partkey, unnest(cast(coalesce(menu->'$.evaluator_only_fields', '[]') as varchar[])) from menus
  union all select p_partkey, unnest(flatten(list_transform(cast(menu->'$.views' as json[]), lambda x: cast(coalesce(x->'$.forbidden_before_purchase', '[]') as varchar[])))) from menus
  union all select p_partkey, unnest({list(FORBIDDEN)}) from menus),
n as (select distinct p_partkey, {_DUCK_NORM.format("k")} as k from named) select p_partkey, count(*) as n, string_agg(k, ',' order by k) as forbidden from n where k <> '' group by 1""")
def forbidden_set(spark, sf_dir):
    names = R.forbidden_names(F.col("menu"))
    return _menus(spark, sf_dir).select("p_partkey", F.size(names).cast("long").alias("n"), F.array_join(names, ",").alias("forbidden"))


@query(f"""with {_MENUS}, v as (select p_partkey, unnest(list_transform(cast(menu->'$.views' as json[]), lambda x: x->>'$.view_id')) as view from menus)
select p_partkey, count(distinct view) as views, string_agg(distinct view, ',' order by view) as declared from v group by 1 union all select p_partkey, 0, null from menus where menu->>'$.views' = '[]'""")
def declared_views(spark, sf_dir):
    names = R.declared_views(F.col("menu"))
    return _menus(spark, sf_dir).select("p_partkey", F.when(names.isNull(), 0).otherwise(F.size(names)).cast("long").alias("views"), F.array_join(names, ",").alias("declared"))


_STR = "case when json_type(menu, '$.{0}') = 'VARCHAR' then nullif(menu->>'$.{0}', '') end"


@query(f"with {_MENUS} select p_partkey, coalesce({', '.join(_STR.format(k) for k in ('cost_menu', 'cost_menu_id', 'menu_id', 'profile_id'))}) as menu_id from menus")
def cost_menu_id(spark, sf_dir):
    return _menus(spark, sf_dir).select("p_partkey", R.cost_menu_id(F.col("menu")).alias("menu_id"))


@query(f"""with {_MENUS} select p_partkey, coalesce(menu->>'$.set_rule', '') <> '' or coalesce(costs->>'$.set_rule', 'false') = 'true' as sets,
  coalesce(menu->>'$.abstain_rule', '{{}}') <> '{{}}' or json_exists(costs, '$.abstain_cost') as abstaining from menus""")
def action_rules(spark, sf_dir):
    m, c = F.col("menu"), F.col("costs")
    return _menus(spark, sf_dir).select("p_partkey", R.allows_sets(m, c).alias("sets"), R.allows_abstaining(m, c).alias("abstaining"))


# Submissions: a row an event.  Every fault occurs, alone and with others.
_ACT = """case event_id % 14 when 0 then ', "route": "signup"' when 1 then ', "route": "view", "abstain": true' when 2 then ', "ranked_views": ["click", "view"]' when 3 then ', "view_set": ["click", "zoom"]'
  when 4 then ', "abstain": true' when 5 then '' when 6 then ', "route": ""' when 7 then ', "route": 5' when 8 then ', "ranked_views": ["click", "click"]' when 9 then ', "ranked_views": "click"'
  when 10 then ', "route": "purchase"' when 11 then ', "route": null, "ranked_views": ["view", 3]' when 12 then ', "route": "click", "ranked_views": ["zoom", "pan"], "view_set": []' else ', "view_set": [], "ranked_views": [], "abstain": false' end"""
_MORE = """case event_id % 11 when 0 then ', "runtime_s": -1.5' when 1 then ', "runtime_s": "fast"' when 2 then ', "extra": 1, "another": 2' when 3 then ', "diagnostics": {"a": [{"Target": 1}], "CE score!": {"qrels": []}}'
  when 4 then ', "runtime_s": 2' when 5 then ', "diagnostics": {"note": "target: none", "k": 3}' when 6 then ', "method": "m", "view_scores": {}' else '' end"""
_ID = """case event_id % 29 when 0 then '7' when 1 then '""' else concat('"q', user_id, '"') end"""
_RAW = f"""case when event_id % 97 = 0 then '[1, 2]' when event_id % 97 = 1 then 'not json' else concat('{{"query_id": ', {_ID}, ', "cell_id": "c', user_id % 3, '", "tier": "', case event_id % 17 when 0 then 'paid' when 1 then '' when 2 then 'public' else 'free' end,
  '", "cost_menu": "', case when event_id % 19 = 0 then 'other' else 'main' end, '"', {_ACT}, {_MORE}, '}}') end"""
_SUB = f"sub as (select event_id as line, {_RAW} as raw from events), ok as (select * from sub where json_valid(raw) and json_type(case when json_valid(raw) then raw else 'null' end) = 'OBJECT')"


def _submissions(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("line"), F.expr(_RAW).alias("raw"))


def _t(key: str) -> str:
    return f"json_type(raw, '$.{key}')"


def _s(key: str) -> str:
    return f"case when {_t(key)} = 'VARCHAR' then raw->>'$.{key}' end"


def _truthy(key: str) -> str:
    return f"coalesce({_t(key)} <> 'NULL' and raw->>'$.{key}' not in ('', '[]', '{{}}', '0', '0.0', 'false'), false)"


_ACTS = f"""list_filter([case when coalesce({_s("route")}, '') <> '' then 'route' end, case when coalesce({_t("route")}, 'NULL') = 'NULL' and {_truthy("ranked_views")} then 'ranked_views' end,
  case when {_truthy("view_set")} then 'view_set' end, case when {_t("abstain")} = 'BOOLEAN' and {_truthy("abstain")} then 'abstain' end], lambda x: x is not null)"""


@query(f"with {_SUB} select line, array_to_string({_ACTS}, ',') as actions, len({_ACTS}) = 1 as valid from ok")
def primary_action(spark, sf_dir):
    v = F.try_parse_json("raw")
    rows = _submissions(spark, sf_dir).where(F.schema_of_variant(v).startswith("OBJECT"))
    return rows.select("line", F.array_join(R.primary_actions(v), ",").alias("actions"), (F.size(R.primary_actions(v)) == 1).alias("valid"))


@query(f"""with {_SUB} select line, case when {_t("abstain")} = 'BOOLEAN' and raw->>'$.abstain' = 'true' then 'abstain' when coalesce({_s("route")}, '') <> '' then {_s("route")}
  when {_t("ranked_views")} = 'ARRAY' and json_array_length(raw, '$.ranked_views') > 0 then raw->>'$.ranked_views[0]'
  when {_t("view_set")} = 'ARRAY' and json_array_length(raw, '$.view_set') > 0 then null else 'abstain' end as selected from ok""")
def select_view(spark, sf_dir):
    v = F.try_parse_json("raw")
    return _submissions(spark, sf_dir).where(F.schema_of_variant(v).startswith("OBJECT")).select("line", R.selected_view(v).alias("selected"))


_TREE = f"""tree as (select line, fullkey as path, {_DUCK_NORM.format("key")} as k from ok, json_tree(raw) where key is not null),
leaking as (select line, replace(path, '"', '') as path from tree where k in ({", ".join(f"'{k}'" for k in FORBIDDEN)}))"""


@query(f"with {_SUB}, {_TREE} select line, path from leaking union all select line, '$' from sub where not json_valid(raw)")
def leak_scan(spark, sf_dir):
    """Forbidden keys at any depth of a JSON text, as paths."""
    return R.leaks(_submissions(spark, sf_dir), "line", "raw", FORBIDDEN)


_VIEWS = ["signup", "click", "view"]
_MANIFEST = """select distinct concat('q', user_id) as query_id, concat('c', user_id % 3) as cell_id, case user_id % 5 when 0 then 'public' when 1 then null else 'free' end as tier, case when user_id % 7 = 0 then 'old' else 'main' end as cost_menu,
  case user_id % 6 when 0 then null when 1 then '' when 2 then 'zoom' when 3 then 'click,view' else 'signup,click,view' end as views, 0 as line from events where user_id % 4 <> 0"""


def _list_rules(key: str) -> str:
    named = f"case when {_t(key)} = 'ARRAY' then list_transform(cast(raw->'$.{key}' as json[]), lambda x: case when json_type(x) = 'VARCHAR' then x->>'$' end) end"
    plain = f"len(list_filter({named}, lambda x: x is null)) = 0"
    other = f"list_filter({named}, lambda x: not list_contains(views, x))"
    return f"""
  union all select line, '{key} is no list of names' from j where coalesce({_t(key)}, 'NULL') <> 'NULL' and not coalesce({plain}, false)
  union all select line, '{key} names a view twice' from j where {plain} and len({named}) <> len(list_distinct({named}))
  union all select line, '{key} has undeclared views: ' || array_to_string(list_sort({other}), ', ') from j where {plain} and len({named}) = len(list_distinct({named})) and len({other}) > 0"""


@query(f"""with {_SUB}, {_TREE}, manifest as ({_MANIFEST}),
j as (select ok.line, raw, {_s("query_id")} as q, {_s("cell_id")} as c, {_s("tier")} as tier, {_s("cost_menu")} as menu, {_ACTS} as acts, {_s("route")} as route, m.query_id as mq, m.tier as mtier, m.cost_menu as mmenu, m.views as mviews,
  case when m.views is null or m.views = '' then {_VIEWS} else list_filter({_VIEWS}, lambda x: list_contains(string_split(m.views, ','), x)) end as views
  from ok left join manifest m on m.query_id = {_s("query_id")} and m.cell_id = {_s("cell_id")}),
e as (select line, 'not a JSON object' as error from sub where line not in (select line from ok)
  union all select line, 'unknown keys: ' || array_to_string(list_sort(list_filter(json_keys(raw), lambda k: not list_contains({list(ROUTE_KEYS)}, k))), ', ') from j where len(list_filter(json_keys(raw), lambda k: not list_contains({list(ROUTE_KEYS)}, k))) > 0
  union all select line, 'no string in query_id' from j where coalesce(q, '') = '' union all select line, 'no string in cell_id' from j where coalesce(c, '') = ''
  union all select line, 'no string in tier' from j where coalesce(tier, '') = '' union all select line, 'no string in cost_menu' from j where coalesce(menu, '') = ''
  union all select line, 'tier isn''t allowed: ' || tier from j where tier not in ('free', 'public') union all select line, 'cost menu isn''t the declared one: ' || menu from j where menu <> 'main'
  union all select line, 'not in the manifest' from j where q is not null and c is not null and mq is null
  union all select line, 'tier differs from the manifest''s: ' || mtier from j where mtier is distinct from tier and mtier is not null
  union all select line, 'cost_menu differs from the manifest''s: ' || mmenu from j where mmenu is distinct from menu and mmenu is not null
  union all select line, 'the manifest''s declared views are no list of names' from j where mviews = ''
  union all select line, 'the manifest''s declared views aren''t in the menu' from j where mviews <> '' and len(views) = 0
  union all select line, 'not one primary action: ' || case when len(acts) = 0 then 'none' else array_to_string(acts, ', ') end from j where len(acts) <> 1
  union all select line, 'no rule for sets of views' from j where list_contains(acts, 'view_set') union all select line, 'no rule for abstaining' from j where list_contains(acts, 'abstain')
  union all select line, 'route is no name' from j where coalesce({_t("route")}, 'NULL') <> 'NULL' and coalesce(route, '') = ''
  union all select line, 'route isn''t declared: ' || route from j where route <> '' and not list_contains(views, route){_list_rules("ranked_views")}{_list_rules("view_set")}
  union all select line, 'abstain is no boolean' from j where {_t("abstain")} <> 'BOOLEAN'
  union all select line, 'runtime_s is no number from 0 up' from j where {_t("runtime_s")} not in ('BIGINT', 'UBIGINT', 'DOUBLE') or try_cast(raw->>'$.runtime_s' as double) < 0
  union all select line, 'the pair was submitted before' from (select line, row_number() over (partition by q, c order by line) as n from j where q is not null and c is not null) where n > 1
  union all select line, 'forbidden keys: ' || string_agg(path, ', ' order by path) from leaking group by line)
select line, error from e""")
def validate_rows(spark, sf_dir):
    """Every fault of every submitted row, by all rules."""
    m = read(spark, sf_dir, "events").where("user_id % 4 <> 0").selectExpr(*[c for c in (
        "concat('q', user_id) as query_id", "concat('c', user_id % 3) as cell_id", "case user_id % 5 when 0 then 'public' when 1 then null else 'free' end as tier", "case when user_id % 7 = 0 then 'old' else 'main' end as cost_menu",
        "case user_id % 6 when 0 then null when 1 then array() when 2 then array('zoom') when 3 then array('click', 'view') else array('signup', 'click', 'view') end as declared_views", "0 as line")]).distinct()
    menu = '{"views": [{"view_id": "signup"}, {"view_id": "click"}, {"view_id": "view"}], "allowed_tiers": ["free", "public"]}'
    return R.faults(_submissions(spark, sf_dir), R.Rules.of(spark, menu, '{"cost_menu": "main"}'), m)


@query(f"""with {_SUB}, m as ({_MANIFEST}), s as (select distinct {_s("query_id")} as q, {_s("cell_id")} as c from ok), j as (select m.query_id, m.cell_id, s.q, s.c, m.views from m full join s on m.query_id = s.q and m.cell_id = s.c)
select 'manifest_only' as fault, count(*) as n from j where q is null and query_id is not null union all select 'reference_only', count(*) from j where query_id is null
union all select 'no_views', count(*) from m where views = '' union all select 'undeclared_views', count(*) from m where len(list_filter(string_split(views, ','), lambda x: not list_contains({_VIEWS}, x))) > 0 and views <> ''""")
def pack_check(spark, sf_dir):
    """Keys that only one side of a pack has, and views that its menu doesn't know."""
    m = read(spark, sf_dir, "events").where("user_id % 4 <> 0").selectExpr("concat('q', user_id) as query_id", "concat('c', user_id % 3) as cell_id", "case user_id % 6 when 0 then null when 1 then '' when 2 then 'zoom' when 3 then 'click,view' else 'signup,click,view' end as views").distinct()
    v = F.try_parse_json("raw")
    s = _submissions(spark, sf_dir).where(F.schema_of_variant(v).startswith("OBJECT")).select(R.text_of(v, "query_id").alias("query_id"), R.text_of(v, "cell_id").alias("cell_id")).distinct()
    known = F.array(*[F.lit(x) for x in _VIEWS])
    other = (F.col("views") != "") & (F.size(F.array_except(F.split("views", ","), known)) > 0)
    keys = K.key_differences(m, s, ["query_id", "cell_id"]).withColumnRenamed("side", "fault")
    views = m.agg(F.count_if(F.col("views") == "").alias("a"), F.count_if(other).alias("b"))
    rows = F.array(F.struct(F.lit("no_views").alias("fault"), F.col("a").alias("n")), F.struct(F.lit("undeclared_views").alias("fault"), F.col("b").alias("n")))
    return keys.unionByName(views.select(F.explode(rows).alias("r")).select("r.*"))
