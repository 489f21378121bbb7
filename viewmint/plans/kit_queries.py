"""Legacy challenge cells: suppliers' returned lines are a cell's points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import kit as K
from .geometry_queries import _POINTS, _sides
from .registry import query, read

_PHASES = "ph as (select s_suppkey as cell, case s_suppkey % 4 when 0 then 'Decision-limited' when 1 then 'Optimization barrier' when 2 then 'collapsed' else 'open' end as phase from supplier)"
_COND = "((vxx + vyy) / 2 + sqrt(pow((vxx - vyy) / 2, 2) + pow(vxy, 2))) / greatest((vxx + vyy) / 2 - sqrt(pow((vxx - vyy) / 2, 2) + pow(vxy, 2)), 1e-8::double)"
_KIT = f"""{_POINTS}, {_PHASES}, m as (select cell, count(*) as n, avg(x) as mx, avg(y) as my, var_pop(x) as vxx, var_pop(y) as vyy, covar_pop(x, y) as vxy from a group by cell),
k as (select *, case when phase like 'Opt%' or {_COND} >= 5 then 'point' when phase like 'Dec%' then 'raster' when phase like 'coll%' or {_COND} < 1.5::double then 'moments' else 'occupancy' end as best, 'pb_' || lpad(cell::varchar, 5, '0') as cell_id from m join ph using (cell))"""


def _phases(spark, sf_dir):
    s = F.col("s_suppkey") % 4
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell"), F.when(s == 0, "Decision-limited").when(s == 1, "Optimization barrier").when(s == 2, "collapsed").otherwise("open").alias("phase"))


def _cells(spark, sf_dir):
    return K.cells(_sides(spark, sf_dir)[0], _phases(spark, sf_dir))


@query(f"""with {_KIT} select cell_id, n as n_points, round(round(mx, 6), 4) as mx, round(round(my, 6), 4) as my, round(round(vxx, 6), 4) as vxx, round(round(vxy, 6), 4) as vxy, round(round(vyy, 6), 4) as vyy, best as oracle_view,
  case when best = 'moments' then 0.82 else 0.45 end::double as u_moments, case when best = 'occupancy' then 0.82 when best = 'moments' then 0.65 else 0.55 end::double as u_occupancy,
  case when best = 'raster' then 0.82 when best = 'point' then 0.70 else 0.62 end::double as u_raster, case when best = 'point' then 0.82 else 0.68 end::double as u_point, 0.0::double as u_abstain from k""")
def gen_cells(spark, sf_dir):
    c = _cells(spark, sf_dir)
    r = lambda x: F.round(x, 4)
    cov = lambda i, j: F.get(F.get("summary.covariance", F.lit(i)), F.lit(j))
    at = lambda i: F.get("summary.mean", F.lit(i))
    return c.select("cell_id", "n_points", r(at(0)).alias("mx"), r(at(1)).alias("my"), r(cov(0, 0)).alias("vxx"), r(cov(0, 1)).alias("vxy"), r(cov(1, 1)).alias("vyy"), "oracle_view", *[F.col("view_utilities")[v].alias(f"u_{v}") for v, _ in K.UTILITIES])


@query(f"with {_KIT} select cell_id, 'cell_id,protocol,n_points,summary' as public_fields, 'cell_id,oracle_view,view_utilities' as hidden_fields, n as n_points, best as oracle_view from k")
def split_hidden(spark, sf_dir):
    """Public and hidden halves of each cell."""
    public, hidden = K.split_hidden(_cells(spark, sf_dir))
    return public.withColumn("public_fields", F.lit(",".join(public.columns))).join(hidden.withColumn("hidden_fields", F.lit(",".join(hidden.columns))), "cell_id").select("cell_id", "public_fields", "hidden_fields", "n_points", "oracle_view")


# Submissions as JSON, with every fault, in SQL that means the same here and in
# DuckDB: two points a cell that is an order of two lines.
_SUB = """concat('{"cell_id": "', case when o_orderkey % 17 = 0 then 'nowhere' else concat('c', o_orderkey) end, '"', case o_orderkey % 5 when 0 then ', "route": "point"' when 1 then ', "route": "zoom"' else '' end,
  case o_orderkey % 7 when 0 then ', "ranked_views": ["point", "raster"]' when 1 then ', "ranked_views": ["point", "point"]' when 2 then ', "ranked_views": ["xray"]' else '' end,
  case o_orderkey % 6 when 0 then ', "points": [[1, 2], [3, 4.5]]' when 1 then ', "candidate": [[1, 2], [3, 4]]' when 2 then ', "candidates": [{"points": [[0, 0], [1, 1]]}]' when 3 then ', "points": [[1, 2]]' when 4 then ', "points": [[1, 2], [3]]' else '' end, '}')"""


@query(f"""with s as (select o_orderkey as line, {_SUB} as raw from orders where o_orderkey % 3 <> 0 union all select o_orderkey + 1000000000, {_SUB} from orders where o_orderkey % 11 = 0 and o_orderkey % 3 <> 0),
k as (select 'c' || o_orderkey::varchar as cell_id from orders), r as (select line, raw->>'$.cell_id' as cell_id, raw->>'$.route' as route, cast(coalesce(raw->'$.ranked_views', '[]') as varchar[]) as rv, replace(raw->>'$.cell_id', 'c', '') as o from s),
v as (select r.cell_id, case when k.cell_id is null then 'unknown cell' when line > min(line) over (partition by r.cell_id) then 'duplicate' when route not in ('moments', 'occupancy', 'raster', 'point', 'abstain') then 'unknown route'
  when list_contains(rv, 'xray') or len(rv) <> len(list_distinct(rv)) then 'bad ranked views' when o::bigint % 6 >= 3 then 'bad points' else 'ok' end as verdict from (select *, case when o = 'nowhere' then null else o end as oo from r) r left join k on k.cell_id = r.cell_id)
select cell_id, verdict from v union all select cell_id, 'missing' from k where cell_id not in (select cell_id from r)""".replace("o::bigint", "try_cast(o as bigint)"))
def legacy_validate(spark, sf_dir):
    """The first fault of every submitted cell, and cells that nobody sent."""
    o = read(spark, sf_dir, "orders", "o_orderkey")
    sent = o.where("o_orderkey % 3 <> 0").withColumn("raw", F.expr(_SUB))
    rows = sent.select(F.col("o_orderkey").alias("line"), "raw").unionByName(sent.where("o_orderkey % 11 = 0").select((F.col("o_orderkey") + 1000000000).alias("line"), "raw"))
    known = o.select(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("cell_id"), F.lit(2).alias("n_points"))
    return K.validate(rows, known)


# Submitted points are the hidden ones, moved by a hundredth in every third cell
# and missing a point in every fourth.
_SCORED = f"""{_KIT}, made as (select a.cell, idx, x + case when a.cell % 3 = 0 then 0.5 else 0 end as x, y, cell_id, n, m0.mx, m0.my, m0.vxx, m0.vyy, m0.vxy from a join k m0 on m0.cell = a.cell),
ok as (select * from made where cell % 4 <> 0), om as (select cell, avg(x) as ax, avg(y) as ay, var_pop(x) as bxx, var_pop(y) as byy, covar_pop(x, y) as bxy, any_value(mx) as mx, any_value(my) as my, any_value(vxx) as vxx, any_value(vyy) as vyy, any_value(vxy) as vxy from ok group by cell),
e as (select cell, round(greatest(abs(ax - round(mx, 6)), abs(ay - round(my, 6))), 4) as mean_error, round(greatest(abs(bxx - round(vxx, 6)), abs(byy - round(vyy, 6)), abs(bxy - round(vxy, 6))), 4) as cov_error from om),
sc as (select k.cell_id, e.cell is not null as valid, coalesce(mean_error <= 0.01::double and cov_error <= 0.01::double, false) as feasible, mean_error, cov_error from k left join e using (cell))"""


def _submitted(spark, sf_dir):
    a = _sides(spark, sf_dir)[0]
    cell_id = F.concat(F.lit("pb_"), F.lpad(F.col("cell").cast("string"), 5, "0"))
    listed = lambda rows: F.transform(F.array_sort(F.collect_list(rows)), lambda s: F.array(s["x"], s["y"]))
    target = a.groupBy("cell").agg(listed(F.struct("idx", "x", "y")).alias("target"))
    moved = F.transform("target", lambda p: F.array(F.get(p, F.lit(0)) + F.when(F.col("cell") % 3 == 0, 0.5).otherwise(0.0), F.get(p, F.lit(1))))
    points = F.when(F.col("cell") % 4 == 0, F.slice(moved, F.lit(2), F.size("target"))).otherwise(moved)
    raw = F.when(F.col("cell") % 2 == 0, F.to_json(F.struct(points.alias("points")))).otherwise(F.to_json(F.struct(F.array(F.struct(points.alias("points"))).alias("candidates"))))
    cells = _cells(spark, sf_dir).select("cell_id", "n_points", F.col("summary.mean").alias("mean"), F.col("summary.covariance").alias("covariance"), F.col("summary.tolerance").alias("tolerance"))
    rows = target.select(cell_id.alias("cell_id"), raw.alias("raw"), "target")
    return rows.select("cell_id", "raw"), cells.join(rows.select("cell_id", "target"), "cell_id")


@query(f"with {_SCORED} select cell_id, valid, feasible, mean_error, cov_error from sc")
def legacy_cell_metrics(spark, sf_dir):
    r = lambda c: F.round(c, 4).alias(c)
    return K.cell_metrics(*_submitted(spark, sf_dir)).select("cell_id", "valid", "feasible", r("mean_error"), r("cov_error"))


@query(f"with {_SCORED} select count(*) as n_cells, round(avg(valid::int::double), 6) as valid_rate, round(avg(feasible::int::double), 6) as feasible_rate from sc")
def legacy_outputs(spark, sf_dir):
    return K.summary(K.cell_metrics(*_submitted(spark, sf_dir))).select("n_cells", "valid_rate", "feasible_rate")


_U = "(('0x' || substr(md5('9{0}:' || cell::varchar || ':' || idx::varchar), 1, 8))::bigint + 0.5::double) / 4294967296.0::double"


@query(f"""with {_KIT}, p as (select *, sqrt(-2 * ln({_U.format("r")})) as r, 2 * pi() * {_U.format("a")} as t, sqrt(greatest(vxx, 1e-12::double)) as l11 from k, (select unnest(range(16)) as idx)),
q as (select *, vxy / l11 as l21 from p) select cell, idx::int as idx, round(mx + l11 * r * cos(t), 4) as x, round(my + l21 * r * cos(t) + sqrt(greatest(vyy - l21 * l21, 0)) * r * sin(t), 4) as y from q""")
def support_points(spark, sf_dir):
    m = G.moments(_sides(spark, sf_dir)[0]).join(_phases(spark, sf_dir).select("cell"), "cell")
    return K.support_points(m, 16, 9).select("cell", "idx", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"with {_POINTS}, m as (select cell, least(count(*), 16) as n, avg(x) as mx, avg(y) as my, var_pop(x) as vxx, var_pop(y) as vyy from a group by cell having count(*) > 3) select cell, n, round(mx, 3) as mx, round(my, 3) as my, round(vxx, 2) as vxx, round(vyy, 2) as vyy from m")
def canonical_target(spark, sf_dir):
    """Moments of the targets: those of their cells."""
    a = _sides(spark, sf_dir)[0]
    big = a.join(a.groupBy("cell").count().where("count > 3").select("cell"), "cell")
    m = G.moments(K.canonical_target(big, 16))
    return m.select("cell", "n", *[F.round(c, 3).alias(c) for c in ("mx", "my")], *[F.round(c, 2).alias(c) for c in ("vxx", "vyy")])
