"""Point sets: an order is a cell, its lines are points (quantity, price)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import geometry as G
from .registry import query, read

_POINTS = """pts as (select l_suppkey as cell, l_orderkey * 10 + l_linenumber as k, l_returnflag, l_quantity as x, l_extendedprice / 1000 as y from lineitem),
uniq as (select cell, k as idx, l_returnflag, avg(x) as x, avg(y) as y from pts group by all),
a as (select cell, idx, x, y from uniq where l_returnflag = 'R'), b as (select cell, idx, x, y from uniq where l_returnflag <> 'R')"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_suppkey").alias("cell"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), "l_returnflag").agg(
        F.avg("l_quantity").alias("x"), F.avg(F.col("l_extendedprice") / 1000).alias("y")
    )


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = _points(spark, sf_dir)
    return p.where("l_returnflag = 'R'").drop("l_returnflag"), p.where("l_returnflag <> 'R'").drop("l_returnflag")


_MOM = f"with {_POINTS}, m as (select cell, count(*) as n, avg(x) as mx, avg(y) as my, var_pop(x) as vxx, var_pop(y) as vyy, covar_pop(x, y) as vxy from a group by cell)"


@query(_MOM + " select cell, n, round(mx, 6) as mx, round(my, 6) as my, round(vxx, 5) as vxx, round(vyy, 5) as vyy, round(vxy, 5) as vxy from m")
def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = G.moments(_sides(spark, sf_dir)[0])
    return m.select("cell", "n", *[F.round(c, 6).alias(c) for c in ("mx", "my")], *[F.round(c, 5).alias(c) for c in ("vxx", "vyy", "vxy")])


@query(_MOM + """, e as (select *, (vxx + vyy) / 2 as h, sqrt(pow((vxx - vyy) / 2, 2) + pow(vxy, 2)) as r from m), f as (select *, h + r as big, greatest(h - r, 1e-12::double) as small from e)
select cell, round(2 * h, 6) as trace, round(vxx * vyy - pow(vxy, 2), 4) as det, round(big / small, 4) as condition, round((big - small) / greatest(big + small, 1e-12::double), 6) as anisotropy from f""")
def feat_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.budget_features(G.moments(_sides(spark, sf_dir)[0]))


_NEAR = """na as (select a.cell, a.idx, sqrt(min(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) as d from a join b on a.cell = b.cell group by all),
nb as (select b.cell, b.idx, sqrt(min(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) as d from a join b on a.cell = b.cell group by all)"""


@query(f"""with {_POINTS}, {_NEAR}, s as (select cell, sqrt(greatest(var_pop(x) + var_pop(y), 1e-12::double)) as s from b group by cell),
x as (select cell, avg(d) as ab from na group by cell), y as (select cell, avg(d) as ba from nb group by cell)
select cell, round((ab + ba) / 2 / s, 6) as chamfer from x join y using (cell) join s using (cell)""")
def chamfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.chamfer(*_sides(spark, sf_dir))


@query(f"""with {_POINTS}, {_NEAR}, x as (select cell, avg(d * d) as ab from na group by cell), y as (select cell, avg(d * d) as ba from nb group by cell)
select cell, round(ab + ba, 4) as chamfer from x join y using (cell)""")
def chamfer_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.chamfer(*_sides(spark, sf_dir), squared=True)


_OWN = "own as (select p.cell, p.idx, sqrt(min(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))) as d from b p join b q on p.cell = q.cell and p.idx <> q.idx group by all)"


@query(f"with {_POINTS}, {_NEAR}, {_OWN}, r as (select cell, quantile_cont(d, 0.5) as r from own group by cell) select cell, round(avg((d <= r)::int::double), 6) as coverage from nb join r using (cell) group by cell")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.coverage(*_sides(spark, sf_dir))


@query(f"with {_POINTS}, {_OWN} select cell, round(stddev_pop(d) / greatest(avg(d), 1e-12::double), 6) as uniformity from own group by cell")
def uniformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.uniformity(_sides(spark, sf_dir)[1])


_RASTER = "(select distinct cell, floor((x - lx) / greatest(hx - lx, 1e-12::double) * 63)::int as i, floor((y - ly) / greatest(hy - ly, 1e-12::double) * 63)::int as j from {0} join (select cell, min(x) as lx, max(x) as hx, min(y) as ly, max(y) as hy from {0} group by cell) using (cell))"


@query(f"""with {_POINTS}, ra as {_RASTER.format("a")}, rb as {_RASTER.format("b")},
m as (select coalesce(ra.cell, rb.cell) as cell, (ra.cell is not null and rb.cell is not null)::int as both_ from ra full join rb on ra.cell = rb.cell and ra.i = rb.i and ra.j = rb.j)
select cell, round(sum(both_) / count(*), 6) as iou, round((count(*) - sum(both_)) / count(*), 6) as xor from m group by cell""")
def raster_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.raster_overlap(*_sides(spark, sf_dir))


@query(f"""with {_POINTS}, u as (select cell, 1 as side, x, y from a union all select cell, -1, x, y from b),
p as (select p.cell, p.side, q.side as t, pow(p.x - q.x, 2) + pow(p.y - q.y, 2) as d2 from u p join u q on p.cell = q.cell),
w as (select cell, quantile_cont(d2, 0.5) as w from p where d2 > 0 group by cell), n as (select cell, count(*) filter (where side = 1) as na, count(*) filter (where side = -1) as nb from u group by cell)
select cell, round(sum(side * t * exp(-d2 / (2 * w)) / ((case when side = 1 then na else nb end) * (case when t = 1 then na else nb end))), 6) as mmd from p join w using (cell) join n using (cell) group by cell""")
def mmd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.rbf_mmd(*_sides(spark, sf_dir))


@query(f"""with {_POINTS}, m as (select cell, avg(x) as mx, avg(y) as my, var_pop(x) as vxx, var_pop(y) as vyy, count(*) as n from a group by cell having count(*) > 2)
select cell, n, round(mx, 3) as mx, round(my, 3) as my, round(vxx, 2) as vxx, round(vyy, 2) as vyy from m where cell in (select cell from b group by cell having count(*) > 2)""")
def affine_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of one side moved to the moments of the other; the moments then."""
    a, b = _sides(spark, sf_dir)
    moved = G.affine_match(b.join(b.groupBy("cell").count().where("count > 2").select("cell"), "cell"), G.moments(a).where("n > 2"))
    n = G.moments(a).select("cell", F.col("n").alias("na"))
    return G.moments(moved).join(n, "cell").select("cell", F.col("na").alias("n"), *[F.round(c, 3).alias(c) for c in ("mx", "my")], *[F.round(c, 2).alias(c) for c in ("vxx", "vyy")])


@query()
def fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.farthest_points(_sides(spark, sf_dir)[0], 8)


_PATHS = "ev as (select user_id as cell, row_number() over (partition by user_id order by ts, event_id) as idx, epoch(ts) / 86400.0 as x, value as y from events)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("cell"), F.row_number().over(order).alias("idx"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 86400).alias("x"), F.col("value").alias("y"))


@query(f"""with {_PATHS}, d as (select *, x - lag(x) over w as dx, y - lag(y) over w as dy from ev window w as (partition by cell order by idx)),
t as (select *, (sign(dy) * sign(lag(dy) over (partition by cell order by idx)) < 0)::int as turn from d)
select cell, round(max(x) - min(x), 6) as width, round(max(y) - min(y), 6) as height, round(sum(sqrt(dx * dx + dy * dy)), 6) as path, coalesce(sum(turn), 0)::bigint as turns from t group by cell""")
def feat_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.structure(_paths(spark, sf_dir))


@query(f"""with {_PATHS} select cell, round(arg_min(y, idx), 6) as first_y, round(arg_max(y, idx), 6) as last_y, count(*) as steps from ev group by cell""")
def archetypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last state of each trajectory."""
    return _paths(spark, sf_dir).groupBy("cell").agg(F.round(F.min_by("y", "idx"), 6).alias("first_y"), F.round(F.max_by("y", "idx"), 6).alias("last_y"), F.count(F.lit(1)).alias("steps"))


@query(f"""with {_POINTS}, c as (select cell, avg(x) as cx, avg(y) as cy from a group by cell)
select cell, idx, row_number() over (partition by cell order by round(atan2(y - cy, x - cx), 9), round(sqrt(pow(x - cx, 2) + pow(y - cy, 2)), 9), idx) as place from a join c using (cell)""")
def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Around the centroid by angle, then by radius."""
    a = _sides(spark, sf_dir)[0]
    c = a.groupBy("cell").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    order = Window.partitionBy("cell").orderBy(F.round(F.atan2(dy, dx), 9), F.round(F.sqrt(F.pow(dx, 2) + F.pow(dy, 2)), 9), "idx")
    return a.join(c, "cell").select("cell", "idx", F.row_number().over(order).cast("long").alias("place"))
