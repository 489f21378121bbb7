"""Diagnostic terrain of customer cells (nation and segment), labelled by region."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import terrain as T
from .geometry_queries import _paths
from .registry import query, read

_CELLS = """cells as (select c_nationkey::varchar || '|' || c_mktsegment as cell, n_regionkey as phase, count(*) as n, round(avg(c_acctbal), 6) as mean, round(max(c_acctbal) - min(c_acctbal), 6) as spread,
  round(avg((c_acctbal < 0)::int::double), 6) as neg, round(stddev_pop(c_acctbal), 6) as sd, sum((c_acctbal > 5000)::int::double) as rich from customer join nation on c_nationkey = n_nationkey group by c_nationkey, c_mktsegment, n_regionkey)"""


def _cells(spark, sf_dir):
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    b = F.col("c_acctbal")
    return c.groupBy("c_nationkey", "c_mktsegment", F.col("n_regionkey").alias("phase")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(b), 6).alias("mean"), F.round(F.max(b) - F.min(b), 6).alias("spread"), F.round(F.avg((b < 0).cast("double")), 6).alias("neg"),
        F.round(F.stddev_pop(b), 6).alias("sd"), F.sum((b > 5000).cast("double")).alias("rich"),
    ).select(F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("cell"), "phase", "n", "mean", "spread", "neg", "sd", "rich")


_GROUPS = {"divergence": ["spread", "sd", "n", "1 - neg"], "barrier": ["mean", "1 - rich", "neg"], "sensitivity": ["abs(mean - 4500)", "sd", "neg", "n"]}


def _axis_sql() -> str:
    ranks, means, spans = [], [], []
    for name, parts in _GROUPS.items():
        ranks += [f"(rank() over (order by round({p}, 9)) + (count(*) over (partition by round({p}, 9)) - 1) / 2.0::double) / count(*) over () as {name}_{i}" for i, p in enumerate(parts)]
        means.append(f"round(({' + '.join(f'{name}_{i}' for i in range(len(parts)))}) / {len(parts)}, 9) as m_{name}")
        spans.append(f"round((m_{name} - min(m_{name}) over ()) / (max(m_{name}) over () - min(m_{name}) over ()), 9) as {name}")
    return f"{_CELLS}, pr as (select *, {', '.join(ranks)} from cells), mn as (select *, {', '.join(means)} from pr), ax as (select *, {', '.join(spans)} from mn)"


def _axes(spark, sf_dir):
    return T.axes(_cells(spark, sf_dir), {name: [F.expr(p) for p in parts] for name, parts in _GROUPS.items()})


@query(f"with {_axis_sql()} select cell, phase, round(divergence, 6) as divergence, round(barrier, 6) as barrier, round(sensitivity, 6) as sensitivity, round(1 - barrier, 6) as reachability from ax")
def terrain_axes(spark, sf_dir):
    r = lambda c: F.round(c, 6)
    return _axes(spark, sf_dir).select("cell", "phase", r("divergence").alias("divergence"), r("barrier").alias("barrier"), r("sensitivity").alias("sensitivity"), r(1 - F.col("barrier")).alias("reachability"))


@query(f"""with {_axis_sql()}, d as (select a.cell, a.phase, b.phase as other, avg(sqrt(pow(a.divergence - b.divergence, 2) + pow(a.barrier - b.barrier, 2) + pow(a.sensitivity - b.sensitivity, 2))) as d from ax a join ax b on a.cell <> b.cell group by all),
s as (select cell, max(case when phase = other then d end) as own, min(case when phase <> other then d end) as nxt from d group by cell)
select round(avg(case when own is null then 0 else (nxt - own) / greatest(own, nxt) end), 6) as silhouette, count(*) as cells from s""")
def silhouette(spark, sf_dir):
    """Three axes, cells labelled by region."""
    return T.silhouette(_axes(spark, sf_dir), ["divergence", "barrier", "sensitivity"], "phase", "cell")


_LABELS = {"action": "action", "topology": "topology", "random": "random"}
_FRAGILE = f"""{_CELLS}, lab as (select *, mean > 4500 as action, n % 3 as topology, ('0x' || substr(md5('5:' || cell), 1, 8))::bigint % 2 as random from cells),
pr as (select a.cell as query, b.cell as neighbour from lab a join lab b on a.cell <> b.cell qualify row_number() over (partition by a.cell order by round(abs(a.mean - b.mean) + abs(a.spread - b.spread), 6), b.cell) <= 5),
met as (select query, (q.action <> n.action)::int::double as da, (q.topology <> n.topology)::int::double as dt, (q.random <> n.random)::int::double as dr, round(abs(q.sd - n.sd), 9) as shift from pr join lab q on q.cell = query join lab n on n.cell = neighbour),
cut as (select quantile_cont(shift, 0.75) as cut from met),
per as (select query as cell, round(avg(da), 6) as action_fragility, round(avg(dt), 6) as topology_fragility, round(avg(dr), 6) as random_fragility, round(avg((shift >= cut)::int::double), 6) as geometry_fragility, round(avg(shift), 6) as geometry_shift from met, cut group by query),
fl as (select cell, action_fragility, topology_fragility, random_fragility, geometry_fragility, geometry_shift, {", ".join(f"({n}_fragility >= (select quantile_cont({n}_fragility, 0.75) from per) and {n}_fragility > 0)::int as high_{n}_fragility" for n in ("action", "topology", "random", "geometry"))} from per)"""


def _fragile(spark, sf_dir):
    h = F.conv(F.substring(F.md5(F.concat(F.lit("5:"), "cell")), 1, 8), 16, 10).cast("long") % 2
    cells = _cells(spark, sf_dir).withColumns({"action": F.col("mean") > 4500, "topology": F.col("n") % 3, "random": h})
    b = cells.select(F.col("cell").alias("neighbour"), F.col("mean").alias("m2"), F.col("spread").alias("s2"))
    near = F.round(F.abs(F.col("mean") - F.col("m2")) + F.abs(F.col("spread") - F.col("s2")), 6)
    order = Window.partitionBy("cell").orderBy(near, "neighbour")
    pairs = cells.crossJoin(b).where("cell != neighbour").withColumn("k", F.row_number().over(order)).where("k <= 5").select(F.col("cell").alias("query"), "neighbour")
    return T.fragility(pairs, cells, "cell", _LABELS, "sd")


@query(f"with {_FRAGILE} select * from fl")
def fragility(spark, sf_dir):
    """How far a cell's five nearest differ from it in labels and geometry."""
    return _fragile(spark, sf_dir)


_FLAGS = [f"high_{n}_fragility" for n in ("action", "topology", "random", "geometry")]


@query(f"with {_FRAGILE}, j as (" + " union all ".join(f"select '{a}' as a, '{b}' as b, round(sum({a} * {b}) / greatest(sum(greatest({a}, {b})), 1), 6) as jaccard from fl" for i, a in enumerate(_FLAGS) for b in _FLAGS[i + 1 :]) + ") select * from j")
def fragility_overlap(spark, sf_dir):
    return T.flag_overlap(_fragile(spark, sf_dir), _FLAGS)


@query()
def archetype_clusters(spark, sf_dir):
    """Clusters and principal components of trajectories' first and last states."""
    p = _paths(spark, sf_dir).groupBy("cell").agg(F.min_by("y", "idx").alias("first"), F.max_by("y", "idx").alias("last"), F.avg("y").alias("mean"), F.count(F.lit(1)).cast("double").alias("steps"))
    return T.run_archetypes(p.withColumn("moved", F.col("last") - F.col("first")), ["first", "last", "moved", "mean", "steps"], "cell")
