"""Queries on evaluation packs, made of the tables' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..menus import FORBIDDEN
from ..operators import packs as K
from .kit_queries import _KIT, _cells
from .rank_queries import _VECTORS, rankings
from .registry import query, read

# Rows of a pack as JSON, in SQL that means the same here and in DuckDB.
_M_RAW = """concat('{"query_id": ', case when k % 23 = 0 then '7' else concat('"q', k, '"') end, ', "cell_id": "c', k % 5, '", "visible_features": ',
  case k % 7 when 0 then '{"margin": 1, "Full Scores": [1]}' when 1 then '{"a": {"oracle-view": 2, "b": [{"label": 1}]}}' else '{"margin": 0.5}' end,
  ', "declared_views": ', case k % 6 when 1 then '[]' when 2 then '"pq"' else '["pq", "full"]' end, case when k % 29 = 0 then '' else '}' end)"""
_R_RAW = """concat('{"query_id": "q', k, '", "cell_id": "c', k % 5, '", "view_scores": ', case k % 8 when 1 then '{}' when 2 then '{"pq": "0.5"}' when 3 then '[1]' when 5 then '{"pq": 0.5, "full": null}' else '{"pq": 0.5, "full": 1}' end, '}')"""


@query("""with o as (select o_orderkey as k from orders), m as (select k as line, k from o where k % 3 <> 0 union all select k + 1000000000, k from o where k % 3 <> 0 and k % 11 = 0),
ok as (select * from m where k % 23 <> 0 and k % 29 <> 0), r as (select k from o where k % 4 <> 0)
select 'manifest' as side, line, 'not a JSON object' as error from m where k % 29 = 0 union all select 'manifest', line, 'query_id and cell_id must be strings' from m where k % 23 = 0 and k % 29 <> 0
union all select 'manifest', line, 'key seen before: q' || k || ', c' || k % 5 from ok where line > 1000000000
union all select 'manifest', line, 'forbidden features: ' || case k % 7 when 0 then '$.visible_features.Full Scores' else '$.visible_features.a.b[0].label, $.visible_features.a.oracle-view' end from ok where k % 7 in (0, 1)
union all select 'manifest', line, 'declared_views must be a list that isn''t empty' from ok where k % 6 in (1, 2)
union all select 'reference', k, 'view_scores must be an object that isn''t empty' from r where k % 8 in (1, 3) union all select 'reference', k, 'view_scores must be numbers' from r where k % 8 in (2, 5)
union all select 'manifest', null, count(distinct k) || ' manifest keys lack a reference row' from ok where k % 4 = 0
union all select 'reference', null, count(*) || ' reference keys aren''t in the manifest' from r where k not in (select k from ok)""")
def pack_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fault of a pack's manifest and reference rows."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    m = o.where("k % 3 <> 0")
    manifest = m.select(F.col("k").alias("line"), F.expr(_M_RAW).alias("raw")).unionByName(m.where("k % 11 = 0").select((F.col("k") + 1000000000).alias("line"), F.expr(_M_RAW).alias("raw")))
    return K.pack_faults(manifest, o.where("k % 4 <> 0").select(F.col("k").alias("line"), F.expr(_R_RAW).alias("raw")), FORBIDDEN)


@query(f"""with {_KIT} select cell_id, 'cell_id,protocol,n_points,summary,cost_menu,visibility_contract' as fields, n as n_points, 'Protocol C' as protocol, 'keep out' as leakage_rule from k""")
def visible_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as methods see them, with the contract attached."""
    cells = _cells(spark, sf_dir).withColumn("cost_menu", F.lit("legacy")).withColumn("seed", F.lit(1))
    seen = K.method_visible(cells, {"protocol": "Protocol C", "visibility_contract": {"leakage_rule": "keep out"}})
    return seen.select("cell_id", F.lit(",".join(seen.columns)).alias("fields"), "n_points", "visibility_contract.protocol", "visibility_contract.leakage_rule")


@query(f"""with {_VECTORS}, a as (select vec_id as key, label, x[1] > 0.1 as topology, x[2] >= 0 as geometry, x[3] - 0.0464::double as gain, x[3] - 0.0464::double > 0 as routing from e),
p as (select view, x.topology <> y.topology as topology, x.geometry <> y.geometry as geometry, x.routing <> y.routing as routing, abs(x.gain - y.gain) as gap from rk join a x on x.key = qid join a y on y.key = did where rank <= 5 and view in ('full', 'binary'))
select 'label' as kind, label::varchar as name, count(*) as n, round(avg(topology::int), 6) as topology, round(avg(geometry::int), 6) as geometry, round(avg(routing::int), 6) as routing, null::double as gap from a group by label
union all select 'pair', view, count(*), round(avg(topology::int), 6), round(avg(geometry::int), 6), round(avg(routing::int), 6), round(avg(gap), 6) from p group by view""")
def action_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators by label, and how often near neighbours differ in them."""
    x = lambda i: F.get("embedding", F.lit(i)).cast("double")
    gain = x(2) - 0.0464
    cells = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "label", (x(0) > 0.1).alias("topology"), (x(1) >= 0).alias("geometry"), (gain > 0).alias("routing"), gain.alias("gain"))
    pairs = rankings(spark, sf_dir, "full", "binary").select(F.col("view").alias("representation"), F.col("qid").alias("query"), F.col("did").alias("neighbor"), "rank")
    by_label = K.label_shares(cells).select(F.lit("label").alias("kind"), F.col("label").cast("string").alias("name"), "n", *K.INDICATORS, F.lit(None).cast("double").alias("gap"))
    return by_label.unionByName(K.pair_disagreement(cells, pairs).select(F.lit("pair").alias("kind"), F.col("representation").alias("name"), "n", *K.INDICATORS, "gap"))
