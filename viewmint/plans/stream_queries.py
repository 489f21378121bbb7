"""Queries that replay the events as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.episodes import episodes, replayed
from ..streaming.streams import event_stream
from .registry import query

_GAP_HOURS, _LATE_HOURS, _ENDINGS = 12, 6, ("error", "purchase")


@query(f"""with w as (select (epoch_us(max(ts)) // 1000 - {_LATE_HOURS} * 3600000) * 1000 as seen from events),
r as (select user_id, event_id, event_type, value, ts, epoch_us(ts) as us, seen from events, w where epoch_us(ts) <= seen),
l as (select *, lag(us) over o as before, lag(event_type) over o as kind from r window o as (partition by user_id order by us, event_id)),
g as (select *, sum((before is null or us - before > {_GAP_HOURS}::bigint * 3600000000 or kind in {_ENDINGS})::int) over (partition by user_id order by us, event_id) as sid from l),
e as (select user_id, min(ts) as start, max(ts) as "end", max(us) as last, max(seen) as seen, count(*) as n, round(sum(value), 4) as total, arg_max(event_type, (us, event_id)) as kind from g group by user_id, sid)
select user_id, start, "end", n, total, case when kind in {_ENDINGS} then kind else 'gap' end as ended_by from e where kind in {_ENDINGS} or last + {_GAP_HOURS}::bigint * 3600000000 <= seen""")
def stateful_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of users, closed by an error, a purchase or 12 quiet hours, as
    far as a watermark of 6 hours gets."""
    events = event_stream(spark, f"{sf_dir}/events.parquet*", 1000)
    found = replayed(episodes(events, f"{_LATE_HOURS} hours", _GAP_HOURS * 3600, _ENDINGS), "episodes")
    return found.select(F.col("key").alias("user_id"), "start", "end", "n", F.round("total", 4).alias("total"), "ended_by")
