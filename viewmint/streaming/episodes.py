"""Episodes of events, by keyed state and timers.

An episode is a run of a key's events with no gap longer than asked for; an
event of an ending type closes it at once.  Events wait in the key's state until
the watermark has passed them and are then taken in order of time, however they
arrived; a timer closes an episode when the watermark has passed its gap.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.lineage import scratch

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "key long, start_us long, end_us long, n long, total double, ended_by string"


class _Episodes(StatefulProcessor):
    def __init__(self, gap_us: int, endings: tuple[str, ...]):
        self.gap, self.endings = gap_us, endings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, id long, kind string, value double")
        self.open = handle.getValueState("open", "start long, end long, n long, total double")

    def _wake(self, us: int) -> None:
        # a timer fires when the watermark is past it: at the millisecond that holds ``us``, or later
        self.handle.registerTimer(max(-(-us // 1000) - 1, 0))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = timerValues.getCurrentWatermarkInMs() * 1000
        first = None
        for batch in rows:
            new = [(int(u), int(i), k, float(v)) for u, i, k, v in zip(batch.us, batch.id, batch.kind, batch.value) if u > seen]
            if new:
                self.waiting.appendList(new)
                first = min([r[0] for r in new] + ([] if first is None else [first]))
        if first is not None:
            self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get())
        due, rest = [r for r in rows if r[0] <= seen], [r for r in rows if r[0] > seen]
        state = self.open.get() if self.open.exists() else None
        out = []
        for us, _, kind, value in due:
            if state and us - state[1] > self.gap:
                out.append((*state, "gap"))
                state = None
            state = (us, us, 1, value) if state is None else (state[0], us, state[2] + 1, state[3] + value)
            if kind in self.endings:
                out.append((*state, kind))
                state = None
        if state and state[1] + self.gap <= seen:
            out.append((*state, "gap"))
            state = None
        if due:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        if state:
            self.open.update(state)
        elif self.open.exists():
            self.open.clear()
        again = [rest[0][0]] if rest else []
        again += [state[1] + self.gap] if state else []
        if again:
            self._wake(min(again))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["key", "start_us", "end_us", "n", "total", "ended_by"])

    def close(self) -> None:
        pass


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in files, not on the heap."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def episodes(events: DataFrame, late: str, gap_seconds: int, endings: tuple[str, ...], key: str = "user_id", time: str = "ts", id_col: str = "event_id", kind: str = "event_type", value: str = "value") -> DataFrame:
    """(key, start, end, n, total, ended_by) of a stream's episodes.

    ``ended_by`` is the ending event's type or ``gap``.  Events of one time go
    by their ids.  Rows behind the watermark, which follows the latest event by
    ``late``, are left out; rows without a key, a time or an id too; a null
    value counts as 0.  Start the query inside :func:`state_on_disk`.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(id_col).isNotNull()).withWatermark(time, late)
    rows = rows.select(
        F.col(key).cast("long").alias("key"), time, F.unix_micros(F.col(time)).alias("us"), F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(kind), F.lit("")).alias("kind"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value"),
    )
    made = rows.groupBy("key").transformWithStateInPandas(_Episodes(gap_seconds * 1_000_000, endings), _OUT, "append", "eventTime")
    return made.select("key", F.timestamp_micros("start_us").alias("start"), F.timestamp_micros("end_us").alias("end"), "n", "total", "ended_by")


def replayed(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what is there into files of the shared folder, each
    row once, and reads them."""
    spark = stream.sparkSession
    path = scratch(spark, name)
    with state_on_disk(spark):
        running = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
        running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
