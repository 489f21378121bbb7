"""Episodes by keyed state: events out of order, late ones, and odd rows."""

from __future__ import annotations

import datetime as dt

import pytest

from viewmint.streaming.episodes import episodes, replayed
from viewmint.streaming.streams import event_stream

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
KINDS = ["view", "click", "end"]


def _at(minute):
    return START + dt.timedelta(minutes=minute)


def _want(files, late, gap, endings):
    """Episodes as far as the watermark gets, with rows behind it left out."""
    seen, taken = None, []
    for rows in files:
        taken += [r for r in rows if None not in (r[0], r[1], r[2]) and (seen is None or r[1] > seen)]
        latest = max((r[1] for r in rows if None not in (r[0], r[1], r[2])), default=None)
        if latest is not None and (seen is None or latest - late > seen):
            seen = latest - late
    out, state = [], {}
    for t, i, user, kind, value in sorted(((r[1], r[2], r[0], r[3] or "", r[4] or 0.0) for r in taken)):
        if t > seen:
            continue
        s = state.pop(user, None)
        if s and t - s[1] > gap:
            out.append((user, *s, "gap"))
            s = None
        s = (s[0], t, s[2] + 1, s[3] + value) if s else (t, t, 1, value)
        if kind in endings:
            out.append((user, *s, kind))
        else:
            state[user] = s
    out += [(u, *s, "gap") for u, s in state.items() if s[1] + gap <= seen]
    return sorted((u, a, b, n, pytest.approx(v), k) for u, a, b, n, v, k in out)


def test_events_out_of_order_and_late(spark, tmp_path):
    import random
    import time

    draw = random.Random(11)
    minutes = [sorted(draw.sample(range(b * 400, b * 400 + 520), 90)) for b in range(4)]  # files overlap in time
    files, i = [], 0
    for part in minutes:
        rows = []
        for m in part:
            i += 1
            rows.append((draw.randint(1, 4), _at(m), i, draw.choice(KINDS + ["view"] * 6), draw.choice([1.5, None, 2.0])))
        draw.shuffle(rows)
        files.append(rows)
    files[2] += [(1, _at(5), 9001, "view", 7.0), (None, _at(900), 9002, "view", 1.0), (2, None, 9003, "view", 1.0), (9, _at(1000), None, "view", 1.0), (3, _at(1010), 9004, None, None)]
    schema = "user_id long, ts timestamp, event_id long, event_type string, value double"
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        time.sleep(1.1)  # files are taken in order of their times
    stream = episodes(event_stream(spark, str(tmp_path / "e"), 1), "60 minutes", 30 * 60, ("end",))
    got = sorted((r["key"], r["start"].replace(tzinfo=dt.timezone.utc), r["end"].replace(tzinfo=dt.timezone.utc), r["n"], r["total"], r["ended_by"]) for r in replayed(stream, "test").collect())
    want = _want(files, dt.timedelta(minutes=60), dt.timedelta(minutes=30), ("end",))
    assert len(got) > 40 and {r[5] for r in got} == {"gap", "end"}
    assert got == want
