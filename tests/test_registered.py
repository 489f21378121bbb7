"""Registered functions and users' solvers, against loops written by hand."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from viewmint.functions import registered as R


def test_discordance_of_odd_groups(spark):
    R.register(spark)
    groups = {1: [(1, 1), (2, 2), (3, 3)], 2: [(3, 1), (2, 2), (1, 3)], 3: [(1, 3), (1, 2), (2, 2)], 4: [(1, 1)], 5: [(None, 1), (2, None)], 6: [(5, 5)] * 9, 7: [(1.5, 2), (None, 9), (0.5, 3), (2.5, 1), (2.0, 2)]}
    rows = [(g, None if s is None else float(s), None if t is None else float(t)) for g, r in groups.items() for s, t in r]
    spark.createDataFrame(rows, "g long, s double, t double").repartition(3).createOrReplaceTempView("ranked_rows")
    got = {r["g"]: r["d"] for r in spark.sql("select g, discordance(s, t) as d from ranked_rows group by g").collect()}
    for g, r in groups.items():
        known = [p for p in r if None not in p]
        pairs = [(a, b) for i, a in enumerate(known) for b in known[:i] if a[0] != b[0] and a[1] != b[1]]
        want = sum((a[0] - b[0]) * (a[1] - b[1]) < 0 for a, b in pairs) / len(pairs) if pairs else None
        assert got[g] == (want if want is None else pytest.approx(want)), g
    spark.catalog.dropTempView("ranked_rows")


def test_leak_paths_in_sql(spark):
    R.register(spark)
    texts = [None, "", "not json", "[]", '{"a": 1}', '{"Gold Label": {"x": [{"gold-label": 1}, {"gold_label": 2}]}}', '{"gold\\u005flabel": 1}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    found = spark.sql("select i, f.path from {r} as r, lateral leak_paths(text, array('gold_label')) as f", r=rows).collect()
    assert sorted(tuple(r) for r in found) == [(1, "$"), (2, "$"), (5, "$.Gold Label"), (5, "$.Gold Label.x[0].gold-label"), (5, "$.Gold Label.x[1].gold_label"), (6, "$.gold_label")]
    assert spark.sql("select * from {r} as r, lateral leak_paths(text, cast(array() as array<string>)) as f", r=rows.where("i > 2")).count() == 0


def test_solver_from_a_file(spark, tmp_path):
    (tmp_path / "s.py").write_text("import math\n\ndef solve(cell):\n    if cell['n'] == 3:\n        return [1]\n    out = {'root': math.sqrt(cell['n'])}\n    return out | {'cell_id': -1} if cell['n'] == 4 else out\n")
    cells = spark.createDataFrame([(i, json.dumps({"n": i - 2})) for i in range(8)] + [(99, "broken"), (100, None)], "cell_id long, cell string")
    got = {r["cell_id"]: r for r in R.solved(cells, str(tmp_path / "s.py")).collect()}
    space: dict = {}
    exec((tmp_path / "s.py").read_text(), space)
    for i in range(8):
        try:
            want = space["solve"]({"n": i - 2})
        except ValueError as e:
            assert got[i]["answer"] is None and got[i]["error"] == f"ValueError: {e}"
            continue
        if isinstance(want, dict):
            assert json.loads(got[i]["answer"]) == {"cell_id": i} | want and got[i]["error"] is None
        else:
            assert got[i]["error"].startswith("TypeError")
    assert got[99]["error"].startswith("JSONDecodeError") and got[100]["error"].startswith("TypeError")
    assert all(r["runtime_s"] >= 0 for r in got.values())
    (tmp_path / "none.py").write_text("solve = 3\n")
    with pytest.raises(ValueError):
        R.solved(cells, str(tmp_path / "none.py"))
    assert R.load_solver(str(tmp_path / "s.py"))({"n": 9}) == {"root": 3.0}
    assert R.solved(cells.where(F.lit(False)), str(tmp_path / "s.py")).count() == 0
