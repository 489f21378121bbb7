"""Queries against DuckDB on the smallest tables, and plans."""

from __future__ import annotations

import math

import pytest

from viewmint.plans import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: None: every query with SQL is compared.
SKIPPED: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return "nan" if math.isnan(v) else f"{float(v) + 0.0:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SKIPPED))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted("|".join(_plain(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall())
    assert sorted("|".join(_plain(r[c]) for c in sorted(columns)) for r in df.collect()) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_scans_are_pruned_and_filtered(spark):
    plan = _plan(QUERIES["filter_isin"](spark, SMALL))
    assert "In(o_orderpriority" in plan.split("PushedFilters")[-1] and "o_custkey" not in plan.split("ReadSchema")[-1]


def test_top_k_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in _plan(QUERIES["lateral_topn"](spark, SMALL))


def test_range_join_is_an_equi_join(spark):
    plan = _plan(QUERIES["range_join"](spark, SMALL))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_function_of_a_module_hides_another():
    """A later one of the same name would serve the queries above it, too."""
    import ast
    from collections import Counter
    from pathlib import Path

    import viewmint

    for path in sorted(Path(viewmint.__file__).parent.rglob("*.py")):
        names = Counter(n.name for n in ast.parse(path.read_text()).body if isinstance(n, (ast.FunctionDef, ast.ClassDef)))
        assert [n for n, times in names.items() if times > 1] == [], path
