"""URL filters against SQL and brute force, with odd URLs and many rules."""

from __future__ import annotations

import random
import re

import pytest

pytest.importorskip("viewmint.llm")

SMALL = "/root/testdata/sf0.001"


def _brute(urls, rules):
    out = []
    for key, url in urls:
        host = path = ""
        if url and "://" in url:
            host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h) + len(p), len(h), v == "block", h + p) for h, p, v in rules if ("." + host).endswith("." + h) and path.startswith(p)]
        best = max(fits, default=None)
        out.append((key, host, path, best and best[3], "allow" if not best or not best[2] else "block"))
    return sorted(out, key=str)


def _rows(df, key="page_id"):
    return sorted(((r[key], r["host"], r["path"], r["rule"], r["verdict"]) for r in df.collect()), key=str)


def test_query_against_sql_and_brute_force(spark):
    import duckdb

    from viewmint.llm.queries import QUERIES
    from viewmint.llm.sql import ORACLES
    from viewmint.llm.urls import RULES

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SMALL}/pages.parquet'")
    found = _rows(QUERIES["op13_url_filters"](spark, SMALL))
    assert found == sorted(con.execute(f"select page_id, host, path, rule, verdict from ({ORACLES['op13_url_filters']})").fetchall(), key=str)
    pages = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    assert found == _brute(pages, RULES)
    assert {r[4] for r in found} == {"allow", "block"}


ODD = [
    None, "", "example.com/en/", "http://", "://", "http://COM/", "http://x.COM", "http://com/?q=/en/", "http://a.example.com/en", "http://a.example.com/en/#/x",
    "https://www.EXAMPLE.com/en/a//b", "http://notexample.com/en/", "http://x.net/es/?u=http://y.com/", "http://net/fr/\nx", "http://x.net/ES/", "http://a..net/es/", "http://.net/es/",
    "http://net./es/", "http://u:p@x.net:80/es/", "http://x.net:80/es/1", "http://İ.com/é/", "http://" + "a." * 20_000 + "net/es/" + "b/" * 20_000, "http://x.net/es/" + "y" * 100_000,
]


def test_odd_rows(spark):
    from viewmint.llm.urls import RULES, judge_urls, rules_table

    urls = [*enumerate(ODD), (3, "http://x.net/es/1"), (3, "http://x.net/es/1"), (None, "http://x.net/fr/"), (None, None)]
    # columns of the names that the operator uses and returns
    rows = spark.createDataFrame([(k, u, "h", "p", 1, 2) for k, u in urls], "page_id long, url string, host string, verdict string, _row int, _best int").repartition(3)
    assert _rows(judge_urls(rows, rules_table(spark))) == _brute(urls, RULES)
    assert judge_urls(rows.limit(0), rules_table(spark)).count() == 0
    assert {r["verdict"] for r in judge_urls(rows, rules_table(spark, []), default="block").collect()} == {"block"}


def test_rules_that_end_inside_a_segment_and_clash(spark, monkeypatch):
    from viewmint.llm import urls as module

    draw = random.Random(5)
    host = lambda: ".".join(draw.choice("abc") for _ in range(draw.randint(1, 3)))
    path = lambda: "/" + "".join(draw.choice("xy/") for _ in range(draw.randint(0, 4)))
    rules = [(host(), path(), draw.choice(["allow", "block"])) for _ in range(60)] + [("a", "", "block"), ("b", "/x", "block"), ("b", "/x", "allow")]
    pages = [(i, f"s://{host()}{draw.choice(['', path()])}{draw.choice(['', '?z', '#z'])}") for i in range(400)]
    rows = spark.createDataFrame(pages, "page_id long, url string")
    want = _brute(pages, rules)
    table = spark.createDataFrame([(*r, "more") for r in [*rules, (None, None, None)]], "host string, path string, verdict string, rule string")
    assert _rows(module.judge_urls(rows, table)) == want
    kept = module.drop_blocked(rows, table)
    assert kept.columns == rows.columns
    assert sorted(r["page_id"] for r in kept.collect()) == sorted(k for k, *_, v in want if v == "allow")
    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)  # rules beyond the bound meet by a shuffle
    assert _rows(module.judge_urls(rows, table)) == want
    monkeypatch.setattr(module, "SHORT_DIGITS", 1)  # short prefixes collide, digests don't
    assert _rows(module.judge_urls(rows, table)) == want


def test_html_is_not_read(spark):
    from viewmint.llm.urls import host_of

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    plan = pages.select(host_of(pages["url"]))._jdf.queryExecution().toString()
    assert "html" not in plan.split("ReadSchema")[-1]
