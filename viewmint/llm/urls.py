"""URL filters: rules on hosts and paths, met through hashed expressions.

A rule names a host, which covers its subdomains, and the beginning of a path.
Each URL is expanded into the suffixes of its host at dots, each with the
prefixes of its path at slashes.  A rule is filed under its host and its path up
to the last slash, so that a rule that fits a URL is filed under one of the
URL's expressions.  Expressions and rules meet by an equi-join on a short prefix
of their SHA-256; full digests and the rest of the rule's path are compared
after it, and the longest of the rules that fit decides.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, sized, stored

#: Hexadecimal digits of a digest that rules and expressions are joined by.
SHORT_DIGITS = 8
#: The rules asked for, (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands behind the first ``://``; the host ends at any of ``/?#``, the
#: path at ``?`` or ``#``.
_HOST, _PATH = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"


def rules_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """(host, path, verdict) rows of rules that are given as tuples."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def host_of(url: Column) -> Column:
    """The host, its A-Z in lower case; empty for null and without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """The path, empty for null and for a URL without one."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PATH, 1)


def _digest(host: Column, path: Column) -> Column:
    # a host has no slash and a path begins with one or is empty
    return F.sha2(F.concat(host, path), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, SHORT_DIGITS), 16, 10).cast("long")


def _up_to_slash(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def _ends(labels: Column, most: int) -> Column:
    """The last 1, 2 .. ``most`` labels of a host, joined by dots."""
    n = F.least(F.size(labels), F.lit(most))
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, -i, i), "."))


def _beginnings(path: Column, most: int) -> Column:
    """The empty path and the path up to its 1st, 2nd .. ``most``-th slash."""
    parts = F.split(path, "/", -1)
    n = F.least(F.size(parts) - 1, F.lit(most))
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i > 0, F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))).otherwise(F.lit("")))


def expressions(host: Column, path: Column, labels: int, slashes: int) -> Column:
    """array<digest> of the host's suffixes with the path's beginnings.

    Suffixes of more labels than any rule has, and beginnings of more slashes,
    can't be a rule's, so ``labels`` and ``slashes`` bound the work for very
    long hosts and paths and lose nothing.
    """
    hosts = _ends(F.split(host, r"\.", -1), labels)
    return F.flatten(F.transform(hosts, lambda h: F.transform(_beginnings(path, slashes), lambda p: _digest(h, p))))


def _filed(rules: DataFrame) -> DataFrame:
    """Rules under their digests; of rules of one host and path one is left: block goes before allow."""
    host = F.translate(F.coalesce(F.col("host"), F.lit("")), _UPPER, _LOWER)
    path = F.coalesce(F.col("path"), F.lit(""))
    path = F.when(path.startswith("/") | (path == ""), path).otherwise(F.concat(F.lit("/"), path))
    one = rules.where(F.col("verdict").isNotNull()).select(host.alias("_rule_host"), path.alias("_rule_path"), F.col("verdict").alias("_rule_verdict"))
    one = one.groupBy("_rule_host", "_rule_path").agg(F.max_by("_rule_verdict", F.struct(F.col("_rule_verdict") == "block", "_rule_verdict")).alias("_rule_verdict"))
    filed = one.withColumn("_rule_digest", _digest(F.col("_rule_host"), _up_to_slash(F.col("_rule_path"))))
    return filed.withColumn("_short", _short(F.col("_rule_digest")))


def judge_urls(
    rows: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """Host, path, deciding rule and verdict of every row's URL.

    ``rules`` has ``host, path, verdict`` (``allow`` or ``block``); other
    columns are ignored, a null host or path is empty, a path without its slash
    gets one, and rows without a verdict are no rules.  A rule fits the URLs of
    its host and of all subdomains whose path starts with its path.  The longest
    rule decides, counted in characters of host and path; of equally long ones
    that with the longer host; of the same rule with both verdicts ``block``.
    URLs that no rule fits get ``default`` and a null ``rule``.

    A null URL, and one without ``://``, has an empty host and path.  Every row
    is judged, also where ids and URLs repeat or are null; only ``id_col`` and
    ``url_col`` are read, so other columns may have any names.  An empty table
    gives an empty result, and no rules give ``default`` throughout.

    Rules are broadcast up to 2^20 of them, counted first; more are joined by a
    shuffle, in which Spark splits the partitions of hot expressions.  A row
    then leaves its task once for each task that found it a rule.

    Returns ``id_col, host, path, rule, verdict``.
    """
    filed = stored(_filed(rules), "url-rules")
    counted = filed.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.size(F.split("_rule_host", r"\.", -1))).alias("labels"),
        F.max(F.size(F.split("_rule_path", "/", -1)) - 1).alias("slashes"),
    ).first()
    pages = rows.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("_host"), path_of(F.col(url_col)).alias("_path"))
    if not counted["n"]:
        none = F.lit(None).cast("string")
        return pages.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), none.alias("rule"), F.lit(default).alias("verdict"))
    # written once, so that a row keeps its number whatever is run again
    pages = stored(pages.withColumn("_row", F.monotonically_increasing_id()), "url-rows")
    short = pages.select("_row", "_host", "_path", F.explode(expressions(F.col("_host"), F.col("_path"), counted["labels"], counted["slashes"])).alias("_digest"))
    if counted["n"] <= BROADCAST_ROWS:
        filed = F.broadcast(filed)
    met = short.withColumn("_short", _short(F.col("_digest"))).join(filed, "_short")
    fits = met.where((F.col("_digest") == F.col("_rule_digest")) & F.col("_path").startswith(F.col("_rule_path")))
    # a URL's rule is told by its lengths: its host ends the URL's, its path begins it
    length, host_length = F.length("_rule_host") + F.length("_rule_path"), F.length("_rule_host")
    rank = F.shiftleft(length.cast("long"), 32) + F.shiftleft(host_length.cast("long"), 1) + (F.col("_rule_verdict") == "block").cast("long")
    best = fits.groupBy("_row").agg(F.max(rank).alias("_best"))
    host_length = F.shiftright("_best", 1).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    path_length = F.shiftright("_best", 32).cast("int") - host_length
    rule = F.concat(F.substring(F.col("_host"), F.length("_host") - host_length + 1, host_length), F.substring(F.col("_path"), F.lit(1), path_length))
    verdict = F.when(F.col("_best").bitwiseAND(F.lit(1)) == 1, F.lit("block")).otherwise(F.lit("allow"))
    return pages.join(best, "_row", "left").select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        rule.alias("rule"),
        F.when(F.col("_best").isNull(), F.lit(default)).otherwise(verdict).alias("verdict"),
    )


def drop_blocked(rows: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``rows`` whose URL isn't blocked, with all their columns.

    Blocked URLs are judged once each, and taken away by an anti-join: a
    broadcast of up to 2^20 of them, a shuffle beyond.  Null URLs are judged
    like empty ones, see :func:`judge_urls`.
    """
    urls = rows.select(F.coalesce(F.col(url_col), F.lit("")).alias("_url")).distinct()
    judged = judge_urls(urls.select("_url", F.col("_url").alias("_judged")), rules, "_url", "_judged", default)
    blocked = sized(judged.where(F.col("verdict") == "block").select(F.col("_url").alias("_blocked_url")), "blocked")
    return rows.join(blocked, F.coalesce(rows[url_col], F.lit("")) == blocked["_blocked_url"], "left_anti")
