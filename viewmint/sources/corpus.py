"""Scans of a corpus of JSON lines for the few titles that are needed.

The title is cut from the raw line by a pattern, tested against a Bloom filter
of the needed titles in the JVM, and only lines that pass are decoded; what the
filter lets through by mistake goes in a join with the titles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import core as C

#: Bits of a filter for each title, and of a filter at most (a literal of 512 kB).
BITS_PER_TITLE, MOST_BITS, HASHES = 16, 1 << 22, 4

_TITLE = r'"title"\s*:\s*"((?:\\.|[^"\\])*)"'
_ROW = "id string, title string, sentences array<string>, mentions array<struct<ref_url:string>>"


def corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files under ``path``, packed ones too, as ``value``."""
    return spark.read.text(path)


def line_title(line: Column) -> Column:
    """The normed first title of a raw line; null where there is none."""
    raw = F.regexp_extract(line, _TITLE, 1)
    plain = F.when(F.contains(raw, F.lit("\\")), F.get(F.from_json(F.concat(F.lit('["'), raw, F.lit('"]')), "array<string>"), F.lit(0))).otherwise(raw)
    return F.when(F.regexp_like(line, F.lit(_TITLE)), C.norm_title(plain))


def _bit(title: Column, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(title, F.lit(i)), F.lit(bits))


def title_filter(titles: DataFrame, n: int) -> tuple[list[int], int]:
    """(words of 64 bits, bits) of a filter for ``titles`` (title)."""
    bits = 64
    while bits < min(MOST_BITS, n * BITS_PER_TITLE):
        bits *= 2
    at = titles.select(F.explode(F.array(*[_bit(F.col("title"), i, bits) for i in range(HASHES)])).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("bit"), F.lit(64)).cast("int"))
    words = [0] * (bits // 64)
    for r in at.groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(one).alias("set")).collect():  # a row a word
        words[r["word"]] = r["set"]
    return words, bits


def may_hold(title: Column, words: list[int], bits: int) -> Column:
    """False for titles that certainly aren't in the filter; null counts as such."""
    table = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
    hit = F.lit(True)
    for i in range(HASHES):
        bit = _bit(title, i, bits)
        word = F.get(table, (bit / 64).cast("int"))
        hit = hit & (F.call_function("getbit", word, F.pmod(bit, F.lit(64)).cast("int")) == 1)
    return F.coalesce(title.isNotNull() & hit, F.lit(False))


def scan_titles(lines: DataFrame, needed: DataFrame, profile: Observation | None = None) -> DataFrame:
    """(id, title, norm_title, sentences, text, links, degree) of the lines
    (``value``) with a title in ``needed`` (title, normed or not).

    Broken lines and lines without a title are passed over; every line of a
    repeated title counts.  ``profile`` gets ``lines``, ``bytes`` and ``passed``
    (lines that were decoded) when the result is first computed.  All lines are
    read: Spark's tasks don't know when others have found the rest.
    """
    titles = needed.select(C.norm_title("title").alias("norm_title")).where("norm_title is not null").distinct()
    words, bits = title_filter(titles.select(F.col("norm_title").alias("title")), titles.count())
    raw = lines.select("value", line_title(F.col("value")).alias("norm_title")).withColumn("passes", may_hold(F.col("norm_title"), words, bits))
    if profile is not None:
        raw = raw.observe(profile, F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("bytes"), F.count_if("passes").alias("passed"))
    decoded = raw.where("passes").select("norm_title", F.from_json("value", _ROW).alias("r")).where("r.title is not null")
    links = F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce("r.mentions", F.array().cast("array<struct<ref_url:string>>")), lambda m: F.trim(m["ref_url"]) != ""), lambda m: C.norm_title(m["ref_url"]))))
    sentences = F.coalesce("r.sentences", F.array().cast("array<string>"))
    return decoded.join(titles, "norm_title", "left_semi").select(
        F.coalesce("r.id", F.lit("")).alias("id"), F.col("r.title").alias("title"), "norm_title", sentences.alias("sentences"), F.array_join(sentences, " ").alias("text"), links.alias("links"), F.size(links).alias("degree")
    )
