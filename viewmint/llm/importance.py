"""Importance resampling towards a target distribution, on hashed word runs.

Documents and target texts are bags of word runs, each run in one of a fixed
number of buckets.  A bucket's gain is the logarithm of how much likelier it is
in the target than in the documents, and a document's weight is the sum of its
runs' gains.  Gumbel noise, hashed from the document's id, is added to the
weights, and the highest scores are drawn: a sample without replacement in
proportion to the weights' exponentials.

A document's buckets are one array, made and summed by higher-order functions:
scoring explodes nothing, and the gains are a literal.  What shuffles is the
counts of buckets, one row a bucket and task, and the scores where they are
ranked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, sized, stored

#: Fixed value: words, as a pattern over texts whose A-Z are in lower case.
FEATURE_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, NGRAMS, PERCENT, LEAST_WORDS, SEED = 10_000, (1, 1), 10, 20, 2024

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of ``monotonically_increasing_id`` that count within a partition.
_PLACE_BITS = 33


def words(text: Column) -> Column:
    """array<string> of a text's words; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(FEATURE_WORDS), F.lit(0))


def word_runs(found: Column, ngrams: tuple[int, int]) -> Column:
    """array<string> of all runs of ``ngrams[0]`` to ``ngrams[1]`` words."""
    least, most = ngrams
    if not 1 <= least <= most:
        raise ValueError("runs of 1 word or more are asked for")

    made, runs = [], found
    for n in range(1, most + 1):
        if n > 1:  # the runs one word shorter, each with the word behind it
            left = F.greatest(F.size(found) - (n - 1), F.lit(0))
            runs = F.zip_with(F.slice(runs, F.lit(1), left), F.slice(found, F.lit(n), left), lambda run, word: F.concat(run, F.lit(" "), word))
        if n >= least:
            made.append(runs)
    return made[0] if len(made) == 1 else F.concat(*made)


def _buckets(docs: DataFrame, text_col: str, buckets: int, ngrams: tuple[int, int], *keep: Column) -> DataFrame:
    """``keep``, ``_n_words`` and the array ``_buckets`` of every row."""
    found = docs.select(*keep, words(F.col(text_col)).alias("_words"))
    names = [c for c in found.columns if c != "_words"]
    hashed = F.transform(word_runs(F.col("_words"), ngrams), lambda w: F.pmod(F.crc32(w), F.lit(buckets)).cast("int"))
    return found.select(*names, F.size("_words").alias("_n_words"), hashed.alias("_buckets"))


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, ngrams: tuple[int, int] = NGRAMS) -> list[int]:
    """How many features of all rows are in each bucket.

    Counted in each task before anything moves, so a task sends one row a
    bucket at most, and the driver gets ``buckets`` rows at most.
    """
    counted = _buckets(docs, text_col, buckets, ngrams).select(F.explode("_buckets").alias("b")).groupBy("b").count().collect()
    out = [0] * buckets
    for row in counted:
        out[row["b"]] = row["count"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of both smoothed shares, rounded down."""
    n, all_s, all_t = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log((t + 1.0) * (all_s + float(n)) / ((s + 1.0) * (all_t + float(n))))) for s, t in zip(source, target)]


def _literal(values: list[int]) -> Column:
    """An array literal; the optimizer folds the text's parts into one value."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def gumbel(key: Column, seed: int) -> Column:
    """Thousandths of standard Gumbel noise drawn for a key, rounded down."""
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((drawn + 0.5) / 4294967296.0))).cast("long")


def _in_order(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with gapless ``_place`` from 1 in ``order``.

    Ranges of the order are sorted apart, and each starts behind the rows of
    those before it; one row a range is summed over as a whole.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = stored(dealt, "importance-order")
    part = F.shiftright("_at", _PLACE_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = dealt.withColumn("_part", part).join(F.broadcast(starts), "_part")  # a row a partition
    return placed.withColumn("_place", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + 1)


def _ranked(docs: DataFrame, target: DataFrame, keep: list[Column], id_col: str, text_col: str, target_col: str, buckets: int, ngrams: tuple[int, int], percent: int, least_words: int, seed: int) -> DataFrame:
    gain = _literal(gains(bucket_counts(docs, text_col, buckets, ngrams), bucket_counts(target, target_col, buckets, ngrams)))
    weight = F.aggregate("_buckets", F.lit(0).cast("long"), lambda total, b: total + F.element_at(gain, b + 1))
    made = _buckets(docs, text_col, buckets, ngrams, F.col(id_col).alias("_id"), *keep)
    names = [c for c in made.columns if c not in ("_n_words", "_buckets")]
    made = made.select(*names, F.size("_buckets").cast("long").alias("_n_features"), weight.alias("_weight"), (F.col("_n_words") >= least_words).alias("_long"))
    scored = stored(made.withColumn("_score", F.col("_weight") + gumbel(F.col("_id"), seed)).withColumn("_row", F.monotonically_increasing_id()), "importance-scores")
    drawn = scored.where("_long").count() * percent // 100
    # rows are told apart by their numbers, so that equal ones can be dealt to several ranges
    placed = _in_order(scored, [F.desc("_long"), F.desc("_score"), F.asc_nulls_last("_id"), F.asc("_row")])
    return placed.withColumn("_rank", F.when(F.col("_place") <= drawn, F.col("_place")))


def importance_scores(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    buckets: int = BUCKETS,
    ngrams: tuple[int, int] = NGRAMS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Features, weight, score and rank in the draw of every row.

    Counts of buckets are taken over all rows of ``docs`` and of ``target``.  Of
    the rows with ``least_words`` words or more, ``percent`` in a hundred
    (rounded down) are drawn, highest scores first, ties to the smaller id, null
    ids last; ``rank`` is null for the others.

    A null or empty text has no features: weight 0, score the noise alone, not
    drawn.  A null id counts as the empty string in the noise.  Rows that repeat
    an id and a text get equal scores and ranks of their own.  Other columns
    may have any names; ``target`` needs ``target_col`` only, and null texts in
    it count as empty.  An empty ``docs`` gives an empty result; an empty
    ``target`` has equal shares of all buckets.

    Returns ``id_col, n_features, weight, score, rank``.
    """
    ranked = _ranked(docs, target, [], id_col, text_col, target_col, buckets, ngrams, percent, least_words, seed)
    named = {"_id": id_col, "_n_features": "n_features", "_weight": "weight", "_score": "score", "_rank": "rank"}
    return ranked.select(*[F.col(c).alias(n) for c, n in named.items()])


def draw_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns.

    Rows that repeat an id and a text are drawn together, if one of them is.
    Null ids, null texts and empty tables as in :func:`importance_scores`.
    """
    ranked = _ranked(docs, target, row_key(id_col, text_col), id_col, text_col, target_col, BUCKETS, NGRAMS, percent, LEAST_WORDS, seed)
    drawn = sized(ranked.where(F.col("_rank").isNotNull()).select("_key_id", "_key_text").distinct(), "drawn")
    text = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(drawn, docs[id_col].eqNullSafe(drawn["_key_id"]) & (text == drawn["_key_text"]), "left_semi")
