"""Mixing sources to target weights by capped water-filling.

Water poured by weight rises evenly in all sources until one is full (at
``max_epochs`` times its size); it is clamped there and its excess goes to the
others by their weights.  Sorted by the level at which they fill, the clamped
sources are a prefix, so the final level follows from running sums.  A source's
target is then so many whole passes over its documents and a fraction of one
more; that fraction takes documents in a seeded order up to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORDS, row_key, sized, stored

#: Weights dealt to the sources in order, again and again.
WEIGHTS = (5.0, 2.0, 1.0)
#: Slices of a source's seeded order; only a slice that the target cuts is
#: ordered row by row.
SLICES = 4096


def words_in(text: Column) -> Column:
    """Number of words that ASCII white space parts; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def seeded_order(id_col: Column, text: Column, seed: int) -> Column:
    """60 bits that look random and depend on id, text and seed only, so that
    rows without an id spread too."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def water_fill(sources: DataFrame, max_epochs: float) -> DataFrame:
    """(source, source_size, weight) -> the same with ``target``.

    Targets share the sum of all sizes by weight; none is above ``max_epochs``
    times its source's size.  Weights are positive.  One row a source: the
    running sums see sources, not documents.
    """
    by_level = Window.orderBy("_level", "_rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = sources.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn(
        "_level", F.col("_cap") / F.col("weight")
    )
    sums = level.select(
        "*",
        F.coalesce(F.sum("_cap").over(before), F.lit(0.0)).alias("_full"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("_past"),
        F.sum("weight").over(every).alias("_weights"),
        F.sum("source_size").over(every).cast("double").alias("_total"),
    ).withColumn("_rest", (F.col("_total") - F.col("_full")) / (F.col("_weights") - F.col("_past")))
    # the level of the first source that doesn't fill
    water = F.min(F.when(F.col("_level") > F.col("_rest"), F.struct("_level", "_rank", "_rest"))).over(every)
    share = F.least(F.col("_cap"), F.col("weight") * water["_rest"])
    return sums.withColumn("target", F.coalesce(share, F.col("_cap"))).drop(
        "_cap", "_level", "_full", "_past", "_weights", "_total", "_rest"
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    max_epochs: float = 3.0,
    seed: int = 17,
) -> DataFrame:
    """How often the mix takes each row of ``docs``.

    Sources are ranked by code point, null (a source of its own) last, and
    weigh ``weights`` in turn.  Whole documents are taken, 0 to ``max_epochs``
    times; a source's words miss its target by half a document at most.  Null,
    empty and blank texts have no words and are taken by their place in the
    seeded order, as others are, up to ``max_epochs`` times too; a source
    without words is not taken.  Rows are told apart by id and text, so rows
    that repeat an id or have none are each taken on their own; equal rows are
    interchangeable.  Other columns are ignored.  An empty table gives an empty
    result.

    Returns ``id_col, size, source, source_size, target, repeats, taken`` and
    ``row_hash``, a hash of the text, which tells rows of one id apart.
    """
    narrow = stored(
        docs.select(
            F.col(id_col).alias("_id"),
            F.col(source_col).alias("_source"),
            words_in(F.col(text_col)).alias("size"),
            row_key(id_col, text_col)[1],
            seeded_order(F.col(id_col), F.col(text_col), seed).alias("_u"),
        ).withColumn("_slice", F.shiftright("_u", 48).cast("int")),
        "mix",
    )
    slices = narrow.groupBy("_source", "_slice").agg(F.sum("size").alias("_words"))
    slices = stored(slices, "mix-slices")
    dealt = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        slices.groupBy("_source")
        .agg(F.sum("_words").alias("source_size"))
        .withColumn("_rank", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1)
        .withColumn("weight", F.element_at(dealt, (F.col("_rank") % len(weights) + 1).cast("int")))
    )
    targets = water_fill(ranked, max_epochs).drop("_rank", "weight")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("_whole", F.floor(ratio).cast("long")).withColumn(
        "_part", F.col("target") - F.col("_whole") * F.col("source_size")
    )
    start = F.coalesce(
        F.sum("_words").over(
            Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    plan = (
        slices.withColumn("_before", start)
        .alias("s")
        .join(targets.withColumnRenamed("_source", "_of").alias("t"), F.col("_source").eqNullSafe(F.col("_of")))
        .select(
            F.col("_source").alias("_in"), F.col("_slice").alias("_nth"), "_before", "source_size", "target", "_whole", "_part"
        )
    )
    both = narrow.join(plan, narrow["_source"].eqNullSafe(plan["_in"]) & (narrow["_slice"] == plan["_nth"]))
    running = Window.partitionBy("_source", "_slice").orderBy("_u", "_id", "size", "_key_text").rowsBetween(
        Window.unboundedPreceding, -1
    )
    begins = F.col("_before") + F.coalesce(F.sum("size").over(running), F.lit(0))
    # a target of whole passes leaves no part to take from, of empty texts neither
    extra = ((F.col("_part") > 0) & (begins + F.col("size") / F.lit(2.0) <= F.col("_part"))).cast("long")
    return both.withColumn("repeats", F.col("_whole") + extra).select(
        F.col("_id").alias(id_col),
        "size",
        F.col("_source").alias("source"),
        "source_size",
        "target",
        "repeats",
        (F.col("size") * F.col("repeats")).alias("taken"),
        F.col("_key_text").alias("row_hash"),
    )


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken.

    Rows that agree in id, source and text are taken as often as the plan takes
    them in all; if they share that number unevenly, those whose columns, as
    JSON, come first have one copy more.  No row is there more than
    ``max_epochs`` times.  All columns are kept, whatever their names; an empty
    table gives an empty result.
    """
    id_col, text_col, source_col = (options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    every = mix_sources(docs, **options).groupBy(F.col(id_col).alias("_id"), F.col("source").alias("_of"), F.col("row_hash").alias("_hash"))
    plan = every.agg(F.sum("repeats").alias("_all"), F.count(F.lit(1)).alias("_rows")).where("_all > 0")
    taken = sized(plan, "taken")
    hashed = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    same = docs[id_col].eqNullSafe(taken["_id"]) & docs[source_col].eqNullSafe(taken["_of"]) & (hashed == taken["_hash"])
    row = F.struct(*[docs[c].alias(c) for c in docs.columns])
    met = docs.join(taken, same).select(row.alias("_row"), F.struct(taken["_id"], taken["_of"], taken["_hash"]).alias("_key"), "_all", "_rows")
    uneven = F.col("_all") % F.col("_rows") != 0  # a group or none a source, where the target cuts equal rows
    even = met.where(~uneven).select("_row", (F.col("_all") / F.col("_rows")).cast("int").alias("_times"))
    nth = F.row_number().over(Window.partitionBy("_key").orderBy(F.to_json("_row")))
    more = (nth <= F.col("_all") % F.col("_rows")).cast("int")
    odd = met.where(uneven).select("_row", (F.floor(F.col("_all") / F.col("_rows")) + more).cast("int").alias("_times"))
    each = even.unionByName(odd).where("_times > 0")
    return each.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")
