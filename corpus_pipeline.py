"""A training corpus from raw documents, in stages that call the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from viewmint.llm.common import stored, table
from viewmint.llm.exact_dedup import drop_exact_copies
from viewmint.llm.mixing import apply_mix
from viewmint.llm.packing import pack_sequences
from viewmint.llm.quality import drop_low_quality
from viewmint.llm.simhash import drop_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Each row goes by its own text, also where ids repeat or are null; null and
    empty texts are scored as texts without words, and very long ones whole.
    All columns stay; an empty table gives an empty one.
    """
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that of the smallest id.

    Null and empty texts are equal.  Of rows that repeat id and text, or of a
    group without any id, one stays; different texts of one id all do.  All
    columns stay; an empty table gives an empty one.
    """
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id.

    Texts without words are one group.  Rows without an id go if their group
    has a row with one.  Texts of one id are told apart; those that share their
    group's smallest id all stay.  All columns stay; an empty table gives an
    empty one.
    """
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them.

    A null source is one of its own; texts without words are taken by their
    place in the seeded order, never more than three times; a source that has
    no words at all isn't taken.  Rows are taken each on its own, also where ids
    repeat or are null.  All columns stay; an empty table gives an empty one.
    """
    return apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the mix in training sequences.

    Null and empty texts are one piece of the end id alone; longer texts than a
    sequence are cut.  Every row is packed, copies and rows without an id too.
    Other columns are ignored; an empty table gives an empty one.
    """
    return pack_sequences(docs, lean=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("simhash_dedup", near),
    ("mix", mix),
    ("pack", pack),
]
#: The classifier's fit and the fingerprints are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
