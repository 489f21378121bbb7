"""The queries of these operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_documents
from .common import table
from .exact_dedup import exact_dedup
from .importance import importance_scores
from .mixing import mix_sources
from .neighbours import nearest_neighbours
from .packing import pack_sequences
from .preference import format_preferences, replies_as_pairs
from .quality import quality_scores
from .rans import tokens_round_trip
from .sharding import shard_records
from .simhash import simhash_components
from .substrings import remove_repeats
from .urls import judge_urls, rules_table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a discriminant fitted on the labelled rows; odd rows as in :func:`quality_scores`."""
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, kept row and digest of every document; odd rows as in :func:`exact_dedup`."""
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; odd rows as in :func:`mix_sources`."""
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in a sequence; odd rows as in :func:`pack_sequences`."""
    return pack_sequences(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are left of every document; odd rows as in :func:`remove_repeats`."""
    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth one; odd rows as in :func:`nearest_neighbours`."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; odd rows as in :func:`shard_records`."""
    return shard_records(table(spark, sf_dir, "documents"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, read back from the files; odd rows as in :func:`tokens_round_trip`."""
    return tokens_round_trip(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; odd rows as in :func:`simhash_components`."""
    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and masked completions of every conversation; odd rows as in :func:`format_preferences`."""
    return format_preferences(replies_as_pairs(table(spark, sf_dir, "conversations")))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of both tokenizers' ids in every document; odd rows as in :func:`align_documents`."""
    return align_documents(table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document against ``benchmark``; odd rows as in :func:`importance_scores`."""
    return importance_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page; odd URLs as in :func:`judge_urls`."""
    return judge_urls(table(spark, sf_dir, "pages"), rules_table(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality,
        op2_exact_dedup,
        op3_mixing,
        op4_packing,
        op5_substring_dedup,
        op6_neighbours,
        op7_sharding,
        op8_token_output,
        op9_simhash,
        op10_preference,
        op11_alignment,
        op12_importance,
        op13_url_filters,
    )
}
