"""Priced menus of views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Default price of a unit of cost, in units of quality.
LAMBDA = 0.08

#: Views in menu order with declared cost, by slice.
MENUS: dict[str, tuple[tuple[str, float], ...]] = {
    "dense": (("summary", 0.0), ("binary", 0.08), ("pq", 0.20), ("int8", 0.30), ("hnsw16", 0.138), ("hnsw64", 0.25), ("full", 0.58), ("ce", 1.03)),
    "ladder": (("summary", 0.0), ("binary", 0.08), ("ivfpq", 0.20), ("trunc96", 0.26), ("int8", 0.30), ("trunc192", 0.40), ("full", 0.58), ("ce", 1.03)),
    "2wiki": (("summary", 0.0), ("one_hop", 0.16), ("two_hop", 0.26), ("full_context", 0.55), ("ce", 0.95)),
    "hyperlink": (("summary", 0.0), ("provided_context", 0.08), ("hyperlink_1hop", 0.20), ("hyperlink_2hop", 0.34), ("full_local_pool", 0.55)),
    "hotpot": (("summary", 0.0), ("title_shortlist", 0.04), ("paragraph", 0.16), ("sentence", 0.28), ("full_context", 0.55), ("ce", 0.95)),
    "musique": (("summary", 0.0), ("decomp_title", 0.04), ("paragraph", 0.16), ("support_set", 0.30), ("full_context", 0.55), ("ce", 0.95)),
    "fever": (("summary", 0.0), ("title_page", 0.05), ("evidence_sentence", 0.22), ("full_evidence_page", 0.72)),
    "strategyqa": (("summary", 0.0), ("decomposition", 0.04), ("fact_snippets", 0.22), ("full_fact_set", 0.95)),
    "docred": (("summary", 0.0), ("co_mention", 0.12), ("evidence_sentences", 0.22), ("full_context", 0.55), ("ce", 0.95)),
    "legacy": (("moments", 0.0), ("occupancy", 0.28), ("raster", 0.42), ("point", 0.58)),
}
#: Keys of a route row, and names that only an evaluator may know.
ROUTE_KEYS: tuple[str, ...] = ("query_id", "cell_id", "tier", "cost_menu", "route", "ranked_views", "view_set", "abstain", "method", "runtime_s", "diagnostics")
FORBIDDEN: tuple[str, ...] = (
    "answer", "answers", "ce_score", "ce_scores", "ce_score_margin", "evidence_triple", "evidence_triples", "evaluator_only", "full_score", "full_scores",
    "hidden_reference", "hidden_target", "label", "labels", "oracle_view", "private_seed", "qrel", "qrels", "source_label", "source_labels", "support_fact",
    "support_facts", "support_title", "support_titles", "target", "target_points", "targets", "view_utilities", "view_score", "view_scores",
)
#: What a dense view is refined from.
DENSE_PARENTS: dict[str, str] = {"binary": "summary", "pq": "summary", "int8": "summary", "hnsw16": "summary", "full": "summary", "hnsw64": "hnsw16", "ce": "full"}


def menu(spark: SparkSession, name: str, views: int | None = None) -> DataFrame:
    """(view, ord, cost) of a menu; ``ord`` is the order that breaks ties."""
    rows = [(v, i, c) for i, (v, c) in enumerate(MENUS[name][:views])]
    return spark.createDataFrame(rows, "view string, ord int, cost double")


def depth_cost(depth: int, deepest: int, family: str = "nprobe") -> float:
    """Cost of an index probed to a depth."""
    base, slope = {"nprobe": (0.05, 0.15), "ef": (0.10, 0.30)}[family]
    return base + slope * depth / deepest
