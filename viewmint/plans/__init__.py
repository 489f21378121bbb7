"""Named queries over the tables, each with the same rows in DuckDB SQL."""

from __future__ import annotations

from . import audit_queries, collection_queries, contract_queries, evidence_queries, geometry_queries, index_queries, kit_queries, lab_queries, pack_queries, policy_queries, rank_queries, relational_queries, report_queries, selection_queries, source_queries, stats_queries, stream_queries, terrain_queries, text_queries, trace_queries, udf_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "audit_queries", "collection_queries", "contract_queries", "evidence_queries", "geometry_queries", "index_queries", "kit_queries", "lab_queries", "pack_queries", "policy_queries", "rank_queries", "relational_queries", "report_queries", "selection_queries", "source_queries", "stats_queries", "stream_queries", "terrain_queries", "text_queries", "trace_queries", "udf_queries"]
