"""Operators of a training-data pipeline: filtering, deduplication, mixing,
packing, search, sharding, token output and chat formatting.

Nothing outside this subpackage imports it.
"""
