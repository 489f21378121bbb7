"""SimHash near-deduplication with multi-index hashing.

Fingerprints within ``RADIUS`` bits are linked.  Cut into segments, two such
fingerprints differ little in one of them: with 3 segments in at most 1 bit of
the first or second, or not at all in the third; with 2 segments in at most 2
bits of the first or 1 of the second.  Each fingerprint is filed under its own
segments and looks up all segments of that small Hamming ball; whatever meets
is compared in full.  Within a task only a spanning forest of the links is
kept, so a dense group costs no more rows than it has fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, hot_join, row_key, stored, without
from .components import components, spanning_stars

RADIUS = 4
SHINGLE = 4
#: Fixed value: the seed of XXH64.
SEED = 42
#: (shift, bits, ball radius) of each segment, by number of segments.
SEGMENTS = {3: ((0, 22, 1), (22, 21, 1), (43, 21, 0)), 2: ((0, 32, 2), (32, 32, 1))}
#: Distinct fingerprints from which two longer segments are used.
TWO_SEGMENTS_FROM = 1 << 26
#: Fingerprints under one segment from which its bucket is cut by further bits.
HOT_BUCKET = 20_000
#: Rows of a batch of texts that are fingerprinted.
TEXT_BATCH = 1000
#: Pairs compared at a time.
BLOCK = 1 << 21


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a whole text; 0 without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist())
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = np.fromiter((fingerprint(t.as_py()) for t in batch.column("_text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_key_text"), pa.array(made.view(np.int64))], ["_id", "_key_text", "_fp"])


def _balls(segments: tuple, filed_only: bool):
    """(key, probe, fp): where fingerprints are filed (probe 0) and looked up (1)."""
    parts = []
    for number, (shift, bits, radius) in enumerate(segments):
        flips = [0]
        if not filed_only:
            for r in range(1, radius + 1):
                flips += [sum(1 << i for i in places) for places in combinations(range(bits), r)]
        parts.append((number, shift, bits, np.array(flips, np.uint64)))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                fp = whole.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                for number, shift, bits, flips in parts:
                    own = (fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
                    keys = (own[:, None] ^ flips[None, :]) | np.uint64(number << 60)
                    probe = np.broadcast_to((flips != 0).astype(np.int8), keys.shape)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys.ravel().view(np.int64)),
                            pa.array(probe.ravel()),
                            pa.array(np.repeat(fp, len(flips)).view(np.int64)),
                        ],
                        ["key", "probe", "fp"],
                    )

    return expand


def _links_of_runs(key: np.ndarray, filed: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs among rows sorted by key, filed ones first in each key."""
    ends = np.r_[np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
    run_end = np.repeat(ends, np.diff(np.r_[0, ends]))
    rows = np.flatnonzero(filed & (run_end - np.arange(len(key)) > 1))
    count = run_end[rows] - rows - 1
    before = np.r_[0, np.cumsum(count)]
    i = 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(before, before[i] + BLOCK, side="right")) - 1)
        n = count[i:j]
        left = np.repeat(rows[i:j], n)
        right = left + 1 + np.arange(len(left)) - np.repeat(before[i:j] - before[i], n)
        near = np.bitwise_count(fp[left] ^ fp[right]) <= RADIUS
        near &= fp[left] != fp[right]
        yield fp[left[near]], fp[right[near]]
        i = j


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links in a partition that is sorted by key."""
    rest = [np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int64)]
    a, b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def met(parts: list[np.ndarray]) -> None:
        nonlocal a, b
        if not len(parts[0]):
            return
        for x, y in _links_of_runs(parts[0], parts[1] == 0, parts[2].view(np.uint64)):
            a, b = np.concatenate([a, x]), np.concatenate([b, y])
            if len(a) > BLOCK:
                a, b = spanning_stars(a, b)

    for batch in batches:
        parts = [np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, batch.columns)]
        last = int(np.searchsorted(parts[0], parts[0][-1])) if len(parts[0]) else 0
        met([p[:last] for p in parts])
        rest = [p[last:] for p in parts]
    met(rest)
    if len(a):
        a, b = spanning_stars(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def near_links(fingerprints: DataFrame, distinct: int) -> DataFrame:
    """(a, b) links that connect whatever is within ``RADIUS`` bits, among the
    ``distinct`` fingerprints (one long column) given; no more than a spanning
    forest of each task's links."""
    segments = SEGMENTS[2 if distinct >= TWO_SEGMENTS_FROM else 3]
    kind = "key long, probe byte, fp long"
    index = fingerprints.mapInArrow(_balls(segments, False), kind)
    filed = fingerprints.mapInArrow(_balls(segments, True), kind)
    hot = stored(
        filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_BUCKET).select("key"), "hot"
    )
    if hot.limit(1).count():
        # Under a hot key, rows also agree in one of RADIUS + 1 slices of the
        # whole fingerprint if they are near, and meet there instead.
        width = -(-64 // (RADIUS + 1))
        cut = F.array(
            *[
                F.xxhash64("key", F.lit(i), F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << min(width, 64 - i * width)) - 1)))
                for i in range(RADIUS + 1)
            ]
        )
        flagged = index.join(hot.withColumn("hot", F.lit(True)), "key", "left")
        where = F.when(F.col("hot"), cut).otherwise(F.array("key"))
        index = flagged.select(F.explode(where).alias("key"), "probe", "fp")
    dealt = index.repartition("key").sortWithinPartitions("key", "probe")
    return dealt.mapInArrow(_links, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and component of every row.

    Null, empty and blank texts have fingerprint zero, which is linked like any
    other; texts of up to four words have the hash of the whole.  Rows that
    repeat share a fingerprint; a null id is never a component's id unless the
    component has no other.  An empty table gives an empty result.

    Returns ``id_col, fingerprint`` (16 hexadecimal digits), ``component_id``
    (the smallest id that can be reached) and ``row_hash``, a hash of the text,
    which tells rows of one id apart.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col)[1], F.col(text_col).alias("_text"))
    with arrow_rows(docs.sparkSession, TEXT_BATCH):
        every = stored(texts.mapInArrow(_fingerprints, f"_id {kind}, _key_text long, _fp long"), "fingerprints")
    nodes = stored(every.groupBy("_fp").agg(F.min("_id").alias("_node"), F.count(F.lit(1)).alias("_n")), "nodes")
    distinct = nodes.count()
    found = components(near_links(nodes.select("_fp"), distinct))
    rooted = nodes.join(found, nodes["_fp"] == found["node"], "left").select(
        "_fp", "_node", "_n", F.coalesce("root", "_fp").alias("_root")
    )
    rooted = stored(rooted, "rooted")
    least = rooted.groupBy("_root").agg(F.min("_node").alias("component_id"), F.count(F.lit(1)).alias("_of"))
    # a component may have any share of the fingerprints, a fingerprint of the rows
    classes = hot_join(rooted, "_root", least, "_root", "_of", distinct).select("_fp", "component_id", "_n")
    answered = hot_join(every, "_fp", stored(classes, "classes"), "_fp", "_n", every.count())
    return answered.select(
        F.col("_id").alias(id_col),
        F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"),
        "component_id",
        F.col("_key_text").alias("row_hash"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the row of the smallest id of each component only.

    Rows are told apart by id and text: of rows that share the smallest id, all
    stay; rows without an id go if their component has one with an id, and stay
    if it has none.  Null and empty texts are one component (fingerprint zero).
    All columns are kept; an empty table gives an empty result.
    """
    every = simhash_components(docs, id_col, text_col)
    gone = every.where(~F.col(id_col).eqNullSafe(F.col("component_id")))
    return without(docs, gone.select(F.col(id_col).alias("_key_id"), F.col("row_hash").alias("_key_text")), id_col, text_col)
