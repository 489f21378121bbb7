"""Exact deduplication by counting quotient filters.

Every partition builds a counting quotient filter of its fingerprints: a
fingerprint's high bits are its quotient, which names a run, and its low bits
its remainder, kept once in the run's slots, in order, each slot with a counter.
Runs of one quotient from several filters merge losslessly and without sorting
again: remainders, sorted in either run, interleave, and equal ones add their
counters.  Merged runs, each of a bounded number of fingerprints, tell which
fingerprints occur more than once; only documents with such a fingerprint have
their bytes compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, hot_join, row_key, sized, stored, without

#: Fingerprints that a merged quotient range holds on average.
RANGE_SIZE = 1 << 14


def merge_slots(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One run of (remainders, counters) out of two, each sorted and distinct.

    Every remainder's slot in the merged run follows from its place in its own
    run and the number of other remainders below it.
    """
    (x, n), (y, m) = a, b
    at = np.searchsorted(x, y)
    here = np.minimum(at, max(len(x) - 1, 0))
    both = (x[here] == y) if len(x) else np.zeros(len(y), bool)
    n = n.copy()
    n[here[both]] += m[both]
    y, m, at = y[~both], m[~both], at[~both]
    slot = at + np.arange(len(y))
    remainders, counters = np.empty(len(x) + len(y), np.uint64), np.empty(len(x) + len(y), np.int64)
    old = np.ones(len(remainders), bool)
    old[slot] = False
    remainders[slot], counters[slot] = y, m
    remainders[old], counters[old] = x, n
    return remainders, counters


class CountingQuotientFilter:
    """A counting quotient filter over ``uint64`` fingerprints.

    ``q`` bits of quotient and ``64 - q`` of remainder.  The slots of run ``i``,
    which holds the remainders of ``quotients[i]``, are those from ``starts[i]``
    to ``starts[i + 1]``; a slot has a remainder and its counter.  As quotient
    and remainder are the whole fingerprint, counts are exact for fingerprints.
    """

    def __init__(self, q: int, fingerprints: np.ndarray):
        values, counts = np.unique(np.asarray(fingerprints, dtype=np.uint64), return_counts=True)
        quotients = (values >> np.uint64(64 - q)) if q else np.zeros(len(values), np.uint64)
        first = np.flatnonzero(np.r_[True, quotients[1:] != quotients[:-1]]) if len(values) else np.zeros(0, np.int64)
        self._set(q, quotients[first], np.r_[first, len(values)], values & np.uint64((1 << (64 - q)) - 1), counts.astype(np.int64))

    def _set(self, q: int, quotients: np.ndarray, starts: np.ndarray, remainders: np.ndarray, counters: np.ndarray) -> None:
        self.q, self.quotients, self.starts, self.remainders, self.counts = q, quotients, starts, remainders, counters

    def run(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(sorted remainders, counters) of the ``i``-th run that isn't empty."""
        return self.remainders[self.starts[i] : self.starts[i + 1]], self.counts[self.starts[i] : self.starts[i + 1]]

    def runs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(quotient, sorted remainders, counters) of each run that isn't empty."""
        for i, quotient in enumerate(self.quotients.tolist()):
            yield quotient, *self.run(i)

    def fingerprints(self) -> np.ndarray:
        if not self.q:
            return self.remainders
        return (np.repeat(self.quotients, np.diff(self.starts)) << np.uint64(64 - self.q)) | self.remainders

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both filters in one, run by run."""
        empty = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = [{quotient: f.run(i) for i, quotient in enumerate(f.quotients.tolist())} for f in (self, other)]
        quotients = sorted(at[0].keys() | at[1].keys())
        made = [merge_slots(at[0].get(x, empty), at[1].get(x, empty)) for x in quotients]
        whole = object.__new__(CountingQuotientFilter)
        whole._set(
            self.q,
            np.array(quotients, np.uint64),
            np.cumsum([0, *(len(r) for r, _ in made)]),
            np.concatenate([empty[0], *(r for r, _ in made)]),
            np.concatenate([empty[1], *(c for _, c in made)]),
        )
        return whole


def _partition_filters(q: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # 8 bytes a row of the partition, sorted once
        seen = [batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for batch in batches]
        if seen and sum(map(len, seen)):
            runs = list(CountingQuotientFilter(q, np.concatenate(seen)).runs())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in runs], pa.int64()),
                    pa.array([r[1].tobytes() for r in runs], pa.binary()),
                    pa.array([r[2].tobytes() for r in runs], pa.binary()),
                ],
                ["quotient", "remainders", "counts"],
            )

    return build


def _merge_runs(q: int):
    def merge(rows: pa.Table) -> pa.Table:
        quotient = rows.column("quotient")[0].as_py()
        runs = [
            (np.frombuffer(r, np.uint64), np.frombuffer(c, np.int64))
            for r, c in zip(rows.column("remainders").to_pylist(), rows.column("counts").to_pylist())
        ]
        while len(runs) > 1:  # in pairs, so that each slot moves a logarithm of times
            runs = [merge_slots(*pair) if len(pair) == 2 else pair[0] for pair in (runs[i : i + 2] for i in range(0, len(runs), 2))]
        remainders, counts = runs[0]
        often = counts > 1
        high = np.uint64((quotient << (64 - q)) if q else 0)
        return pa.table({"fp": pa.array((remainders[often] | high).view(np.int64)), "n": pa.array(counts[often])})

    return merge


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of the fingerprints that occur n > 1 times in the one column
    (a long) of ``fingerprints``, which has ``rows`` rows."""
    q = max(0, (rows // RANGE_SIZE)).bit_length()
    runs = fingerprints.mapInArrow(_partition_filters(q), "quotient long, remainders binary, counts binary")
    return runs.groupBy("quotient").applyInArrow(_merge_runs(q), "fp long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: the row of equal text that stays.

    Texts are equal when identical after each run of ASCII white space became
    one space; null counts as empty, and a text of only white space equals ``" "``,
    not the empty one.  The smallest id of a group stays; a null
    id stays only in a group of null ids.  Rows that repeat both id and text
    carry the same answer.  Other columns are ignored.  An empty table gives an
    empty result.

    Returns ``id_col, keep_id, group_size, kept, text_sha256`` and ``row_hash``,
    a hash of the text as it is, which tells rows of one id apart.
    """
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    own = docs.select(*row_key(id_col, text_col), F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_fp", F.xxhash64("_text"))
    digests = stored(own.select("_id", "_key_text", "_fp", F.sha2("_text", 256).alias("_sha")), "digests")
    rows = digests.count()
    routed = sized(repeated_fingerprints(digests.select("_fp"), rows).select(F.col("fp").alias("_fp")), "routed")
    suspects = own.join(routed, "_fp", "left_semi")
    # The grouping key is the text itself, so equality is that of all bytes;
    # copies within a partition are one row before the shuffle.
    groups = suspects.groupBy("_text").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    verified = (
        groups.groupBy(F.sha2("_text", 256).alias("_sha"))
        .agg(F.first("_keep").alias("_keep"), F.first("_size").alias("_size"), F.count(F.lit(1)).alias("_texts"))
        .withColumn(
            "_keep",
            F.when(F.col("_texts") == 1, F.col("_keep")).otherwise(
                F.raise_error(F.lit("two different texts have one SHA-256 digest")).cast(docs.schema[id_col].dataType)
            ),
        )
    )
    # the most repeated text may have any share of the rows
    joined = hot_join(digests, "_sha", verified.select("_sha", "_keep", "_size", F.col("_size").alias("_n")), "_sha", "_n", rows)
    keep = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return joined.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        F.col("_key_text").alias("row_hash"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops, all columns.

    Rows are told apart by id and text, so a row stays or goes by its own text
    also where ids repeat or are null.  Of rows that are kept and have equal
    texts (so they repeat an id, or none of their group has one) the one whose
    text and other columns, as JSON, come first stays.  Null and empty texts
    are equal texts; an empty table gives an empty result.
    """
    found = stored(exact_dedup(docs, id_col, text_col), "copies")
    gone = found.where(~F.col("kept")).select(F.col(id_col).alias("_key_id"), F.col("row_hash").alias("_key_text"))
    left = without(docs, gone, id_col, text_col)
    again = found.where("kept").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("text_sha256")
    again = stored(again, "again")
    if not again.limit(1).count():
        return left
    rows = stored(found.where("kept").join(again, "text_sha256", "left_semi").select(F.col(id_col).alias("_key_id"), F.col("row_hash").alias("_key_text")).distinct(), "twice")
    once = without(left, rows, id_col, text_col)
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    picked = sized(rows, "picked")
    keys = left.join(
        picked, left[id_col].eqNullSafe(picked["_key_id"]) & (F.xxhash64(F.coalesce(left[text_col], F.lit(""))) == picked["_key_text"]), "left_semi"
    )
    whole = F.struct(*[F.col(c) for c in docs.columns])
    first = keys.groupBy(text.alias("_own")).agg(F.min_by(whole, F.to_json(whole)).alias("_row"))
    return once.unionByName(first.select("_row.*"))
