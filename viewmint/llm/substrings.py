"""Substring deduplication by difference-cover anchors.

``COVER`` is a difference cover modulo ``PERIOD``: for any two positions some
shift below the period takes both into the cover.  So if two windows of
``WINDOW`` words are equal, some anchor (``ANCHOR`` words at a cover position)
lies inside both at the same shift.  Anchors are hashed at cover positions only
and grouped; those that occur once are done with.  From each anchor that occurs
again the match is extended to the whole windows around it.  These are compared
by a cryptographic digest of their words' bytes, so hashes of words only lead to
candidates; every window but the first of its words marks the words it covers.

What a task already knows to be repeated travels as is; of the rest each task
sends one representative a hash, so a passage that all documents share costs
one row a task, not one a document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, stored, with_rank

WINDOW = 20
#: A perfect difference set, {0, 1, 3, 9} modulo 13.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of text behind a bucket of hashes, and of documents, on average.
HASH_BUCKET_BYTES, DOC_BUCKET_BYTES = 24_000_000, 8_000_000
LEAST_BUCKETS = 64
#: Bytes of text hashed at a time.
SLICE_BYTES = 4_000_000
#: The five primes of XXH64.
_XXH64 = (
    0x9E3779B185EBCA87,
    0xC2B2AE3D27D4EB4F,
    0x165667B19E3779F9,
    0x85EBCA77C2B2AE63,
    0x27D4EB2F165667C5,
)
_NO_ID = np.iinfo(np.int64).max

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(20)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_FACTORS = _RANDOM.integers(0, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each text)."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[joined]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    # a word's hash is a polynomial in its bytes, from sums over the buffer
    powers = np.full(len(joined) + 1, _BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_BYTE[joined] * powers[:-1], out=sums[1:])
    powers[1:] = _BASE_INVERSE
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    hashes = _mixed((sums[ends] - sums[starts]) * powers[starts] + (ends - starts).astype(np.uint64))
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return hashes, np.diff(np.searchsorted(starts, begins))


def _at(words: np.ndarray, where: np.ndarray, length: int) -> np.ndarray:
    """Hash of ``length`` words from each place in ``where``."""
    total = np.zeros(len(where), np.uint64)
    for k in range(length):
        total += words[where + k] * _FACTORS[k]
    return _mixed(total)


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    slot = np.cumsum(sizes) // SLICE_BYTES
    edges = np.r_[0, np.flatnonzero(slot[1:] != slot[:-1]) + 1, len(sizes)]
    yield from ((int(a), int(b)) for a, b in zip(edges[:-1], edges[1:]) if b > a)


def _squeezed(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


# Documents are told apart by id and, where an id has several texts, the text's
# number: arrays of them have a row of ids and one of numbers.


def _packed(bucket: np.ndarray, doc: np.ndarray, at: np.ndarray, length: np.ndarray, hashes: np.ndarray):
    """Rows (bucket, n, where, hashes): entries of a bucket in one row."""
    order = np.argsort(bucket, kind="stable")
    bucket, doc, at, length, hashes = bucket[order], doc[:, order], at[order], length[order], hashes[order]
    edges = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b > a:
            step = np.diff(doc[:, a:b], prepend=np.zeros((2, 1), np.int64))
            where = _squeezed(step, at[a:b].astype(np.uint32), length[a:b].astype(np.uint32))
            yield int(bucket[a]), b - a, where, hashes[a:b].tobytes()


_PACKED = "bucket int, known boolean, n int, place binary, hashes binary"


def _batch(rows: list[tuple], known: bool) -> pa.RecordBatch:
    bucket, n, where, hashes = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket, pa.int32()),
            pa.array([known] * len(rows)),
            pa.array(n, pa.int32()),
            pa.array(where, pa.binary()),
            pa.array(hashes, pa.binary()),
        ],
        ["bucket", "known", "n", "place", "hashes"],
    )


def _unpacked(n: list[int], where: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    docs, ats, lengths = [np.zeros((2, 0), np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    inflate = zstandard.ZstdDecompressor().decompress
    for k, raw in zip(n, where):
        raw = inflate(raw, max_output_size=24 * k)
        docs.append(np.cumsum(np.frombuffer(raw, np.int64, 2 * k).reshape(2, k), axis=1))
        ats.append(np.frombuffer(raw, np.uint32, k, 16 * k).astype(np.int64))
        lengths.append(np.frombuffer(raw, np.uint32, k, 20 * k).astype(np.int64))
    return np.concatenate(docs, axis=1), np.concatenate(ats), np.concatenate(lengths)


def _changes(*sorted_: np.ndarray) -> np.ndarray:
    """Where a row of the sorted arrays differs from the one before."""
    new = np.zeros(len(sorted_[0]), bool)
    new[:1] = True
    for s in sorted_:
        new[1:] |= s[1:] != s[:-1]
    return new


def _numbered(some: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for documents, the same for the same one, in their order."""
    both = np.concatenate([some, others], axis=1)
    order = np.lexsort((both[1], both[0]))
    number = np.empty(both.shape[1], np.int64)
    number[order] = np.cumsum(_changes(both[0][order], both[1][order]))
    return number[: some.shape[1]], number[some.shape[1] :]


def _bucket_of(doc: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a document: ``pmod(xxhash64(_id, _text_no), buckets)`` of Spark."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in _XXH64)

    def rotated(x: np.ndarray, r: int) -> np.ndarray:
        return (x << np.uint64(r)) | (x >> np.uint64(64 - r))

    h = np.full(doc.shape[1], 42, np.uint64)
    for part in doc:
        h = rotated(np.ascontiguousarray(part).view(np.uint64) * p2, 31) * p1 ^ (h + p5 + np.uint64(8))
        h = rotated(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h = h ^ (h >> np.uint64(32))
    return h.view(np.int64) % buckets


def _runs(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted, distinct places as runs (doc, first, length)."""
    order = np.lexsort((at, doc[1], doc[0]))
    doc, at = doc[:, order], at[order]
    new = _changes(doc[0], doc[1], at)
    doc, at = doc[:, new], at[new]
    first = np.flatnonzero(_changes(doc[0], doc[1], at - np.arange(len(at))))
    return doc[:, first], at[first], np.diff(np.r_[first, len(at)])


def _to_documents(doc: np.ndarray, at: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    doc, at, length = _runs(doc, at)
    rows = list(_packed(_bucket_of(doc, buckets), doc, at, length, np.zeros((len(at), 0), np.uint8)))
    if rows:
        yield _batch(rows, True)


def _repeats(keys: list[np.ndarray], doc: np.ndarray, at: np.ndarray, all_known: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by keys and place; which of it is the first place of its key;
    which is repeated: all but the first place, or that too if there are others)."""
    order = np.lexsort((at, doc[1], doc[0], *reversed(keys)))
    first = _changes(*(k[order] for k in keys))
    group = np.cumsum(first) - 1
    d, a = doc[:, order], at[order]
    head = np.flatnonzero(first)[group]
    repeated = (d != d[:, head]).any(axis=0) | (a != a[head])
    if all_known and len(order):
        often = np.zeros(group[-1] + 1, bool)
        often[group[repeated]] = True
        repeated = often[group]
    return order, first, repeated


def _representatives(
    keys: list[np.ndarray], raw: np.ndarray, doc: np.ndarray, at: np.ndarray, hash_buckets: int, doc_buckets: int, all_known: bool
) -> Iterator[pa.RecordBatch]:
    """The first place of each hash, to its bucket; and the places known to be
    repeated."""
    if not len(at):
        return
    order, first, repeated = _repeats(keys, doc, at, all_known)
    known = order[repeated]
    if len(known):
        yield from _to_documents(doc[:, known], at[known], doc_buckets)
    pick = np.sort(order[first])
    bucket = (keys[0][pick] % np.uint64(hash_buckets)).astype(np.int64)
    yield _batch(list(_packed(bucket, doc[:, pick], at[pick], np.ones(len(pick)), raw[pick])), False)


def _documents(ids: pa.Array, numbers: pa.Array) -> np.ndarray:
    return np.array([ids.to_numpy(zero_copy_only=False), numbers.to_numpy(zero_copy_only=False)], np.int64)


def _anchors(hash_buckets: int, doc_buckets: int):
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False)
            for a, b in _slices(sizes):
                docs = _documents(whole.column(0).slice(a, b - a), whole.column(2).slice(a, b - a))
                texts = [t or b"" for t in whole.column(1).slice(a, b - a).to_pylist()]
                words, counts = word_hashes(texts)
                begin = np.concatenate([[0], np.cumsum(counts)])
                doc = np.repeat(np.arange(len(texts)), counts)
                at = np.arange(len(words)) - begin[doc]
                n = counts[doc]
                pick = np.flatnonzero(cover[at % PERIOD] & (at + ANCHOR <= n) & (n >= WINDOW))
                h = _at(words, pick, ANCHOR)
                raw = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]
                yield from _representatives([h], raw, docs[:, doc[pick]], at[pick], hash_buckets, doc_buckets, True)

    return run


def _repeated(doc_buckets: int, width: int, all_known: bool):
    """Of a bucket's hashes, the places that are repeated; and what was known."""

    def run(rows: pa.Table) -> pa.Table:
        known = rows.column("known").to_pylist()
        n, where, hashes = (rows.column(c).to_pylist() for c in ("n", "place", "hashes"))
        fresh = [i for i, k in enumerate(known) if not k]
        out = [pa.Table.from_batches([], rows.schema)]
        told = rows.filter(rows.column("known"))
        if told.num_rows:  # these rows bear the bucket of their documents in n's place: see _echo
            out.append(told)
        doc, at, _ = _unpacked([n[i] for i in fresh], [where[i] for i in fresh])
        if len(at):
            raw = np.frombuffer(b"".join(hashes[i] for i in fresh), np.uint8).reshape(-1, width)
            wide = np.zeros((len(raw), 16), np.uint8)
            wide[:, :width] = raw
            keys = [wide[:, k : k + 8].copy().view("<u8").ravel() for k in range(0, width, 8)]
            order, _, repeated = _repeats(keys, doc, at, all_known)
            again = order[repeated]
            out += [pa.Table.from_batches([b]) for b in _to_documents(doc[:, again], at[again], doc_buckets)]
        return pa.concat_tables([t.select(rows.schema.names).cast(rows.schema) for t in out])

    return run


def _own_words(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def _windows(hash_buckets: int, doc_buckets: int):
    """Candidate windows of a bucket's documents: those around anchors."""

    def run(docs: pa.Table, anchors: pa.Table) -> pa.Table:
        empty = pa.schema(
            [("bucket", pa.int32()), ("known", pa.bool_()), ("n", pa.int32()), ("place", pa.binary()), ("hashes", pa.binary())]
        ).empty_table()
        doc, at, length = _unpacked(anchors.column("n").to_pylist(), anchors.column("place").to_pylist())
        if not len(at) or not docs.num_rows:
            return empty
        docs = docs.combine_chunks()
        own, owner = _numbered(_documents(docs.column("_id"), docs.column("_text_no")), doc)
        own, row = np.unique(own, return_index=True)  # equal rows are one document
        wanted = np.isin(own, owner)
        own, row = own[wanted], row[wanted]
        texts = docs.column("_text").take(pa.array(row))
        # the anchors of a run start at every place of it
        place = np.repeat(at, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        owner = np.repeat(owner, length)
        by = np.argsort(owner, kind="stable")
        owner, place = owner[by], place[by]
        lo, hi = np.searchsorted(owner, own), np.searchsorted(owner, own, side="right")
        names = _documents(docs.column("_id"), docs.column("_text_no"))[:, row]
        which, where, digests = [], [], []
        for k, text in enumerate(texts):
            words = _own_words(text.as_py())
            top = len(words) - WINDOW + 1
            if top <= 0 or hi[k] == lo[k]:
                continue
            mask = np.zeros(top + 1, np.int64)
            p = place[lo[k] : hi[k]]
            np.add.at(mask, np.clip(p - (WINDOW - ANCHOR), 0, top), 1)
            np.add.at(mask, np.clip(p + 1, 0, top), -1)
            pick = np.flatnonzero(np.cumsum(mask)[:-1] > 0)
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.r_[0, ends[:-1] + 1]
            digests += [hashlib.blake2b(joined[x:y], digest_size=16).digest() for x, y in zip(starts[pick].tolist(), ends[pick + WINDOW - 1].tolist())]
            which.append(np.full(len(pick), k))
            where.append(pick)
        if not digests:
            return empty
        raw = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 16)
        keys = [raw[:, k : k + 8].copy().view("<u8").ravel() for k in (0, 8)]
        made = list(_representatives(keys, raw, names[:, np.concatenate(which)], np.concatenate(where), hash_buckets, doc_buckets, False))
        return pa.Table.from_batches(made) if made else empty

    return run


def _kept(docs: pa.Table, marked: pa.Table) -> pa.Table:
    """Documents without the words of their marked windows."""
    doc, at, length = _unpacked(marked.column("n").to_pylist(), marked.column("place").to_pylist())
    ids, owner = _numbered(_documents(docs.column("_id"), docs.column("_text_no")), doc)
    by = np.lexsort((at, owner))
    owner, at, end = owner[by], at[by], (at + length - 1 + WINDOW)[by]
    lo, hi = np.searchsorted(owner, ids), np.searchsorted(owner, ids, side="right")
    n, gone, digest, kept_texts = [], [], [], []
    for k, text in enumerate(docs.column("_text").to_pylist()):
        words = _own_words(text)
        n.append(len(words))
        kept = words
        if hi[k] > lo[k]:
            kept, upto = [], 0
            for a, b in zip(at[lo[k] : hi[k]].tolist(), end[lo[k] : hi[k]].tolist()):
                if a > upto:
                    kept += words[upto:a]
                upto = max(upto, b)
            kept += words[upto:]
        gone.append(len(words) - len(kept))
        joined = b" ".join(kept)
        kept_texts.append(joined)
        digest.append(hashlib.sha256(joined).hexdigest())
    return pa.table(
        {
            "_id": docs.column("_id"),
            "n_words": pa.array(n, pa.int64()),
            "n_removed": pa.array(gone, pa.int64()),
            "kept_sha256": pa.array(digest, pa.string()),
            "kept": pa.array(kept_texts, pa.binary()),
        }
    )


def _without_texts(docs: pa.Table, marked: pa.Table) -> pa.Table:
    return _kept(docs, marked).drop_columns(["kept"])


def _echo(rows: DataFrame, spread: int) -> DataFrame:
    """What is known already needs no bucket of hashes: it passes through the
    shuffle wherever it falls, keeping its documents' bucket in ``_to``."""
    at = F.when(F.col("known"), F.pmod(F.xxhash64("place"), F.lit(spread)).cast("int")).otherwise(F.col("bucket"))
    return rows.withColumn("_at", at)


def _with_text_number(own: DataFrame) -> DataFrame:
    """(_id, _text, _text_no): 0, but for ids that have several texts, whose
    texts are numbered."""
    digest = F.md5(F.coalesce("_text", F.lit("").cast("binary")))
    several = own.groupBy("_id").agg(F.min(digest).alias("a"), F.max(digest).alias("b")).where("a < b").select("_id")
    several = stored(several, "several")
    if not several.limit(1).count():
        return own.withColumn("_text_no", F.lit(0).cast("long"))
    named = own.withColumn("_digest", digest)
    texts = named.select("_id", "_digest").join(sized(several, "ids"), "_id", "left_semi").distinct()
    texts = stored(texts.withColumn("_chunk", F.substring("_digest", 1, 3)), "texts")
    numbers = sized(with_rank(texts, ["_id"], "_chunk", [F.col("_digest")], "_text_no").select("_id", "_digest", "_text_no"), "numbers")
    return named.join(numbers, ["_id", "_digest"], "left").select("_id", "_text", F.coalesce("_text_no", F.lit(0)).cast("long").alias("_text_no"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """What is left of each document without its repeated windows.

    A word goes if a window of 20 words that covers it starts, in the same
    words, also earlier: in a smaller id, or before in the same document.  Ids
    are integers; null ids come behind all others.  Null and blank texts have no
    words; texts of fewer than 20 words have no window.  Rows are judged by their
    own texts, also where ids repeat or are null: different texts of one id are
    documents of their own, one before the other by a hash of their texts; equal
    rows (id and text) are one document and no repeats of each other.  Other
    columns are ignored.  An empty table gives an empty result.

    Returns ``id_col, n_words, n_removed, kept_sha256`` and, if asked for, the
    text that is kept, its words joined by one space.
    """
    total = docs.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    hash_buckets = max(LEAST_BUCKETS, int(total) // HASH_BUCKET_BYTES)
    doc_buckets = max(LEAST_BUCKETS, int(total) // DOC_BUCKET_BYTES)
    own = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(int(_NO_ID))).alias("_id"), F.col(text_col).cast("binary").alias("_text")
    )
    own = _with_text_number(own)
    # as _bucket_of has it: documents meet what is known of them
    dealt = own.withColumn("_bucket", F.pmod(F.xxhash64("_id", "_text_no"), F.lit(doc_buckets)).cast("int"))

    def found(rows: DataFrame, width: int, all_known: bool) -> DataFrame:
        return _echo(rows, hash_buckets).groupBy("_at").applyInArrow(_dropping_at(_repeated(doc_buckets, width, all_known)), _PACKED)

    anchors = found(own.mapInArrow(_anchors(hash_buckets, doc_buckets), _PACKED), 6, True)
    windows = dealt.groupBy("_bucket").cogroup(anchors.groupBy("bucket")).applyInArrow(_windows(hash_buckets, doc_buckets), _PACKED)
    marked = found(windows, 16, False)
    fields = "_id long, n_words long, n_removed long, kept_sha256 string"
    if with_text:
        left = dealt.groupBy("_bucket").cogroup(marked.groupBy("bucket")).applyInArrow(_kept, f"{fields}, kept binary")
        left = left.withColumn("kept", F.decode("kept", "UTF-8"))
    else:
        left = dealt.groupBy("_bucket").cogroup(marked.groupBy("bucket")).applyInArrow(_without_texts, fields)
    kind = docs.schema[id_col].dataType
    return left.withColumn("_id", F.when(F.col("_id") != int(_NO_ID), F.col("_id")).cast(kind)).withColumnRenamed("_id", id_col)


def _dropping_at(f):
    def run(rows: pa.Table) -> pa.Table:
        return f(rows.drop_columns(["_at"]))

    return run
