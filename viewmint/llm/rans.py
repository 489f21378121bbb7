"""Token ids in compressed blocks: a static range asymmetric numeral system.

All blocks share one table of frequencies, counted over the whole corpus.  A
block holds whole documents, in ascending id order, and is coded on its own: id
``i`` goes to lane ``i % lanes``, each lane is a 64-bit state that sheds and
takes 32-bit words, and the lanes' words interleave in one stream.  Every so
many steps the lanes' states and the place in the stream are kept, so that a
block can also be decoded from there.  Checksums cover the stream and the ids.

A container is a folder of Parquet files (written by Spark, so that a task that
dies leaves nothing half done) whose rows are blocks, and a frequency table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stored
from .tokens import LARGE, WordEncoder, default_vocabulary, in_slices

#: Bits of the frequency table's total.
SCALE_BITS = 20
#: Ids after which a block ends with its document, and lanes of a full block.
BLOCK_IDS, LANES = 1 << 18, 2048
#: Steps between two checkpoints.
CHECKPOINT_STEPS = 64
#: Ids in a file, about.
FILE_IDS = 6_000_000

_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


@dataclass(frozen=True)
class FrequencyTable:
    """Frequencies of all ids, at least 1 for each that occurs, of sum 2**20."""

    freq: np.ndarray
    cum: np.ndarray
    slots: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> FrequencyTable:
        total = 1 << SCALE_BITS
        some = np.flatnonzero(counts)
        freq = np.zeros(len(counts), np.int64)
        if len(some):
            if len(some) > total:
                raise ValueError("more ids than the table has slots")
            freq[some] = np.maximum(1, counts[some].astype(float) / counts.sum() * total).astype(np.int64)
            while (over := int(freq.sum()) - total) != 0:
                if over < 0:
                    freq[freq.argmax()] -= over
                else:
                    big = np.argsort(-freq, kind="stable")[: max(1, len(some) // 4)]
                    cut = np.minimum(freq[big] - 1, -(-over // len(big)))
                    cut[np.cumsum(cut) > over] = 0
                    if not cut.any():
                        cut[0] = 1
                    freq[big] -= cut
        cum = np.concatenate([[0], np.cumsum(freq)[:-1]])
        slots = np.repeat(np.arange(len(freq)), freq).astype(np.uint16 if len(freq) <= 1 << 16 else np.uint32)
        return cls(freq.astype(np.uint64), cum.astype(np.uint64), slots)


@dataclass(frozen=True)
class Block:
    n: int
    lanes: int
    states: bytes
    words: bytes
    checkpoints: bytes  # per checkpoint: place in the stream, then the states
    ids_crc: int
    words_crc: int


def encode_block(ids: np.ndarray, table: FrequencyTable, lanes: int = LANES) -> Block:
    n = len(ids)
    lanes = int(min(lanes, max(1, n)))
    steps = -(-n // lanes) if n else 0
    grid = np.full(steps * lanes, int(table.freq.argmax()), np.int64)
    grid[:n] = ids
    grid = grid.reshape(steps, lanes)
    x = np.full(lanes, _LOW, np.uint64)
    scale, room = np.uint64(SCALE_BITS), np.uint64(63 - SCALE_BITS)
    shed: list[np.ndarray] = []
    marks: list[tuple[int, bytes]] = []
    out = 0
    for t in range(steps - 1, -1, -1):
        s = grid[t]
        f = table.freq[s]
        full = x >= (f << room)
        if full.any():
            words = x[full].astype(np.uint32)
            x[full] >>= _WORD
            shed.append(words)
            out += len(words)
        q = x // f
        x = (q << scale) + (x - q * f) + table.cum[s]
        if t and t % CHECKPOINT_STEPS == 0:
            marks.append((out, x.tobytes()))
    stream = (np.concatenate(shed[::-1]) if shed else np.zeros(0, np.uint32)).astype("<u4").tobytes()
    kept = b"".join((out - done).to_bytes(8, "little") + states for done, states in reversed(marks))
    crc = zlib.crc32(np.asarray(ids).astype("<u4").tobytes())
    return Block(n, lanes, x.astype("<u8").tobytes(), stream, kept, crc, zlib.crc32(stream))


def decode_block(block: Block, table: FrequencyTable, checkpoint: int = 0) -> np.ndarray:
    """The block's ids, or those from its ``checkpoint``-th checkpoint on."""
    if zlib.crc32(block.words) != block.words_crc:
        raise ValueError("a block's stream doesn't match its checksum")
    steps = -(-block.n // block.lanes) if block.n else 0
    stream = np.frombuffer(block.words, "<u4")
    x, at, first = np.frombuffer(block.states, "<u8").astype(np.uint64), 0, 0
    if checkpoint:
        size = 8 + 8 * block.lanes
        mark = block.checkpoints[(checkpoint - 1) * size : checkpoint * size]
        at, first = int.from_bytes(mark[:8], "little"), checkpoint * CHECKPOINT_STEPS
        x = np.frombuffer(mark[8:], "<u8").astype(np.uint64)
    out = np.empty((steps - first, block.lanes), np.uint32)
    scale, mask = np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1)
    for t in range(steps - first):
        slot = x & mask
        s = table.slots[slot]
        out[t] = s
        x = table.freq[s] * (x >> scale) + slot - table.cum[s]
        low = x < _LOW
        if low.any():
            k = int(np.count_nonzero(low))
            x[low] = (x[low] << _WORD) | stream[at : at + k]
            at += k
    ids = out.ravel()[: max(0, block.n - first * block.lanes)]
    if not checkpoint and zlib.crc32(ids.astype("<u4").tobytes()) != block.ids_crc:
        raise ValueError("a block's ids don't match their checksum")
    return ids


def _tokenised(path: str, end: int):
    """Documents' ids, packed for the way to their file; then the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(path, LARGE)
        pack = zstandard.ZstdCompressor(level=1).compress
        counts = np.zeros(1, np.int64)
        kind = None
        for docs, texts in in_slices(batches, encoder.slice_bytes):
            kind = docs.type
            n, packed = [], []
            ids, begin = encoder.encode(texts)
            # byte planes: ids below 65536 have two, and the high one is dull
            planes = [(ids >> np.uint32(8 * k)).astype(np.uint8).tobytes() for k in range(4 if ids.max(initial=0) >> 16 else 2)]
            for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
                n.append(b - a + 1)
                packed.append(pack(b"".join([p[a:b] for p in planes])))
            part = np.bincount(ids, minlength=max(len(counts), end + 1))
            part[end] += len(n)
            part[: len(counts)] += counts
            counts = part
            yield pa.RecordBatch.from_arrays(
                [docs, pa.array(n, pa.int64()), pa.array(packed, pa.binary()), pa.nulls(len(n), pa.binary())],
                ["_id", "n", "ids", "counts"],
            )
        if kind is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, kind), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()])],
                ["_id", "n", "ids", "counts"],
            )

    return run


def _unpacked(packed: bytes, n: int, end: int, inflate) -> np.ndarray:
    """The n ids of a document, of which the last is ``end``."""
    out = np.full(n, end, np.uint32)
    if n > 1:
        raw = np.frombuffer(inflate(packed, max_output_size=4 * n), np.uint8).reshape(-1, n - 1)
        ids = raw[0].astype(np.uint32)
        for k in range(1, len(raw)):
            ids |= raw[k].astype(np.uint32) << np.uint32(8 * k)
        out[:-1] = ids
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            counts = np.frombuffer(raw, np.int64)
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["token", "c"])


_BLOCKS = (
    "file int, block int, first long, n long, lanes int, states binary, words binary, checkpoints binary, "
    "ids_crc long, words_crc long, lengths array<long>"
)


def _blocks(table: FrequencyTable, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = TaskContext.get().partitionId()
        inflate = zstandard.ZstdDecompressor().decompress
        first = number = 0
        docs, ids, waiting = [], [], 0

        def made(kind: pa.DataType) -> pa.RecordBatch:
            nonlocal first, number, docs, ids, waiting
            b = encode_block(np.concatenate(ids), table)
            row = [file, number, first, b.n, b.lanes, b.states, b.words, b.checkpoints, b.ids_crc, b.words_crc]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 3, pa.int64(), pa.int64()]
            columns = [pa.array([v], t) for v, t in zip(row, types)]
            columns.append(pa.array([[len(i) for i in ids]], pa.list_(pa.int64())))
            columns.append(pa.array([docs], pa.list_(kind)))
            first, number, docs, ids, waiting = first + b.n, number + 1, [], [], 0
            names = [f.split()[0] for f in _BLOCKS.split(", ")] + ["docs"]
            return pa.RecordBatch.from_arrays(columns, names)

        kind = None
        for batch in batches:
            kind = batch.column("_id").type
            for doc, n, packed in zip(*[batch.column(c).to_pylist() for c in ("_id", "n", "ids")]):
                docs.append(doc)
                ids.append(_unpacked(packed, n, end, inflate))
                waiting += n
                if waiting >= BLOCK_IDS:
                    yield made(kind)
        if docs:
            yield made(kind)

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    end: int = 0,
) -> None:
    """Writes the ids of all documents, each followed by ``end``, to ``path``.

    ``path/blocks`` has the blocks, files in ascending id order and so within a
    file; ``path/frequencies`` the shared table.  Null texts count as empty;
    rows with null ids come first; rows that repeat an id keep a row each,
    ordered by a hash of their ids.  Texts may be of any length, as a block ends
    with a document; columns but these two are ignored, whatever their names;
    an empty table gives an empty container.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    made = stored(
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
            _tokenised(vocabulary or default_vocabulary(), end), f"_id {kind}, n long, ids binary, counts binary"
        ),
        "tokens",
    )
    counts = (
        made.where("counts is not null").select("counts").mapInArrow(_counted, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
    )
    found = counts.collect()  # a row for each id of the vocabulary at most
    total = np.zeros(max((r["token"] for r in found), default=0) + 1, np.int64)
    for r in found:
        total[r["token"]] = r["c"]
    table = FrequencyTable.of(total)
    spark = docs.sparkSession
    spark.createDataFrame(
        [(i, int(f)) for i, f in enumerate(table.freq) if f], "token long, frequency long"
    ).coalesce(1).write.parquet(f"{path}/frequencies")
    files = max(1, -(-int(total.sum()) // FILE_IDS))
    # ties in full, so that rows that repeat an id come in the same order always
    # and rows without one spread over files
    order = ["_id", F.xxhash64("ids"), "n", "ids"]
    ordered = made.where("ids is not null").drop("counts").repartitionByRange(files, *order[:2]).sortWithinPartitions(*order)
    blocks = ordered.mapInArrow(_blocks(table, end), f"{_BLOCKS}, docs array<{kind}>")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


def read_table(spark, path: str) -> FrequencyTable:
    rows = spark.read.parquet(f"{path}/frequencies").collect()
    counts = np.zeros(max((r["token"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r["token"]] = r["frequency"]
    return FrequencyTable.of(counts)


def _decoded(table: FrequencyTable, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("docs").type.value_type
            for row in batch.to_pylist():
                block = Block(*[row[k] for k in ("n", "lanes", "states", "words", "checkpoints", "ids_crc", "words_crc")])
                ids = decode_block(block, table).astype("<u4")
                raw = ids.tobytes()
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                spans = list(zip(((ends - lengths) * 4).tolist(), (ends * 4).tolist()))
                columns = [
                    pa.array(row["docs"], kind),
                    pa.array([row["file"]] * len(lengths), pa.int32()),
                    pa.array(row["first"] + ends - lengths),
                    pa.array(lengths),
                    pa.array([zlib.crc32(raw[a:b]) for a, b in spans], pa.int64()),
                ]
                names = ["_id", "file", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids[a // 4 : b // 4].tolist() for a, b in spans], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def read_tokens(spark, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """What a container holds: a row for each document that went in.

    Blocks are decoded one by one, in parallel, and checked.  Returns ``id_col,
    start, n_tokens, ids_crc32`` and, if asked for, ``ids``.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["docs"].dataType.elementType.simpleString()
    fields = f"_id {kind}, file int, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    docs = blocks.mapInArrow(_decoded(read_table(spark, path), with_ids), fields)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy("file").agg(F.sum("n").alias("_n"))  # one row a file
    files = files.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return docs.join(files, "file").select(
        F.col("_id").alias(id_col),
        (F.col("_before") + F.col("at")).alias("start"),
        "n_tokens",
        "ids_crc32",
        *["ids"] * with_ids,
    )


def tokens_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Writes all documents' ids to the shared folder and reads the files back.

    An empty table gives an empty result.  See :func:`write_tokens`.
    """
    spark = docs.sparkSession
    path = scratch(spark, "rans")
    write_tokens(docs, path, id_col, text_col, **options)
    return read_tokens(spark, path, id_col)
