"""Best-fit packing by a configuration linear program.

Pieces are told apart by length only, so packing is a cutting-stock problem
over the length histogram: cover every length's count by the fewest
configurations (multisets of lengths that fit a sequence).  Multiplicative
weights solve its linear program: each length has a weight that falls as it is
covered; the configuration of the highest weight, found by a knapsack dynamic
program, is raised by a step, until all lengths are covered.  The configurations
are rounded down and then up, the fullest first, as far as there are pieces.
What is left is packed by best fit, longest pieces first, into open room before
new sequences.  How many pieces of each length the rounding leaves for that, and
how much room it may waste, is tried out: the plan of fewest sequences is taken.

The histogram and the configurations have a size bounded by the capacity.
Pieces find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import nullcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, stored, with_rank
from .tokens import LARGE, SMALL, SMALL_BATCH, WordEncoder, default_vocabulary, in_slices

CAPACITY = 1024
END = 2
#: Step of the weights' exponents, share of a length's count that the linear
#: program may leave uncovered, and of the best value that it may give away.
RATE, TOLERANCE, SLACK = 0.1, 0.05, 0.2
#: Room that a dealt configuration may leave empty (None: any), and shares of
#: each length's pieces that are held back for best fit, to be tried out.
WASTES, HELD_BACK = (0, 2, 16, None), (0.0, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75)
#: Pieces in a chunk of a length's ranks, on average, and the fewest chunks.
CHUNK_PIECES, LEAST_CHUNKS = 50_000, 256

Pattern = dict[int, int]


def linear_program(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, float]]:
    """Configurations and how often each is used, fractionally, so that every
    length is used ``counts`` (by length) times, ``TOLERANCE`` aside, or more.

    A knapsack dynamic program prices the best configuration and, with it, the
    best one that holds each length.  Weights only fall, so those that stay
    within ``SLACK`` of its best value are raised too before it is run again.
    Room may stay empty: a length that is covered many times over weighs
    nothing beside the others and is left out, so the rounds come to an end.
    """
    lengths = np.flatnonzero(counts)
    need = counts[lengths].astype(float)
    size = lengths.tolist()
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    covered = np.zeros(len(lengths))
    used: dict[tuple, float] = {}
    while (covered / need).min() < 1 - TOLERANCE:
        ratio = covered / need
        least = ratio.min()
        weights = np.exp(-(ratio - least) / RATE) * lengths / need
        best = np.zeros(capacity + 1)
        pick = [-1] * (capacity + 1)
        for c in range(1, capacity + 1):
            best[c] = best[c - 1]
            if upto[c]:
                total = weights[: upto[c]] + best[c - lengths[: upto[c]]]
                i = int(total.argmax())
                if total[i] > best[c]:
                    best[c], pick[c] = total[i], i
        holding = weights + best[capacity - lengths]
        enough = (1 - SLACK) * best[capacity]
        for i in np.argsort(-holding, kind="stable")[: int((holding >= enough).sum())].tolist():
            found, c = {i: 1}, capacity - size[i]
            while c > 0:
                j = pick[c]
                if j >= 0:
                    found[j] = found.get(j, 0) + 1
                c -= size[j] if j >= 0 else 1
            at = np.fromiter(found, np.int64)
            many = np.fromiter(found.values(), float)
            now = np.exp(-(covered[at] / need[at] - least) / RATE) * lengths[at] / need[at]
            if now @ many >= enough:
                step = RATE * (need[at] / many).min()
                covered[at] += step * many
                key = tuple(sorted((size[j], a) for j, a in found.items()))
                used[key] = used.get(key, 0.0) + step
    return [(dict(k), x) for k, x in used.items()]


def best_fit(counts: np.ndarray, capacity: int, begun: list[tuple[Pattern, int]]) -> list[tuple[Pattern, int]]:
    """Best fit, longest pieces first, for whole counts at a time, into the
    room of sequences that are ``begun`` and into new ones.

    Each piece goes to the fullest sequence that has room.  Sequences of equal
    contents are one entry with a number, so that the work depends on the
    capacity and not on how many pieces there are.
    """
    open_: dict[int, list[tuple[Pattern, int]]] = {}  # by room that is left

    def place(pattern: Pattern, n: int, copies: int, times: int, room: int) -> None:
        if times:
            made = {**pattern, n: pattern.get(n, 0) + copies} if copies else pattern
            open_.setdefault(room - n * copies, []).append((made, times))

    for pattern, times in begun:
        open_.setdefault(capacity - sum(n * a for n, a in pattern.items()), []).append((pattern, times))
    for n in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[n])
        for room in sorted(r for r in open_ if r >= n):
            if not left:
                break
            each, waiting = room // n, open_.pop(room)
            for pattern, times in waiting:
                whole = min(times, left // each)
                left -= whole * each
                place(pattern, n, each, whole, room)
                rest = left if whole < times and left < each else 0
                if rest:
                    place(pattern, n, rest, 1, room)
                    left = 0
                place(pattern, n, 0, times - whole - (rest > 0), room)
        each = capacity // n
        place({}, n, each, left // each, capacity)
        place({}, n, left % each, int(left % each > 0), capacity)
    return [entry for entries in open_.values() for entry in entries]


def rounded(
    found: list[tuple[Pattern, float]], counts: np.ndarray, capacity: int, waste: int | None
) -> list[tuple[Pattern, int]]:
    """Whole numbers of uses of the configurations ``found`` that leave no more
    than ``waste`` room and that ``counts`` has pieces for: rounded down, then
    one more of each that is full, the fullest first and of these the most used."""
    left = counts.copy()
    plan: list[tuple[Pattern, int]] = []
    room = {id(p): capacity - sum(n * a for n, a in p.items()) for p, _ in found}
    order = sorted(found, key=lambda e: (room[id(e[0])], -e[1]))
    for more in (False, True):
        for pattern, x in order:
            empty = room[id(pattern)]
            if empty and (more or (waste is not None and empty > waste)):
                continue
            times = min(1 if more else int(x), *(int(left[n]) // a for n, a in pattern.items()))
            if times:
                for n, a in pattern.items():
                    left[n] -= a * times
                plan.append((pattern, times))
    return plan


def dealt_patterns(counts: np.ndarray, capacity: int) -> tuple[list[tuple[Pattern, int]], list[tuple[Pattern, int]]]:
    """(the plan of fewest sequences for ``counts``, what of it the linear
    program dealt); of equal plans the one of which it dealt most.

    Best fit for all pieces is one of the plans, for histograms on which every
    rounding is worse.
    """
    if not counts.any():
        return [], []
    found = linear_program(counts, capacity)
    best: tuple | None = None
    for held in (*HELD_BACK, 1.0):
        most = np.floor(counts * (1 - held)).astype(np.int64)
        for waste in WASTES if held < 1 else (0,):
            dealt = rounded(found, most, capacity, waste)
            left = counts.copy()
            for pattern, times in dealt:
                for n, a in pattern.items():
                    left[n] -= a * times
            plan = best_fit(left, capacity, dealt)
            rank = sum(t for _, t in plan), int(left.sum())
            if best is None or rank < best[0]:
                best = rank, plan, dealt
    return best[1], best[2]


def pack_histogram(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Configurations and whole numbers of uses that use up ``counts``."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    plan: list[tuple[Pattern, int]] = [({capacity: 1}, int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    return plan + dealt_patterns(left, capacity)[0]


def _pieces(path: str, end: int, capacity: int, lean: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = SMALL if lean else LARGE
        encoder = WordEncoder.of(path, size)
        for docs, texts in in_slices(batches, encoder.slice_bytes):
            rows: list[tuple] = []
            ids, begin = encoder.encode(texts)
            last = np.array([end], np.uint32).tobytes()
            for doc, x, y in zip(docs, begin[:-1].tolist(), begin[1:].tolist()):
                raw = ids[x:y].tobytes() + last
                n = len(raw) // 4
                first = (n - 1) % capacity + 1
                edges = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append((doc, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])))
            doc, k, a, n, crc = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, docs.type), pa.array(k, pa.int32()), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                ["_id", "piece", "start", "length", "ids_crc32"],
            )
        if lean:
            del encoder
            WordEncoder.drop(path, size)

    return cut


def _placer(plan: list[tuple[Pattern, int]]):
    """Places (length, rank) by searching the plan's slots of that length."""
    keys, bases, copies, offsets = [], [], [], []
    taken: dict[int, int] = {}
    base = 0
    for pattern, times in plan:
        offset = 0
        for n, a in sorted(pattern.items(), reverse=True):
            keys.append((n << 44) + taken.get(n, 0))
            bases.append(base)
            copies.append(a)
            offsets.append(offset)
            taken[n] = taken.get(n, 0) + a * times
            offset += n * a
        base += times
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    key, first, many, offset = (np.array(x, np.int64)[order] for x in (keys, bases, copies, offsets))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            want = (length << 44) + batch.column("_rank").to_numpy(zero_copy_only=False)
            i = np.searchsorted(key, want, side="right") - 1
            nth = want - key[i]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("_id", "piece", "start", "length", "ids_crc32")],
                    pa.array(first[i] + nth // many[i]),
                    pa.array(offset[i] + nth % many[i] * length),
                ],
                ["_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return place


def pack_sequences(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    end: int = END,
    capacity: int = CAPACITY,
    lean: bool = False,
) -> DataFrame:
    """Pieces of all documents and their places in sequences.

    A document is its text's ids and ``end``; null and empty texts are ``end``
    alone.  Only a document of more than ``capacity`` ids is cut; its first
    piece is the short one.  Rows that repeat an id or have none are packed each
    on its own.  Other columns are ignored, whatever their names.  An empty
    table gives an empty result.  ``lean``: workers keep nothing of a
    vocabulary between tasks, for executors that have other stages' workers.

    Returns ``id_col, piece, start, length, ids_crc32, sequence_id, offset``.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"_id {kind}, piece int, start long, length long, ids_crc32 long"
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    cut = texts.mapInArrow(_pieces(vocabulary or default_vocabulary(), end, capacity, lean), fields)
    with arrow_rows(docs.sparkSession, SMALL_BATCH) if lean else nullcontext():
        pieces = stored(cut, "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # capacity rows at most
        counts[r["length"]] = r["count"]
    plan = pack_histogram(counts, capacity)
    chunks = max(LEAST_CHUNKS, int(counts.sum()) // CHUNK_PIECES)
    own = ["_id", "piece", "start", "ids_crc32"]  # rows that repeat an id differ in these or are equal
    dealt = pieces.withColumn("_chunk", F.pmod(F.xxhash64(*own), F.lit(chunks)))
    ranked = with_rank(dealt, ["length"], "_chunk", [F.col(c) for c in own], "_rank").drop("_chunk")
    placed = ranked.mapInArrow(_placer(plan), f"{fields}, sequence_id long, offset long")
    return placed.withColumnRenamed("_id", id_col)
