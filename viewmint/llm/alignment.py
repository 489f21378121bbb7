"""Alignment of two tokenizers' ids over the same bytes.

Each text is cut into tokens by a byte-level BPE (A) and by a piece model (B);
both cover the same bytes.  B's tokens are a static interval index over byte
offsets: for every A token two bisections find the B tokens that it overlaps.
A gap behind an A token that no B token spans is a group boundary.  Within a
group every A token is linked with every B token.

Workers write each document's counts and its distinct id pairs once; how many
documents hold a pair is then counted over the whole corpus by Spark, and the
counts are summed up per document by joins on the pair.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, arrow_rows, stored
from .tokens import SMALL, SMALL_BATCH, WordEncoder, default_vocabulary, give_back, in_slices

#: Links of a group that are listed one by one; larger groups are counted by
#: distinct ids first.
LISTED_LINKS = 4096


def default_pieces() -> str:
    """Path of the 32k piece model installed with Python."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE's characters and the bytes that they stand for: printable
    Latin-1 is itself, the others follow from U+0100 on in their order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Bytes and decimal digits of all ids of a vocabulary, as pools."""

    def __init__(self, entries: list[bytes]):
        self.n = len(entries)
        self.bytes, self.start, self.length = _pooled(entries)
        self.digits = _pooled([str(i).encode() for i in range(len(entries))])


def _pooled(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = np.array([len(e) for e in entries], np.int64)
    return np.frombuffer(b"".join(entries), np.uint8), np.cumsum(length) - length, length


class TextEncoder(WordEncoder):
    """Tokenizer A; strings of special tokens in texts are plain text."""

    _made: dict[tuple, WordEncoder] = {}

    def __init__(self, path: str, size: tuple[int, int, int] = SMALL):
        super().__init__(path, size)
        self._tokenizer.encode_special_tokens = True
        of = _byte_of_char()
        entries = [b""] * self._tokenizer.get_vocab_size(with_added_tokens=True)
        for entry, i in self._tokenizer.get_vocab(with_added_tokens=True).items():
            entries[i] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()
        self.tokens = Tokens(entries)


class PieceEncoder(WordEncoder):
    """Tokenizer B, for texts that begin with the space which it adds itself.

    If spaces stand only in front of pieces and no piece holds a newline, words
    with the space before them and newlines never merge, so the word lookup of
    the other encoder serves here too; otherwise texts are encoded whole.
    """

    _made: dict[tuple, WordEncoder] = {}

    def __init__(self, path: str, size: tuple[int, int, int] = SMALL):
        import sentencepiece

        self.slice_bytes, self._most_known, self._call_words = size
        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        coded = [re.fullmatch("<0x([0-9A-F]{2})>", p) for p in pieces]
        self.tokens = Tokens([bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode() for p, m in zip(pieces, coded)])
        self._apart = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) and self._plainly_coded()
        self._known = pa.array([], pa.string())
        self._pool = np.zeros(0, np.uint32)
        self._starts = np.zeros(1, np.int64)

    def _plainly_coded(self) -> bool:
        # a space in front, and a newline as a token of its own that words don't touch
        alone, line, both = (self._model.encode(x) for x in ("x", "\n", "\nx"))
        return len(line) == 2 and both[:2] == line and line[0] == self._model.piece_to_id("▁") and self._model.encode("x x") == alone * 2

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._model.encode(text[1:]), np.uint32)  # texts come with the space that the model adds

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words behind a space lose it, as the model adds one; others are
        encoded behind a newline, whose two tokens are taken away again."""
        parts, counts = [], []
        for i in range(0, len(words), self._call_words):
            some = words[i : i + self._call_words]
            made = self._model.encode([w[1:] if w.startswith(" ") else "\n" + w if w not in ("", "\n") else w for w in some], num_threads=1)
            made = [ids if w.startswith(" ") else ids[1:] if w == "\n" else ids[2:] for w, ids in zip(some, made)]
            counts.append(np.array([len(m) for m in made], np.int64))
            parts.append(np.fromiter((x for m in made for x in m), np.uint32, int(counts[-1].sum())))
        return (np.concatenate(parts), np.concatenate(counts)) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self._apart:
            return super()._plain(texts)
        made = [self._ids(t) for t in texts.to_pylist()]
        return np.concatenate([np.zeros(0, np.uint32), *made]), np.cumsum([0, *(len(m) for m in made)])


def _gathered(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The pool's runs (start, length) in a row."""
    ends = np.cumsum(length)
    return pool[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]


def _same_bytes(tokens: Tokens, ids: np.ndarray, begin: np.ndarray, text: np.ndarray, text_begin: np.ndarray) -> np.ndarray:
    """Of each text, whether its tokens' bytes in a row are the text's."""
    sizes = np.concatenate([[0], np.cumsum(tokens.length[ids])])[begin]
    same = np.diff(sizes) == np.diff(text_begin)
    if same.all():
        wrong = np.flatnonzero(_gathered(tokens.bytes, tokens.start[ids], tokens.length[ids]) != text)
        same[np.searchsorted(text_begin, wrong, "right") - 1] = False
        return same
    for i in np.flatnonzero(same):
        own = ids[begin[i] : begin[i + 1]]
        same[i] = np.array_equal(_gathered(tokens.bytes, tokens.start[own], tokens.length[own]), text[text_begin[i] : text_begin[i + 1]])
    return same


def group_tokens(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups (first token, and the end, of A's and of B's, by rows) of tokens
    given by their ends over the same bytes."""
    b_start = np.concatenate([[0], b_end[:-1]])
    # the B tokens that an A token overlaps end at the last one that starts before its end
    last = np.searchsorted(b_start, a_end, "left")
    cuts = b_end[last - 1] <= a_end  # no B token spans the gap behind the A token
    a_to, b_to = np.flatnonzero(cuts) + 1, last[cuts]
    return np.stack([np.concatenate([[0], a_to[:-1]]), a_to]), np.stack([np.concatenate([[0], b_to[:-1]]), b_to])


def _runs(n: np.ndarray) -> np.ndarray:
    """0, 1 .. n[0] - 1, 0, 1 .. n[1] - 1 and so on."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)


def _links(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, doc: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, times) of all links, a row for each pair of a document.

    ``doc`` is each group's document.  A pair is ``a * n_b + b``.
    """
    n_a_of, n_b_of = np.diff(a_group, axis=0)[0], np.diff(b_group, axis=0)[0]
    links = n_a_of * n_b_of
    small = links <= LISTED_LINKS
    each = np.flatnonzero(small)
    at, of = _runs(links[each]), np.repeat(each, links[each])
    pair = a[a_group[0][of] + at // n_b_of[of]].astype(np.int64) * n_b + b[b_group[0][of] + at % n_b_of[of]]
    docs, pairs, times = [doc[of]], [pair], [np.ones(len(pair), np.int64)]
    for g in np.flatnonzero(~small):
        ua, ca = np.unique(a[a_group[0][g] : a_group[1][g]], return_counts=True)
        ub, cb = np.unique(b[b_group[0][g] : b_group[1][g]], return_counts=True)
        pairs.append((ua.astype(np.int64)[:, None] * n_b + ub[None, :]).ravel())
        times.append((ca[:, None] * cb[None, :]).ravel())
        docs.append(np.full(len(pairs[-1]), doc[g]))
    docs, pairs, times = (np.concatenate(x) for x in (docs, pairs, times))
    order = np.lexsort((pairs, docs))
    docs, pairs, times = docs[order], pairs[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (pairs[1:] != pairs[:-1])])) if len(docs) else np.zeros(0, np.int64)
    return docs[first], pairs[first], np.add.reduceat(times, first) if len(first) else times


def _written(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, a_tokens: Tokens, b_tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(characters of all groups as ``a1,a2|b1;``, where each group's end).

    Every id is followed by its separator, the last one of a group by ``;``.
    """
    n_a, n_b = np.diff(a_group, axis=0)[0], np.diff(b_group, axis=0)[0]
    group_a, group_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
    place_a = np.arange(len(a)) + b_group[0][group_a]  # B's of the groups before come first
    place_b = np.arange(len(b)) + a_group[1][group_b]
    n = len(a) + len(b)
    pool = np.concatenate([a_tokens.digits[0], b_tokens.digits[0]])
    start, length, behind = np.empty(n, np.int64), np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    start[place_a], length[place_a] = a_tokens.digits[1][a], a_tokens.digits[2][a]
    start[place_b], length[place_b] = b_tokens.digits[1][b] + len(a_tokens.digits[0]), b_tokens.digits[2][b]
    behind[place_a[a_group[1] - 1]] = ord("|")
    behind[place_b[b_group[1] - 1]] = ord(";")
    ends = np.cumsum(length + 1)
    out = np.empty(ends[-1], np.uint8)
    is_digit = np.ones(ends[-1], bool)
    is_digit[ends - 1] = False
    out[ends - 1] = behind
    out[is_digit] = _gathered(pool, start, length)
    return out, ends[place_b[b_group[1] - 1]]


def align_texts(texts: pa.Array, a_encoder: TextEncoder, b_encoder: PieceEncoder) -> dict[str, list | np.ndarray | pa.Array]:
    """Columns ``n_a .. groups_sha256, pairs, times`` of a slice of texts."""
    n = len(texts)
    texts = pc.fill_null(texts, "")
    spaced = pc.binary_join_element_wise(pa.array([" "] * n, pa.string()), texts.cast(pa.string()), "")
    (a, a_begin), (b, b_begin) = a_encoder.encode(spaced), b_encoder.encode(spaced)
    _, offsets, data = spaced.buffers()
    text_begin = np.frombuffer(offsets, np.int32)[spaced.offset : spaced.offset + n + 1].astype(np.int64)
    text = np.frombuffer(data, np.uint8)[text_begin[0] : text_begin[-1]] if data else np.zeros(0, np.uint8)
    text_begin = text_begin - text_begin[0]
    good = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for tokens, ids, begin in ((a_encoder.tokens, a, a_begin), (b_encoder.tokens, b, b_begin)):
        good &= _same_bytes(tokens, ids, begin, text, text_begin)
    keep_a, keep_b = np.repeat(good, np.diff(a_begin)), np.repeat(good, np.diff(b_begin))
    a, b = a[keep_a].astype(np.int64), b[keep_b].astype(np.int64)
    n_a, n_b = np.diff(a_begin) * good, np.diff(b_begin) * good
    out = {"n_a": n_a, "n_b": n_b, "n_groups": np.zeros(n, np.int64), "n_links": np.zeros(n, np.int64), "groups_sha256": [""] * n}
    edges, pairs, times = np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(a):
        a_group, b_group = group_tokens(np.cumsum(a_encoder.tokens.length[a]), np.cumsum(b_encoder.tokens.length[b]))
        doc = np.searchsorted(np.cumsum(n_a), a_group[0], "right")
        out["n_groups"] = np.bincount(doc, minlength=n)
        links = np.diff(a_group, axis=0)[0] * np.diff(b_group, axis=0)[0]
        np.add.at(out["n_links"], doc, links)
        written, ends = _written(a, b, a_group, b_group, a_encoder.tokens, b_encoder.tokens)
        last = ends[np.cumsum(out["n_groups"])[good] - 1]
        first = np.concatenate([[0], last[:-1]])
        view = memoryview(written)
        for i, x, y in zip(np.flatnonzero(good).tolist(), first.tolist(), last.tolist()):
            out["groups_sha256"][i] = hashlib.sha256(view[x : y - 1]).hexdigest()  # without the last separator
        docs, pairs, times = _links(a, b, a_group, b_group, doc, b_encoder.tokens.n)
        edges = np.searchsorted(docs, np.arange(n + 1))
    offsets = pa.array(edges.astype(np.int32))
    out["pairs"] = pa.ListArray.from_arrays(offsets, pa.array(pairs, pa.int64()))
    out["times"] = pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))
    return out


_SCHEMA = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Tokens, groups, links and distinct pairs of every row, see :func:`align_documents`.

    ``pairs`` are ``a * (size of B's vocabulary) + b``, ascending, and
    ``times`` how often each is linked.
    """
    a_path, b_path = a_path or default_vocabulary(), b_path or default_pieces()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_encoder, b_encoder = TextEncoder.of(a_path), PieceEncoder.of(b_path)
        for ids, texts in in_slices(batches, a_encoder.slice_bytes):
            made = align_texts(texts, a_encoder, b_encoder)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(v) if isinstance(v, (list, np.ndarray)) else v for v in made.values())], names=["_id", *made])
            del made
            gc.collect()
        give_back()

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"_id {kind}, {_SCHEMA}")


def align_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    a_path: str | None = None,
    b_path: str | None = None,
) -> DataFrame:
    """Tokens of both tokenizers, their groups and links, for every row.

    A text is encoded whole by both, without special tokens.  A null or empty
    text, and one that isn't what its tokens' bytes spell (a literal U+2581,
    say), has no tokens: zeros and an empty ``groups_sha256``.  Every row is a
    document of its own, also where ids repeat or are null; ties for an A id's
    highest count all count.  Other columns may have any names; an empty table
    gives an empty result.

    How many rows hold a pair linked is counted over all rows.  The commonest
    pairs, at most 2^20, are broadcast (all pairs, if they are no more); the
    rest, which have less than a 2^20th of all entries each, meet by a shuffle.

    Returns ``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.
    """
    with arrow_rows(docs.sparkSession, SMALL_BATCH):
        # written once, so that a row keeps its number whatever is run again
        made = stored(aligned(docs, id_col, text_col, a_path, b_path).withColumn("_row", F.monotonically_increasing_id()), "aligned")
    n_b = PieceEncoder.of(b_path or default_pieces()).tokens.n
    entries = made.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("_e")).select("_row", F.col("_e.pairs").alias("pair"), F.col("_e.times").alias("times"))
    held = stored(made.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("held")), "pairs")
    a_id = F.floor(F.col("pair") / F.lit(n_b)).cast("long")
    highest = held.groupBy(a_id.alias("_a")).agg(F.max("held").alias("_most"))  # an A id's rows at most
    counts = stored(held.withColumn("_a", a_id).join(highest, "_a").select("pair", "held", (F.col("held") == F.col("_most")).alias("best")), "pair-counts")
    n, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("held"), F.lit(0))).first()
    limit = 0 if n <= BROADCAST_ROWS else total // BROADCAST_ROWS
    common, rare = F.broadcast(counts.where(F.col("held") > limit)), counts.where(F.col("held") <= limit)

    def summed(met: DataFrame) -> DataFrame:
        best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0))
        return met.groupBy("_row").agg(best.alias("n_best"), F.sum(F.col("times") * F.col("held")).alias("count_sum"))

    sums = summed(entries.join(common, "pair"))
    if limit:
        rest = entries.join(common.select("pair"), "pair", "left_anti").join(rare, "pair")
        sums = sums.unionByName(summed(rest)).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return made.drop("pairs", "times").join(sums, "_row", "left").select(
        F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256"
    )
