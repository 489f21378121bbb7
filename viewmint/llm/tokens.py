"""Byte-level BPE ids of whole texts, by the ``tokenizers`` library.

BPE never merges across pre-token borders, so a text's ids are the ids of its
pre-tokens in a row.  Words repeat a lot, so each distinct space-separated word
of a slice of texts is looked up or encoded once, and its ids are copied to
where it stands.  The first words that a worker meets stay known, up to a bound.
A text with white space whose borders depend on its neighbours (two white-space
characters in a row, any other than space and newline, or a space at the end)
is encoded whole.
"""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded at a time, words that a worker keeps the ids
#: of (40 bytes each), and words encoded in one call: small, where a worker
#: shares its executor with other stages, or large, for speed.
SMALL, LARGE = (2_000_000, 250_000, 4_000), (10_000_000, 1_500_000, 20_000)
#: Rows of a batch of texts where memory is short.
SMALL_BATCH = 1000

_WHITE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_RARE = r"\t\r\f" + _WHITE[2:]
#: Texts to encode whole; the last two hold what marks words or special ids.
_WHOLE = rf"[{_WHITE}][{_WHITE}]|[{_RARE}]| \z|\x00|<\|"


def default_vocabulary() -> str:
    """Path of the 50k byte-level BPE vocabulary installed with Python."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class WordEncoder:
    """Encodes arrays of texts; one instance per worker and vocabulary file."""

    _made: dict[tuple, WordEncoder] = {}

    def __init__(self, path: str, size: tuple[int, int, int] = SMALL):
        self.slice_bytes, self._most_known, self._call_words = size
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        newline = self._ids("\n")
        if len(newline) != 1:
            raise ValueError("a vocabulary with one id for the newline is asked for")
        self._newline = newline[0]
        self._known = pa.array([], pa.string())
        self._pool = np.zeros(0, np.uint32)  # the ids of known words in a row
        self._starts = np.zeros(1, np.int64)

    @classmethod
    def of(cls, path: str, size: tuple[int, int, int] = SMALL) -> WordEncoder:
        if (path, size) not in cls._made:
            cls._made[path, size] = cls(path, size)
        return cls._made[path, size]

    @classmethod
    def drop(cls, path: str, size: tuple[int, int, int]) -> None:
        """Forgets an encoder, for a worker that stays idle afterwards."""
        cls._made.pop((path, size), None)
        give_back()

    def _ids(self, text: str) -> np.ndarray:
        (made,) = self._tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(made.ids, dtype=np.uint32)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each).

        Words are encoded in one go, each on a line of its own: a lone newline
        is a pre-token, so its id marks where a word ends.  The newline itself,
        as a word, stands for its id.  The empty word has none and no line
        either: two newlines in a row can be one pre-token.
        """
        parts, counts = [], []
        for i in range(0, len(words), self._call_words):
            some = words[i : i + self._call_words]
            own = np.array([w == "\n" for w in some])
            lined = np.array([w not in ("", "\n") for w in some])
            ids = self._ids("\n".join([w for w in some if w not in ("", "\n")] + [""]))
            ends = np.flatnonzero(ids == self._newline)
            if len(ends) != lined.sum():  # a newline went into another pre-token: word by word, then
                alone = [self._ids(w) for w in some]
                parts.append(np.concatenate(alone))
                counts.append(np.array([len(a) for a in alone], np.int64))
                continue
            n = own.astype(np.int64)
            n[lined] = np.diff(ends, prepend=-1) - 1
            out = np.full(int(n.sum()), self._newline, np.uint32)
            out[~np.repeat(own, n)] = ids[ids != self._newline]
            parts.append(out)
            counts.append(n)
        return (np.concatenate(parts), np.concatenate(counts)) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _learn(self, words: pa.Array, ids: np.ndarray, n: np.ndarray) -> None:
        room = self._most_known - len(self._known)
        if room <= 0 or not len(words):
            return
        ends = np.cumsum(n[:room])
        self._known = pa.concat_arrays([self._known, words[:room]])
        self._pool = np.concatenate([self._pool, ids[: ends[-1]]])
        self._starts = np.concatenate([self._starts, self._starts[-1] + ends])

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        marked = pc.replace_substring(pc.replace_substring(texts, "\n", "\0\n\0"), " ", "\0 ")
        split = pc.split_pattern(marked, "\0")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        place = pc.fill_null(pc.index_in(words, value_set=self._known), -1).to_numpy(zero_copy_only=False)
        fresh = place < 0
        new = words.filter(pa.array(fresh))
        ids, n_new = self._words(new.to_pylist())
        # the known words' ids, and behind them those of the new ones
        pool = np.concatenate([self._pool, ids])
        n = np.empty(len(words), np.int32)
        start = np.empty(len(words), np.int32)
        n[fresh] = n_new
        start[fresh] = len(self._pool) + np.cumsum(n_new) - n_new
        old = place[~fresh]
        start[~fresh] = self._starts[old]
        n[~fresh] = self._starts[old + 1] - self._starts[old]
        self._learn(new, ids, n_new)
        index = coded.indices.to_numpy(zero_copy_only=False)
        each = n[index]
        ends = np.cumsum(each, dtype=np.int64)
        where = np.repeat((start[index] - (ends - each)).astype(np.int32), each)
        where += np.arange(len(where), dtype=np.int32)
        border = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
        return pool[where], np.concatenate([[0], ends])[border]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's ids begin, and the end).

        Null counts as empty.
        """
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._plain(texts)
        ids, begin = self._plain(texts.filter(pa.array(~whole)))
        alone = [self._ids(t) for t in texts.filter(pa.array(whole)).to_pylist()]
        n = np.zeros(len(texts), np.int64)
        n[~whole] = np.diff(begin)
        n[whole] = [len(a) for a in alone]
        out = np.empty(int(n.sum()), np.uint32)
        of_whole = np.repeat(whole, n)
        out[~of_whole] = ids
        out[of_whole] = np.concatenate(alone)
        return out, np.concatenate([[0], np.cumsum(n)])


def give_back() -> None:
    """Memory that isn't used any more goes back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def in_slices(batches: Iterator[pa.RecordBatch], slice_bytes: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of two-column batches, in slices of bounded text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        slot = np.cumsum(sizes) // slice_bytes
        edges = np.r_[0, np.flatnonzero(slot[1:] != slot[:-1]) + 1, batch.num_rows]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b > a:
                yield batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)
                give_back()
