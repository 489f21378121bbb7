"""Alignment of two tokenizers against brute force, on tables and odd rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("viewmint.llm")

SMALL = "/root/testdata/sf0.001"
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def both():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, more = {chr(x): x for x in keep}, 0
    for x in range(256):
        if x not in keep:
            chars[chr(256 + more)] = x
            more += 1
    a_bytes = {i: bytes(chars[c] for c in t) for t, i in a.get_vocab().items() if all(c in chars for c in t)}

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()

    def tokens(text):
        """[(id, start, end)] of A and of B, or nothing."""
        if not text:
            return [], []
        out = []
        for ids, of in ((a.encode(" " + text, add_special_tokens=False).ids, a_bytes.get), (b.encode(text), b_bytes)):
            at, found, joined = 0, [], b""
            for i in ids:
                entry = of(i)
                found.append((i, at, at + len(entry)))
                at += len(entry)
                joined += entry
            if joined != (" " + text).encode():
                return [], []
            out.append(found)
        return out

    return tokens


def _brute(rows, tokens):
    held, docs = defaultdict(int), []
    for key, text in rows:
        a, b = tokens(text)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        of_a, of_b = [[] for _ in cuts], [[] for _ in cuts]
        for found, of in ((a, of_a), (b, of_b)):
            g = 0
            for i, _, end in found:
                while end > cuts[g]:
                    g += 1
                of[g].append(i)
        links = Counter()
        for x, y in zip(of_a, of_b):
            for i, n in Counter(x).items():
                for j, m in Counter(y).items():
                    links[i, j] += n * m
        for pair in links:
            held[pair] += 1
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in zip(of_a, of_b))
        docs.append((key, len(a), len(b), len(cuts), links, hashlib.sha256(written.encode()).hexdigest() if cuts else ""))
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    return sorted(
        ((k, a, b, g, sum(links.values()), sum(t for p, t in links.items() if held[p] == most[p[0]]), sum(t * held[p] for p, t in links.items()), sha) for k, a, b, g, links, sha in docs),
        key=str,
    )


def _found(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


def test_query_against_brute_force(spark, both):
    from viewmint.llm.queries import QUERIES

    df = QUERIES["op11_alignment"](spark, SMALL)
    assert df.dtypes == [(c, "string" if c == "groups_sha256" else "bigint") for c in NAMES]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    found = _found(df)
    assert found == _brute(rows, both)
    assert sum(r[3] for r in found) < sum(r[1] for r in found)  # some groups hold several tokens


ODD = [
    None, "", " ", "  ", "\n", "x\n", "\nx", "\n\n x", "one", " one", "one ", "one  two", "a\tb\r\nc\x0b", "▁ piece", "x▁y", "\x00", "a\x00b", "<|endoftext|> x", "a<|endoftext|>", "<s> </s> <unk> <0x41>",
    "é ü ß 汉字 漢字かな 👩‍👩‍👧 🏳️‍🌈", "हिन्दी ไทย", "  x　y", "İı ſ ﬁ", "1234567890 12,345.67", "ha" * 3000, "ahah" * 3000, "汉" * 3000, "word " * 20_000, "x" * 50_000, " " * 3000, "don't can't I'll", "same text", "same text",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [*enumerate(ODD), (3, "same text"), (None, "same text"), (None, None), (3, "same text")]
    # columns of the names that the operator uses and returns
    return rows, spark.createDataFrame([(k, t, "x", 1, 2, "y") for k, t in rows], "doc_id long, text string, pairs string, _row int, n_a int, times string").repartition(3)


def test_odd_rows(spark, both, odd):
    from viewmint.llm.alignment import align_documents

    rows, df = odd
    assert _found(align_documents(df)) == _brute(rows, both)
    assert align_documents(df.limit(0)).count() == 0
    assert _found(align_documents(df.where("text = ''"))) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_rare_pairs_meet_by_a_shuffle(spark, both, odd, monkeypatch):
    from viewmint.llm import alignment

    rows, df = odd
    monkeypatch.setattr(alignment, "BROADCAST_ROWS", 20)
    assert _found(alignment.align_documents(df)) == _brute(rows, both)


def test_large_groups_are_counted_by_distinct_ids(monkeypatch, both):
    from viewmint.llm import alignment

    a, b = alignment.TextEncoder.of(alignment.default_vocabulary()), alignment.PieceEncoder.of(alignment.default_pieces())
    texts = pa.array(["ahah" * 50, "hahaha " * 40, *[t for t in ODD if t]])
    plain = alignment.align_texts(texts, a, b)
    monkeypatch.setattr(alignment, "LISTED_LINKS", 1)
    counted = alignment.align_texts(texts, a, b)
    assert all(list(plain[c]) == list(counted[c]) if isinstance(plain[c], (list, np.ndarray)) else plain[c].equals(counted[c]) for c in plain)
    assert plain["n_links"].sum() > plain["n_a"].sum()


def test_piece_words_equal_whole_texts(both):
    """The word lookup of B gives what the model gives for whole texts (without
    U+2581, whose texts never spell what was encoded)."""
    from viewmint.llm.alignment import PieceEncoder, default_pieces

    encoder, draw = PieceEncoder.of(default_pieces()), random.Random(3)
    assert encoder._apart
    parts = ["a", "the", " ", " ", "\n", "x1", "é", "汉", "'s", "<s>", "--", "\t", "İ", "9", "word", "👩"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 12))) for _ in range(4000)]
    ids, begin = encoder.encode(pa.array([" " + t for t in texts]))
    for i, t in enumerate(texts):
        assert ids[begin[i] : begin[i + 1]].tolist() == encoder._model.encode(t), repr(t)
