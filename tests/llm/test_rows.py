"""Rows without an id, rows that repeat one, and what a full source takes."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("viewmint.llm")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FIELDS = "doc_id long, text string, source string"


def _passage(seed: int, n: int = 25) -> str:
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**6, n))


def _by_row(rows):
    """Windows judged by row: documents in order of id (null last) and digest of the text."""
    docs = sorted({(i is None, i or 0, hashlib.md5((t or "").encode()).hexdigest()[:3], hashlib.md5((t or "").encode()).hexdigest(), t or "") for i, t in rows})
    first, left = {}, {}
    for doc in docs:
        words = WORD.findall(doc[-1])
        for k in range(len(words) - 19):
            first.setdefault(tuple(words[k : k + 20]), (doc, k))
    for doc in docs:
        words = WORD.findall(doc[-1])
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            if first[tuple(words[k : k + 20])] != (doc, k):
                gone[k : k + 20] = [True] * 20
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        left[(None if doc[0] else doc[1], doc[-1])] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return Counter((i, *left[(i, t or "")]) for i, t in rows)


def test_substrings_without_and_with_repeated_ids(spark):
    from viewmint.llm.substrings import remove_repeats

    a, b, c = _passage(1), _passage(2), _passage(3)
    for rows in (
        [(1, a), (None, a), (None, b)],
        [(7, a), (7, b), (7, a)],
        [(None, f"{a} {b}"), (None, f"x {b}"), (None, c), (None, None), (None, "")],
        [(7, f"{a} {b}"), (7, f"{b} {c}"), (7, f"{b} {c}"), (8, c), (None, f"{c} {a}"), (3, f"{a} {a}")],
    ):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert Counter(tuple(r) for r in remove_repeats(docs).collect()) == _by_row(rows)


def test_substrings_of_random_rows(spark):
    from viewmint.llm.substrings import remove_repeats

    rng = random.Random(4)
    parts = [_passage(k, rng.randint(15, 40)) for k in range(6)]
    rows = [(rng.choice([None, 1, 2, 3, 4]), " ".join(rng.choice(parts) for _ in range(rng.randint(0, 4)))) for _ in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(tuple(r) for r in remove_repeats(docs).collect()) == _by_row(rows)


def test_buckets_are_those_of_spark(spark):
    from pyspark.sql import functions as F

    from viewmint.llm.substrings import _bucket_of

    ids, numbers = [0, 1, -5, 2**62, 2**63 - 1], [0, 3, 1, 0, 2**40]
    rows = spark.createDataFrame(list(zip(ids, numbers)), "a long, b long").select(F.pmod(F.xxhash64("a", "b"), F.lit(1000))).collect()
    assert [r[0] for r in rows] == _bucket_of(np.array([ids, numbers], np.int64), 1000).tolist()


@pytest.fixture(scope="module")
def sources(spark):
    rows = [(i, "one two three", "big") for i in range(50)] + [(100, "alone", "full"), (101, "", "full"), (102, None, "full"), (103, " ", "none")]
    rows += [(None, f"text {i}", "idless") for i in range(40)] + [(5, "same row", "twice")] * 7
    return spark.createDataFrame(rows, FIELDS).repartition(3)


def test_mix_takes_rows_as_planned(sources):
    from viewmint.llm.mixing import apply_mix, mix_sources

    plan = mix_sources(sources).collect()
    assert all(0 <= r["repeats"] <= 3 for r in plan)
    wanted: Counter = Counter()
    for r in plan:
        wanted[r["source"]] += r["repeats"]
    made = Counter(r["source"] for r in apply_mix(sources).collect())
    assert made == +wanted
    copies = Counter((r["doc_id"], r["text"], r["source"]) for r in apply_mix(sources).collect())
    there = Counter((r["doc_id"], r["text"], r["source"]) for r in sources.collect())
    assert all(n <= 3 * there[k] for k, n in copies.items())
    assert copies == Counter((r["doc_id"], r["text"], r["source"]) for r in apply_mix(sources.repartition(5)).collect())


def test_filters_judge_rows_by_their_texts(spark):
    from viewmint.llm.exact_dedup import drop_exact_copies
    from viewmint.llm.simhash import drop_near_copies

    long = [_passage(k, 60) for k in range(5)]
    rows = [(3, long[0], "a"), (7, long[0], "b"), (7, long[1], "c"), (None, long[0], "d"), (None, long[2], "e"), (None, long[2], "f"), (9, long[3], "g"), (9, long[3], "h"), (9, long[4], "i")]
    docs = spark.createDataFrame(rows, FIELDS).repartition(3)
    kept = [tuple(r) for r in drop_exact_copies(docs).collect()]
    assert Counter(t for _, t, _ in kept) == Counter(long) and (3, long[0], "a") in kept and (7, long[1], "c") in kept
    assert (None, long[2], "e") in kept and (9, long[3], "g") in kept
    near = [tuple(r) for r in drop_near_copies(docs).collect()]
    assert {t for _, t, _ in near} == set(long) and (7, long[0], "b") not in near and (None, long[0], "d") not in near


def test_token_files_do_not_depend_on_the_deal(spark):
    from viewmint.llm.rans import tokens_round_trip

    rows = [(1, f"text {k} " + "x " * k) for k in range(40)] + [(None, f"no id {k}") for k in range(9)] + [(0, "first")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(tuple(r) for r in tokens_round_trip(docs.repartition(1)).select("start", "n_tokens", "ids_crc32").collect())
    four = sorted(tuple(r) for r in tokens_round_trip(docs.repartition(4, "text")).select("start", "n_tokens", "ids_crc32").collect())
    assert one == four and len(one) == 50


def test_hot_join_gives_each_row_its_key(spark, monkeypatch):
    from viewmint.llm import common

    many = spark.createDataFrame([(i, 0 if i % 3 else i, None) for i in range(300)] + [(300, None, None), (301, -1, None)], "id long, k long, _x string")
    one = many.where("k is null or k >= 0").groupBy("k").count().selectExpr("k", "count as n", "concat('v', coalesce(k, -9)) as v")
    for least in (10, 10**6):
        monkeypatch.setattr(common, "HOT_ROWS", least)
        got = {r["id"]: r["v"] for r in common.hot_join(many, "k", one, "k", "n", 302).collect()}
        assert got == {i: f"v{0 if i % 3 else i}" for i in range(300)} | {300: "v-9", 301: None}


def test_shared_folder_is_asked_for_on_a_cluster(monkeypatch):
    from viewmint.llm.common import shared_dir

    class Nothing:
        master = "spark://host:7077"

        def get(self, *_):
            return None

        def getCheckpointDir(self):
            return None

    session = Nothing()
    session.conf, session.sparkContext = Nothing(), Nothing()
    with pytest.raises(ValueError):
        shared_dir(session)


def _fuzz_texts(seed: int):
    bits = [" ", "  ", "\n", "\n\n", "\t", "\r", "a", "the", "The", " dog", "'s", "é", "日本", "　", "\xa0", "\x0b", "\x1c", "\x85", "<|endoftext|>", "<|", "23", "!!", "\x00", "😀", "​", " ", "_"]
    rng = random.Random(seed)
    while True:
        yield [None if rng.random() < 0.05 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 8))]


def test_word_encoder_equals_the_tokenizer():
    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer

    from viewmint.llm.tokens import SMALL, WordEncoder, default_vocabulary

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoders = [WordEncoder(default_vocabulary(), (3_000_000, 300, 7)), WordEncoder(default_vocabulary(), SMALL)]
    for _, texts in zip(range(2000), _fuzz_texts(1)):
        for e in encoders:
            ids, begin = e.encode(pa.array(texts, pa.string()))
            got = [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])]
            assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_packing_and_token_output_of_leading_spaces(spark):
    from viewmint.llm.packing import pack_sequences
    from viewmint.llm.rans import tokens_round_trip

    docs = spark.createDataFrame([(1, "foo"), (2, " bar"), (3, "\n x"), (4, ""), (5, " ")], "doc_id long, text string").coalesce(1)
    assert pack_sequences(docs).count() == 5 and tokens_round_trip(docs).count() == 5


def _independent_scores(x, y, to_pooled, to_identity):
    """Log odds of regularised quadratic discriminants, by solving with the
    covariances themselves."""
    own = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    n = np.array([(y == c).sum() for c in (0, 1)])
    pooled = (own[0] * n[0] + own[1] * n[1]) / n.sum()
    p = x.shape[1]

    def density(v, c):
        cov = (1 - to_identity) * ((1 - to_pooled) * own[c] + to_pooled * pooled) + to_identity * (np.trace(pooled) / p + 1e-6) * np.eye(p)
        d = v - x[y == c].mean(axis=0)
        return -0.5 * np.sum(d * np.linalg.solve(cov, d.T).T, axis=1) - 0.5 * np.linalg.slogdet(cov)[1] + np.log((n[c] + 1) / (n.sum() + 2))

    return lambda v: 1 / (1 + np.exp(-np.clip(density(v, 1) - density(v, 0), -500, 500)))


def test_quality_scores_are_those_of_an_independent_fit(spark):
    import zlib

    from viewmint.llm.quality import KEEP_FROM, TO_IDENTITY, TO_POOLED, features, quality_scores

    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    x = {r["_id"]: np.array(r["_x"]) for r in features(docs, "doc_id", "text").collect()}
    told = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] in x and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    ids = sorted(told)
    score = _independent_scores(np.array([x[i] for i in ids]), np.array([told[i] for i in ids]), TO_POOLED, TO_IDENTITY)
    every = sorted(x)
    want = dict(zip(every, score(np.array([x[i] for i in every]))))
    rows = quality_scores(docs, labels).collect()
    assert len(rows) == len(every)
    for r in rows:
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-8) and r["predicted"] == int(r["score"] >= KEEP_FROM)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_statistics_by_hand(spark):
    from viewmint.llm.quality import features

    texts = [(1, "The cat cat sat."), (2, None), (3, ""), (4, " \t "), (5, "A! #1 |x|")]
    rows = {r["_id"]: r["_x"] for r in features(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text").collect()}
    assert rows[2] == rows[3] and all(np.isfinite(v).all() for v in rows.values())
    assert rows[1][0] == pytest.approx(np.log(5)) and rows[1][1] == pytest.approx(np.log(0.002 + (3 + 8) / 14)) and rows[1][2] == pytest.approx(np.log(0.002 + 1.1 / 14))
    assert rows[4][0] == 0 and rows[5][0] == pytest.approx(np.log(4))


def test_preferences_of_odd_conversations(spark):
    from viewmint.llm.preference import conversations_of, format_preferences, replies_as_pairs

    long = "word " * 200_000
    fields = "conv_id long, turn long, role string, text string, prompt string, chosen int, usable string"
    rows = [
        (1, 0, "user", long, "p", 1, "u"), (1, 1, "assistant", "a", "p", 1, "u"), (1, 2, "assistant", long, "p", 1, "u"), (1, 3, "user", "after", "p", 1, "u"),
        (2, 0, "assistant", "x", None, None, None), (2, 0, "assistant", "x", None, None, None),
        (None, 5, "user", "lonely", None, None, None), (None, 5, "user", "lonely", None, None, None), (None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, fields).repartition(3)
    assert sum(len(r["turns"]) for r in conversations_of(df).collect()) == len(rows)
    made = format_preferences(replies_as_pairs(df)).collect()
    assert len(made) == 5 and sum(r["conv_id"] is None for r in made) == 3
    one = next(r for r in made if r["conv_id"] == 1)
    assert one["n_prompt_turns"] == 2 and one["chosen"].endswith("<|user|>\nafter<|end|>\n") and one["rejected"] == "<|assistant|>\na<|end|>\n<|user|>\nafter<|end|>\n" and one["usable"]
    assert long in one["prompt"] and long in one["chosen"]
    twice = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "b")])] * 2 + [(2, [("user", "q")], None)], "conv_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    again = format_preferences(twice).collect()
    assert [r["n_prompt_turns"] for r in again if r["conv_id"] == 1] == [1, 1] and [r["usable"] for r in again if r["conv_id"] == 2] == [False]


def test_no_turn_is_left_out(spark):
    from viewmint.llm.preference import format_preferences, replies_as_pairs

    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    whole: dict = {}
    for r in turns.orderBy("conv_id", "turn", "role", "text").collect():
        whole.setdefault(r["conv_id"], []).append(f"<|{r['role']}|>\n{r['text']}<|end|>\n")
    for r in format_preferences(replies_as_pairs(turns)).collect():
        assert r["prompt"] + r["chosen"] == "".join(whole[r["conv_id"]])
