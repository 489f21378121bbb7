"""Queries against brute force, on the smallest tables and on odd rows."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

pytest.importorskip("viewmint.llm")

SMALL = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "word " * 30_000

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        # names that clash with what the operators use inside or return
        T.StructField("size", T.StringType()),
        T.StructField("_id", T.LongType()),
        T.StructField("score", T.StringType()),
    ]
)


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", " ", "\n", "one", "one two three", "a  b\tc", "a b c", "A B c", LONG, LONG, "é ü ß x", "same text", "same text", "<|endoftext|> x", "0 1 2 3 4 5"]
    rows = [(i, t, "en", None if i % 3 else f"s{i % 2}", "x", 7, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[12], (None, "no id", None, None, None, None, None)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def _rows(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def _key(x):
    return tuple((v is None, 0 if v is None else v) for v in x)


def _tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("which", ["small", "odd"])
def test_exact_dedup(spark, odd, which):
    from viewmint.llm.exact_dedup import exact_dedup

    docs = _docs(spark) if which == "small" else odd
    groups: dict[str, list] = {}
    for i, t in _rows(docs):
        groups.setdefault(SPACE.sub(" ", t), []).append(i)
    want = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep) for i in ids]
    got = [tuple(r)[:4] for r in exact_dedup(docs).collect()]
    assert sorted(got, key=_key) == sorted(want, key=_key)


def test_counting_quotient_filter_merges_losslessly():
    from viewmint.llm.exact_dedup import CountingQuotientFilter

    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**64, 500, dtype=np.uint64)[rng.integers(0, 500, 3000)]
    parts = [CountingQuotientFilter(5, v) for v in np.array_split(values, 4)]
    merged = parts[0].merge(parts[1]).merge(parts[2]).merge(parts[3])
    known, counts = np.unique(values, return_counts=True)
    assert (merged.fingerprints() == known).all() and (merged.counts == counts).all()
    for quotient, remainders, _ in merged.runs():
        assert (np.diff(remainders.astype(object)) > 0).all() and quotient < 32


def test_merged_slots_are_not_sorted_again(monkeypatch):
    from viewmint.llm import exact_dedup

    rng = np.random.default_rng(4)
    parts = [exact_dedup.CountingQuotientFilter(3, rng.integers(0, 400, n, dtype=np.uint64) << np.uint64(55)) for n in (0, 1, 300, 700)]
    everything = np.concatenate([np.repeat(f.fingerprints(), f.counts) for f in parts])
    for name in ("sort", "unique", "argsort"):
        monkeypatch.setattr(np, name, None)
    merged = parts[0]
    for f in parts[1:]:
        merged = f.merge(merged)
    monkeypatch.undo()
    known, counts = np.unique(everything, return_counts=True)
    assert (merged.fingerprints() == known).all() and (merged.counts == counts).all()


def test_water_filling(spark, odd):
    from viewmint.llm.mixing import mix_sources

    for docs in (_docs(spark), odd):
        rows = mix_sources(docs).collect()
        sizes: dict = {}
        for r in docs.select("source", "text").collect():
            sizes[r["source"]] = sizes.get(r["source"], 0) + len(WORD.findall(r["text"] or ""))
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        target, open_, left = {}, set(names), float(sum(sizes.values()))
        while open_:
            share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            full = {s for s in open_ if share[s] >= 3 * sizes[s]}
            if not full:
                target.update(share)
                break
            for s in full:
                target[s] = 3.0 * sizes[s]
                left -= target[s]
            open_ -= full
        assert len(rows) == docs.count()
        taken: dict = {}
        for r in rows:
            assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
            assert r["target"] == pytest.approx(target[r["source"]])
            taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest = max(r["size"] for r in rows)
        assert all(abs(taken[s] - target[s]) <= largest / 2 + 1e-6 for s in names)


@pytest.mark.parametrize("which", ["small", "odd"])
def test_packing(spark, odd, which):
    from viewmint.llm.packing import pack_sequences

    docs = _docs(spark) if which == "small" else odd
    t = _tokenizer()
    want = []
    for i, text in _rows(docs):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        edges = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    rows = pack_sequences(docs).collect()
    assert sorted((tuple(r)[:5] for r in rows), key=_key) == sorted(want, key=_key)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(x[1] for x in parts[:k]) for k in range(len(parts))]
        assert sum(p[1] for p in parts) <= 1024
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // 1024) * 1.03 + 1


def test_linear_program_covers_all_lengths():
    from viewmint.llm.packing import linear_program, pack_histogram

    counts = np.random.default_rng(5).poisson(np.r_[0, 12_000 / np.arange(20, 1043), 0])
    covered = np.zeros(1025)
    for pattern, x in linear_program(counts, 1024):
        assert sum(n * a for n, a in pattern.items()) <= 1024
        for n, a in pattern.items():
            covered[n] += a * x
    assert (covered >= 0.949 * counts).all()

    packed = np.zeros(1025, np.int64)
    sequences = 0
    for pattern, times in pack_histogram(counts):
        sequences += times
        for n, a in pattern.items():
            packed[n] += a * times
    assert (packed == counts).all()
    assert sequences <= 1.01 * -(-int(counts @ np.arange(1025)) // 1024) + 1


def test_packing_is_no_worse_than_best_fit():
    from viewmint.llm.packing import best_fit, dealt_patterns, pack_histogram

    rng = np.random.default_rng(6)
    flat = np.bincount(rng.integers(260, 701, 20_000), minlength=1025)
    five, four = np.zeros(1025, np.int64), np.zeros(1025, np.int64)
    five[[200, 250, 274, 300, 411]] = 1000
    four[[512, 700, 300, 341]] = 500, 500, 700, 900
    for counts, least in ((flat, 0.1), (five, 0.9), (four, 0.9)):
        plan, dealt = dealt_patterns(counts, 1024)
        assert sum(t for _, t in plan) <= sum(t for _, t in best_fit(counts, 1024, []))
        assert sum(t * sum(p.values()) for p, t in dealt) >= least * counts.sum()
        packed = np.zeros(1025, np.int64)
        for pattern, times in pack_histogram(counts):
            assert sum(n * a for n, a in pattern.items()) <= 1024
            for n, a in pattern.items():
                packed[n] += a * times
        assert (packed == counts).all()
    for counts in (flat, five):
        assert sum(t for _, t in pack_histogram(counts)) < sum(t for _, t in best_fit(counts, 1024, []))


def test_knapsack_prices_every_length():
    from viewmint.llm.packing import linear_program

    counts = np.zeros(1025, np.int64)
    counts[[512, 700, 300, 341]] = 100
    found = linear_program(counts, 1024)
    assert {n for p, _ in found for n in p} == {512, 700, 300, 341}


@pytest.mark.parametrize("size", [None, (3_000_000, 400_000, 1), (3_000_000, 400_000, 2), (3_000_000, 0, 4_000), (3_000_000, 1, 3)])
@pytest.mark.parametrize(
    "texts",
    [
        ["The cat sat\n", "The dog ran"],
        ["alpha", "", "alpha beta"],
        ["x", " a"],
        ["\nx", None, " a b"],
        ["", None],
        ["x\ny", "\n", "", "y z\n", " x"],
    ],
)
def test_empty_words_have_no_ids(texts, size):
    import pyarrow as pa

    from viewmint.llm.tokens import SMALL, WordEncoder, default_vocabulary

    encoder = WordEncoder(default_vocabulary(), size or SMALL)
    t = _tokenizer()
    for again in (texts, texts[::-1], texts):
        ids, begin = encoder.encode(pa.array(again, pa.string()))
        made = [ids[a:b].tolist() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
        assert made == [t.encode(x or "", add_special_tokens=False).ids for x in again]


@pytest.mark.parametrize("which", ["small", "odd"])
def test_token_output(spark, odd, which, tmp_path):
    from viewmint.llm.rans import read_tokens, tokens_round_trip, write_tokens

    docs = _docs(spark) if which == "small" else odd
    t = _tokenizer()
    rows = sorted(_rows(docs), key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, []
    for i, text in rows:
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in tokens_round_trip(docs).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    if which == "odd":
        path = str(tmp_path / "tokens")
        write_tokens(docs, path)
        back = {r["start"]: r["ids"] for r in read_tokens(spark, path, with_ids=True).collect()}
        assert back[want[5][1]] == [*t.encode(rows[5][1], add_special_tokens=False).ids, 0]


def test_rans_blocks():
    from viewmint.llm.rans import CHECKPOINT_STEPS, Block, FrequencyTable, decode_block, encode_block

    rng = np.random.default_rng(0)
    ids = np.minimum(50_256, (rng.pareto(0.8, 90_000) * 9).astype(int))
    table = FrequencyTable.of(np.bincount(ids, minlength=50_257))
    assert table.freq.sum() == 1 << 20
    for n in (1, 2, 1023, 1024, 1025, 90_000):
        assert (decode_block(encode_block(ids[:n], table), table) == ids[:n]).all()
    block = encode_block(ids, table, lanes=256)
    assert (decode_block(block, table, 2) == ids[2 * CHECKPOINT_STEPS * 256 :]).all()
    broken = Block(**{**block.__dict__, "words": b"\0\0\0\1" + block.words[4:]})
    with pytest.raises(ValueError):
        decode_block(broken, table)


@pytest.mark.parametrize("which", ["small", "odd"])
def test_simhash(spark, odd, which):
    import xxhash

    from viewmint.llm.simhash import simhash_components

    docs = _docs(spark) if which == "small" else odd
    made = []
    for i, text in _rows(docs):
        words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        made.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    parent = list(range(len(made)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(made)):
        for b in range(a):
            if (made[a][1] ^ made[b][1]).bit_count() <= 4:
                parent[root(a)] = root(b)
    least: dict = {}
    for k, (i, _) in enumerate(made):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    want = [(i, f"{fp:016x}", least.get(root(k))) for k, (i, fp) in enumerate(made)]
    got = [tuple(r)[:3] for r in simhash_components(docs).collect()]
    assert sorted(got, key=_key) == sorted(want, key=_key)


def test_multi_index_finds_all_links(spark, monkeypatch):
    from viewmint.llm import simhash
    from viewmint.llm.components import components

    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 40, dtype=np.int64)
    fps = {int(c) for c in centres}
    for c in centres:
        for _ in range(12):
            flips = rng.choice(62, int(rng.integers(1, 7)), replace=False)
            fps.add(int(c) ^ int(sum(1 << int(f) for f in flips)))
    fps = sorted(fps)
    label = {f: f for f in fps}
    changed = True
    links = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    for hot, two in ((20_000, 1 << 26), (2, 1 << 26), (20_000, 1)):
        monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
        monkeypatch.setattr(simhash, "TWO_SEGMENTS_FROM", two)
        found = {r["node"]: r["root"] for r in components(simhash.near_links(frame, len(fps))).collect()}
        assert {f: found.get(f, f) for f in fps} == label


@pytest.mark.parametrize("which", ["small", "odd"])
def test_sharding(spark, odd, which):
    from viewmint.llm.sharding import shard_records

    docs = _docs(spark) if which == "small" else odd
    rows = shard_records(docs).collect()
    want = sorted(((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in _rows(docs)), key=_key)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=_key) == want
    for s in range(24):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    grown = {r["doc_id"]: r["shard"] for r in shard_records(docs, shards=25).collect()}
    assert all(r["grown_shard"] in (r["shard"], 24) and grown[r["doc_id"]] == r["grown_shard"] for r in rows)


def test_weights_draw_records(spark):
    from viewmint.llm.sharding import shard_records

    docs = spark.range(4000).selectExpr("id as doc_id", "'x' as text")
    rows = shard_records(docs, shards=3, weights=[1.0, 1.0, 2.0]).collect()
    share = [sum(r["shard"] == s for r in rows) / 4000 for s in range(3)]
    assert share[2] == pytest.approx(0.5, abs=0.04) and share[0] == pytest.approx(0.25, abs=0.04)


def test_quality_on_held_out(spark):
    from viewmint.llm.quality import quality_scores

    data = "/root/testdata/sf0.01"
    scored = quality_scores(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet"))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = [r for r in scored.collect() if r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"]]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.97
    assert np.mean([(s >= 0.3) == bool(y) for s, y in held]) > 0.95


def test_quality_of_odd_rows(spark, odd, empty):
    from viewmint.llm.quality import quality_scores

    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(3, None, 0), (4, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_scores(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    none = quality_scores(odd, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality_scores(empty, labels).count() == 0


def test_preference_pairs(spark):
    from viewmint.llm.preference import format_preferences, replies_as_pairs

    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "user", "more"), (1, 3, "assistant", "b"), (1, 4, "user", "end"),
        (2, 0, "user", "alone"),
        (3, 0, "system", None), (3, 1, "assistant", "only"),
        (4, None, None, "t"), (4, 1, "assistant", "same"), (4, 2, "assistant", "same"), (4, 2, "assistant", "same"),
        (None, 0, "user", "x"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = {r["conv_id"]: r for r in format_preferences(replies_as_pairs(df)).collect()}
    one = rows[1]
    assert one["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\na<|end|>\n<|user|>\nmore<|end|>\n"
    assert one["chosen"] == "<|assistant|>\nb<|end|>\n<|user|>\nend<|end|>\n" and one["rejected"] == one["chosen"].replace("b<", "a<")
    assert one["chosen_mask"] == "0:14,1:9,0:20" and one["usable"]
    assert rows[2]["chosen"] == rows[2]["rejected"] == "" and rows[2]["n_prompt_turns"] == 1 and not rows[2]["usable"]
    assert rows[3]["rejected"] == "<|assistant|>\n<|end|>\n" and rows[3]["chosen"] == "<|assistant|>\nonly<|end|>\n" and not rows[3]["usable"]
    assert rows[4]["chosen"] != rows[4]["rejected"] and not rows[4]["usable"] and len(rows) == 5
    for r in rows.values():
        for side in ("chosen", "rejected"):
            runs = [x.split(":") for x in r[f"{side}_mask"].split(",") if x]
            assert sum(int(n) for _, n in runs) == len(r[side])
            at = 0
            for flag, n in runs:
                if flag == "1":
                    assert r[side][at : at + int(n)].endswith("<|end|>\n")
                at += int(n)
    assert format_preferences(replies_as_pairs(df.limit(0))).count() == 0
    pairs = spark.createDataFrame([(1, None, [("user", "x")])], "conv_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    assert format_preferences(pairs).first()["rejected"] == "<|user|>\nx<|end|>\n"


def test_empty_tables(spark, empty):
    from viewmint.llm.exact_dedup import exact_dedup
    from viewmint.llm.mixing import apply_mix, mix_sources
    from viewmint.llm.packing import pack_sequences
    from viewmint.llm.rans import tokens_round_trip
    from viewmint.llm.sharding import shard_records
    from viewmint.llm.simhash import drop_near_copies, simhash_components

    from viewmint.llm.exact_dedup import drop_exact_copies
    from viewmint.llm.substrings import remove_repeats

    for f in (exact_dedup, drop_exact_copies, remove_repeats, mix_sources, apply_mix, pack_sequences, tokens_round_trip, shard_records, simhash_components, drop_near_copies):
        assert f(empty).count() == 0, f


def _brute_repeats(rows):
    import hashlib

    first, out = {}, []
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, words in split:
        for k in range(len(words) - 19):
            first.setdefault(tuple(words[k : k + 20]), (i, k))
    for i, words in split:
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            if first[tuple(words[k : k + 20])] != (i, k):
                gone[k : k + 20] = [True] * 20
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("which", ["small", "odd", "random"])
def test_substring_dedup(spark, odd, which):
    from viewmint.llm.substrings import remove_repeats

    docs = _docs(spark) if which == "small" else odd
    if which == "random":
        rng = np.random.default_rng(8)
        passages = [" ".join(rng.choice(list("abc"), n)) for n in (19, 20, 21, 33, 60)]
        texts = [" ".join(str(x) for p in rng.choice(5, 4) for x in (rng.choice(list("abcxyz"), rng.integers(0, 30)).tolist() + [passages[p]])) for _ in range(60)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in remove_repeats(docs).collect()]
    assert sorted(got, key=_key) == sorted(_brute_repeats([tuple(r) for r in docs.select("doc_id", "text").collect()]), key=_key)


def test_difference_cover():
    from viewmint.llm.substrings import ANCHOR, COVER, PERIOD, WINDOW

    assert ANCHOR + PERIOD - 1 == WINDOW
    for i in range(PERIOD):
        for j in range(PERIOD):
            assert any((i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER for d in range(PERIOD))


def _brute_neighbours(rows, every):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    ids = np.array([i for i, _ in fine])
    x = np.array([v for _, v in fine])
    out = {}
    for i, v in fine:
        if i % every == 0:
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            d[ids == i] = np.inf
            order = np.lexsort((ids, d))[: min(10, len(ids) - 1)]
            out[i] = [(int(ids[j]), d[j]) for j in order]
    return out


def test_neighbours(spark):
    from pyspark.sql import functions as F

    from viewmint.llm.neighbours import nearest_neighbours

    data = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = _brute_neighbours([(r["vec_id"], r["embedding"]) for r in data.collect()], 20)
    got: dict = {}
    for r in nearest_neighbours(data, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = sum(len({v for _, v, _ in sorted(got[q])} & {v for v, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    exact = {(q, v): d for q, found in want.items() for v, d in found}
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        assert all(exact.get((q, v), s) == pytest.approx(s, rel=1e-12) for _, v, s in found)


def test_neighbours_of_odd_rows(spark):
    from pyspark.sql import functions as F

    from viewmint.llm.neighbours import nearest_neighbours

    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [0.5, None]), (7, [0.0, 1.0]), (8, [1.0, 0.0]), (9, [1.0]), (10, [2.0, 2.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int, _id int")
    want = _brute_neighbours([(i, v) for i, v in rows if v is None or len(v) == 2], 10)
    got: dict = {}
    for r in nearest_neighbours(df, F.col("vec_id") % 10 == 0).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == want
    assert nearest_neighbours(df.limit(0), F.lit(True)).count() == 0
    assert nearest_neighbours(df.where("vec_id = 0"), F.lit(True)).count() == 0


def test_few_distances_are_computed(spark):
    """Clustered vectors are found by a small share of all distances, and the
    share falls as vectors become more."""
    from pyspark.sql import functions as F

    from viewmint.llm.neighbours import nearest_neighbours

    shares = []
    for n in (4_000, 32_000):
        rng = np.random.default_rng(9)
        x = rng.normal(size=(n // 40, 12)).repeat(40, axis=0) + 0.05 * rng.normal(size=(n, 12))
        data = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").repartition(4)
        got: dict = {}
        compared = {}
        for r in nearest_neighbours(data, F.col("vec_id") % 100 == 0).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
            compared[r["query_id"]] = r["compared"]
        want = _brute_neighbours(list(enumerate(x.tolist())), 100)
        assert sum(len(got[q] & {v for v, _ in w}) for q, w in want.items()) >= 0.9 * 10 * len(want)
        shares.append(sum(compared.values()) / (n * len(want)))
    assert shares[0] < 0.5 and shares[1] < 0.5 * shares[0]


def test_probes_come_in_order_of_estimated_success():
    from math import erf, sqrt

    from viewmint.llm.neighbours import WIDTH, Hashing

    rng = np.random.default_rng(2)
    hashing = Hashing(rng.normal(size=(1, 4, 6)), rng.uniform(0, 1, (1, 4)), 0.7, 60)
    q = rng.normal(size=(3, 6))
    at = hashing.places(q, 0)
    grid = np.stack(np.meshgrid(*[np.arange(-2, 3)] * 4, indexing="ij"), -1).reshape(-1, 4)
    for i in range(3):
        cells = np.floor(at[i]) + grid
        low = (cells - at[i]) * WIDTH / sqrt(2)
        chance = np.prod([[erf(b) - erf(a) for a, b in zip(r, r + WIDTH / sqrt(2))] for r in low], axis=1)
        best = cells[np.argsort(-chance, kind="stable")[:60]]
        assert (hashing.probed(q, 0)[0][i] == hashing._named(best, 0)[0]).all()


def test_copied_and_split_parts_find_the_same(spark, monkeypatch):
    from pyspark.sql import functions as F

    from viewmint.llm import neighbours

    data = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")

    def found():
        return {(r["query_id"], r["rank"]): (r["vec_id"], r["score"], r["compared"]) for r in neighbours.nearest_neighbours(data, F.col("vec_id") % 20 == 0).collect()}

    whole = found()
    monkeypatch.setattr(neighbours, "PART_ROWS", 60)
    monkeypatch.setattr(neighbours, "PART_QUERIES", 3)
    assert found() == whole
    monkeypatch.setattr(neighbours, "AIM", 1.0)
    monkeypatch.setattr(neighbours, "HASHES", (12,))
    monkeypatch.setattr(neighbours, "MOST_PROBES", 2)  # no hashing will do: all is compared
    exact = found()
    want = _brute_neighbours([(r["vec_id"], r["embedding"]) for r in data.collect()], 20)
    assert {(q, n + 1): v for q, w in want.items() for n, (v, _) in enumerate(w)} == {k: v[0] for k, v in exact.items()}


def test_equal_vectors_and_lengths(spark):
    from pyspark.sql import functions as F

    from viewmint.llm.neighbours import nearest_neighbours

    rows = [(i, [1.0, 2.0]) for i in range(60)] + [(100 + i, [float(i), 1.0, 0.0]) for i in range(1, 14)] + [(100, [5.0]), (7, [9.0, 9.0]), (7, [9.0, 9.0])]
    got: dict = {}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for r in nearest_neighbours(df, F.col("vec_id").isin(0, 7, 30, 104, 100)).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got[0] == list(range(1, 11)) and got[30] == list(range(10)) and got[7] == [i for i in range(11) if i != 7]
    assert got[104][:2] == [103, 105] and len(got[104]) == 10 and 100 not in got


def test_filters_keep_columns_and_clashing_names(spark, odd):
    from viewmint.llm.exact_dedup import drop_exact_copies
    from viewmint.llm.mixing import apply_mix, mix_sources
    from viewmint.llm.quality import drop_low_quality
    from viewmint.llm.simhash import drop_near_copies

    labels = spark.createDataFrame([(1, 0), (4, 1), (12, 1)], "doc_id long, quality int")
    for f in (drop_exact_copies, drop_near_copies, apply_mix, lambda d: drop_low_quality(d, labels)):
        assert f(odd).columns == odd.columns
    kept = sorted(r["doc_id"] for r in drop_exact_copies(odd.where("doc_id is not null")).collect())
    assert kept == [0, 2, 4, 5, 6, 8, 9, 11, 12, 14, 15]
    mixed = apply_mix(odd)
    planned: dict = {}
    for r in mix_sources(odd).collect():
        planned[r["doc_id"]] = planned.get(r["doc_id"], 0) + r["repeats"]
    made = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert made == {k: v for k, v in planned.items() if v}
