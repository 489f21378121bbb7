"""The pipeline's stages, each against a brute-force version of its own input."""

from __future__ import annotations

import re
from collections import Counter

import pytest

pytest.importorskip("corpus_pipeline")

SMALL = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def _fingerprint(text: str) -> int:
    import xxhash

    words = re.sub("[A-Z]+", lambda m: m[0].lower(), text).split()
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline as pipe
    from viewmint.llm.common import stored, table

    docs, out = table(spark, SMALL, "documents"), []
    for name, stage in pipe.STAGES:
        before, docs = docs, stored(stage(spark, docs, SMALL), f"test-{name}")
        out.append((name, before, docs))
    return out


def _rows(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


def test_stages_keep_the_columns(stages):
    assert [s[0] for s in stages] == ["quality", "exact_dedup", "simhash_dedup", "mix", "pack"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_quality_rejects_labelled_junk_only(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    _, before, after = stages[0]
    gone = set(_rows(before)) - set(_rows(after))
    told = [labels[d] for d in gone if d in labels]
    assert told and sum(told) <= 0.1 * len(told)


def test_exact_copies(stages):
    _, before, after = stages[1]
    first: dict[str, int] = {}
    for i, t in sorted(_rows(before).items()):
        first.setdefault(SPACE.sub(" ", t), i)
    assert set(_rows(after)) == set(first.values())


def test_near_copies(stages):
    _, before, after = stages[2]
    fps = sorted((i, _fingerprint(t)) for i, t in _rows(before).items())
    root = {i: i for i, _ in fps}
    changed = True
    links = [(a, b) for k, (a, x) in enumerate(fps) for b, y in fps[:k] if (x ^ y).bit_count() <= 4]
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    assert set(_rows(after)) == {i for i, r in root.items() if i == r}


def test_mix_repeats_rows(stages):
    from viewmint.llm.mixing import mix_sources

    _, before, after = stages[3]
    times = Counter(r["doc_id"] for r in after.select("doc_id").collect())
    assert {r["doc_id"]: r["repeats"] for r in mix_sources(before).collect() if r["repeats"]} == dict(times)


def test_pack_holds_every_token_once(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    _, before, after = stages[4]
    want: Counter = Counter()
    for r in before.select("doc_id", "text").collect():
        want[r["doc_id"]] += len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    got: Counter = Counter()
    places: dict = {}
    for r in after.collect():
        got[r["doc_id"]] += r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == want
    for parts in places.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 1024


def test_run_gives_the_last_stage(spark, stages):
    import corpus_pipeline as pipe

    made = pipe.run(spark, SMALL)
    key = lambda d: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in d.collect())
    assert key(made) == key(stages[-1][2])


ODD = "doc_id long, text string, lang string, source string, n_chars long, _id long, size string, _key_id string, repeats int"


def _odd(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 7, "x", "y", 3) for i, t, s in rows], ODD)


@pytest.fixture(scope="module")
def odd_stages(spark, tmp_path_factory):
    """All stages over a folder of odd documents; labels as they are."""
    import corpus_pipeline as pipe
    from viewmint.llm.common import stored, table

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    some = [t for _, t in sorted(docs.items()) if t][:30]
    rows = [(i, t, f"s{i % 2}") for i, t in enumerate(some)]
    rows += [(None, some[0], "s0"), (None, some[3] + " and so on", None), (5, some[5], "s1"), (5, some[5], "s1"), (6, some[7] + " more", "s0"), (100, None, "s0"), (101, "", None), (102, " \n", "s1"), (103, " leading space", "s0"), (104, some[2] * 40, "s1")]
    where = tmp_path_factory.mktemp("odd")
    _odd(spark, rows).repartition(3).write.parquet(str(where / "documents.parquet"))
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(str(where / "labels.parquet"))
    made = table(spark, str(where), "documents")
    out = []
    for name, stage in pipe.STAGES:
        before, made = made, stored(stage(spark, made, str(where)), f"odd-{name}")
        out.append((name, before, made))
    return str(where), out


def _texts(df):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())


def test_odd_rows_go_through_all_stages(spark, odd_stages):
    from viewmint.llm.quality import quality_scores

    where, stages = odd_stages
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns
    _, before, after = stages[0]
    scored = quality_scores(before, spark.read.parquet(f"{where}/labels.parquet")).collect()
    assert sum(after.groupBy().count().first()) == sum(r["predicted"] for r in scored)
    _, before, after = stages[1]
    norm = lambda d: Counter(SPACE.sub(" ", t or "") for (_, t, _), n in _texts(d).items() for _ in range(n))
    assert norm(after) == Counter(dict.fromkeys(norm(before), 1))
    _, before, after = stages[2]
    rows = sorted(_texts(before).elements(), key=str)
    prints = [_fingerprint(t or "") for _, t, _ in rows]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min(root[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(len(rows))]
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in root}
    assert _texts(after) == Counter(row for row, r in zip(rows, root) if row[0] == least[r])
    _, before, after = stages[3]
    there = _texts(before)
    assert all(n <= 3 * there[k] for k, n in _texts(after).items())
    _, before, after = stages[4]
    rows = after.collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert Counter(r["doc_id"] for r in rows if r["start"] == 0) == Counter(r["doc_id"] for r in before.collect())


def test_an_empty_table_goes_through(spark, tmp_path):
    import corpus_pipeline as pipe

    _odd(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert pipe.run(spark, str(tmp_path)).count() == 0
