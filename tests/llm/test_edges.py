"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing columns; planted cases; the pipeline."""

import random

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline
from tidemark.llm.audio import align
from tidemark.llm.bpe import token_counts
from tidemark.llm.codec import digests, encode, texts
from tidemark.llm.lattice import score_texts
from tidemark.llm.licenses import TEMPLATES, scan_licenses
from tidemark.llm.lines import dedup_lines
from tidemark.llm.packing import best_fit, pack, pack_lengths
from tidemark.llm.quality import quality
from tidemark.llm.sharding import min_cost_flow, reshard
from tidemark.llm.near import near_copies, shingle_set
from tidemark.llm.simhash import keys_of, near_groups

OPERATORS = {
    "lines": dedup_lines,
    "audio": lambda d: align(d.selectExpr("doc_id", "cast(text as binary) AS pcm", "tm_key")),
    "counts": lambda d: token_counts(d, P.path("byte_bpe_50k.json"), P.PATTERN),
    "shards": reshard,
    "codec": lambda d: digests(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
    "lattice": lambda d: score_texts(d, P.path("piece_bpe_32k.model")),
    "groups": near_groups,
    "quality": lambda d: quality(d, [P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken")]),
    "licenses": scan_licenses,
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tm_key string, kept boolean, batch long, word string, h1 long, `a.b` string"


def words(n, seed):
    r = random.Random(seed)
    parts = "water stone river light house garden winter summer market letter paper people country number river moment story music".split()
    return [r.choice(parts) + r.choice(("", "s", "ing", "ed", "er", "ly", "able")) + r.choice(("", "", "in", "of", "the")) for _ in range(n)]


def odd_rows():
    long = " ".join(words(60_000, 1))
    line = " ".join(words(30, 2))
    rows = [
        (1, "", "en"), (2, None, "en"), (None, "hello world", None), (3, "   \n\t \n", "fr"), (4, long, "en"), (5, long + " tail", "en"),
        (6, f"{line}\n{line}\n\n{line}\n{line}", "de"), (6, f"{line}\n{line}\n\n{line}\n{line}", "de"), (7, "x", None), (8, "x", "zz"), (9, "é ß <|endoftext|> \x1c 中文", "en"),
        (10, "MIT License. Licensed under the Apache License, Version 2.0; the General Public License", "en"), (None, None, None),
    ]
    return [(i, t, lang, None, None if t is None else len(t), "k", None, 1, None, 2, "dot") for i, t, lang in rows]


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_each_get_a_row(spark, name):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    got = OPERATORS[name](docs).collect()
    assert len(got) == len(odd_rows())
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in odd_rows())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_none(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_packing_of_odd_rows_and_none(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    got = pack(docs, P.path("word_bpe_49k.json")).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in odd_rows()}
    assert pack(docs.filter("false"), P.path("word_bpe_49k.json")).collect() == []


def test_near_copies_of_odd_rows_and_none(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    kept = near_copies(docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(str(i) for i in (1, 4, 6, 7, 9, 10, None))
    assert near_copies(docs.filter("false")).collect() == []


def test_near_copies_against_all_pairs(spark):
    r = random.Random(3)
    made = []
    for group in range(12):
        base = words(80, 100 + group)
        for copy in range(r.choice((1, 2, 5, 40))):
            own = list(base)
            for _ in range(copy % 3):
                own[r.randrange(len(own))] = "changed"
            made.append(" ".join(own))
    r.shuffle(made)
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    sets = [set(shingle_set(t).tolist()) for t in made]
    up = list(range(len(made)))
    for i in range(len(made)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    assert sorted(x["doc_id"] for x in near_copies(docs).collect()) == sorted(set(up))


def test_near_copies_of_a_star_whose_centre_is_in_the_middle(spark):
    base = words(400, 77)
    arms = []
    for arm in range(400):  # each differs from the centre in 8 places of its own: alike to the centre, seldom to each other
        own = list(base)
        for at in random.Random(arm).sample(range(400), 8):
            own[at] = f"own{arm}x{at}"
        arms.append(" ".join(own))
    made = [*arms[:200], " ".join(base), *arms[200:]]
    sets = [set(shingle_set(t).tolist()) for t in made]
    alike = [[len(x & y) >= 0.8 * len(x | y) for y in sets] for x in sets]
    assert all(alike[200]) and sum(map(sum, alike)) < 401 * 401 / 2
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    assert [x["doc_id"] for x in near_copies(docs).collect()] == [0]


def test_near_copies_of_block_edits(spark):
    r, made, alike = random.Random(13), [], []
    for n in range(240):
        base = words(r.randint(60, 600), 1000 + n)
        part = r.randint(len(base) // 20, len(base) // 5)
        at, other = r.randrange(len(base) - part), words(part, 5000 + n)
        copy = (base + other, base[:-part], base[:at] + other[: part // 2] + base[at + part // 2 :], [other[0] if r.random() < 0.02 else w for w in base])[n % 4]
        made += [" ".join(base), " ".join(copy)]
        x, y = (set(shingle_set(t).tolist()) for t in made[-2:])
        alike.append(len(x & y) >= 0.8 * len(x | y))
    assert all(sum(alike[kind::4]) >= 15 for kind in range(4))
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    kept = {x["doc_id"] for x in near_copies(docs).collect()}
    assert kept == {2 * n for n in range(240)} | {2 * n + 1 for n in range(240) if not alike[n]}


def test_codeword_keys_meet_within_distance():
    r = random.Random(5)
    fps = [r.getrandbits(64) for _ in range(200)]
    for distance in (2, 5):
        other = [f ^ sum(1 << b for b in r.sample(range(64), distance)) for f in fps]
        for a, b in zip(keys_of(np.array(fps, np.uint64), distance), keys_of(np.array(other, np.uint64), distance), strict=True):
            assert set(a.tolist()) & set(b.tolist())


def test_a_file_of_all_licence_notices_has_all_labels(spark):
    docs = spark.createDataFrame([(1, "\n\n".join(t.words for t in TEMPLATES)), *((2 + n, t.words) for n, t in enumerate(TEMPLATES))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in scan_licenses(docs).collect()}
    assert {t.label for t in TEMPLATES} <= set(got[1]["labels"].split(",")) and got[1]["score"] == 1.0
    assert all(t.label in got[2 + n]["labels"].split(",") for n, t in enumerate(TEMPLATES))


def test_ids_decode_to_the_text(spark):
    docs = spark.createDataFrame([(1, "naïve 東京\n\n  x"), (2, ""), (3, None)], "doc_id long, text string")
    ranks = P.path("byte_bpe_50k.tiktoken")
    got = {r["doc_id"]: bytes(r["decoded"]).decode() for r in texts(encode(docs, ranks, P.PATTERN), ranks).collect()}
    assert got == {1: "naïve 東京\n\n  x", 2: "", 3: ""}


def test_shifted_recordings_align(spark):
    r = np.random.default_rng(7)
    t = np.arange(24_000) / 8000
    sound = np.concatenate([np.sin(2 * np.pi * f * t[:2000]) for f in r.uniform(150, 2000, 12)])
    pcm = (128 + 90 * sound).astype(np.uint8)
    media = spark.createDataFrame([(100, bytearray(pcm.tobytes())), (1, bytearray(pcm[640:].tobytes())), (2, bytearray(r.integers(0, 255, 20_000).astype(np.uint8).tobytes()))], "doc_id long, pcm binary")
    got = {x["doc_id"]: x for x in align(media).collect()}
    assert got[1]["query_id"] == 100 and got[1]["offset"] == 10 and got[1]["bit_errors"] == 0
    assert got[2]["query_id"] is None


def test_flow_moves_the_fewest_bytes():
    flow = min_cost_flow([10, 20, 0], [10, 10, 10], [[int(i != j) for j in range(3)] for i in range(3)])
    assert [sum(x) for x in flow] == [10, 20, 0] and [sum(x) for x in zip(*flow, strict=True)] == [10, 10, 10]
    assert sum(flow[i][j] for i in range(3) for j in range(3) if i != j) == 10


def test_swaps_never_need_more_bins():
    r = random.Random(11)
    for _ in range(20):
        lengths = [r.randint(1, 64) for _ in range(r.randint(1, 120))]
        bins = pack_lengths(lengths, 64)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 64 for b in bins) and len(bins) <= len(best_fit(lengths, 64))


def test_pipeline_stages_take_effect(spark, tmp_path):
    held = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("lang = 'en'").selectExpr("explode(split(text, '[^a-zA-Z]+')) AS w").filter("length(w) > 1").distinct()
    pool = sorted(r["w"] for r in held.collect())
    prose = lambda n, seed: " ".join(random.Random(seed).choices(pool, k=n))
    a, b, c = (prose(120, s) for s in (21, 22, 23))
    shared = "\n".join(prose(30, s) for s in (31, 32))
    rows = [(1, a), (2, a + " more"), (3, f"{b}\n{shared}"), (4, f"{c}\n{shared}"), (5, "short"), (6, None), (7, "spam spam spam " * 40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns
        seen[name] = {r["doc_id"]: r["text"] for r in left.collect()}
    assert sorted(seen["quality_rules"]) == [1, 2, 3, 4]
    assert seen["line_dedup"][3].endswith(shared) and seen["line_dedup"][4] == c
    assert sorted(seen["near_dedup"]) == [1, 3, 4]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, 3, 4}
