"""Votes, offsets, runs and links of recordings against all pairs, silence, and recall by noise."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm.audio import APART, SILENT, Audio, align, codes, keys, matching_run
from tidemark.llm.queries import op2_chroma_alignment

SF = "/root/testdata/sf0.001"


def tones(seed, seconds=3.0):
    r, x = np.random.default_rng(seed), []
    while sum(map(len, x)) < 8000 * seconds:
        n, f = int(r.integers(800, 3200)), r.uniform(80, 3000, 3)
        x.append(sum(np.sin(2 * np.pi * g * np.arange(n) / 8000 + r.uniform(0, 6)) for g in f) * 25)
    return np.concatenate(x)[: int(8000 * seconds)]


def pcm(x, noise=0.0, seed=0):
    return np.clip(np.round(x + np.random.default_rng(seed).normal(0, noise, len(x)) + 128), 0, 255).astype(np.uint8).tobytes()


def plain_links(rows, every=100, least=2, overlap=8, most=0.2):
    """(class id, n_links, query_id, offset, overlap, bit_errors) of each id, from votes counted pair by pair."""
    held = {i: np.frombuffer(np.asarray(c, "<u4").tobytes(), "<u4") for i, c in zip(rows, codes(list(rows.values()), Audio()), strict=True)}
    classes = defaultdict(list)
    for i, c in held.items():
        if len(c):
            classes[c.tobytes()].append(i)
    of = {min(v): (held[v[0]], any(i % every == 0 for i in v), v) for v in classes.values()}
    links = defaultdict(list)
    for q, (a, asks, _) in of.items():
        if not asks:
            continue
        pairs_of = lambda c: [(int(c[i]), int(c[i + APART]), i) for i in range(len(c) - APART) if SILENT not in (c[i], c[i + APART]) and (i == 0 or SILENT in (c[i - 1], c[i - 1 + APART]) or (c[i], c[i + APART]) != (c[i - 1], c[i - 1 + APART]))]
        mine = defaultdict(list)
        for x, y, i in pairs_of(a):
            mine[x, y].append(i)
        for k, (b, _, _) in of.items():
            if k == q:
                continue
            votes = Counter(i - j for x, y, j in pairs_of(b) for i in mine[x, y])
            found = [((most - e) * n, -o, n, e) for o, v in votes.items() if v >= least for n, e in [matching_run(a, b, o, most)] if n >= overlap and e <= most]
            if found:
                gain, o, n, e = max(found)
                links[k].append((-gain, q, -o, n, e))
    out = dict.fromkeys(held, (None, 0, None, None, None, None))
    for k, (_, _, members) in of.items():
        best = min(links[k], default=None)
        told = (k, len(links[k]), *(best[1:] if best else (None,) * 4))
        out.update(dict.fromkeys(members, told))
    return out


def test_op2_is_what_all_pairs_say(spark):
    rows = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["query_id"], r["offset"], r["overlap"], r["bit_errors"]) for r in op2_chroma_alignment(spark, SF).collect()}
    assert got == plain_links(rows)


def test_links_of_noisy_repeated_and_cut_recordings_are_those_of_all_pairs(spark):
    rows = {}
    for n in range(8):
        base = tones(n, 1.5)
        again = np.concatenate([base[:6000], tones(50 + n, 0.5), base[:6000]])
        for k, x in enumerate((pcm(base), pcm(again, 3, n), pcm(base[640:], 2, n), pcm(np.zeros(9000)), pcm(np.concatenate([base[:4000], np.zeros(4000)])))):
            rows[100 * n + k] = x
    got = align(spark.createDataFrame([(i, bytearray(x)) for i, x in rows.items()], "doc_id long, pcm binary")).collect()
    want = plain_links(rows)
    assert {r["doc_id"]: (r["class_id"], r["n_links"], r["query_id"], r["offset"], r["overlap"], r["bit_errors"]) for r in got} == want
    assert sum(v[1] for v in want.values()) > 8


def test_recordings_that_share_only_silence_have_no_links(spark):
    rows = []
    for n in range(120):
        a, b = tones(1000 + n, 0.5), tones(2000 + n, 0.5)
        rows.append((10 * n, bytearray(pcm(np.concatenate([a, np.zeros(2000 + 8 * n), b])))))
    media = spark.createDataFrame(rows, "doc_id long, pcm binary")
    assert align(media, every=20).agg({"n_links": "sum"}).first()[0] == 0
    c = codes([bytes(rows[0][1])], Audio())[0]
    assert (c == SILENT).sum() > 8 and len(keys(c)[0]) <= len(c) - (c == SILENT).sum()


@pytest.mark.parametrize(("noise", "least"), [(4, 0.9), (8, 0.9)])
def test_recall_under_noise(spark, noise, least):
    """Two equal codes APART must survive: at a tenth of the bits wrong nearly all recordings of three seconds are found (README has the figures beyond)."""
    rows = [(100 * n, pcm(tones(300 + n))) for n in range(1, 31)] + [(100 * n + 1, pcm(tones(300 + n), noise, n)) for n in range(1, 31)]
    got = {r["doc_id"]: r["query_id"] for r in align(spark.createDataFrame([(i, bytearray(x)) for i, x in rows], "doc_id long, pcm binary")).collect()}
    assert sum(got[100 * n + 1] == 100 * n for n in range(1, 31)) >= 30 * least
