"""The contract of each numbered query against a brute-force version over the whole small tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import xxhash

from test_methods import plain_repeats

from tidemark.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def rows(spark, query):
    return [r.asDict() for r in query(spark, SF).collect()]


def test_op3_counts_are_the_librarys(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = rows(spark, Q.op3_token_counts)
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got} == {
        i: (len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 512) for i, x in docs.items()
    }


def test_op5_ids_are_the_librarys_and_decode_to_the_text(spark, docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for i, x in docs.items():
        ids = enc.encode_ordinary(x)
        want[i] = (len(ids), sha(" ".join(map(str, ids)).encode()), sha(x.encode()))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(spark, Q.op5_bpe_codec)} == want


def test_op4_shards_are_near_equal_and_slots_gapless(spark, docs):
    got = rows(spark, Q.op4_flow_sharding)
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        data = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert set(slots) <= set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op6_base_score_and_probability(spark, docs):
    tokens = {i: [*words_of(lower(x)), None] for i, x in docs.items()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    c = Counter(w for i, ws in tokens.items() if not out[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for r in rows(spark, Q.op6_lattice_lm):
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[r["doc_id"]], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_op7_packs_every_piece_once(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want, total = {}, 0
    for i, x in docs.items():
        ids = [*t.encode(x, add_special_tokens=False).ids, 0]
        total += len(ids)
        for at in range(0, len(ids), 2048):
            part = np.array(ids[at : at + 2048], "<u4")
            want[i, at // 2048] = (at, len(part), zlib.crc32(part.tobytes()))
    got = rows(spark, Q.op7_packing)
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(held) <= -(-total // 2048) + 1


def _fingerprint(text):
    ws = words_of(lower(text))
    runs = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] if ws else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op8_components_of_all_pairs(spark, docs):
    fp = {i: _fingerprint(x) for i, x in docs.items()}
    up = {i: i for i in docs}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(spark, Q.op8_simhash)} == {i: (f"{fp[i]:016x}", root(i)) for i in ids}


def test_op9_counts(spark, docs):
    for r in rows(spark, Q.op9_quality):
        x = docs[r["doc_id"]]
        ws = words_of(x)
        windows = Counter(zip(ws, ws[1:], ws[2:]))
        covered = {j for i, w in enumerate(zip(ws, ws[1:], ws[2:])) if windows[w] > 1 for j in (i, i + 1, i + 2)}
        seen, dup = set(), 0
        for line in x.split("\n"):
            if words_of(line):
                dup += line in seen
                seen.add(line)
        failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
        want = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(covered), failed)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (failed and r["kept"])


def test_op10_base_places(spark, docs):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for r in rows(spark, Q.op10_license_scan):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(docs[r["doc_id"]]))
        at = sorted((i, label) for p, label in phrases.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split())
        places, labels = [i for i, _ in at], {x for _, x in at}
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(ws), len(at), ",".join(sorted(labels)))
        assert (r["first_word"], r["last_word"]) == ((places[0], places[-1]) if at else (None, None))
        assert labels <= set(r["labels"].split(",")) or not labels
        assert 0 <= r["score"] <= 1


def test_op1_deletes_later_copies_of_runs(spark, docs):
    order = sorted(docs.items())
    gone = defaultdict(set)
    for d, i in plain_repeats([x for _, x in order]):  # all pairs of places, longest equal runs
        gone[order[d][0]].add(i)
    for r in rows(spark, Q.op1_line_dedup):
        x = docs[r["doc_id"]]
        assert r["n_deleted"] == len(gone[r["doc_id"]]), r["doc_id"]
        if r["text"] is not None:
            assert r["text"] == "\n".join(line for i, line in enumerate(x.split("\n")) if i not in gone[r["doc_id"]])


def test_op2_copies_share_a_class(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, Q.op2_chroma_alignment)}
    assert sorted(got) == sorted(docs)
    by_text = defaultdict(list)
    for i, x in docs.items():
        by_text[x].append(i)
    for same in by_text.values():
        assert len({got[i]["class_id"] for i in same}) == 1
    assert all(r["n_samples"] == len(docs[i].encode()) for i, r in got.items())
