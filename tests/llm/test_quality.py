"""No clean language falls, junk in each goes; `kept` against a plain version that asks the libraries token by token."""

import base64
import math
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from paragraphs import PARAGRAPHS
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm.quality import BANDS, CHUNK, Lexicon, quality, script_of

FILES = ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")


def judged(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r["kept"] for r in sorted(quality(rows, [P.path(f) for f in FILES], min_words=40).collect(), key=lambda r: r["doc_id"])]


def test_clean_prose_in_35_languages_stays(spark):
    assert len(PARAGRAPHS) >= 35
    kept = judged(spark, PARAGRAPHS.values())
    assert [name for name, k in zip(PARAGRAPHS, kept, strict=True) if not k] == []


def test_junk_in_each_language_goes(spark):
    """Bytes read in a wrong charset, for languages with many letters beyond ASCII; words with separators between them, where a vocabulary holds words of the script."""
    plain = {"en", "de", "es", "it", "sw", "ha"}
    letters = {"az", "hi", "bn", "ta", "th", "ja", "ka", "am"}
    wrong = {name: t.encode().decode("cp1252", "replace") for name, t in PARAGRAPHS.items() if name not in plain}
    cut = {name: " | ".join(t.split()) + " |" for name, t in PARAGRAPHS.items() if name not in letters}
    assert set(wrong) | set(cut) == set(PARAGRAPHS)
    for junk in (wrong, cut):
        assert [name for name, k in zip(junk, judged(spark, junk.values()), strict=True) if k] == []


def test_scripts():
    want = {"en": "latin", "vi": "marked", "yo": "marked", "ru": "cyrillic", "el": "greek", "hi": "devanagari", "bn": "other", "th": "thai", "ar": "arabic", "he": "hebrew", "zh": "cjk", "ja": "cjk", "ko": "hangul", "am": "other", "pl": "latin"}
    assert {name: script_of(PARAGRAPHS[name]) for name in want} == want
    assert [script_of(t) for t in ("", "12 34", "é", "é ∑∑∑", "\ud800é".encode("utf-8", "replace").decode())] == ["latin"] * 5


def plain_kept(text, models):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else None
    if often is None:
        return None
    repeats = {i + k for i, g in enumerate(grams) if g in often for k in range(3)}
    if len(words) < 50 or 100 * len(repeats) > 50 * len(words):
        return False
    told = []
    for encode, is_byte in models:
        ids = [i for w in words for i in encode(w)]
        size = max(1, len(ids) // 128)
        blocks = [ids[128 * b : 128 * (b + 1) if b + 1 < size else len(ids)] for b in range(size)]
        spread = [sum(-x.count(i) / len(x) * math.log2(x.count(i) / len(x)) for i in set(x)) / math.log2(len(x)) for x in blocks]
        told.append((sum(map(len, words)) / len(ids), sum(map(is_byte, ids)) / len(ids), sum(spread) / len(spread)))
    band = BANDS[script_of(text)]
    fits = all(band.chars_per_token[0] <= c <= band.chars_per_token[1] and f <= band.fallback and e >= band.entropy for c, f, e in told)
    return fits and max(told)[2] >= band.best


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    import tiktoken

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path(FILES[0]))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(FILES[1]), "rb"))}
    enc = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    single = {i for t, i in ranks.items() if len(t) == 1 and t[0] > 127}
    return [(sp.encode, sp.is_byte), (lambda w: enc.encode_ordinary(" " + w), single.__contains__)]


def test_kept_is_that_of_a_plain_loop(spark, models):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    some = [r for r in docs.collect() if len(r["text"] or "") < 6000][:250]
    want = {r["doc_id"]: plain_kept(r["text"] or "", models) for r in some}
    got = {r["doc_id"]: r["kept"] for r in quality(spark.createDataFrame(some, docs.schema), [P.path(f) for f in FILES]).collect()}
    assert {i: got[i] for i in want} == want and sum(want.values()) > 100 and sum(not v for v in want.values()) > 20


def test_a_batch_is_judged_and_handed_on_in_bounded_parts_and_its_text_is_sent_once(spark, monkeypatch):
    taken = {}
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: taken.update(run=run, sent=self.columns) or self.select(*(F.col(c).alias(n) for c, n in zip(self.columns, schema.names, strict=False)), *(F.lit(True).alias(n) for n in schema.names[len(docs.columns) :])))
    corpus_pipeline.quality_rules(spark, docs, "")
    assert len(taken["sent"]) == len(docs.columns)
    texts = [t * 400 for t in PARAGRAPHS.values()][:20] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"c0": list(range(len(texts))), "c1": texts, "c2": [None] * len(texts), "c3": ["s"] * len(texts), "c4": [0] * len(texts)})
    parts = list(taken["run"](iter([batch])))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts))) and [t for p in parts for t in p.column(1).to_pylist()] == texts
    assert len(parts) > 2 and all(sum(len(t or "") for t in p.column(1).to_pylist()[:-1]) < CHUNK for p in parts)


def test_held_words_are_bounded_and_what_is_told_stays():
    paths = tuple(P.path(f) for f in FILES)
    few, many = Lexicon(paths, 300), Lexicon(paths)
    for _ in range(2):
        for text in PARAGRAPHS.values():
            words = text.split()
            told = []
            for known in (few, many):
                known.learn(list(dict.fromkeys(words)))
                told.append(known.fertility(np.array([known.number[w] for w in words]), sum(map(len, words))))
            assert told[0] == told[1]
            assert len(few.number) <= 300 + len(set(words))
    assert len(many.number) > 1000
