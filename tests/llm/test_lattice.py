"""The lattice's score against all segmentations of all words, its one step of expectation included."""

import math
from collections import Counter

import public_tokenizers as P
import pytest

from tidemark.llm.lattice import held_out_by_id, score_texts

MODEL = "piece_bpe_32k.model"
PRIOR = 50.0


@pytest.fixture(scope="module")
def vocabulary():
    """piece -> weight before the step, and the weight of a byte."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path(MODEL))
    raw = {sp.id_to_piece(i): 1 / (10 - sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    n_bytes = sum(sp.is_byte(i) for i in range(sp.get_piece_size()))
    least = min(raw.values())
    total = sum(raw.values()) + n_bytes * least
    return {k: w / total for k, w in raw.items()}, least / total, n_bytes


def ways(word, pieces, byte):
    """(weight, pieces) of every segmentation; a character that is no piece is spelt in bytes."""
    if not word:
        yield 1.0, ()
        return
    for size in range(1, len(word) + 1):
        head = word[:size]
        if head in pieces:
            for w, rest in ways(word[size:], pieces, byte):
                yield pieces[head] * w, (head, *rest)
        elif size == 1:
            n = len(head.encode())
            for w, rest in ways(word[1:], pieces, byte):
                yield byte**n * w, ((None, n), *rest)


def plain_scores(docs, vocabulary):
    pieces, byte, n_bytes = vocabulary
    split = {i: ["".join(c.lower() if c.isascii() else c for c in w) for w in (t or "").split()] for i, t in docs}
    learnt = {i: w for i, w in split.items() if not held_out_by_id(i)}
    words = Counter(w for ws in learnt.values() for w in ws)
    counted, spelt = Counter(), 0.0
    for word, c in words.items():
        every = list(ways("▁" + word, pieces, byte))
        total = sum(w for w, _ in every)
        for w, parts in every:
            for x in parts:
                if isinstance(x, tuple):
                    spelt += c * w / total * x[1]
                else:
                    counted[x] += c * w / total
    mass = sum(counted.values()) + spelt + PRIOR
    after = {k: (counted[k] + PRIOR * w) / mass for k, w in pieces.items()}
    byte_after = (spelt + PRIOR * byte * n_bytes) / mass / n_bytes
    n_words, n_ends = sum(words.values()), len(learnt)
    stop = (n_ends + 1) / (n_words + n_ends + 2)
    total, distinct = n_words + n_ends, len(words) + 1
    out = {}
    for i, ws in split.items():
        log = sum(math.log10(sum(w for w, _ in ways("▁" + x, after, byte_after))) for x in ws)
        base = sum(math.log10((words[x] + 1) / (total + distinct + 1)) for x in ws) + math.log10((n_ends + 1) / (total + distinct + 1))
        out[i] = (log + len(ws) * math.log10(1 - stop) + math.log10(stop), base, len(ws) + 1, sum(x in words for x in ws) + 1)
    return out


def test_scores_are_those_of_all_segmentations_after_one_step(spark, vocabulary):
    held = [i for i in range(200) if held_out_by_id(i)][:3]
    learnt = [i for i in range(200) if not held_out_by_id(i)][:7]
    texts = ["the river runs", "The RIVER stone 中é", "", None, "zq zq ☃ house", "summer light", "a b"]
    docs = [*zip(learnt, texts, strict=True), (held[0], "the river ☃"), (held[1], "unseen Wörter"), (held[2], None)]
    got = {r["doc_id"]: r for r in score_texts(spark.createDataFrame(docs, "doc_id long, text string"), P.path(MODEL), prior=PRIOR).collect()}
    want = plain_scores(docs, vocabulary)
    assert {i: r["held_out"] for i, r in got.items()} == {i: i in held for i, _ in docs}
    for i, (score, base, n, known) in want.items():
        assert got[i]["score"] == pytest.approx(score, rel=1e-9) and got[i]["base_score"] == pytest.approx(base, rel=1e-9) and (got[i]["n_tokens"], got[i]["n_known"]) == (n, known)


def test_held_out_texts_teach_nothing(spark):
    held = next(i for i in range(200) if held_out_by_id(i))
    learnt = [i for i in range(200) if not held_out_by_id(i)][:4]
    score = lambda text: {r["doc_id"]: r["score"] for r in score_texts(spark.createDataFrame([*((i, f"river stone {i}") for i in learnt), (held, text)], "doc_id long, text string"), P.path(MODEL)).collect()}
    a, b = score("river"), score("quite other words " * 50)
    assert all(a[i] == b[i] for i in learnt) and a[held] != b[held]
