"""What a packing worker holds: two generations of words, both bounded, with the library's ids throughout."""

import random

import numpy as np
import public_tokenizers as P

from tidemark.llm.packing import Ids


def test_words_that_come_back_are_held_on_and_others_go():
    path, r = P.path("word_bpe_49k.json"), random.Random(7)
    encode = Ids(path, 300)
    name = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(2, 9)))
    common = [f"{name()}{tail}" for tail in ("", ",", "?!") for _ in range(20)]
    most, hits = 0, []
    for _ in range(40):
        text = " ".join([*common, *(w.capitalize() for w in common), *(name() for _ in range(100)), "éa", "x'y", "中文"])
        whole = encode.tokenizer.encode(text, add_special_tokens=False).ids
        assert encode([text, ""]) == [np.array(whole, "<u4").tobytes(), b""]
        most = max(most, len(encode.held) + len(encode.older))
        hits.append(len(set(common) & (encode.held.keys() | encode.older.keys())))
    assert most < 2 * (300 + 400)  # a generation is full when a text begins
    assert min(hits) == len(set(common))


def test_words_that_are_held_are_not_looked_up_again_and_texts_are_cut_at_all_white_space():
    encode, asked = Ids(P.path("word_bpe_49k.json")), []
    missing = encode.missing
    encode.missing = lambda words: missing(asked.append(len(words)) or words)
    texts = [" the  and\nof　é x\t", "", "the of", " ", "\x85and ", "a\x1cb", "word " * 400_000]
    first = encode(texts)
    assert first == [encode.whole(t) for t in texts] and max(asked)
    asked.clear()
    assert encode(texts) == first and not any(asked)
