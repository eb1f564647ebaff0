"""The codec's steps against plain versions: how texts are cut into matches, and words merged together."""

import random
import time

import public_tokenizers as P
import pytest
import regex

from tidemark.llm.bpe import TOGETHER, merges
from tidemark.llm.codec import splitter

ODD = ["a", "b", "E", "é", "́", "ß", "中", " ", " ", "  ", "\n", "'s", "'ll", "1", "²", "_", "-", "...", "\t", "\x1c", "\x85", " ", "\r\n", "<|endoftext|>", "😀", "ab cd", "x\ny", "ŉȀ"]


@pytest.mark.parametrize("pattern", [P.PATTERN, r"\S+|\s+"])
def test_words_are_the_matches_of_whole_texts(pattern):
    r, find, split = random.Random(1), regex.compile(pattern).findall, splitter(pattern)()
    for n in [1, 2, 5, 40] * 30:
        texts = ["".join(r.choice(ODD) for _ in range(r.randint(0, 14))) for _ in range(n)]
        words, at, counts = split(texts)
        words, at, own = words.to_pylist(), at.tolist(), []
        assert len(set(words)) == len(words)
        for k in counts.tolist():
            own.append([words[i] for i in at[:k]])
            del at[:k]
        assert own == [find(t) for t in texts] and not at


def test_words_merged_together_are_as_merged_alone_and_cost_less():
    import pyarrow as pa

    table, r = merges(P.path("byte_bpe_50k.tiktoken")), random.Random(2)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "ti", "é", "中", "!", " "]
    words = [*{"".join(r.choice(syllables) for _ in range(r.randint(1, 8))) for _ in range(20_000)}, "", "x", "a" * (TOGETHER + 1), "the" * 50]
    table.merge_all(pa.array(["warm"], pa.large_string()))
    began = time.process_time()
    sizes, ids = table.merge_all(pa.array(words, pa.large_string()))
    took, began = time.process_time() - began, time.process_time()
    alone = [table.merge(w.encode()) for w in words]
    assert took < (time.process_time() - began) / 2
    assert sizes.tolist() == list(map(len, alone)) and ids.tolist() == [i for own in alone for i in own]
    none = table.merge_all(pa.array([], pa.large_string()))
    assert not len(none[0]) and not len(none[1])
