"""Periodic runs of words: Lyndon arrays for both orders of the alphabet, with the matches found so far used again.

A run's smallest period is that of a Lyndon word that starts in it, under the order of words or its reverse, so the edges of two
Lyndon arrays name all runs. The extensions that those edges need are found while the arrays are built: an extension that lies
inside an earlier match is that of the earlier place, and what goes beyond it is read once. No suffix array, tree or hash of texts is used.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import WORD, chunks, col

#: A run has this many words at least, and this many periods.
LEAST, TIMES = 6, 4
#: Characters of text that a task looks at together; a longer document stands alone or ends its batch.
BATCH = 1 << 20

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

Run = tuple[int, int, int]


def lyndon(t: Sequence[int]) -> tuple[list[int], list[int]]:
    """For each place: where the next smaller suffix starts (len(t) if none but the empty one is), and how far the two agree.

    Places whose next smaller suffix isn't known wait on a stack; each new place is compared with the top, and with the one below
    if the top is larger. What the new place shares with the one below follows from what both share with the top, unless those are
    equal. `x`, `y` and `end` are the pair whose match reaches farthest: t[q] == t[q - (y - x)] for y <= q < end.
    """
    n = len(t)
    after, shared = [n] * n, [0] * n  # of the next smaller suffix
    below, common = [-1] * n, [0] * n  # of the one before that is smaller
    x = y = end = 0
    stack: list[int] = []
    for j in range(n):
        held, m = -1, 0
        while stack:
            i = stack[-1]
            extend = True
            if held >= 0:
                known = common[held]
                if known < m:  # i is smaller than held where j still agrees with held
                    m = known
                    break
                extend = known == m
            if extend:
                if y < j < end:
                    back = j - (y - x)
                    if i >= y and after[i - y + x] == back:
                        m, extend = _seen(shared[i - y + x], m, end - j)
                    elif i >= y and below[back] == i - y + x or i < y and below[back] == i:
                        m, extend = _seen(common[back], m, end - j)
                    elif i == back:
                        m = max(m, end - j)
                if extend:
                    while j + m < n and t[i + m] == t[j + m]:
                        m += 1
                if j + m > end:
                    x, y, end = i, j, j + m
            if j + m < n and t[i + m] < t[j + m]:
                break
            after[i], shared[i] = j, m
            held = stack.pop()
        if stack:
            below[j], common[j] = stack[-1], m
        stack.append(j)
    return after, shared


def _seen(value: int, m: int, left: int) -> tuple[int, bool]:
    """What an earlier pair shared, and whether the text beyond the match must be read."""
    return (value, False) if value < left else (max(m, left), True)


def runs(t: Sequence[int]) -> list[Run]:
    """(start, length, period) of all runs of LEAST words and TIMES periods or more, by start, then period."""
    found = set()
    for order in (t, [-v for v in t]):
        after, shared = lyndon(order)
        for i, (j, right) in enumerate(zip(after, shared, strict=True)):
            p = j - i
            if right < (TIMES - 2) * p + 1 or i >= p and after[i - p] == i and shared[i - p] >= p:  # too short, or its run has an earlier root
                continue
            left = 0
            while left < i and t[i - left - 1] == t[j - left - 1]:
                left += 1
            if left + p + right >= max(LEAST, TIMES * p):
                found.add((i - left, left + p + right, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) of the parts of the batch that can hold runs: three words in a row that stand in a run stand in its document three times or more.

    With four periods of q words, and six words, that holds for every q; so no run has fewer, nor has a place beside a run that would extend it.
    ids: all words of the batch, doc: the number of each word's document.
    """
    if len(ids) < LEAST:
        return []
    base = int(ids.max()) + 1
    pairs = ids[:-1].astype(np.int64) * base + ids[1:]
    _, pairs = np.unique(pairs, return_inverse=True)
    _, threes = np.unique(pairs[:-1].astype(np.int64) * (int(pairs.max()) + 1) + pairs[1:], return_inverse=True)
    inside = doc[:-2] == doc[2:]  # false at a document's last two words, so no part goes across documents
    name = threes.astype(np.int64) * (int(doc[-1]) + 1) + doc[:-2]
    _, name, n = np.unique(name, return_inverse=True, return_counts=True)
    often = np.concatenate([[False], inside & (n[name] >= 3), [False]])
    edges = np.flatnonzero(often[1:] != often[:-1])
    return [(a, b + 2) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b + 2 - a >= LEAST]


def rewritten(words: list[str], doc_id: int | None) -> list[str]:
    """The words with a made repetition where the document's number asks for one."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def collapsed(words: list[str], found: list[Run]) -> list[str]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def runs_of(texts: list[list[str]]) -> list[list[Run]]:
    """The runs of each list of words."""
    out: list[list[Run]] = [[] for _ in texts]
    number = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}  # the order of the alphabet
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = np.fromiter((number[w] for t in texts for w in t), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    begins = np.cumsum(sizes) - sizes
    for a, b in stretches(ids, doc):
        d = int(doc[a])
        out[d] += [(s + a - int(begins[d]), length, p) for s, length, p in runs(ids[a:b].tolist())]
    return out


def periodic_runs(docs: DataFrame, *, rewrite: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_runs, the run with the greatest length by period (ties: smallest start, then period; nulls if there is none),
    runs_sha256 (of `start,length,period` and a newline for each run by start, then period) and collapsed_sha256 (of the words
    that stay when each run keeps its first period, joined by one space).

    Words are what ASCII white space separates. A run is a stretch with smallest period q, of max(6, 4 q) words or more, that no word beside
    it extends. `rewrite` first plants repetitions, as rewritten() says. Null text counts as empty and has no words; an empty table gives none;
    rows that repeat are told each; a null id stays null and plants nothing; other columns of docs are not kept, so none can clash.

    One scan without a shuffle. A task holds BATCH characters and a document more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = re.compile(WORD).findall
        rows = ((i, t or "") for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for held in chunks(rows, lambda r: len(r[1]) + 64, BATCH):
            texts = [rewritten(w, i) if rewrite else w for i, w in ((i, split(t)) for i, t in held)]
            out = []
            for (i, _), words, found in zip(held, texts, runs_of(texts), strict=True):
                best = _best(found)
                told = "".join(f"{s},{length},{p}\n" for s, length, p in found)
                out.append((i, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], _sha(told), _sha(" ".join(collapsed(words, found)))))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k > 5 else pa.int64()) for k, c in enumerate(zip(*out, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _best(found: list[Run]) -> Run | None:
    """By exact fractions, as floats may take two for one."""
    best = None
    for r in found:
        if best is None or (r[1] * best[2], -r[0], -r[2]) > (best[1] * r[2], -best[0], -best[2]):
            best = r
    return best


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
