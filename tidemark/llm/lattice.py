"""Probabilities of texts under a subword lattice: all segmentations of a word into pieces, weighted by unigram scores."""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import batched, checked, one_by_one, regroup, unpack, words
from tidemark.llm.common import settle

#: Stands before each word in the vocabulary's pieces.
MARK = "▁"
#: Words of one numpy pass.
PASS = 4096
#: Code points have 21 bits; a key is a node and the next code point.
POINT = 21


@dataclass(frozen=True)
class Trie:
    """The pieces of a vocabulary, letter by letter. keys: node << 21 | code point, sorted, with the node each leads to; piece: of each node, or -1."""

    keys: np.ndarray
    to: np.ndarray
    piece: np.ndarray
    lengths: np.ndarray
    scores: np.ndarray
    fallback: np.ndarray
    longest: int


@functools.cache
def trie(model: str) -> Trie:
    """The pieces of a sentencepiece model, without control and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    step: dict[int, int] = {}
    piece_of, lengths = [-1], np.zeros(n, np.int64)
    fallback = np.array([sp.is_byte(i) for i in range(n)])
    for i in range(n):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
            continue
        node, text = 0, sp.id_to_piece(i)
        lengths[i] = len(text)
        for c in text:
            key = node << POINT | ord(c)
            if key not in step:
                step[key] = len(piece_of)
                piece_of.append(-1)
            node = step[key]
        piece_of[node] = i
    keys = np.array(sorted(step), np.int64)
    return Trie(keys, np.array([step[k] for k in keys.tolist()]), np.array(piece_of), lengths, np.array([sp.get_score(i) for i in range(n)]), fallback, int(lengths.max()))


def starting(t: Trie) -> np.ndarray:
    """Natural-log probabilities of the pieces by the vocabulary's own scores. Scores that are log probabilities are taken as
    they are; those of merged vocabularies are minus the rank of the merge, and the probability falls with the rank as 1 / (rank + 10). A byte gets the least of any piece."""
    ranked = float(t.scores.min()) < -100
    weights = np.where(t.lengths > 0, 1.0 / (10.0 - t.scores) if ranked else np.exp(np.minimum(t.scores, 0)), 0.0)
    weights[t.fallback] = weights[weights > 0].min()
    return np.log(np.maximum(weights / weights.sum(), 1e-300))


@dataclass
class Arcs:
    """Pieces that fit in a pass of words of one length: word, start and end, piece (-1: its character by bytes), sorted by end."""

    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    bytes: np.ndarray


def arcs(points: np.ndarray, t: Trie) -> Arcs:
    """All pieces that stand anywhere in the words, which are rows of code points of one length.

    Each character that is no piece by itself can also be spelt in bytes, so every word has a segmentation.
    """
    n, length = points.shape
    found = []
    word, start = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(length), indexing="ij"))
    node = np.zeros(n * length, np.int64)
    single = np.zeros(n * length, bool)
    at = np.arange(n * length)
    for size in range(1, t.longest + 1):
        fits = start + size <= length
        word, start, node, at = word[fits], start[fits], node[fits], at[fits]
        if not len(word):
            break
        key = node << POINT | points[word, start + size - 1]
        where = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
        known = t.keys[where] == key
        word, start, node, at = word[known], start[known], t.to[where[known]], at[known]
        ends = t.piece[node] >= 0
        found.append((word[ends], start[ends], start[ends] + size, t.piece[node[ends]]))
        if size == 1:
            single[at[ends]] = True
    word, start = np.nonzero(~single.reshape(n, length))
    found.append((word, start, start + 1, np.full(len(word), -1)))
    w, s, e, p = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((s, e))
    w, s, e, p = w[order], s[order], e[order], p[order]
    c = points[w, s]
    spelt = np.where(p < 0, 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF), 0)
    return Arcs(w, s, e, p, spelt)


def _weights(a: Arcs, logp: np.ndarray, byte: float) -> np.ndarray:
    return np.where(a.piece >= 0, logp[a.piece], a.bytes * byte)


def forward(a: Arcs, weight: np.ndarray, n: int, length: int) -> np.ndarray:
    """alpha[word, i]: log of the total weight of all segmentations of the word's first i characters."""
    alpha = np.full((n, length + 1), -np.inf)
    alpha[:, 0] = 0.0
    bounds = np.searchsorted(a.end, np.arange(1, length + 2))
    for i in range(1, length + 1):
        part = slice(bounds[i - 1], bounds[i])
        np.logaddexp.at(alpha[:, i], a.word[part], alpha[a.word[part], a.start[part]] + weight[part])
    return alpha


def backward(a: Arcs, weight: np.ndarray, n: int, length: int) -> np.ndarray:
    """beta[word, i]: the same for what follows the first i characters."""
    beta = np.full((n, length + 1), -np.inf)
    beta[:, length] = 0.0
    order = np.argsort(a.start, kind="stable")
    bounds = np.searchsorted(a.start[order], np.arange(length + 1))
    for i in range(length - 1, -1, -1):
        part = order[bounds[i] : bounds[i + 1]]
        np.logaddexp.at(beta[:, i], a.word[part], beta[a.word[part], a.end[part]] + weight[part])
    return beta


def _by_length(held: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in held, rows of code points with the word mark in front) of words of one length, a pass at a time."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(held):
        groups.setdefault(len(w), []).append(i)
    for length, places in groups.items():
        step = max(1, PASS * 8 // (length + 1))
        for at in range(0, len(places), step):
            some = places[at : at + step]
            points = np.frombuffer("".join(MARK + held[i] for i in some).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            yield np.array(some), points.reshape(len(some), length + 1)


def word_logs(held: list[str], t: Trie, logp: np.ndarray) -> np.ndarray:
    """Natural log of the marginal probability of each word: the sum over all its segmentations."""
    out, byte = np.zeros(len(held)), float(logp[t.fallback].max()) if t.fallback.any() else -40.0
    for places, points in _by_length(held):
        a = arcs(points, t)
        out[places] = forward(a, _weights(a, logp, byte), *points.shape)[:, -1]
    return out


def expected(held: list[str], counts: np.ndarray, t: Trie, logp: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words, which count as often as given; bytes count at the fallback's first place."""
    out, byte = np.zeros(len(logp)), float(logp[t.fallback].max()) if t.fallback.any() else -40.0
    first_byte = int(np.argmax(t.fallback))
    for places, points in _by_length(held):
        a = arcs(points, t)
        w = _weights(a, logp, byte)
        alpha, beta = forward(a, w, *points.shape), backward(a, w, *points.shape)
        share = np.exp(alpha[a.word, a.start] + w + beta[a.word, a.end] - alpha[a.word, -1]) * counts[places][a.word]
        known = a.piece >= 0
        out += np.bincount(a.piece[known], share[known], len(out))
        out[first_byte] += float((share * a.bytes)[~known].sum())
    return out


def held_out_by_id(doc_id) -> bool:
    """crc32 of the id's decimal digits leaves 2 by 7; a null id is none."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _lower_words():
    return one_by_one(lambda text: text.encode().lower().split(), pa.binary())


def _adapt(stats: DataFrame, model: str, prior: float) -> tuple[np.ndarray, int, int]:
    """Log probabilities of the pieces after one step of expectation over all training words, and the number of word tokens
    and distinct words. What goes to the driver is a sum for each piece of the vocabulary."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie(model)
        logp = starting(t)
        total = np.zeros(len(logp) + 2)
        for b in parts:
            counts = b.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            held = [w.decode() for w in b.column(0).to_pylist()]
            total[:-2] += expected(held, counts, t, logp)
            total[-2:] += counts.sum(), len(held)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["piece", "n"])

    t = trie(model)
    start = starting(t)
    sums = np.zeros(len(start) + 2)
    for r in stats.filter("c > 0").select("word", "c").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        sums[r["piece"]] = r["n"]
    counted = sums[:-2]
    p = (counted + prior * np.exp(start)) / (counted.sum() + prior)
    n_bytes = int(t.fallback.sum())
    if n_bytes:  # bytes share what was counted for any of them
        p[t.fallback] = p[t.fallback].sum() / n_bytes
    return np.log(np.maximum(p, 1e-300)), round(sums[-2]), round(sums[-1])


def score_texts(docs: DataFrame, model: str, *, prior: float = 10_000.0, held_out=held_out_by_id, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mixed_score (log10 of probabilities).

    Tokens are words, A-Z in lower case, then one end. All documents that are not held out are learnt from. base_score is
    the add-one unigram probability of the tokens. In score, the model's, each word is the sum over all its segmentations into the
    vocabulary's pieces, by the forward recursion in log space, and the end is drawn after each word with its share of the
    training tokens, so that the text's words and its length are both paid for. The vocabulary's own scores weight the
    pieces at first; one step of expectation over the counts of all training words adapts them (`prior` pseudo-pieces keep the
    vocabulary's shares). No piece is added or taken away. In mixed_score the lattice of a training word has one more arc, over all of it, that weighs its
    count against the number of distinct words, which goes to the pieces (Witten-Bell).

    Null text counts as empty: only the end. A null id is not held out and stays null; repeated rows each get their row; an
    empty table gives none; other columns are not read. Words of any length and in any script have a probability.
    """
    found = settle(batched(docs, _lower_words, "binary", held_out, stable=True, id_col=id_col, text_col=text_col))
    each = words(found)
    stats = settle(each.groupBy("word").agg(F.sum("seen").alias("c")))
    logp, n_words, n_distinct = _adapt(stats, model, prior)
    n_ends = found.select(F.sum(F.size(F.filter("marks", lambda m: ~m)))).first()[0] or 0
    total, distinct = n_words + n_ends, n_distinct + (n_ends > 0)
    base = math.log10(total + distinct + 1)  # N + 1 * (V + 1)
    stop = (n_ends + 1) / (total + 2)
    log_end, log_on = math.log10(stop), math.log10(1 - stop)

    def weigh(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie(model)
        for b in parts:
            logs = word_logs([w.decode() for w in b.column(0).to_pylist()], t, logp) / math.log(10)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(logs)], names=["word", "c", "log"])

    weighed = stats.mapInArrow(weigh, "word binary, c long, log double")
    known = each.select("batch", "place", "word").join(weighed, "word").select("batch", "place", F.struct("c", "log").alias("stat"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for doc_ids, counts, marks, packed, stat, own_words in zip(*(b.column(i) for i in range(6)), strict=True):
                checked(own_words.as_py(), len(stat) if stat.is_valid else 0)
                n = np.array(counts.as_py(), np.int64)
                at, of = unpack(packed.as_py()), stat.values if stat.is_valid else None  # of a list scalar: its own values
                c = of.field("c").to_numpy(zero_copy_only=False) if of is not None else np.zeros(0, np.int64)
                logs = of.field("log").to_numpy(zero_copy_only=False) if of is not None else np.zeros(0)
                ends = np.cumsum(n)
                plain = np.log10(c + 1.0)
                with np.errstate(divide="ignore"):
                    mixed = np.logaddexp(np.log(c), math.log(max(n_distinct, 1)) + logs * math.log(10)) / math.log(10) - math.log10(n_words + max(n_distinct, 1))
                seen = np.concatenate([[0], np.cumsum((c > 0)[at])])
                known_n = seen[ends] - seen[ends - n] + (n_ends > 0)
                exact = [(plain[at[e - k : e]].sum(), mixed[at[e - k : e]].sum(), logs[at[e - k : e]].sum()) for k, e in zip(n.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids.as_py(), pa.int64()), pa.array(marks.as_py(), pa.bool_()), pa.array(n + 1), pa.array(known_n), pa.array(np.full(len(n), total, np.int64)),
                        pa.array([x + math.log10(n_ends + 1) - (k + 1) * base for (x, _, _), k in zip(exact, n.tolist(), strict=True)], pa.float64()),
                        pa.array([z + k * log_on + log_end for (_, _, z), k in zip(exact, n.tolist(), strict=True)], pa.float64()),
                        pa.array([y + k * log_on + log_end for (_, y, _), k in zip(exact, n.tolist(), strict=True)], pa.float64()),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "mixed_score"],
                )

    whole = regroup(found, known, "stat").select("docs", "counts", "marks", "places", "stat", "n_words")
    return whole.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mixed_score double")
