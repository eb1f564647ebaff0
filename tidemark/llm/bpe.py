"""Byte-pair merging with a heap over a linked list, and token counts of whole texts."""

from __future__ import annotations

import base64
import functools
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import Memo, col


#: No rank: above all there are.
NONE = 1 << 40
#: Bytes of the longest words that are merged together with others.
TOGETHER = 40


class Merges:
    """Ranked merges of adjacent symbols. Symbols are small integers; a merge's rank also finds its product."""

    def __init__(self, symbol_of_byte: list[int], rank_of_pair: dict[int, int], product_of_rank: list[int]):
        self.symbol_of_byte, self.rank_of_pair, self.product_of_rank = symbol_of_byte, rank_of_pair, product_of_rank

    @classmethod
    def from_json(cls, path: str) -> Merges:
        """A byte-level BPE in the JSON form of the tokenizers library."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        pairs, made = {}, []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            pairs[ids[left] << 20 | ids[right]] = rank
            made.append(ids[left + right])
        return cls([ids[c] for c in byte_letters()], pairs, made)

    @classmethod
    def from_ranks(cls, path: str) -> Merges:
        """A rank file: base64 of the token's bytes, then its rank, which is also its id.

        A token of two or more bytes is the product of the two parts that lower ranks leave of it.
        """
        ranks = load_ranks(path)
        symbols = [ranks[bytes([b])] for b in range(256)]
        own = cls(symbols, {}, [])
        made: dict[int, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = own.merge(token)
                if len(parts) == 2:
                    own.rank_of_pair[parts[0] << 20 | parts[1]] = rank
                    made[rank] = rank
                    own.product_of_rank = made  # type: ignore[assignment]
        return own

    def _merged(self, word: bytes) -> tuple[list[int], int]:
        """The word's symbols, -1 where one has gone into its left neighbour, and how many merges there were: the adjacent pair of
        lowest rank, leftmost first, merges until none can."""
        rank_of, product = self.rank_of_pair, self.product_of_rank
        sym = [self.symbol_of_byte[b] for b in word]
        n, merges = len(sym), 0
        pairs = [a << 20 | b for a, b in zip(sym, sym[1:])]
        heap = [rank_of[p] << 32 | i for i, p in enumerate(pairs) if p in rank_of]
        if not heap:
            return sym, 0
        heapify(heap)
        pairs.append(-1)  # pairs[i]: the pair that starts at symbol i, -1 if none does
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heappop(heap)
            i, r = entry & 0xFFFFFFFF, entry >> 32
            if rank_of.get(pairs[i]) != r:
                continue  # one of the two has merged since
            merges += 1
            j = after[i]
            sym[i] = s = product[r]
            sym[j] = pairs[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                pairs[i] = p = s << 20 | sym[k]
                if p in rank_of:
                    heappush(heap, rank_of[p] << 32 | i)
            else:
                pairs[i] = -1
            if (h := before[i]) >= 0:
                pairs[h] = p = sym[h] << 20 | s
                if p in rank_of:
                    heappush(heap, rank_of[p] << 32 | h)
        return sym, merges

    def merge(self, word: bytes) -> list[int]:
        """The symbols that merging leaves of a word."""
        sym, merges = self._merged(word)
        return [s for s in sym if s >= 0] if merges else sym

    def count(self, word: bytes) -> int:
        """How many symbols merging leaves: those at the start minus the merges; no list of them is made."""
        return len(word) - self._merged(word)[1]


    @functools.cached_property
    def _arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of bytes, pairs in order, the ranks of those, and products of ranks."""
        pairs = np.array(sorted(self.rank_of_pair), np.int64)
        ranks = np.fromiter(map(self.rank_of_pair.__getitem__, pairs.tolist()), np.int64, len(pairs))
        product = np.zeros(ranks.max(initial=0) + 1, np.int64)
        product[ranks] = [self.product_of_rank[r] for r in ranks.tolist()]
        return np.array(self.symbol_of_byte, np.int64), np.append(pairs, 1 << 62), np.append(ranks, NONE), product

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where there is none."""
        _, pairs, ranks, _ = self._arrays
        wanted = left << 20 | right
        at = np.searchsorted(pairs, wanted)
        return np.where(pairs[at] == wanted, ranks[at], NONE)

    def merge_all(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many symbols merging leaves of each word, and those of all words, in order. Words (large strings) of one length are merged
        together, one pair of each at a time, so all that still merge stay of one length; long ones are merged each by itself."""
        symbols, _, _, product = self._arrays
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        lengths, sizes, done = np.diff(offsets), np.zeros(len(words), np.int64), []
        for length in np.unique(lengths).tolist():
            rows = np.nonzero(lengths == length)[0]
            if length > TOGETHER:
                for row in rows.tolist():
                    own = np.array(self.merge(data[offsets[row] : offsets[row + 1]].tobytes()), np.int64)
                    done.append((np.array([row]), own[None]))
                continue
            sym = symbols[data[offsets[rows][:, None] + np.arange(length)]]
            rank = self._ranks(sym[:, :-1], sym[:, 1:])
            while sym.shape[1] > 1:
                m, at = sym.shape[1], rank.argmin(axis=1)
                best = rank[np.arange(len(rows)), at]
                on = best < NONE
                if not on.all():
                    done.append((rows[~on], sym[~on]))
                    rows, sym, rank, at, best = rows[on], sym[on], rank[on], at[on], best[on]
                if not len(rows):
                    break
                each = np.arange(len(rows))
                sym[each, at] = product[best]
                keep = np.arange(m) != (at + 1)[:, None]
                sym = sym[keep].reshape(len(rows), m - 1)
                rank = rank[keep[:, 1:]].reshape(len(rows), m - 2)
                inner, last = at > 0, at < m - 2
                rank[each[inner], at[inner] - 1] = self._ranks(sym[each[inner], at[inner] - 1], sym[each[inner], at[inner]])
                rank[each[last], at[last]] = self._ranks(sym[each[last], at[last]], sym[each[last], at[last] + 1])
            if len(rows):
                done.append((rows, sym))
        for rows, sym in done:
            sizes[rows] = sym.shape[1]
        begins, out = np.cumsum(sizes) - sizes, np.zeros(sizes.sum(), np.uint32)
        for rows, sym in done:
            out[begins[rows][:, None] + np.arange(sym.shape[1])] = sym
        return sizes, out


def byte_letters() -> str:
    """The printable letter that stands for each byte in byte-level vocabularies: visible Latin-1 is itself, others follow from U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in visible else next(others)) for b in range(256))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@functools.cache
def merges(path: str) -> Merges:
    return Merges.from_json(path) if path.endswith(".json") else Merges.from_ranks(path)


@functools.cache
def special_strings(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as f:
        return tuple(x["content"] for x in json.load(f)["added_tokens"])


# Fixed value: the pattern of the byte-level vocabularies. Its matches never go from one word into the next, so where words
# stand one blank or newline apart, each word with what stands before it can be looked up whole.
BY_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Counter:
    """Counts the tokens of texts; distinct words are merged once for as long as the memo holds them."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.find, table = regex.compile(pattern).findall, merges(path)
        self.by_words = pattern == BY_WORDS
        self.special = special_strings(path)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pretoken = Memo(lambda m: table.count(m.encode()))
        self.first = Memo(lambda w: sum(map(self.pretoken.__getitem__, self.find(w))))
        self.later = Memo(lambda w: self.first[w if w[:1] == "\n" else " " + w])

    def plain(self, text: str) -> int:
        if not self.by_words or " ".join(text.split()) != text.replace("\n", " "):  # white space other than one blank or newline between words
            return sum(map(self.pretoken.__getitem__, self.find(text)))
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.first[first] + sum(map(self.later.__getitem__, rest))

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if self.cut and any(s in text for s in self.special):
            pieces = self.cut.split(text)
            return len(pieces) - 1 + sum(map(self, pieces))
        return self.plain(text)


@functools.cache
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    `vocabulary` is a byte-level BPE file in the tokenizers library's JSON form, at a path that executors can open; its
    special strings inside a text count as one token each. Null text counts as empty: 0 bytes, 0 tokens. A null id stays
    null, repeated rows each get their own row, an empty table gives no rows, and other columns are not read. Every
    text is counted whole, however long; merging takes O(n log n) for a word of n bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = [count(t) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
