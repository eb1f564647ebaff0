"""Packing of tokenized documents into sequences of one length: best fit, then a local search by swaps."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, col, only, settle

#: Pieces that one task packs by itself. Groups are dealt at random, so each is a fair sample and leaves a bin or two underfull.
GROUP = 20_000


#: Lines that are a word of Latin letters with what may stand behind it; the tokenizer cuts between the two, and its letters don't change in
#: number. Combining marks are not among that: the tokenizer composes them with the letter before.
PLAIN = re.compile(r"(?m)^(([A-Za-zÀ-ÖØ-öø-ÿ]+)([^\w\s'\p{M}]*))$")


#: Words that a worker holds with their ids in one of two generations, some 160 bytes each. A full one becomes the older and pushes that out; words found there are held on.
HELD = 900_000

#: Characters of text that are split into words at once, a text more at most; the more, the fewer times a frequent word is looked up.
CHUNK = 1 << 23

#: Words whose ids are put in their places at once, a text more at most.
EXPANDED = 1 << 19

#: Words that the tokenizer gets at once, and that are learnt at once: what is made of each is large until its ids are taken.
AT_ONCE, LEARNT = 2000, 20_000


class Ids:
    """Ids of whole texts by a tokenizers file whose tokens never hold white space and mark the ends of words; distinct words are encoded once while they are held."""

    def __init__(self, path: str, most: int = HELD):
        self.most = most
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.held: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return self.encoded([text])[0]

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for at in range(0, len(texts), AT_ONCE) for e in self.tokenizer.encode_batch_fast(texts[at : at + AT_ONCE], add_special_tokens=False)]

    def missing(self, words: Iterable[str]) -> list[str]:
        """Those of the words that neither generation holds; the newer one holds the others from then on."""
        new = [w for w in words if w not in self.held]
        back = [w for w in new if w in self.older]
        self.held.update(zip(back, map(self.older.__getitem__, back), strict=True))
        return [w for w in new if w not in self.older] if back else new

    def learn(self, words: list[str]) -> None:
        """The ids of new words. Plain ones are encoded many in a text, by their stems, which are words too; ids that end a word tell them apart."""
        plain = PLAIN.findall("\n".join(words))
        lower = "\n".join([stem for _, stem, _ in plain]).lower().split("\n") if plain else []  # letter by letter, as these letters are
        stems = self.missing(set(lower))
        for at in range(0, len(stems), AT_ONCE):
            some = stems[at : at + AT_ONCE]
            found = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.nonzero(self.ends[found])[0] + 1
            if len(stops) == len(some) and stops[-1] == len(found):
                data, ends = found.tobytes(), (4 * stops).tolist()
                self.held.update(zip(some, map(data.__getitem__, map(slice, [0, *ends], ends)), strict=False))
            else:
                self.held.update(zip(some, self.encoded(some), strict=True))
        names, tails = [w for w, _, _ in plain], [tail for _, _, tail in plain]
        rest = [*self.missing(set(tails)), *set(words).difference(names)]
        self.held.update(zip(rest, self.encoded(rest), strict=True))
        get = self.held.__getitem__
        self.held.update(zip(names, list(map(add, map(get, lower), map(get, tails))), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit. Texts with special strings, or with separators that only Python takes for white space, go to the tokenizer whole."""
        odd = [any(s in t for s in self.special) or any(c in t for c in "\x1c\x1d\x1e\x1f") for t in texts]
        split = pc.utf8_split_whitespace(pa.array(["" if o else t for t, o in zip(texts, odd, strict=True)], pa.large_string()))
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        coded = split.flatten().dictionary_encode()  # each distinct word of the texts is looked up once; an empty one stands where white space begins or ends a text
        del split
        if len(self.held) > self.most:
            self.held, self.older = {"": b""}, self.held
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        known = list(map(self.held.get, words))
        gaps = [i for i, own in enumerate(known) if own is None]
        new = self.missing([words[i] for i in gaps])
        for first in range(0, len(new), LEARNT):
            self.learn(new[first : first + LEARNT])
        for i in gaps:
            known[i] = self.held[words[i]]
        flat, n = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4
        begins, out, to = np.cumsum(n) - n, [], 0
        for some in chunks(iter(counts.tolist()), lambda k: k, EXPANDED):
            stops = np.concatenate([[0], np.cumsum(some)])
            own = at[to : to + stops[-1]]
            to += stops[-1]
            ends = np.concatenate([[0], np.cumsum(n[own])])
            ids = flat[np.repeat(begins[own] - ends[:-1], n[own]) + np.arange(ends[-1])].tobytes()
            cuts = (4 * ends[stops]).tolist()
            out += [ids[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
        return [self.whole(t) if o else own for t, o, own in zip(texts, odd, out, strict=True)]


def pieces(docs: DataFrame, tokenizer: str, *, size: int = 2048, end: int = 0, held: int = HELD, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids, then the id `end`, cut every `size` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, closing = only(Ids, tokenizer, held), np.array([end], "<u4").tobytes()
        for b in batches:
            rows = ((i, t) for at in range(0, b.num_rows, 100) for part in [b.slice(at, 100)] for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
            for some in chunks(rows, lambda r: len(r[1] or ""), chunk):
                out = []
                for (doc_id, _), own in zip(some, encode([t or "" for _, t in some]), strict=True):
                    own += closing
                    out += [(doc_id, at // size, at, min(size, len(own) // 4 - at), zlib.crc32(own[4 * at : 4 * (at + size)])) for at in range(0, len(own) // 4, size)]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of places in `lengths`: the longest first, each into the fullest bin that it fits into."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(size + 1)]  # bins by what is free in them
    mask = 0  # of free sizes that a bin has
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fitting = mask >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                mask ^= 1 << free
        else:
            free, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        left = free - n
        if left:
            room[left].append(b)
            mask |= 1 << left
    return bins


class Search:
    """Local search over underfull bins. Each step fills a bin further from emptier ones, which increases the sum of squared fills; bins that run empty go.

    Steps, for a bin with free space and one of its pieces, or none: one larger piece for it, two for it, or one moved in.
    """

    def __init__(self, lengths: list[int], bins: list[list[int]], size: int):
        self.lengths, self.bins, self.size = lengths, bins, size
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.where: list[set[int]] = [set() for _ in range(size + 1)]  # pieces of emptier bins by length
        self.mask = 0
        self.bin_of = {i: b for b, held in enumerate(bins) for i in held}

    def offer(self, i: int) -> None:
        n = self.lengths[i]
        self.where[n].add(i)
        self.mask |= 1 << n

    def withdraw(self, i: int) -> None:
        n = self.lengths[i]
        self.where[n].discard(i)
        if not self.where[n]:
            self.mask &= ~(1 << n)

    def put(self, i: int, b: int) -> None:
        old = self.bin_of[i]
        self.bins[old].remove(i)
        self.bins[b].append(i)
        self.fill[old] -= self.lengths[i]
        self.fill[b] += self.lengths[i]
        self.bin_of[i] = b

    def largest(self, most: int, over: int) -> int:
        """The largest length on offer that is over `over` and at most `most`, or 0."""
        found = (self.mask & ((1 << most + 1) - 1)) >> (over + 1)
        return found.bit_length() + over if found else 0

    def from_emptiest(self, n: int, but: int = -1) -> int | None:
        return min((i for i in self.where[n] if i != but), key=lambda i: (self.fill[self.bin_of[i]], i), default=None)

    def squares(self, moves: list[tuple[int, int]]) -> int:
        """How much the sum of squared fills grows if pieces go to bins; -1 if a bin overflows."""
        change: dict[int, int] = {}
        for i, to in moves:
            n, old = self.lengths[i], self.bin_of[i]
            change[old] = change.get(old, 0) - n
            change[to] = change.get(to, 0) + n
        if any(self.fill[x] + d > self.size for x, d in change.items()):
            return -1
        return sum((self.fill[x] + d) ** 2 - self.fill[x] ** 2 for x, d in change.items())

    def choices(self, b: int) -> list[tuple[int, int | None, tuple[int, ...]]]:
        """(gain, piece that leaves, lengths that come) for the bin: for each piece of it and for none, the best single length and the best two."""
        free, found = self.size - self.fill[b], []
        for out in [None, *sorted(self.bins[b], key=lambda i: (self.lengths[i], i))]:
            n = 0 if out is None else self.lengths[out]
            one = self.largest(n + free, n)
            if one:
                found.append((one - n, out, (one,)))
                if one - n == free:
                    return [found[-1], *found]
            target, low, best = n + free, self.mask & ((1 << (n + free) // 2 + 1) - 1), (0, 0)
            while low and sum(best) < target:
                small = low & -low
                low ^= small
                first = small.bit_length() - 1
                second = self.largest(target - first, first - 1)
                if second == first and len(self.where[first]) < 2:
                    second = 0
                if second and first + second > sum(best):
                    best = (first, second)
            if sum(best) > n:
                found.append((sum(best) - n, out, best))
        return sorted(found, key=lambda c: -c[0])

    def step(self, b: int) -> bool:
        """The change with the largest gain that increases the sum of squared fills; what leaves goes to a bin that something came from."""
        for _, out, come in self.choices(b):
            first = self.from_emptiest(come[0])
            second = self.from_emptiest(come[1], first) if len(come) > 1 else None
            into = [(i, b) for i in (first, second) if i is not None]
            ways = [[*into, (out, self.bin_of[i])] for i, _ in into] if out is not None else [into]
            moves = max(ways, key=self.squares)
            if self.squares(moves) > 0:
                for i, to in moves:
                    if to == b:
                        self.withdraw(i)
                    self.put(i, to)
                    if to != b:
                        self.offer(i)
                return True
        return False

    def run(self) -> None:
        """Passes over the underfull bins until one changes nothing. Each change makes the sum of squared fills larger, so there is a last."""
        changed = True
        while changed:
            order = sorted((b for b in range(len(self.bins)) if 0 < self.fill[b] < self.size), key=lambda b: (-self.fill[b], b))
            self.mask = 0
            for held in self.where:
                held.clear()
            for b in order:
                for i in self.bins[b]:
                    self.offer(i)
            changed = False
            for b in order:
                for i in self.bins[b]:
                    self.withdraw(i)
                while 0 < self.fill[b] < self.size and self.step(b):
                    changed = True


def pack_lengths(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of places in `lengths`, each of at most `size` in all."""
    bins = best_fit(lengths, size)
    Search(lengths, bins, size).run()
    return [b for b in bins if b]


def pack(docs: DataFrame, tokenizer: str, *, size: int = 2048, end: int = 0, group: int = GROUP, held: int = HELD, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids by the tokenizers file, then the id `end`; only longer ones than `size` are cut, every `size` ids.
    Pieces are dealt at random into groups of about `group`, and each group is packed in one task: best fit, then swaps. A
    task's work is bounded whatever the table's size, and a group wastes no more than its last few bins. Null text counts as
    empty: its end alone. A null id stays null; repeated rows are packed each; an empty table gives no rows; other columns are not read.
    `held` and `chunk` set what a Python worker needs, for time: words that it holds a generation, and characters that it splits at once.
    """
    cut = settle(pieces(docs, tokenizer, size=size, end=end, held=held, chunk=chunk, id_col=id_col, text_col=text_col))
    groups = -(-cut.count() // group) or 1

    def run(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values(["tm_row"], ignore_index=True)
        lengths = held["length"].tolist()
        sequence, offset = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
        for number, b in enumerate(pack_lengths(lengths, size)):
            at = 0
            for i in b:
                sequence[i], offset[i] = number, at
                at += lengths[i]
        return held.assign(sequence_id=held["tm_group"].astype("int64") * (1 << 32) + sequence, offset=offset)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    dealt = cut.withColumn("tm_row", F.monotonically_increasing_id()).withColumn("tm_group", F.pmod(F.xxhash64("tm_row"), F.lit(groups)).cast("long"))
    return dealt.groupBy("tm_group").applyInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
