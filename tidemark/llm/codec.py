"""Byte-level BPE: distinct words are encoded once for all documents, texts are put together again and decoded."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.batches import Splitter, apart, checked, one_by_one, pack, unpack
from tidemark.llm.bpe import BY_WORDS, load_ranks, merges
from tidemark.llm.common import chunks

#: Words whose ids are written out at once, a document more at most.
AT_ONCE = 1 << 19


def token_bytes(spark: SparkSession, ranks: str) -> DataFrame:
    """The token-byte table of a rank file: id and its bytes. The file is at a path that executors can open."""

    def run(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load_ranks(ranks)
        yield pa.RecordBatch.from_arrays([pa.array(list(table.values()), pa.int64()), pa.array(list(table), pa.binary())], names=["id", "bytes"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "id long, bytes binary")


#: What keeps a text from being cut at blanks and newlines: other white space, two in a row, one at an end.
UNEVEN = "[\\t\\v\\f\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|[ \\n][ \\n]|\\A[ \\n]|[ \\n]\\z"
#: Units of Latin letters, which are one match.
LETTERS = "\\A ?[A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{24f}]+\\z"


def splitter(pattern: str) -> Splitter:
    """A text's words are the matches of the pattern. Where words stand one blank or newline apart, a text is first cut into units, words with what
    stands before them, and each distinct unit is matched once; other texts are matched whole."""

    def make():
        import regex

        find, by_words = regex.compile(pattern).findall, pattern == BY_WORDS
        whole = one_by_one(find, pa.large_string())

        def matches(units: pa.Array) -> tuple[pa.Array, np.ndarray]:
            """All matches of the units, and which of them each has: (first, number). Units that begin with white space are matched in one text."""
            simple = pc.match_substring_regex(units, LETTERS).to_numpy(zero_copy_only=False)
            n, first = np.ones(len(units), np.int64), np.cumsum(simple) - simple
            others = np.nonzero(~simple)[0]
            listed = units.take(pa.array(others)).to_pylist()
            spaced = np.array([u[:1] in (" ", "\n") for u in listed], bool)
            found = find("".join([u for u in listed if u[:1] in (" ", "\n")]))
            begins = np.nonzero(np.fromiter((m[0] in " \n" for m in found), bool, len(found)))[0]
            loose = [find(u) for u in listed if u[:1] not in (" ", "\n")]
            sizes = np.array([len(x) for x in loose], np.int64)
            n[others[spaced]], first[others[spaced]] = np.diff([*begins, len(found)]), simple.sum() + begins
            n[others[~spaced]], first[others[~spaced]] = sizes, simple.sum() + len(found) + np.cumsum(sizes) - sizes
            return pa.concat_arrays([units.filter(pa.array(simple)), pa.array(found, pa.large_string()), pa.array([m for x in loose for m in x], pa.large_string())]), np.stack([first, n])

        def split(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
            if not by_words:
                return whole(texts)
            uneven = pc.match_substring_regex(pa.array(texts, pa.large_string()), UNEVEN).to_numpy(zero_copy_only=False)
            cut = pc.split_pattern(pa.array([t.replace("\n", "\r\n").replace(" ", "\r ") for t, odd in zip(texts, uneven.tolist(), strict=True) if not odd], pa.large_string()), "\r")
            n_units = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = cut.flatten().dictionary_encode()
            del cut
            of_units, (first, n) = matches(coded.dictionary)
            odd_words, odd_at, odd_counts = whole([t for t, odd in zip(texts, uneven.tolist(), strict=True) if odd])
            words = pa.concat_arrays([of_units, odd_words]).dictionary_encode()
            flat, at = words.indices.to_numpy(), coded.indices.to_numpy()
            long = n[at]
            ends = np.concatenate([[0], np.cumsum(long)])
            found = flat[np.repeat(first[at] - ends[:-1], long) + np.arange(ends[-1])]
            if not uneven.any():
                return words.dictionary, found, np.diff(ends[np.concatenate([[0], np.cumsum(n_units)])])
            counts, starts = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            counts[~uneven], counts[uneven] = np.diff(ends[np.concatenate([[0], np.cumsum(n_units)])]), odd_counts
            starts[~uneven], starts[uneven] = np.cumsum(counts[~uneven]) - counts[~uneven], len(found) + np.cumsum(odd_counts) - odd_counts
            both = np.concatenate([found, flat[len(of_units) + odd_at.astype(np.int64)]])
            return words.dictionary, both[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())], counts

        return split

    return make


@dataclass(frozen=True)
class Encoded:
    """batches: batch, docs, counts, places, n_words; known: batch and ids, structs of packed places, lengths and ids of its pre-tokens."""

    batches: DataFrame
    known: DataFrame


def encode(docs: DataFrame, ranks: str, pattern: str, *, stable: bool = False, id_col: str = "doc_id", text_col: str = "text") -> Encoded:
    """Batches of docs (see batches.batched) and the ids of their pre-tokens.

    Pre-tokens are the matches of `pattern`, each encoded by itself by the ranks. All batches' pre-tokens are shuffled by
    value and sorted, so that equal ones stand together and each is merged once; their ids go back to the places they came
    from, those of one batch packed together, and a batch's places give its texts' order. The table is read twice, for the
    pre-tokens and for the order, which costs less disk than keeping either, if `stable` says that its rows come in the same order
    each time, as those of files do; else it is checkpointed. Null text counts as empty, and a null id stays null.
    """
    found, each = apart(docs, splitter(pattern), stable=stable, id_col=id_col, text_col=text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merges(ranks)
        rows = (b.slice(at, 1 << 16) for b in parts for at in range(0, b.num_rows, 1 << 16))
        for some in chunks(rows, lambda b: b.num_rows, 1 << 16):
            batch, place = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in some]) for i in (0, 1))
            coded = pa.concat_arrays([b.column(2).cast(pa.large_string()) for b in some]).dictionary_encode()
            n, held = table.merge_all(coded.dictionary)
            of = coded.indices.to_numpy()
            sizes, first = n[of], (np.cumsum(n) - n)[of]
            flat = held[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            order = np.argsort(batch, kind="stable")
            begins = np.cumsum(sizes) - sizes
            names, starts = np.unique(batch[order], return_index=True)
            out = []
            for name, part in zip(names.tolist(), np.split(order, starts[1:]), strict=True):
                at = np.repeat(begins[part] - (np.cumsum(sizes[part]) - sizes[part]), sizes[part]) + np.arange(sizes[part].sum())
                out.append((name, pack(place[part]), pack(sizes[part]), pack(flat[at])))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["batch", "at", "sizes", "ids"])

    together = each.repartition("word").sortWithinPartitions("word")
    known = together.mapInArrow(run, "batch long, at binary, sizes binary, ids binary").filter("batch IS NOT NULL").groupBy("batch").agg(F.collect_list(F.struct("at", "sizes", "ids")).alias("ids"))
    return Encoded(found, known)


def _word_ids(n_words: int, packed: list[dict] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, size) of each word's ids, and the ids, from what came back for a batch."""
    held = packed or []
    empty = np.zeros(0, np.int64)
    at = np.concatenate([empty, *(unpack(x["at"]) for x in held)]).astype(np.int64)
    sizes = np.concatenate([empty, *(unpack(x["sizes"]) for x in held)]).astype(np.int64)
    ids = np.concatenate([np.zeros(0, np.uint32), *(unpack(x["ids"]) for x in held)])
    checked(n_words, len(at))
    order = np.argsort(at, kind="stable")
    return (np.cumsum(sizes) - sizes)[order], sizes[order], ids


def with_bytes(encoded: Encoded, ranks: str) -> DataFrame:
    """encode()'s batches with `tokens`: (id, bytes) of each id that the batch uses, from a join with the token-byte table.

    The table is broadcast: it has a row for each token of the vocabulary, whatever the data's size.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for batch, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                used = np.unique(np.concatenate([np.zeros(0, np.uint32), *(unpack(x["ids"]) for x in packed or [])]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), batch, np.int64)), pa.array(used.astype(np.int64))], names=["batch", "id"])

    used = encoded.known.mapInArrow(run, "batch long, id long")
    found = used.join(F.broadcast(token_bytes(encoded.batches.sparkSession, ranks)), "id").groupBy("batch").agg(F.collect_list(F.struct("id", "bytes")).alias("tokens"))
    return encoded.batches.join(encoded.known, "batch", "left").join(found, "batch", "left")


def _table(tokens: list[dict] | None) -> dict[int, bytes]:
    return {t["id"]: t["bytes"] for t in tokens or []}


def texts(encoded: Encoded, ranks: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and decoded (bytes) of each document that was encoded."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for doc_ids, counts, places, packed, n_words, tokens in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                begin, size, ids = _word_ids(n_words, packed)
                table, data, at, end = _table(tokens), ids.astype("<u4").tobytes(), unpack(places), 0
                word = [data[4 * x : 4 * (x + n)] for x, n in zip(begin.tolist(), size.tolist(), strict=True)]
                for doc_id, n in zip(doc_ids, counts, strict=True):
                    end += n
                    own = b"".join(map(word.__getitem__, at[end - n : end].tolist()))
                    decoded = b"".join(map(table.__getitem__, np.frombuffer(own, "<u4").tolist()))
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([own], pa.binary()), pa.array([decoded], pa.binary())], names=["doc_id", "ids", "decoded"])

    return with_bytes(encoded, ranks).select("docs", "counts", "places", "ids", "n_words", "tokens").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def _cut(values: pa.Array, stops: np.ndarray) -> Iterator[memoryview]:
    """The values between two stops as they stand together, for each."""
    _, offsets, data = values.buffers()
    if not len(values):
        yield from (memoryview(b"") for _ in stops[1:])
        return
    ends, held = np.frombuffer(offsets, np.int64)[stops].tolist(), memoryview(data)
    yield from (held[a:b] for a, b in zip(ends, ends[1:], strict=False))


def digests(docs: DataFrame, ranks: str, pattern: str, *, stable: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256 (of the
    bytes that the ids decode to, which are the text's).

    Null text counts as empty: 0 tokens, digests of nothing. A null id stays null; repeated rows each get their row; an
    empty table gives none; other columns are not read. Special strings are ordinary text. stable: see encode().
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for b in parts:
            for doc_ids, counts, places, packed, n_words, known in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                begin, sizes, ids = _word_ids(n_words, packed)
                used = np.array([t["id"] for t in known or []], np.int64)
                where = np.zeros(used.max(initial=-1) + 1, np.int32)
                where[used] = np.arange(len(used))
                shown, plain = pa.array([f"{i} ".encode() for i in used.tolist()], pa.large_binary()), pa.array([t["bytes"] for t in known or []], pa.large_binary())
                at, codes = unpack(places), where[ids]
                tokens, said, back, end = [], [], [], 0
                for some in chunks(iter(counts), lambda n: n, AT_ONCE):
                    words_to = np.concatenate([[0], np.cumsum(some)])
                    own = at[end : end + words_to[-1]]
                    end += words_to[-1]
                    n = sizes[own]
                    tokens_to = np.concatenate([[0], np.cumsum(n)])
                    own = pa.array(codes[np.repeat(begin[own] - tokens_to[:-1], n) + np.arange(tokens_to[-1])])
                    stops = tokens_to[words_to]
                    tokens += np.diff(stops).tolist()
                    said += [sha(x[:-1]) for x in _cut(shown.take(own), stops)]
                    back += [sha(x) for x in _cut(plain.take(own), stops)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(tokens, pa.int64()), pa.array(said), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    encoded = with_bytes(encode(docs, ranks, pattern, stable=stable, id_col=id_col, text_col=text_col), ranks)
    return encoded.select("docs", "counts", "places", "ids", "n_words", "tokens").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
