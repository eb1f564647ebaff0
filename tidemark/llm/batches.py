"""Documents in dictionary batches: each batch holds its distinct words once, and its texts as places in that list.

A batch is what one task tokenizes before it has seen `BATCH_BYTES` of text and a document more, so it is bounded; words meet across batches in
a shuffle that carries each distinct word of a batch once, however often the batch or a hot document repeats it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Memo, chunks, col, settle

BATCH_BYTES = 32 << 20

SCHEMA = "batch long, docs array<long>, counts array<int>, marks array<boolean>, places binary, words array<{word}>, seen array<int>"

#: Made inside a task: the function from texts to their distinct words, the places in those of all their words in order, and how many words each text has.
Splitter = Callable[[], Callable[[list[str]], tuple[pa.Array, np.ndarray, np.ndarray]]]


def one_by_one(words_of: Callable[[str], list], kind: pa.DataType) -> Callable[[list[str]], tuple[pa.Array, np.ndarray, np.ndarray]]:
    """What a Splitter makes, from the function that gives a text's words."""

    def split(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        numbers, blocks = _numbers(), []
        for text in texts:
            own = words_of(text)
            blocks.append(np.fromiter(map(numbers.__getitem__, own), np.uint32, len(own)))
        counts = np.array([len(x) for x in blocks], np.int64)
        return pa.array(list(numbers), kind), np.concatenate([np.zeros(0, np.uint32), *blocks]), counts

    return split


def _coded(batches: Iterator[pa.RecordBatch], split: Splitter) -> Iterator[tuple]:
    """A batch's name, its rows (id, text), its distinct words, the most frequent first, the places of all its words in those, how many each text has, and the order of the words."""
    coded, part = split(), TaskContext.get().partitionId()
    rows = ((i, t or "") for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    for number, held in enumerate(chunks(rows, lambda r: len(r[1]) + 64, BATCH_BYTES)):
        listed, at, counts = coded([t for _, t in held])
        often = np.argsort(-np.bincount(at, minlength=len(listed)), kind="stable")
        rank = np.empty(len(listed), np.uint32)
        rank[often] = np.arange(len(listed), dtype=np.uint32)
        yield part << 24 | number, held, listed.take(pa.array(often)), rank[at], counts


def _read(docs: DataFrame, stable: bool, id_col: str, text_col: str) -> DataFrame:
    read = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return read if stable else settle(read)


def apart(docs: DataFrame, split: Splitter, *, stable: bool = False, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """batched() for those who need its words in other tasks than its places, in two tables: (batch, docs, counts, places, n_words) and (batch, place, word)."""

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, held, listed, at, counts in _coded(batches, split):
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([[i for i, _ in held]], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())), pa.array([pack(at)], pa.binary()), pa.array([len(listed)], pa.int32())],
                names=["batch", "docs", "counts", "places", "n_words"],
            )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, listed, _, _ in _coded(batches, split):
            for at in range(0, len(listed), 1 << 16):
                some = listed.slice(at, 1 << 16)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), name, np.int64)), pa.array(np.arange(at, at + len(some), dtype=np.int32)), some.cast(pa.string())], names=["batch", "place", "word"])

    read = _read(docs, stable, id_col, text_col)
    return read.mapInArrow(order, "batch long, docs array<long>, counts array<int>, places binary, n_words int"), read.mapInArrow(each, "batch long, place int, word string")


def batched(docs: DataFrame, split: Splitter, word_type: str, mark: Callable[[object], bool] | None = None, *, stable: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Batches of docs: batch (its name), docs (ids), counts (words of each), marks (mark(id) of each), places (the words of
    all texts in order, as places in words, packed), words (distinct, of word_type, the most frequent first), seen (how often
    each stands in unmarked texts; 0 without `mark`). A batch is named by its place in the table.

    Callers may evaluate this twice and let the batches meet by name, so the rows' order must be the same each time. `stable` says
    that it is, as that of files is; otherwise ids and texts are checkpointed first. Null text counts as empty, and a null id stays null.
    """
    arrow_word = {"string": pa.string(), "binary": pa.binary()}[word_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, held, listed, at, counts in _coded(batches, split):
            marks, seen = [False] * len(held), np.zeros(len(listed), np.int32)
            if mark:
                marks = [bool(mark(i)) for i, _ in held]
                seen = np.bincount(at[~np.repeat(np.array(marks, bool), counts)], minlength=len(listed)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name]), pa.array([[i for i, _ in held]], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())), pa.array([marks], pa.list_(pa.bool_())),
                    pa.array([pack(at)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed.cast(arrow_word)), pa.array([seen], pa.list_(pa.int32())),
                ],
                names=["batch", "docs", "counts", "marks", "places", "words", "seen"],
            )

    return _read(docs, stable, id_col, text_col).mapInArrow(run, SCHEMA.format(word=word_type))


def _numbers() -> Memo:
    """Numbers keys as they come."""
    out = Memo(lambda _: len(out), 1 << 62)
    return out


def pack(places: np.ndarray) -> bytes:
    """Unsigned 32-bit places, byte by byte of all: the upper bytes of frequent words are zeros, and zstd makes them few."""
    return zstandard.ZstdCompressor(level=3).compress(places.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(places: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(places), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def words(batches: DataFrame) -> DataFrame:
    """batch, place, word, seen: each distinct word of each batch."""
    return batches.select("batch", F.posexplode(F.arrays_zip("words", "seen")).alias("place", "w")).select("batch", "place", F.col("w.words").alias("word"), F.col("w.seen").alias("seen"))


def regroup(batches: DataFrame, known: DataFrame, value: str) -> DataFrame:
    """batches with `value`: what `known` (batch, place, value) has for its words, in order of place, and n_words.

    A batch's words come back to one row, as many as it has.
    """
    ordered = known.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("place", value))).alias("w")).select("batch", F.col(f"w.{value}").alias(value))
    return batches.select("batch", "docs", "counts", "marks", "places", F.size("words").alias("n_words")).join(ordered, "batch", "left")


def checked(n_words: int, found: int) -> None:
    """Stops the job if the words that came back are not those that went out: docs were said to be stable and weren't."""
    if n_words != found:
        raise RuntimeError(f"a batch has {n_words} words and {found} came back: the table's rows changed between two readings")
