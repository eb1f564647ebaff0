"""SimHash fingerprints, near copies found through a Golay code, and the groups that they form."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, settle
from tidemark.operators.components import components

#: The generator polynomial of the binary Golay code of 23 bits, 12 of them free, and any two words 7 bits apart.
GOLAY = 0b101011100011
#: Where the three segments of a 64-bit fingerprint start and how many bits they have.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: A bucket of more fingerprints than this is joined through shared neighbours, not pair by pair.
PAIRS_TO = 24


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """The XXH64 values (seed 42) of the text's word shingles, repeats included.

    A-Z become lower case. A text of fewer words is one shingle; one without words has none.
    """
    import xxhash

    words = text.encode().lower().split()  # of bytes: only ASCII letters and blanks count
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        runs = [b" ".join(words)]
    else:
        runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(r, 42) for r in runs), dtype="<u8", count=max(1, len(words) - shingle + 1))


def majority(hashes: np.ndarray) -> int:
    """64 bits: each is set if it is set in over half of the values; 0 of none."""
    ones = np.zeros(64, np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = 3) -> int:
    """The SimHash of a text: the majority of its shingles' hashes, bit by bit."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (long, the 64 bits) of each row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) if t else 0 for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _syndromes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders by the generator of a word's low 12 and high 11 bits, and the one error of up to 3 bits of each remainder."""

    def remainder(v: int) -> int:
        for shift in range(11, -1, -1):
            if v >> (shift + 11) & 1:
                v ^= GOLAY << shift
        return v

    low, high = (np.array([remainder(v << shift) for v in range(1 << bits)], np.int64) for bits, shift in ((12, 0), (11, 12)))
    error = np.zeros(2048, np.int64)
    for n in range(1, 4):
        for places in combinations(range(23), n):
            e = sum(1 << p for p in places)
            error[remainder(e)] = e
    return low, high, error


_LOW, _HIGH, _ERROR = _syndromes()


def codeword(words: np.ndarray) -> np.ndarray:
    """The index (12 bits) of the codeword nearest to each 23-bit word; the code is perfect, so there is one within 3 bits."""
    return (words ^ _ERROR[_LOW[words & 0xFFF] ^ _HIGH[words >> 12]]) >> 11


def nearby(words: np.ndarray, bits: int) -> np.ndarray:
    """For each word, the codewords of the word and of its neighbours at one bit.

    Words that differ in up to two bits share one: two flips have a word midway, which is a neighbour of both.
    """
    return codeword(words[:, None] ^ np.array([0, *(1 << i for i in range(bits))], np.int64))


def keys_of(fps: np.ndarray, distance: int) -> list[np.ndarray]:
    """Keys of each fingerprint, at least one of which any two fingerprints within `distance` bits share.

    Up to 2 bits: of three segments one is free of errors, and the next then has at most 2: the first segment as it is,
    with each nearby codeword of the next. Up to 5: two segments have at most 2 errors each, and so share a codeword each.
    """
    segments = [(fps >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    near = [nearby(x, n) for x, (_, n) in zip(segments, SEGMENTS, strict=True)]
    if distance <= 2:
        made = [(a << 60) | (segments[a][:, None] << 12) | near[(a + 1) % 3] for a in range(3)]
    elif distance <= 5:
        made = [(a << 60) | (near[a][:, :, None] << 12 | near[b][:, None, :]).reshape(len(fps), -1) for a, b in ((0, 1), (1, 2), (0, 2))]
    else:
        raise ValueError("codeword keys hold for up to 5 differing bits")
    every = np.sort(np.concatenate(made, axis=1), axis=1)
    new = np.concatenate([np.ones((len(fps), 1), bool), every[:, 1:] != every[:, :-1]], axis=1)
    return [row[n] for row, n in zip(every, new, strict=True)]


def _keyed(distinct: DataFrame, distance: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 2048):
                part = fps[at : at + 2048]
                keys = keys_of(part.view(np.uint64), distance)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, [len(k) for k in keys])), pa.array(np.concatenate(keys))], names=["fp", "key"])

    return distinct.mapInArrow(run, "fp long, key long")


def links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b) between fingerprints (column fp, each once) within `distance` bits.

    Small buckets of a key are compared pair by pair. A fingerprint of a large bucket is instead tied to the smallest
    fingerprint that has a word within `distance` / 2 bits in common with it, which is exact for 2 bits: two fingerprints
    share a word one bit off each if and only if they differ in up to two bits. No link between groups is lost: what pairs
    would join, these ties join through the smallest one. For over 2 bits all buckets are compared pair by pair.
    """
    keyed = _keyed(distinct, distance)
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = settle(keyed.join(sizes, "key"))
    small = shared if distance > 2 else shared.filter(F.col("n") <= PAIRS_TO)
    pairs = (
        small.select("key", F.col("fp").alias("a"))
        .join(small.select("key", F.col("fp").alias("b")), "key")
        .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
        .select("a", "b")
    )
    if distance > 2:
        return pairs.distinct()
    crowded = shared.filter(F.col("n") > PAIRS_TO).select("fp").distinct()

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.array([0, *(1 << i for i in range(64))], np.uint64)
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, 65)), pa.array((part.view(np.uint64)[:, None] ^ flips).ravel().view(np.int64))], names=["fp", "word"])

    spread = crowded.mapInArrow(around, "fp long, word long")
    least = spread.groupBy("word").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("word", "a")
    ties = spread.join(least, "word").filter("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(ties).distinct()


def near_groups(docs: DataFrame, *, shingle: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links).

    Two rows are linked if their fingerprints differ in up to `distance` bits. Rows of one fingerprint are one node, so
    copies never meet in pairs, and only fingerprints that occur are compared. Null text counts as empty: fingerprint zero,
    linked like any other. A null id is returned as null and never is a component's id unless all of its ids are null.
    Repeated rows each get their row; an empty table gives none; other columns are not read.
    """
    fp = settle(fingerprints(docs, shingle, id_col, text_col))
    first = settle(fp.groupBy("fp").agg(F.min("doc_id").alias("least")))
    of = components(links(first.select("fp"), distance))
    joined = first.join(of.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("comp", "fp").alias("comp"), "least")
    ids = joined.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_fp = joined.join(ids, "comp").select("fp", "component_id")
    return fp.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
