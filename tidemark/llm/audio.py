"""Chroma fingerprints of audio columns, and the alignment of recordings by them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, col, settle


@dataclass(frozen=True)
class Audio:
    """Unsigned 8-bit mono samples, `frame` of them in a spectrum, a new one every `hop`; a code looks at `width` frames."""

    rate: int = 8000
    frame: int = 256
    hop: int = 64
    width: int = 16
    smooth: tuple[float, ...] = (0.25, 0.75, 1.0, 0.75, 0.25)
    lowest: float = 60.0
    highest: float = 3600.0


#: Steps of a chroma value; sums of them are exact, so equal sounds have equal codes whatever stands beside them.
GRID = 4096
PITCHES = 12
#: The code where less than half of the frames have energy; without any, every filter's ratio is 1. Such codes make no keys and no run, as all recordings with a pause would share them.
SILENT = 0xFFFFFFFF


def pitch_classes(a: Audio) -> np.ndarray:
    """Which of the twelve pitch classes each bin of a spectrum is in (bins x 12), counted from A."""
    hertz = np.fft.rfftfreq(a.frame, 1 / a.rate)
    out = np.zeros((len(hertz), PITCHES))
    heard = np.nonzero((hertz >= a.lowest) & (hertz <= a.highest))[0]
    out[heard, np.round(PITCHES * np.log2(hertz[heard] / 440.0)).astype(int) % PITCHES] = 1
    return out


def filters(width: int) -> list[tuple[int, int, int, int]]:
    """Sixteen rectangles (kind, first pitch class, pitch classes, frames) from one rule: five ways to set one part of a
    rectangle against the rest, over growing spans of pitch and time."""
    out = []
    for n in range(16):
        high = (4, 6, 8, 12)[n % 4]
        out.append((n % 5, (n * 5) % (PITCHES - high + 1), high, max(4, width >> (n // 6))))
    return out


def _halves(kind: int, low: int, high: int, span: int) -> tuple[tuple[int, int, int, int], ...]:
    """Parts of a rectangle (pitch from, to, frame from, to) that are set against the rest."""
    up, mid = low + high, low + high // 2
    third, part = max(1, high // 3), span // 3
    if kind == 0:
        return ((mid, up, 0, span),)
    if kind == 1:
        return ((low, up, span // 2, span),)
    if kind == 2:
        return ((low, mid, 0, span // 2), (mid, up, span // 2, span))
    if kind == 3:
        return ((low, up, part, span - part),)
    return ((low + third, up - third, 0, span),)


def codes(held: list[bytes], a: Audio) -> list[np.ndarray]:
    """The 32-bit codes of each recording: one for each `width` smoothed frames that it has, none if it is shorter.

    Spectra become energies of pitch classes, smoothed over five frames and scaled to length 1. Running sums over time and
    pitch (an integral image) give any rectangle's sum from four values. Each filter compares two areas by the log of their
    ratio; three thresholds make it two bits, in Gray order, so that a small change costs one bit. Where most frames are silent the code is SILENT.
    """
    n_frames = [max(0, (len(x) - a.frame) // a.hop + 1) for x in held]
    drop = len(a.smooth) - 1
    n_codes = [max(0, n - drop - a.width + 1) for n in n_frames]
    if not any(n_codes):
        return [np.zeros(0, np.uint32) for _ in held]
    samples = np.frombuffer(b"".join(held), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(x) for x in held])[:-1]])
    starts = np.concatenate([b + a.hop * np.arange(n) for b, n in zip(begin, n_frames, strict=True)]).astype(np.int64)
    window, classes = np.hanning(a.frame), pitch_classes(a)
    chroma = np.empty((len(starts), PITCHES))
    for at in range(0, len(starts), 4096):
        frames = samples[starts[at : at + 4096, None] + np.arange(a.frame)] - 128.0
        spectrum = np.fft.rfft(frames * window, axis=1)
        chroma[at : at + 4096] = (spectrum.real**2 + spectrum.imag**2) @ classes
    smooth = sum(w * chroma[i : len(chroma) - drop + i] for i, w in enumerate(a.smooth))
    size = np.sqrt((smooth**2).sum(axis=1, keepdims=True))
    image = np.round(np.where(size > 1e-6, smooth / np.maximum(size, 1e-6), 0) * GRID).astype(np.int64)
    integral = np.zeros((len(image) + 1, PITCHES + 1), np.int64)
    integral[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    first = np.concatenate([[0], np.cumsum(n_frames)[:-1]])
    at = np.concatenate([f + np.arange(n) for f, n in zip(first, n_codes, strict=True)]).astype(np.int64)

    def area(low: int, high: int, start: int, stop: int) -> np.ndarray:
        return integral[at + stop, high] - integral[at + start, high] - integral[at + stop, low] + integral[at + start, low]

    out = np.zeros(len(at), np.uint32)
    for kind, low, high, span in filters(a.width):
        begins = (a.width - span) // 2
        part = sum(area(p, q, begins + s, begins + t) for p, q, s, t in _halves(kind, low, high, span))
        rest = area(low, low + high, begins, begins + span) - part
        ratio = np.log((part + GRID) / (rest + GRID))
        level = np.digitize(ratio, (-0.35, 0.0, 0.35))
        out = out << np.uint32(2) | (level ^ level >> 1).astype(np.uint32)
    heard = np.concatenate([[0], np.cumsum(image.any(axis=1))])
    out[2 * (heard[at + a.width] - heard[at]) < a.width] = SILENT
    return np.split(out, np.cumsum(n_codes)[:-1])


def fingerprints(media: DataFrame, audio: Audio | None = None, *, id_col: str = "doc_id", pcm_col: str = "pcm") -> DataFrame:
    """id, n_samples and codes (little-endian unsigned 32-bit) of each row's samples (binary); null samples count as none."""
    a = audio or Audio()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = iter(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            for some in chunks(rows, lambda r: len(r[1] or b""), 1 << 20):
                held = [x or b"" for _, x in some]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int64()), pa.array([len(x) for x in held], pa.int64()), pa.array([c.astype("<u4").tobytes() for c in codes(held, a)], pa.binary())], names=["id", "n_samples", "codes"])

    return media.select(col(id_col).cast("long").alias("id"), col(pcm_col).cast("binary").alias("pcm")).mapInArrow(run, "id long, n_samples long, codes binary")


#: Codes between the two of a key. Neighbours look at nearly the same frames and say little more than one; these share half of theirs.
APART = 7


def keys(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a recording's codes (each two that are APART and not silent) and their places. Of a key that stands at places in a row, as in a held tone, the first counts."""
    if len(c) <= APART:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    key = (c[:-APART].astype(np.uint64) << np.uint64(32) | c[APART:]).view(np.int64)
    new = (c[:-APART] != SILENT) & (c[APART:] != SILENT)
    new[1:] &= key[1:] != key[:-1]
    return key[new], np.flatnonzero(new).astype(np.int32)


def _postings(classes: DataFrame) -> DataFrame:
    """key, cls, asks, at: the keys of each class with all their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                found = [keys(np.frombuffer(data, "<u4")) for data in part.column(2).to_pylist()]
                n = [len(k) for k, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([k for k, _ in found])), pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), n)), pa.array(np.repeat(part.column(1).to_numpy(zero_copy_only=False), n)), pa.array(np.concatenate([p for _, p in found]))],
                    names=["key", "cls", "asks", "at"],
                )

    return classes.select("cls", "asks", "codes").mapInArrow(run, "key long, cls long, asks boolean, at int")


def matching_run(a: np.ndarray, b: np.ndarray, offset: int, most_errors: float) -> tuple[int, float]:
    """How long a's codes, moved by `offset`, and b's agree, and the share of bits that differ there.

    Each code of the overlap gains what its bit errors leave of `most_errors`; the run with the largest sum is the one that
    agrees, so what stands before, behind or between two shared passages doesn't count against them. Places where both are silent count neither way.
    """
    start, stop = max(0, -offset), min(len(b), len(a) - offset)
    if stop <= start:
        return 0, 1.0
    one, two = a[start + offset : stop + offset], b[start:stop]
    errors, heard = np.bitwise_count(one ^ two).astype(np.float64), (one != SILENT) | (two != SILENT)
    gained = np.concatenate([[0.0], np.cumsum(np.where(heard, 32 * most_errors - errors, 0.0))])
    lowest = np.minimum.accumulate(gained)
    end = int(np.argmax(gained - lowest))
    begin = int(np.flatnonzero(gained[: end + 1] == lowest[end])[0])
    if end <= begin:
        return 0, 1.0
    heard = heard[begin:end]
    return int(heard.sum()), float(errors[begin:end][heard].mean()) / 32


def align(media: DataFrame, audio: Audio | None = None, *, every: int = 100, least: int = 2, overlap: int = 8, most_errors: float = 0.2, id_col: str = "doc_id", pcm_col: str = "pcm") -> DataFrame:
    """One row per input row: doc_id, n_samples, n_codes, class_id, n_links, query_id, offset, overlap, bit_errors.

    Recordings with equal codes are one class; class_id is its smallest id, so copies never meet in pairs. Queries are the
    classes that hold an id divisible by `every`; they are searched against all classes. Each two codes, APART from each
    other and not silent, that both have vote for the offset between their places; every offset with `least` votes or more is checked code by
    code: the run that agrees (see matching_run) has `overlap` codes or more, and no more than `most_errors` of its bits differ. Of
    a pair's offsets the one whose run gains most counts (its length times what its bit errors leave of `most_errors`), then the smallest.
    n_links counts a row's class's other classes so aligned, query_id is the query class whose run gains most, then the smallest id.

    Null or short samples have no codes: class_id is null, n_links 0. A null id is never a query and names a class only if
    all of its ids are null. Repeated rows each get their row; an empty table gives none; other columns are not read.
    """
    fp = settle(fingerprints(media, audio, id_col=id_col, pcm_col=pcm_col))
    name = ["h1", "h2", "n_codes"]
    named = fp.select("id", "n_samples", "codes", F.xxhash64("codes").alias("h1"), F.xxhash64(F.lit(5), F.hex(F.md5("codes").cast("binary"))).alias("h2"), (F.octet_length("codes") / 4).cast("long").alias("n_codes"))
    grouped = named.filter("n_codes > 0").groupBy(*name).agg(F.min("id").alias("class_id"), F.bool_or(F.coalesce(F.pmod("id", F.lit(every)) == 0, F.lit(False))).alias("asks"), F.min("codes").alias("codes"))
    classes = settle(grouped.withColumn("cls", F.monotonically_increasing_id()))
    postings = _postings(classes)
    asked = postings.filter("asks").select("key", F.col("cls").alias("q"), F.col("at").alias("q_at"))
    voted = (
        postings.join(asked, "key")
        .filter("cls <> q")
        .groupBy("q", "cls", (F.col("q_at") - F.col("at")).alias("offset"))
        .agg(F.count(F.lit(1)).alias("votes"))
        .filter(F.col("votes") >= least)
        .select("q", "cls", "offset")
    )
    own = classes.select("cls", "codes")
    pairs = voted.join(own, "cls").join(own.select(F.col("cls").alias("q"), F.col("codes").alias("q_codes")), "q")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [matching_run(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), o, most_errors) for x, y, o in zip(*(b.column(i).to_pylist() for i in (3, 4, 2)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([n for n, _ in found], pa.int64()), pa.array([e for _, e in found], pa.float64())], names=["q", "cls", "offset", "overlap", "bit_errors"])

    checked = pairs.select("q", "cls", "offset", "q_codes", "codes").mapInArrow(verify, "q long, cls long, offset int, overlap long, bit_errors double")
    good = checked.filter((F.col("overlap") >= overlap) & (F.col("bit_errors") <= most_errors))
    gain = (F.lit(most_errors) - F.col("bit_errors")) * F.col("overlap")
    most = F.max(F.struct(gain.alias("gain"), (-F.col("offset")).alias("o"), "overlap", "bit_errors"))
    links = good.groupBy("q", "cls").agg(most.alias("l")).select("q", "cls", "l.gain", "l.overlap", "l.bit_errors", (-F.col("l.o")).alias("offset"))
    ids = classes.select(F.col("cls").alias("q"), F.col("class_id").alias("query_id"))
    best = links.join(ids, "q").groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"), F.min(F.struct((-F.col("gain")).alias("least"), "query_id", "offset", "overlap", "bit_errors")).alias("best"))
    of = classes.drop("codes", "asks").join(best, "cls", "left").drop("cls")
    return named.drop("codes").join(of, name, "left").select(
        F.col("id").alias("doc_id"), "n_samples", "n_codes", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "best.query_id", F.col("best.offset").cast("long").alias("offset"), "best.overlap", "best.bit_errors"
    )
