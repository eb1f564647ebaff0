"""Near copies by word shingles: candidates by codeword keys of SimHash fingerprints and by prefixes of shingle sets, verified whole."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, fresh, row_key, settle
from tidemark.llm.simhash import links, majority, shingle_hashes
from tidemark.operators.components import components

#: Cells that shingles are counted in, to put frequent ones last. The count changes the cost, never the result.
CELLS = 1 << 16
#: Documents of a bucket that one task compares among themselves; a larger bucket is dealt in blocks.
BLOCK = 4096
#: Buckets up to this size are compared pair by pair, many buckets at a time; in larger ones a spanning tree is grown.
SMALL = 8
#: Bits of the table of documents whose texts are compared.
BITS = 1 << 24
_KEY = ("no_id", "id", "h1", "h2")


def shingle_set(text: str, shingle: int = 5) -> np.ndarray:
    """The distinct word shingles of a text, as sorted 64-bit hashes; a text of fewer words is one shingle, one without words has none."""
    return np.unique(shingle_hashes(text, shingle))


def prefix(grams: np.ndarray, often: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """The first shingles of a set in the common order (rare cells first, then by hash), and how many of them are its leading ones.

    Take two sets of n <= m shingles that are as similar as that. They share similarity * m at least, and
    2 * similarity / (1 + similarity) * n. So the first shingle that they share is among the first m - ceil(similarity * m) + 1 of
    the larger, and among the first n - ceil(2 * similarity / (1 + similarity) * n) + 1 of the smaller: its leading ones. A set of
    none has the key 0.
    """
    n = len(grams)
    if not n:
        return np.zeros(1, np.uint64), 1
    order = np.lexsort((grams, often[(grams & np.uint64(len(often) - 1)).astype(np.int64)]))
    leading = n - math.ceil(2 * similarity / (1 + similarity) * n - 1e-9) + 1
    return grams[order[: n - math.ceil(similarity * n - 1e-9) + 1]], leading


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parities of the set over cells, as 64-bit words: two to four cells a shingle, a power of two and 512 at least.

    A shingle that only one of two sets has changes one cell, so sets differ in as many shingles, at least, as their sketches
    in bits. Folding a sketch in two gives that over half as many cells.
    """
    bits = max(512, 2 << max(0, (len(grams) - 1).bit_length()))
    odd = np.bincount((grams >> np.uint64(40)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<u8")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Shared shingles over all shingles; two texts without words are alike."""
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


class Rows:
    """Documents side by side in a task: what they are in their buckets, and how far apart their sketches say they are at least."""

    def __init__(self, uid: np.ndarray, size: np.ndarray, leads: np.ndarray, sketches: list[bytes], similarity: float):
        self.uid, self.size, self.leads, self.similarity = uid, size.astype(np.float64), leads, similarity
        width = np.array([len(x) // 8 for x in sketches], np.int64)
        self.width, self.at, self.of = width, {}, {}
        for w in np.unique(width).tolist():  # each sketch in its own width, and folded once
            own = np.flatnonzero(width == w)
            whole = np.frombuffer(b"".join(sketches[i] for i in own.tolist()), "<u8").reshape(len(own), w)
            self._put(w, own, whole)
            if w > 8:
                self._put(w // 2, own, whole[:, : w // 2] ^ whole[:, w // 2 :])

    def _put(self, w: int, own: np.ndarray, rows: np.ndarray) -> None:
        at = self.at.setdefault(w, np.full(len(self.uid), -1))
        before = self.of.get(w, np.zeros((0, w), np.uint64))
        at[own] = len(before) + np.arange(len(own))
        self.of[w] = np.concatenate([before, rows])

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of rows, at least how many shingles only one of the two has, over how many they have in all; infinite
        if they can't be as similar as asked, or if this bucket isn't one where they have to meet (see prefix)."""
        out = np.full(len(a), np.inf)
        s, t = self.size[a], self.size[b]
        meet = (np.minimum(s, t) >= self.similarity * np.maximum(s, t) - 1e-6) & ((s <= t) & self.leads[a] | (t <= s) & self.leads[b])
        narrow = np.minimum(self.width[a], self.width[b])
        for w in np.unique(narrow[meet]).tolist():
            x = np.flatnonzero(meet & (narrow == w) & (np.maximum(self.width[a], self.width[b]) <= 2 * w))
            for some in np.array_split(x, len(x) * w // (1 << 21) + 1):
                differ = np.bitwise_count(self.of[w][self.at[w][a[some]]] ^ self.of[w][self.at[w][b[some]]]).sum(axis=1)
                out[some] = differ / np.maximum(1, s[some] + t[some])
        out[out > (1 - self.similarity) / (1 + self.similarity) + 1e-9] = np.inf
        return out

    def tree(self, rows: np.ndarray) -> tuple[list[int], list[int]]:
        """Pairs of the rows that may be alike and span what such pairs join, the likest first at each step."""
        one, two = [], []
        here, left = rows[0], rows[1:]
        best, via = self.apart(np.full(len(left), here), left), np.full(len(left), here)
        while len(left):
            k = int(np.argmin(best))
            here = left[k]
            if best[k] < np.inf:
                one.append(int(via[k]))
                two.append(int(here))
            left, best, via = np.delete(left, k), np.delete(best, k), np.delete(via, k)
            now = self.apart(np.full(len(left), here), left)
            nearer = now < best
            best[nearer], via[nearer] = now[nearer], here
        return one, two


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[list[np.ndarray], pa.Table, np.ndarray]]:
    """Whole groups of rows that are sorted by their first columns: (those columns, the rows, where groups start)."""
    held: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
        keys = [table.column(i).to_numpy() for i in range(n_keys)]
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        return keys, np.flatnonzero(new)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) < 8192:
            continue
        table = pa.Table.from_batches(held)
        _, at = starts(table)
        if len(at) > 1:
            whole = table.slice(0, at[-1])
            keys, at2 = starts(whole)
            yield keys, whole, at2
            held = table.slice(at[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        keys, at = starts(table)
        yield keys, table, at


def _pairs(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Pairs of ids, the smaller first, by the bucket that they were found in."""
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["key", "a", "b"])


def _rows(table: pa.Table, similarity: float, first: int) -> Rows:
    uid, size, leads = (table.column(first + i).to_numpy() for i in range(3))
    return Rows(uid, size, leads.astype(bool), table.column(first + 3).to_pylist(), similarity)


def _spanning(members: DataFrame, nodes: DataFrame, similarity: float, block: int) -> DataFrame:
    """(key, a, b): pairs that may be alike, inside each bucket, or block of one, as many as join all that may be.

    members: key, uid, leads, n (the bucket's size). A block goes through one task, with a quarter to half a byte a shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, table, at in _groups(batches, 2):
            rows, sizes = _rows(table, similarity, 2), np.diff(np.append(at, table.num_rows))
            one, two = [], []
            for lag in range(1, SMALL):
                few = (sizes <= SMALL) & (sizes > lag)
                a = np.repeat(at[few], sizes[few] - lag) + _counted(sizes[few] - lag)
                if len(a):
                    near = rows.apart(a, a + lag) < np.inf
                    one.append(a[near])
                    two.append(a[near] + lag)
            for start, size in zip(at[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
                x, y = rows.tree(np.arange(start, start + size))
                one.append(np.array(x, np.int64))
                two.append(np.array(y, np.int64))
            a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (one, two))
            yield _pairs(keys[0][a], rows.uid[a], rows.uid[b])

    dealt = members.withColumn("block", F.pmod(F.xxhash64("uid"), F.ceil(F.col("n") / block)).cast("long"))
    joined = dealt.join(nodes.select("uid", "size", "sketch"), "uid").select("key", "block", "uid", "size", "leads", "sketch")
    return joined.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(run, "key long, a long, b long")


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size, one after another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _across(members: DataFrame, nodes: DataFrame, similarity: float, block: int) -> DataFrame:
    """(key, a, b): all pairs that may be alike between components inside a bucket. members: key, uid, leads, n, comp.

    Documents outside the component of the bucket's first are compared with all of the bucket, in blocks of both.
    """
    of = members.groupBy("key").agg(F.min(F.struct("uid", "comp"))["comp"].alias("main"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    mixed = members.join(of.filter("low <> high"), "key").withColumn("outer", F.col("comp") != F.col("main")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    number = F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")
    all_blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    carried = ["key", "uid", "leads", "comp"]
    inner = mixed.select(*carried, F.col("outer").alias("is_outer"), F.lit(False).alias("asks"), number.alias("i"), F.explode(all_blocks).alias("o"))
    outer = mixed.filter("outer").select(*carried, F.lit(True).alias("is_outer"), F.lit(True).alias("asks"), F.explode(all_blocks).alias("i"), number.alias("o"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, table, at in _groups(batches, 3):
            rows = _rows(table, similarity, 3)
            comp, is_outer, asks = (table.column(7 + i).to_numpy() for i in range(3))
            one, two = [], []
            for start, stop in zip(at.tolist(), [*at[1:].tolist(), table.num_rows], strict=True):
                here = np.arange(start, stop)
                told = here[~asks[start:stop].astype(bool)]
                for a in here[asks[start:stop].astype(bool)].tolist():
                    b = told[(comp[told] != comp[a]) & (~is_outer[told].astype(bool) | (rows.uid[a] < rows.uid[told]))]
                    b = b[rows.apart(np.full(len(b), a), b) < np.inf]
                    one.append(np.full(len(b), a))
                    two.append(b)
            a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (one, two))
            yield _pairs(keys[0][a], rows.uid[a], rows.uid[b])

    joined = inner.unionByName(outer).join(nodes.select("uid", "size", "sketch"), "uid").select("key", "i", "o", "uid", "size", "leads", "sketch", "comp", "is_outer", "asks")
    return joined.repartition("key", "i", "o").sortWithinPartitions("key", "i", "o").mapInArrow(run, "key long, a long, b long")


def _cells(docs: DataFrame, shingle: int) -> np.ndarray:
    """How often shingles fall into each of CELLS cells; what goes to the driver is bounded, whatever the data's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(CELLS, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                held += np.bincount((shingle_hashes(t, shingle) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        at = np.nonzero(held)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["cell", "n"])

    counted = docs.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(CELLS, np.int64)
    for r in counted.toLocalIterator():
        out[r["cell"]] = r["n"]
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    return docs.select(row_key(text, col(id_col)).alias("k"), text.alias("text")).select(*(F.col(f"k.{c}") for c in _KEY), "text")


def _among(docs: DataFrame, meeting: DataFrame) -> DataFrame:
    """Rows of docs whose h1 may be among those of `meeting`, so that few texts are shuffled where few meet.

    A table of BITS bits goes to the driver and to all executors. The more documents meet, the more others pass; the join with
    `meeting` that follows decides.
    """
    place = F.shiftright(F.col("h1").cast("long"), 16).bitwiseAND(F.lit(BITS - 1))
    words = meeting.select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    table = np.zeros(BITS >> 6, np.int64)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        table[r["word"]] = r["bits"]
    held = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(2).to_numpy(zero_copy_only=False) >> 16 & (BITS - 1)
            yield b.filter(pa.array(held.value[at >> 6] >> (at & 63) & 1 == 1))

    return docs.mapInArrow(run, docs.schema)


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are as similar as that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= similarity for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select([0, 1]).filter(pa.array(near, pa.bool_()))

    joined = pairs.join(sets.select(F.col("uid").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("uid").alias("b"), F.col("grams").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _by_codewords(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose fingerprints are up to two bits apart, as far as they join all such: by codeword keys, see simhash.links."""
    first = settle(nodes.groupBy("fp").agg(F.min("uid").alias("least"), F.count(F.lit(1)).alias("n")))
    same = nodes.join(first.filter("n > 1"), "fp").filter("uid <> least").select(F.col("least").alias("a"), F.col("uid").alias("b"))
    ends = [first.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_uid")) for c in "ab"]
    near = links(first.select("fp"), 2).join(ends[0], "a").join(ends[1], "b").select(F.least("a_uid", "b_uid").alias("a"), F.greatest("a_uid", "b_uid").alias("b"))
    return same.unionByName(near)


def _labelled(members: DataFrame, of: DataFrame) -> DataFrame:
    return members.join(of.withColumnRenamed("node", "uid"), "uid", "left").select(*members.columns, F.coalesce("comp", "uid").alias("comp"))


def _representatives(members: DataFrame) -> DataFrame:
    """Of buckets that hold several components, one document of each component: key, uid, leads, n."""
    crowded = members.groupBy("key", "comp").agg(F.min_by(F.struct("uid", "leads"), F.struct(~F.col("leads"), F.col("uid"))).alias("r"))
    counts = crowded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return crowded.join(counts, "key").select("key", "r.uid", "r.leads", "n")


def _verified_links(nodes: DataFrame, shared: DataFrame, alike: Callable[[DataFrame], DataFrame], similarity: float, block: int) -> DataFrame:
    """Components (node, comp) of all pairs of nodes that are alike, nodes in no such pair left out.

    First candidates are those of the codeword keys, and in each bucket of a prefix shingle a tree of its likest pairs. Where
    all pairs of a tree are verified, all that may be alike in that bucket is joined. Buckets of several blocks then
    compare what their blocks have found, a document for each component. At last, in such buckets and in those where a
    pair of the tree was refuted, all pairs between different components are compared by their sketches, and those that may
    be alike are verified. So no link is lost, and a hot group costs one comparison of sets for each of its documents, as
    far as verified pairs join it.
    """
    tried = settle(_spanning(shared, nodes, similarity, block))
    candidates = settle(_by_codewords(nodes).unionByName(tried.select("a", "b")).distinct())
    found = settle(alike(candidates))
    of = components(found)
    crowded = shared.filter(F.col("n") > block)
    if not crowded.isEmpty():
        linked = settle(alike(_spanning(_representatives(_labelled(crowded, of)), nodes, similarity, block).select("a", "b").distinct()))
        found = found.unionByName(linked)
        of = components(found)
    ends = [of.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp")) for c in "ab"]
    refuted = tried.join(found, ["a", "b"], "left_anti").join(ends[0], "a", "left").join(ends[1], "b", "left")
    apart = refuted.filter(F.coalesce("a_comp", "a") != F.coalesce("b_comp", "b")).select("key")
    open_keys = settle(apart.unionByName(crowded.select("key")).distinct())
    if not open_keys.isEmpty():
        more = _across(settle(_labelled(shared.join(open_keys, "key"), of)), nodes, similarity, block).select("a", "b").distinct()
        linked = settle(alike(more.join(candidates, ["a", "b"], "left_anti")))
        if not linked.isEmpty():
            of = components(found.unionByName(linked))
    return of


def near_copies(docs: DataFrame, *, similarity: float = 0.8, shingle: int = 5, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near copies: the first by id (nulls last), of equal ids the smallest text hash.

    Two documents are near copies if their sets of `shingle`-word shingles have a Jaccard similarity of `similarity` or more.
    Equal texts are one. Of the others, candidates are pairs whose SimHash fingerprints share a Golay codeword key and are up to
    two bits apart, and pairs that share a key of their prefixes (see prefix), as any two near copies do, whatever their
    difference looks like. All candidates are verified on their whole shingle sets. Groups are the components of the verified
    links (see _verified_links).

    Null text counts as empty; texts without words are copies of each other. Of rows that repeat id and text, one stays. An
    empty table gives none. All columns stay, whatever their names.
    """
    read = _texts(docs, id_col, text_col)
    often = docs.sparkSession.sparkContext.broadcast(_cells(read, shingle))

    def print_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                hashes = [shingle_hashes(t, shingle) for t in part.column(4).to_pylist()]
                grams = [np.unique(h) for h in hashes]
                first = [prefix(g, often.value, similarity) for g in grams]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:4], pa.array([len(g) for g in grams], pa.int64()), pa.array(np.array([majority(h) for h in hashes], np.uint64).view(np.int64)), pa.array([sketch(g).tobytes() for g in grams], pa.binary()),
                        pa.array([n for _, n in first], pa.int32()), pa.array([f.view(np.int64) for f, _ in first], pa.list_(pa.int64())),
                    ],
                    names=[*_KEY, "size", "fp", "sketch", "leading", "f"],
                )

    printed = read.mapInArrow(print_all, "no_id boolean, id long, h1 long, h2 long, size long, fp long, sketch binary, leading int, f array<long>")
    carried = ["size", "fp", "sketch", "leading", "f"]
    firsts = settle(printed.groupBy("h1", "h2").agg(F.min(F.struct("no_id", "id")).alias("first"), F.first(F.struct(*carried)).alias("r")).select("first.no_id", "first.id", "h1", "h2", "r.*"))
    nodes = firsts.withColumn("uid", F.monotonically_increasing_id())
    keyed = nodes.select("uid", F.col("size").cast("int").alias("size"), "leading", F.posexplode("f").alias("at", "key")).select("key", "uid", "size", (F.col("at") < F.col("leading")).alias("leads"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bool_or("leads").alias("any"), F.min(F.struct("size", "leads")).alias("low"), F.max("size").alias("high"))
    meets = (F.col("n") > 2) | (F.col("low.size") >= similarity * F.col("high") - 1e-6) & (F.col("low.leads") | (F.col("low.size") == F.col("high")))  # two documents: see Rows.apart
    shared = settle(keyed.join(counts.filter(F.col("any") & (F.col("n") > 1) & meets).select("key", "n"), "key").select("key", "uid", "leads", "n"))

    def gram_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, shingle).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["uid", "grams"])

    def alike(pairs: DataFrame) -> DataFrame:
        pairs = settle(pairs)
        meeting = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct().join(nodes.select("uid", *_KEY), "uid")
        sets = settle(_among(read, meeting).join(meeting, list(_KEY)).select("uid", "text").mapInArrow(gram_all, "uid long, grams binary").dropDuplicates(["uid"]))
        return _alike(pairs, sets, similarity)

    of = _verified_links(nodes, shared, alike, similarity, block)
    named = of.withColumnRenamed("node", "uid").join(nodes.select("uid", F.struct(*_KEY).alias("k")), "uid")
    least = named.groupBy("comp").agg(F.min("k").alias("least"))
    dropped = named.join(least, "comp").filter(F.col("k") != F.col("least")).select("uid")
    stay = nodes.join(dropped, "uid", "left_anti").select(F.struct(*_KEY).alias("k"))
    (key,) = fresh(docs, "tm_key")
    out = docs.withColumn(key, row_key(F.coalesce(col(text_col).cast("string"), F.lit("")), col(id_col))).join(stay.withColumnRenamed("k", key), key, "left_semi")
    repeats = read.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not repeats.isEmpty():
        out = out.dropDuplicates([key])
    return out.drop(key)
