"""Approximate nearest neighbours by a forest of random-projection trees, whose cells all trees' queries visit in one order of priority.

The forest grows with the table, by rounds: a cell that holds more than LEAF rows is split by a small tree, fitted on a bounded sample
of that cell alone, so no tree, level or sample is ever in one place, and leaves stay small at every size of the table. Rows and
queries meet the small trees, and at the end each other, in blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, settle

#: Rows that a leaf holds at most; a cell with more is split.
LEAF = 256
#: Levels by which a cell is split in a round at most, and the rows that its small tree is fitted on, as drawn by a hash (expected number).
LEVELS, SAMPLE = 8, 4096
#: Queries whose best a task holds before it hands them on.
HELD = 10_000
#: Rows of a block.
BLOCK = 512
#: Queries whose neighbours are looked up in all rows, to see how many cells a search must visit. Drawn by a hash; no more are collected.
TRIED = 128
#: Cells that those visit at first; four times as many if that isn't enough.
FIRST = 1024

BLOCKS = "dim int, cell long, ids array<long>, names array<long>, marks array<double>, vectors binary"


def blocks(rows: DataFrame, most: int = BLOCK) -> DataFrame:
    """rows (dim, cell, id, name, mark, vector) as blocks of one cell each, `most` rows or fewer. A cell with many rows lies in several tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out = None, [], []

        def close() -> None:
            if held:
                ids, names, marks, vectors = zip(*held, strict=True)
                out.append((*at, ids, names, marks, b"".join(vectors)))
                held.clear()

        def batch() -> pa.RecordBatch:
            cols = [list(c) for c in zip(*out, strict=True)]
            out.clear()
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["dim", "cell", "ids", "names", "marks", "vectors"])

        for b in batches:
            for dim, cell, *row in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if (dim, cell) != at or len(held) >= most:
                    close()
                    at = (dim, cell)
                held.append(row)
            if len(out) >= 64:
                yield batch()
        close()
        if out:
            yield batch()

    dealt = rows.select("dim", "cell", "id", "name", "mark", "vector", F.xxhash64("id").alias("o")).repartitionByRange("dim", "cell", "o").sortWithinPartitions("dim", "cell", "o").drop("o")
    return dealt.mapInArrow(run, BLOCKS)


def matrix(vectors: bytes, dim: int, n: int) -> np.ndarray:
    """n vectors of 32-bit or 64-bit numbers."""
    return np.frombuffer(vectors, "<f4" if len(vectors) == 4 * n * dim else "<f8").reshape(n, dim).astype(np.float64)


def cut(vectors: bytes, n: int) -> list[bytes]:
    size = len(vectors) // n
    return [vectors[i * size : (i + 1) * size] for i in range(n)]


def _tree(row: dict) -> np.ndarray:
    return np.frombuffer(row["tree"], "<f8").reshape(-1, row["dim"] + 1)


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; what is too large or small to square is scaled first."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The cosine of each row of x with q, summed in the same order for each row, so that equal rows score the same."""

    def plain(a: np.ndarray) -> np.ndarray | None:
        with np.errstate(all="ignore"):
            n = np.sqrt((a * a).sum(axis=1))
        return n if ((n > 1e-100) & (n < 1e100)).all() else None

    n, m = plain(x), plain(q[None])
    return (x * q).sum(axis=1) / (n * m[0]) if n is not None and m is not None else (units(x) * units(q[None])).sum(axis=1)


# A small tree: an array of nodes in heap order, each a direction and the place where it cuts. A direction of zeros splits at random.


def fit(x: np.ndarray, levels: int, seed: int) -> np.ndarray:
    """A tree of `levels` levels over unit rows x. A node cuts between two means of a few rows, next to the median; where most rows are copies, by chance."""
    rng = np.random.default_rng(seed)
    out = np.zeros(((1 << levels) - 1, x.shape[1] + 1))
    parts = {0: np.arange(len(x))}
    for node in range(len(out)):
        rows = parts.pop(node)
        side = None
        if len(rows) > 1:
            some = x[rng.choice(rows, min(len(rows), 256), replace=False)]
            a, b = some[0], some[1]
            for _ in range(3):
                near = some @ a > some @ b
                if near.all() or not near.any():
                    break
                a, b = some[near].mean(axis=0), some[~near].mean(axis=0)
            w = a - b
            size = np.sqrt(w @ w)
            if size > 1e-9:
                p = x[rows] @ (w / size)
                middle = np.median(p)
                side = p > middle
                if 0.1 <= side.mean() <= 0.9:
                    out[node, :-1], out[node, -1] = w / size, (p[~side].max() + p[side].min()) / 2  # between two rows, so that rounding doesn't decide about the median
                else:
                    side = None
        if side is None:
            side = rng.random(len(rows)) < 0.5
        for child, chosen in ((2 * node + 1, rows[side]), (2 * node + 2, rows[~side])):
            parts[child] = chosen
    return out


def leaves(tree: np.ndarray, x: np.ndarray, ids: np.ndarray, cell: int) -> np.ndarray:
    """The leaf of each unit row of x, from 0. Where a node splits at random, a hash of the row's id and the cell decides."""
    at = np.zeros(len(x), np.int64)
    mixed = (ids.astype(np.uint64) ^ np.uint64(cell * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    for level in range((len(tree) + 1).bit_length() - 1):
        w = tree[at]
        dull = ~w[:, :-1].any(axis=1)
        side = (w[:, :-1] * x).sum(axis=1) > w[:, -1]
        chance = (mixed >> np.uint64(17 + level)) & np.uint64(1) == 1
        at = 2 * at + np.where(np.where(dull, chance, side), 1, 2)
    return at - len(tree)


def margins(tree: np.ndarray, x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each unit row of x and each leaf: how far inside the row is of the least of the cuts on the way there, or of `start`."""
    d = x @ tree[:, :-1].T - tree[:, -1] * tree[:, :-1].any(axis=1)
    found = np.empty((len(x), 2 * len(tree) + 1))
    found[:, 0] = start
    for node in range(len(tree)):
        found[:, 2 * node + 1] = np.minimum(found[:, node], d[:, node])
        found[:, 2 * node + 2] = np.minimum(found[:, node], -d[:, node])
    return found[:, len(tree) :]


def _roots(trees: int) -> Column:
    """The first cell of each tree. A cell's parts are numbered from its own number times 2**LEVELS, so that no two cells of any round share one."""
    if not 0 < trees <= 1 << LEVELS - 1:
        raise ValueError(f"1 to {1 << LEVELS - 1} trees")
    return F.sequence(F.lit(trees).cast("long"), F.lit(2 * trees - 1).cast("long"))


def grow(rows: DataFrame, trees: int) -> tuple[list[DataFrame], DataFrame]:
    """The small trees of each round (dim, cell, tree), and where all rows ended (dim, cell, id, name, mark, vector).

    rows: dim, id, name, mark, vector.
    """
    open_rows = rows.withColumn("cell", F.explode(_roots(trees)))
    models, ended = [], None

    def fit_group(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        tree = fit(units(matrix(b"".join(group["vector"]), key[0], len(group))), int(group["levels"].iloc[0]), abs(hash(key)) % (1 << 31))
        return pd.DataFrame({"dim": [key[0]], "cell": [key[1]], "tree": [tree.astype("<f8").tobytes()]})

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, n = np.array(r["ids"]), len(r["ids"])
                to = (r["cell"] << LEVELS) + leaves(_tree(r), units(matrix(r["vectors"], r["dim"], n)), ids, r["cell"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["dim"]] * n, pa.int32()), pa.array(to), pa.array(ids), pa.array(r["names"], pa.int64()), pa.array(r["marks"], pa.float64()), pa.array(cut(r["vectors"], n), pa.binary())],
                    names=["dim", "cell", "id", "name", "mark", "vector"],
                )

    while True:
        n = open_rows.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"))
        counted = settle(open_rows.join(n, ["dim", "cell"]))
        done = counted.filter(F.col("n") <= LEAF).drop("n")
        ended = done if ended is None else ended.unionByName(done)
        large = counted.filter(F.col("n") > LEAF)
        if large.isEmpty():
            return models, ended
        levels = F.least(F.ceil(F.log2(F.col("n") / LEAF)), F.lit(LEVELS)).cast("int")
        drawn = large.filter(F.pmod(F.xxhash64("id", "cell"), F.lit(1 << 30)) * F.col("n") < float(SAMPLE * (1 << 30)))
        tree = settle(drawn.select("dim", "cell", "id", "vector", levels.alias("levels")).groupBy("dim", "cell").applyInPandas(lambda key, group: fit_group(key, group), "dim int, cell long, tree binary"))
        models.append(tree)
        # A cell that no row was drawn from can't be fitted: with SAMPLE rows expected, that doesn't happen.
        open_rows = settle(blocks(large).join(tree, ["dim", "cell"]).mapInArrow(route, "dim int, cell long, id long, name long, mark double, vector binary"))


def visits(queries: DataFrame, models: list[DataFrame], trees: int, most: int) -> DataFrame:
    """dim, id, name, vector, cells: the `most` leaves that each query visits, over all trees, the surest first.

    The queue that all trees share is a table: in each round a query's cells that were split give way to their parts, and of all its cells
    those with the widest margins stay.
    """
    start = F.transform(_roots(trees), lambda c: F.struct(F.lit(-1e9).alias("margin"), c.alias("cell")))
    held = queries.select("dim", "id", "name", "vector", start.alias("cells"))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n = len(r["ids"])
                m = -margins(_tree(r), units(matrix(r["vectors"], r["dim"], n)), -np.array(r["marks"]))
                best = np.argsort(m, axis=1, kind="stable")[:, :most]
                cells = (r["cell"] << LEVELS) + best
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["dim"]] * n, pa.int32()), pa.array(r["ids"], pa.int64()), pa.array(r["names"], pa.int64()), pa.array(cut(r["vectors"], n), pa.binary()),
                        pa.array([[{"margin": a, "cell": c} for a, c in zip(row, cs, strict=True)] for row, cs in zip(np.take_along_axis(m, best, 1).tolist(), cells.tolist(), strict=True)], pa.list_(pa.struct([("margin", pa.float64()), ("cell", pa.int64())]))),
                    ],
                    names=["dim", "id", "name", "vector", "cells"],
                )

    for tree in models:
        each = settle(held.select("dim", "id", "name", "vector", F.explode("cells").alias("c")).select("dim", "id", "name", "vector", "c.cell", F.col("c.margin").alias("mark")))
        split = tree.select("dim", "cell")
        opened = blocks(settle(each.join(split, ["dim", "cell"], "left_semi"))).join(tree, ["dim", "cell"]).mapInArrow(expand, "dim int, id long, name long, vector binary, cells array<struct<margin: double, cell: long>>")
        stay = each.join(split, ["dim", "cell"], "left_anti").select("dim", "id", "name", "vector", F.array(F.struct(F.col("mark").alias("margin"), "cell")).alias("cells"))
        both = opened.unionByName(stay).groupBy("dim", "id").agg(F.any_value("name").alias("name"), F.any_value("vector").alias("vector"), F.flatten(F.collect_list("cells")).alias("cells"))
        held = settle(both.withColumn("cells", F.slice(F.sort_array("cells"), 1, most)))
    return held


class Best:
    """The k best of each query among what a task has seen: (score, smaller name) first, a row once."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def add(self, query: int, scores: list[float], names: list[int | None], ids: list[int]) -> None:
        held = self.of.setdefault(query, {})
        held.update({i: (-s, n is None, n or 0, i) for s, n, i in zip(scores, names, ids, strict=True)})
        if len(held) > 4 * self.k:
            self.of[query] = {v[3]: v for v in heapq.nsmallest(self.k, held.values())}

    def batch(self) -> pa.RecordBatch:
        rows = [(q, None if v[1] else v[2], v[3], -v[0]) for q, held in self.of.items() for v in heapq.nsmallest(self.k, held.values())]
        self.of = {}
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query", "name", "id", "score"])


FOUND = "query long, name long, id long, score double"


def candidates(x: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the rows of x that can be among q's k best; own: those that are q itself."""
    with np.errstate(all="ignore"):
        sizes = np.sqrt((x * x).sum(axis=1)) * np.sqrt(q @ q)
        odd = ~((sizes > 1e-100) & (sizes < 1e100))  # too large or small to square: left to cosines()
        rough = np.where(own | odd, -9.0, x @ q / sizes)
    plain = int((~own & ~odd).sum())
    at = np.flatnonzero(~own & (odd | (rough >= (np.partition(rough, len(x) - k)[len(x) - k] - 1e-9 if plain > k else -9.0))))
    return at, cosines(x[at], q) if len(at) else np.empty(0)


def nearest_in_all(rows: DataFrame, asked: list[tuple[int, int, bytes]], k: int) -> DataFrame:
    """The true k nearest of a bounded list of queries (dim, id, vector), by one pass over all rows."""
    held = [(d, i, matrix(v, d, 1)[0]) for d, i, v in asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for b in batches:
            dims, ids, names = (np.array(b.column(c).to_pylist(), object) for c in range(3))
            for d in {d for d, _, _ in held} & set(dims.tolist()):
                at = np.flatnonzero(dims == d)
                x = matrix(b"".join(b.column(3).take(pa.array(at)).to_pylist()), d, len(at))
                for q in (h for h in held if h[0] == d):
                    i, scores = candidates(x, q[2], ids[at] == q[1], k)
                    best.add(q[1], scores.tolist(), names[at][i].tolist(), ids[at][i].tolist())
        yield best.batch()

    return _top(rows.select("dim", "id", "name", "vector").mapInArrow(run, FOUND), k)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank; found: k rows a task for each query at most."""
    order = F.struct((-F.col("score")).alias("s"), F.col("name").isNull().alias("no"), F.coalesce("name", F.lit(0).cast("long")).alias("name"), "id")
    best = found.groupBy("query").agg(F.slice(F.sort_array(F.collect_set(F.struct(order.alias("o"), "score", "name", "id"))), 1, k).alias("best"))
    return best.select("query", F.posexplode("best").alias("rank", "b")).select("query", (F.col("rank") + 1).alias("rank"), "b.name", "b.id", "b.score")


def search(seen: DataFrame, leaf_blocks: DataFrame, k: int) -> DataFrame:
    """query, rank, name, id, score: the k best of each query in the leaves that it visits, ranked by exact cosines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for b in batches:
            for r in b.to_pylist():
                x, q = matrix(r["vectors"], r["dim"], len(r["ids"])), matrix(r["asked"], r["dim"], len(r["queries"]))
                ids, names = np.array(r["ids"]), np.array(r["names"], object)
                for i, v in zip(r["queries"], q, strict=True):
                    at, scores = candidates(x, v, ids == i, k)
                    best.add(i, scores.tolist(), names[at].tolist(), ids[at].tolist())
            if len(best.of) > HELD:
                yield best.batch()
        yield best.batch()

    each = settle(seen.select("dim", F.explode("cells.cell").alias("cell"), "id", "name", F.lit(0.0).alias("mark"), "vector"))
    asked = blocks(each).select("dim", "cell", F.col("ids").alias("queries"), F.col("vectors").alias("asked"))
    return _top(asked.join(leaf_blocks, ["dim", "cell"]).mapInArrow(run, FOUND), k)


def probes(rows: DataFrame, queries: DataFrame, models: list[DataFrame], ended: DataFrame, *, trees: int, k: int, recall: float) -> int:
    """How many leaves a query must visit so that TRIED queries find `recall` of their true k nearest.

    The true ones come from one pass over all rows; for each, the place in the query's order of the first leaf that holds it says how many visits it takes.
    """
    some = queries.orderBy(F.xxhash64("id")).limit(TRIED)
    tried = settle(some)
    truth = settle(nearest_in_all(rows, [tuple(r) for r in tried.select("dim", "id", "vector").collect()], k).select("query", "id"))
    there = settle(ended.select("id", "cell").join(F.broadcast(truth), "id").select("query", "id", "cell"))  # TRIED * k rows are sent
    n, most = truth.count(), FIRST
    while True:
        seen = settle(visits(tried, models, trees, most).select(F.col("id").alias("query"), F.posexplode("cells.cell").alias("turn", "cell")))
        turns = sorted(r[0] for r in seen.join(there, ["query", "cell"]).groupBy("query", "id").agg(F.min("turn")).select("min(turn)").collect())
        needed = int(np.ceil(recall * n))
        if len(turns) >= needed:
            return turns[needed - 1] + 1 if needed else 1
        most *= 4


def neighbours(vectors: DataFrame, *, every: int = 50, k: int = 5, trees: int = 4, recall: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows by cosine, of those found, for each row whose id is divisible by `every`: query_id, rank (from 1), vec_id, score.

    Candidates are all rows but the query's own (rows that repeat an id are candidates of each other); ties go to the smaller id, then any.
    Vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of different lengths are never compared. A row
    with a null id is a candidate, last among ties, and no query. An empty table gives none. Other columns are not kept, so none can clash.

    Scores are exact; which rows are found is approximate. How many leaves queries visit is set so that TRIED queries find `recall` of their true
    neighbours: few where vectors cluster, a large share of all where they are spread evenly in many dimensions, as no index helps there. A query whose
    leaves hold fewer than k others visits four times as many, until there are k or no more.
    """
    v = F.transform(col(vector_col), lambda x: x.cast("double"))
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))

    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in lists], pa.int32()), b.column(0), pa.array([np.array(x, kind).tobytes() for x in lists], pa.binary())], names=["dim", "name", "vector"])

    clean = vectors.filter(fine).select(col(id_col).cast("long").alias("name"), v.alias("v")).mapInArrow(packed, "dim int, name long, vector binary")
    rows = settle(clean.select("dim", F.monotonically_increasing_id().alias("id"), "name", F.lit(0.0).alias("mark"), "vector"))
    models, ended = grow(rows, trees)
    leaf_blocks = settle(blocks(ended, LEAF).select("dim", "cell", "ids", "names", "vectors"))
    queries = settle(rows.filter(F.col("name") % every == 0).drop("mark"))
    most = probes(rows, queries, models, ended, trees=trees, k=k, recall=recall)
    others = rows.groupBy("dim").agg(F.least(F.count(F.lit(1)) - 1, F.lit(k)).alias("there"))
    out, left = None, queries
    while True:
        found = settle(search(visits(left, models, trees, most), leaf_blocks, k))
        n = found.groupBy(F.col("query").alias("id")).agg(F.count(F.lit(1)).alias("n"))
        few = settle(left.join(n, "id", "left").join(others, "dim").filter(F.coalesce("n", F.lit(0)) < F.col("there")).select(left.columns))
        kept = found.join(few.select(F.col("id").alias("query")), "query", "left_anti")
        out = kept if out is None else out.unionByName(kept)
        if few.isEmpty():
            break
        left, most = few, 4 * most
    asked = queries.select(F.col("id").alias("query"), F.col("name").alias("query_id"))
    return out.join(asked, "query").select("query_id", "rank", F.col("name").alias("vec_id"), "score")

