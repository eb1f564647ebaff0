"""The prefix trie of conversations as a Patricia tree: sort, keep only points where paths branch or end, expand the edges last.

Conversations are sorted over all executors as sequences of turn names. Along that order a task builds the part of the compressed
tree that its rows span, with one path in memory; only points on the borders between tasks have shares in several of them, and those are summed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import col, settle

#: Bytes that name a turn: the first half of its SHA-256.
NAME = 16
#: Bytes of joined conversation numbers in one row, where the members that end in a point are many or lie in several tasks.
PIECE = 1 << 20

POINT = "node binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, net long, sums array<long>, ends string, shared boolean, piece binary, place long"
ARROW = pa.schema(
    [(n, pa.binary()) for n in ("node", "parent")] + [(n, pa.int64()) for n in ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "net")]
    + [("sums", pa.list_(pa.int64())), ("ends", pa.string()), ("shared", pa.bool_()), ("piece", pa.binary()), ("place", pa.int64())]
)

EMPTY = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame, *, branch: bool = False, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, key (the names of its turns, joined) and sizes (UTF-8 bytes of each turn's text) of each conversation.

    Turns stand in order of turn, null first; of equal turns by role, then by name. Null role or text counts as empty; rows without a
    conversation are left out. A conversation is one row here: 24 bytes a turn. `branch` rebuilds each conversation c as the
    first crc32(c) % 9 turns of c - c % 5 and then its own turns after as many, so that paths are shared.
    """
    role, text, c = F.coalesce(col(role_col).cast("string"), F.lit("")), F.coalesce(col(text_col).cast("string"), F.lit("")), col(conv_col).cast("long")
    name = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, NAME)
    turn = F.struct(col(turn_col).cast("long").alias("turn"), role.alias("role"), name.alias("name"), F.octet_length(text).cast("long").alias("size"))
    rows = conversations.filter(c.isNotNull()).select(c.alias("conv_id"), turn.alias("t"))
    ordered = lambda x: F.transform(F.sort_array(x), lambda t: F.struct(t["name"], t["size"]))
    if not branch:
        held = rows.groupBy("conv_id").agg(F.collect_list("t").alias("ts")).select("conv_id", ordered(F.col("ts")).alias("ts"))
    else:
        # Five conversations at most share a base, so they meet in one shuffle.
        base = rows.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).repartition("base").groupBy("base", "conv_id").agg(F.collect_list("t").alias("ts")).select("base", "conv_id", ordered(F.col("ts")).alias("ts"))
        group = base.groupBy("base").agg(F.map_from_entries(F.collect_list(F.struct("conv_id", "ts"))).alias("of"))
        h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
        none = F.slice(F.col("ts"), 1, 0)
        held = group.select("of", "base", F.explode("of").alias("conv_id", "ts")).select(
            "conv_id", F.concat(F.coalesce(F.slice(F.try_element_at("of", F.col("base")), 1, h), none), F.slice(F.col("ts"), h + 1, F.greatest(F.size("ts"), F.lit(1)))).alias("ts")
        )
    joined = F.unhex(F.array_join(F.transform("ts", lambda t: F.hex(t["name"])), ""))
    return held.select("conv_id", joined.alias("key"), F.transform("ts", lambda t: t["size"]).alias("sizes"))


def agree(a: bytes, b: bytes) -> int:
    """Turns that two keys share at their start."""
    low, high = 0, min(len(a), len(b)) // NAME
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * NAME] == b[: mid * NAME] else (low, mid - 1)
    return low


@dataclass(slots=True)
class Point:
    """A point of the path that a task is on: sums over its members so far, those of closed points below included.

    said: bytes of all members' turns below it; stored: bytes of the distinct turns below it; ended: the members that end here.
    """

    depth: int
    least: int | None = None
    n: int = 0
    children: int = 0
    leaves: int = 0
    said: int = 0
    stored: int = 0
    ended: Ends | None = None


@dataclass(slots=True)
class Ends:
    """Numbers of members that end in a point, in order: hashed here, or handed on in pieces if they are many or others may be elsewhere."""

    pieces: bool = False
    held: list[str] = field(default_factory=list)
    size: int = 0
    n: int = 0


class Walk:
    """Builds the compressed tree of sorted sequences with one path in memory.

    before, after: how many turns the first and the last sequence share with those of the tasks beside this one (-1: nothing is beside it).
    Points up to there are made at every depth, since other tasks have shares in them; they count what is new in this task alone.
    """

    def __init__(self, part: int, before: int, after: int):
        self.part, self.after, self.inherited = part, after, before
        self.path = [Point(d) for d in range(max(before, 0) + 1)]
        self.key: bytes | None = None
        self.sums, self.out = [0], []

    def _unwind(self, depth: int, shared: bool = False) -> None:
        """Closes all points of the path below `depth`, and makes the point there if there is none."""
        while self.path[-1].depth > depth:
            low = self.path.pop()
            if self.path[-1].depth < depth:
                self.path.append(Point(depth))
            up = self.path[-1]
            new = low.depth > self.inherited
            edge = self.sums[low.depth] - self.sums[up.depth]
            up.least = low.least if up.least is None else min(up.least, low.least)
            up.n, up.leaves, up.children = up.n + low.n, up.leaves + low.leaves, up.children + new
            up.said, up.stored = up.said + low.said + low.n * edge, up.stored + low.stored + new * edge
            self._close(low, up.depth, shared or not new)
        self.inherited = min(self.inherited, depth)

    def _close(self, p: Point, above: int, shared: bool) -> None:
        node = self._node(p.depth)
        ends = self._ended(p, node) if p.ended else EMPTY
        sums = [self.sums[p.depth] - self.sums[d] for d in range(above, p.depth)] if p.depth else [0]
        self.out.append((node, self._node(above) if p.depth else None, p.depth, p.least, p.n, p.children, p.leaves, p.said - p.stored, sums, ends, shared or ends is None, None, None))

    def _node(self, depth: int) -> bytes:
        return hashlib.blake2b(self.key[: depth * NAME], digest_size=16).digest()

    def _ended(self, p: Point, node: bytes) -> str | None:
        if not p.ended.pieces:
            return hashlib.sha256(",".join(p.ended.held).encode()).hexdigest()
        self._piece(p.ended, node)
        return None

    def _piece(self, e: Ends, node: bytes) -> None:
        if e.held:
            self.out.append((node, *(None,) * 10, ",".join(e.held).encode(), self.part << 32 | e.n))
            e.n, e.size = e.n + 1, 0
            e.held.clear()

    def add(self, key: bytes, sizes: list[int], conv_id: int) -> None:
        depth = len(key) // NAME
        if key != self.key:
            if self.key is not None:
                same = agree(self.key, key)
                self._leaf(same)
                self._unwind(same)
            self.key, self.sums = key, [0, *accumulate(sizes)]
            if self.path[-1].depth < depth:
                self.path.append(Point(depth))
        top = self.path[-1]
        top.n += 1
        top.least = conv_id if top.least is None else min(top.least, conv_id)
        e = top.ended = top.ended or Ends(pieces=depth <= self.inherited)
        e.held.append(str(conv_id))
        e.size += 20
        if e.size > PIECE:
            e.pieces = True
            self._piece(e, self._node(depth))

    def _leaf(self, same: int) -> None:
        """The last sequence's point has nothing below it if the next one leaves its path above."""
        if self.path[-1].depth > same and self.path[-1].ended:
            self.path[-1].leaves += 1

    def finish(self) -> None:
        self._leaf(self.after)
        if self.after >= self.path[-1].depth:
            self.path[-1].ended.pieces = True  # the next task has more of them, or goes on from here
        for d in range(self.after, -1, -1):
            self._unwind(d, shared=d < self.after)
        self._unwind(0, shared=self.after >= 0)
        self._close(self.path.pop(), 0, True)


def points(ordered: DataFrame, beside: dict[int, tuple[int, int]]) -> DataFrame:
    """The points of the compressed tree, with shares of those that lie on borders, and pieces of members that end in them.

    ordered: part, key, sizes, conv_id, sorted in each of its tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for b in batches:
            for part, key, sizes, conv_id in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                walk = walk or Walk(part, *beside[part])
                walk.add(key, sizes, conv_id)
                if len(walk.out) > 2000:
                    yield _batch(walk.out)
        if walk:
            walk.finish()
            yield _batch(walk.out)

    return ordered.select("part", "key", "sizes", "conv_id").mapInArrow(run, POINT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)
    rows.clear()
    return out


def _beside(ordered: DataFrame) -> dict[int, tuple[int, int]]:
    """For each task of `ordered` that has rows: the turns that its first sequence shares with the one before, and its last with the one after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, -1 if low is None else agree(low, a), -1 if high is None else agree(z, high)) for p, a, z, low, high in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3, names=["part", "before", "after"])

    along = Window.orderBy("part")  # a row for each task
    ends = ordered.groupBy("part").agg(F.min("key").alias("a"), F.max("key").alias("z")).select("part", "a", "z", F.lag("z").over(along).alias("low"), F.lead("a").over(along).alias("high"))
    return {r["part"]: (r["before"], r["after"]) for r in ends.mapInArrow(run, "part long, before long, after long").collect()}


def _hashed(pieces: DataFrame) -> DataFrame:
    """node, whole: the hash of its members' numbers. A hash is made from its start to its end, so a point's pieces go through one task, a piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for b in batches:
            done = []
            for n, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if n == node:
                    sha.update(b"," + piece)
                    continue
                if node is not None:
                    done.append((node, sha.hexdigest()))
                node, sha = n, hashlib.sha256(piece)
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["node", "whole"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()])], names=["node", "whole"])

    return pieces.select("node", "piece", "place").repartition("node").sortWithinPartitions("node", "place").select("node", "piece").mapInArrow(run, "node binary, whole string")


def prefix_trie(conversations: DataFrame, *, branch: bool = False, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node of the trie of conversations, the root included: conv_id (smallest member), depth, parent_conv_id (null at the root),
    n_convs, n_children, n_leaves (in its subtree), saved_tokens (over its subtree, (n_convs - 1) times the bytes of the node's text) and ends_sha256
    (of the decimal numbers of the members that end there, ascending, joined by commas).

    What a conversation is, and what nulls and ties do, is told at sequences(). Rows that repeat are turns of their own. An empty table
    gives none. Other columns are not kept, so none can clash.

    A point where paths branch or end gets its sums from the rows of its task; a point that several tasks share gets them by adding up, since all
    sums go over sequences: with the sequence before, each knows which turns are new with it. A point between, with one way on, has its lower
    end's members, so its saved bytes follow from the suffix sums of the edge.
    """
    held = settle(sequences(conversations, branch=branch, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col))
    ordered = settle(held.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("part", F.spark_partition_id().cast("long")))
    made = settle(points(ordered, _beside(ordered)))
    alone = made.filter("piece is null and not shared").select("node", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "net", "sums", "ends")
    summed = made.filter("piece is null and shared").groupBy("node").agg(
        F.any_value("parent", ignoreNulls=True).alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "net")),
        F.max("sums").alias("sums"), F.max(F.when(F.col("ends") != EMPTY, F.col("ends"))).alias("ends"),
    )
    joined = summed.join(_hashed(made.filter("piece is not null")), "node", "left").withColumn("ends", F.coalesce("whole", "ends", F.lit(EMPTY))).drop("whole")
    every = settle(alone.unionByName(joined))
    up = every.join(every.select(F.col("node").alias("parent"), F.col("conv_id").alias("above")), "parent", "left")
    steps = F.size("sums")
    shown = up.select("*", F.posexplode("sums").alias("k", "sum")).withColumn("last", F.col("k") == steps - 1)
    at_end = lambda here, between: F.when(F.col("last"), here).otherwise(between)
    return shown.select(
        "conv_id", (F.col("depth") - steps + 1 + F.col("k")).cast("long").alias("depth"), F.when(F.col("k") == 0, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        at_end(F.col("n_children"), F.lit(1)).cast("long").alias("n_children"), "n_leaves", ((F.col("n_convs") - 1) * F.col("sum") + F.col("net")).alias("saved_tokens"), at_end(F.col("ends"), F.lit(EMPTY)).alias("ends_sha256"),
    )

