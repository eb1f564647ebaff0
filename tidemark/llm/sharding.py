"""Resharding by minimum-cost flow: the fewest bytes move from old shards to new ones of equal size."""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import col, fresh, settle

#: Bytes that a document has besides its text.
OVERHEAD = 16


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """flow[i][j] from each source to each sink, all of the supply at the least cost, by shortest augmenting paths.

    The sum of capacity must be that of supply or more. Nodes are shards, so the network is small whatever the data's size.
    """
    n, m = len(supply), len(capacity)
    start, stop = n + m, n + m + 1
    ends: list[list[int]] = [[] for _ in range(n + m + 2)]
    to: list[int] = []
    room: list[int] = []
    price: list[int] = []

    def arc(a: int, b: int, r: int, p: int) -> None:
        for x, y, z, w in ((a, b, r, p), (b, a, 0, -p)):
            ends[x].append(len(to))
            to.append(y)
            room.append(z)
            price.append(w)

    for i, s in enumerate(supply):
        arc(start, i, s, 0)
    first = len(to)
    for i in range(n):
        for j in range(m):
            arc(i, n + j, min(supply[i], capacity[j]), cost[i][j])
    for j, c in enumerate(capacity):
        arc(n + j, stop, c, 0)
    left = sum(supply)
    while left:
        best: list[float] = [float("inf")] * len(ends)
        came = [-1] * len(ends)
        best[start], waiting, queued = 0, deque([start]), {start}
        while waiting:
            a = waiting.popleft()
            queued.discard(a)
            for e in ends[a]:
                if room[e] and best[a] + price[e] < best[to[e]]:
                    best[to[e]], came[to[e]] = best[a] + price[e], e
                    if to[e] not in queued:
                        queued.add(to[e])
                        waiting.append(to[e])
        if came[stop] < 0:
            raise ValueError("the new shards have no room for all")
        path, node = [], stop
        while node != start:
            path.append(came[node])
            node = to[came[node] ^ 1]
        push = min(left, min(room[e] for e in path))
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
        left -= push
    return [[room[(first + 2 * (i * m + j)) ^ 1] for j in range(m)] for i in range(n)]


#: Size classes a doubling, and the part of a new shard over which documents are placed before the others.
CLASSES, LARGE = 8, 64


def _measured(docs: DataFrame, old: int, blocks: int, id_col: str, text_col: str, carried: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, h (a hash of the document), old_shard, class (of sizes), block, and `row` where something is carried."""
    text = col(text_col).cast("string")
    doc_id = col(id_col).cast("long")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")
    h = F.xxhash64(F.lit(11), F.coalesce(doc_id, F.lit(0)), text)
    return docs.select(
        doc_id.alias("doc_id"),
        size.alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        h.alias("h"),
        F.pmod(F.crc32(F.coalesce(doc_id, F.lit(0)).cast("string").cast("binary")), F.lit(old)).cast("int").alias("old_shard"),
        F.floor(F.log2(size.cast("double")) * CLASSES).cast("int").alias("class"),
        F.pmod(h, F.lit(blocks)).cast("int").alias("block"),
        *([] if carried is None else [carried.alias("row")]),
    )


def _cuts(sent: list[list[float]], held: list[int]) -> list[tuple[int, int, int, int]]:
    """(old shard, from, to, new shard): each old shard's bytes, what it holds, cut in proportion to what it sends, what stays first."""
    out = []
    for i, parts in enumerate(sent):
        total, at, before = sum(parts), 0, 0.0
        for j in sorted((j for j, n in enumerate(parts) if n > 0), key=lambda j, i=i: (j != i, j)):
            before += parts[j]
            to = round(held[i] * before / total)
            out.append((i, at, to, j))
            at = to
    return out


#: Bytes of text in a file of a rewritten shard.
FILE = 256 << 20


def _placed(rows: DataFrame, light: DataFrame, old: int, new: int) -> tuple[DataFrame, list[list[int]]]:
    """rows with `nth` (place in its block) and `shard`, and the flow. light: the same rows, settled, for the counts.

    What goes to the driver is bounded by the shards and the classes of sizes.
    """
    by_block = settle(light.groupBy("old_shard", "class", "block").agg(F.sum("size").alias("bytes")))
    totals = [(r["old_shard"], r["class"], r["bytes"]) for r in by_block.groupBy("old_shard", "class").agg(F.sum("bytes").alias("bytes")).collect()]
    supply = [sum(n for i, _, n in totals if i == s) for s in range(old)]
    total = sum(supply)
    capacity = [total // new + (j < total % new) for j in range(new)]
    flow = min_cost_flow(supply, capacity, [[int(i != j) for j in range(new)] for i in range(old)])
    first = math.ceil(math.log2(max(2, total / new / LARGE)) * CLASSES)  # the least class of large documents
    large = [sum(n for i, c, n in totals if i == s and c >= first) for s in range(old)]
    is_large = F.col("class") >= first
    ahead = Window.partitionBy("old_shard", is_large).orderBy(F.desc("class"), "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_block.select("old_shard", "class", "block", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("begins"))
    inside = Window.partitionBy("old_shard", "class", "block").orderBy("h", "doc_id", "text_crc32")

    def dealt(some: DataFrame, sent: list[list[float]], held: list[int]) -> DataFrame:
        cut = F.broadcast(some.sparkSession.createDataFrame(_cuts(sent, held), "o int, low long, high long, shard int"))
        middle = F.col("begins") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.floor(F.col("size") / 2)
        ordered = some.join(starts, ["old_shard", "class", "block"]).withColumn("nth", F.row_number().over(inside)).withColumn("middle", middle)
        return ordered.join(cut, (F.col("old_shard") == F.col("o")) & (F.col("middle") >= F.col("low")) & (F.col("middle") < F.col("high"))).drop("o")

    got = [[0] * new for _ in range(old)]
    for r in dealt(light.filter(is_large), flow, large).groupBy("old_shard", "shard").agg(F.sum("size").alias("n")).collect():
        got[r["old_shard"]][r["shard"]] = r["n"]
    left = [[max(0, f - g) for f, g in zip(*both, strict=True)] for both in zip(flow, got, strict=True)]
    left = [x if any(x) else f for x, f in zip(left, flow, strict=True)]
    small = [s - n for s, n in zip(supply, large, strict=True)]
    return dealt(rows.filter(is_large), flow, large).unionByName(dealt(rows.filter(~is_large), left, small)), flow


def reshard(docs: DataFrame, *, old: int = 32, new: int = 40, blocks: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard.

    The old layout deals documents to `old` shards by a hash of the id; the new one has `new` shards of equal bytes (law
    `bytes`). Old sizes and new capacities go to the driver, one number for each shard; the minimum-cost flow says how many
    bytes each old shard sends to each new one. Documents of an old shard stand in a fixed order: by size, an eighth of a
    doubling at a time, the larger first, then by one of `blocks` blocks of a hash, then by the hash. That order is cut where
    the running sum of bytes reaches each new shard's share, first of those over a 64th of a new shard, then of the others, which
    make up for what the cuts between large ones left uneven. So shards differ by no more than small documents at their cuts,
    as long as there are enough. Running sums go over blocks first and then inside each. slot counts a new shard's documents from 0.

    size is the text's UTF-8 bytes plus 16; null text has no bytes and no crc (null counts as empty: crc 0). A null id is
    dealt like the id 0; repeated rows are dealt each; an empty table gives no rows; other columns are not read.
    """
    rows = settle(_measured(docs, old, blocks, id_col, text_col))
    sent = settle(_placed(rows, rows, old, new)[0])
    part = ["shard", "old_shard", "class", "block"]
    counted = sent.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("from"))
    before = Window.partitionBy("shard").orderBy("old_shard", "class", "block").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select(*part, "from", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return sent.join(base, part).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("nth") - F.col("from")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard"
    )


def rewrite(docs: DataFrame, path: str, *, old: int = 32, new: int = 40, blocks: int = 64, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """Write the shards that resharding changes under `path`, one folder for each (tm_shard=N), and return their numbers.

    A shard is changed if a document enters or leaves it; all documents that it has then are written, with all their columns,
    each row once: rows are carried through the placing, so repeated rows and null ids need no matching. A shard is as many files
    of about FILE bytes of text as it needs, each written by one task, so no task holds a shard. An empty table writes nothing. Running it again writes the same folders anew, so a lost run can be repeated.
    """
    shard, inside = fresh(docs, "tm_shard", "tm_row")
    light = settle(_measured(docs, old, blocks, id_col, text_col))
    whole = _measured(docs, old, blocks, id_col, text_col, F.struct(*map(col, docs.columns)))
    placed, flow = _placed(whole, light, old, new)
    moves = [(i, j) for i, sent in enumerate(flow) for j, n in enumerate(sent) if n and i != j]
    touched = sorted({x for move in moves for x in move} & set(range(new)))
    if touched:
        held = placed.filter(F.col("shard").isin(touched)).select(F.col("row").alias(inside), F.col("shard").alias(shard))
        rows = held.select(*(F.col(inside).getField(c).alias(c) for c in docs.columns), shard)
        parts = max(1, round(sum(map(sum, flow)) / new / FILE))
        rows.repartition(shard, F.pmod(F.xxhash64(*map(col, rows.columns)), F.lit(parts))).write.mode("overwrite").partitionBy(shard).parquet(path)
    return touched
