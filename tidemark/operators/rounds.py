"""What goes round between passes: ranks and running sums over ranges, the budgeted rotation with its cursor, a table sorted within its slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.components import settled


def ranked(rows: DataFrame, order: list[Column | str], name: str, *, total: str | None = None, total_name: str = "before") -> DataFrame:
    """rows with `name`, their place from 0 in the order, and with `total` also the sum of that column over all rows before.

    Rows are sorted by ranges over all executors; what lies before a range is the sum over the ranges before it, one row each, so no task
    sees them all. Ranges are sampled, so the sorted rows are checkpointed before they are summed. Rows of equal order are placed in any order.
    """
    value = F.coalesce(F.col(total), F.lit(0)) if total else F.lit(0)
    ordered = rows.withColumn("_value", value).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = settled(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() % (1 << 33)))
    ranges = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.sum("_value").alias("s"))
    before = sums.select("_part", F.coalesce(F.sum("n").over(ranges), F.lit(0)).alias("_n"), F.coalesce(F.sum("s").over(ranges), F.lit(0)).alias("_s"))
    joined = placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_n") + F.col("_at"))
    if total:
        inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        joined = joined.withColumn(total_name, F.col("_s") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return joined.drop("_part", "_at", "_value", "_n", "_s")


def resume(sources: DataFrame, cursor: int, budget: float, *, place: str = "place", cost: str = "cost") -> tuple[DataFrame, int]:
    """(sources with turn, before and taken; the next cursor): a round that starts at the source in place `cursor` and ends when its time is used up.

    place: from 0, unique and without gaps. A source is taken if the costs of those before it in the round, from the cursor on and over the end,
    are within the budget; the first one always is. The next round starts at the first that was not taken, or at 0 if all were. A null cost counts as 0.
    """
    n = sources.count()
    if not n:
        return sources.withColumns({"turn": F.lit(0).cast("long"), "before": F.lit(0.0), "taken": F.lit(True)}), 0
    turned = sources.withColumn("turn", F.pmod(F.col(place) - F.lit(cursor % n), F.lit(n)).cast("long"))
    summed = ranked(turned, ["turn"], "_rank", total=cost).drop("_rank")
    told = settled(summed.withColumn("taken", (F.col("turn") == 0) | (F.col("before") <= budget)))
    first = told.filter(~F.col("taken")).agg(F.min("turn").alias("t")).first()["t"]
    return told, 0 if first is None else (cursor + first) % n


def sort_in_place(rows: DataFrame, slot: str, known: Column, order: list[Column | str]) -> DataFrame:
    """rows with `slot` anew: known rows stand in order in the slots that known rows had; others keep theirs, and so do known rows without a slot.

    The n-th of the known rows in order gets the n-th of their slots: two ranks over ranges and a join on them, which are unique.
    """
    moves = known & F.col(slot).isNotNull()
    flagged = settled(rows.withColumn("_moves", F.coalesce(moves, F.lit(False))))
    contents = ranked(flagged.filter("_moves"), order, "_rank").drop(slot)
    free = ranked(flagged.filter("_moves").select(slot), [slot], "_rank")
    return contents.join(free, "_rank").select(*rows.columns).unionByName(flagged.filter(~F.col("_moves")).select(*rows.columns))
