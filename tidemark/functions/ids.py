"""Identifiers of notices: TP-000001 and on, six digits or more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.components import settled


def format_id(n: Column) -> Column:
    """Padded to six digits, longer numbers whole."""
    return F.format_string("TP-%06d", n.cast("long"))


def number_of(c: Column) -> Column:
    """The number of an identifier, null if the text is none."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"^TP-(\d+)$", 1).try_cast("long")


def assign_ids(new: DataFrame, tracked: DataFrame, order: str, id_col: str = "id") -> DataFrame:
    """new with identifiers that follow the largest one tracked, in the given order.

    Numbers go on over ranges: rows are counted for each of a bounded number of ranges of the order first, so that no task
    sees them all. Ranges are sampled, so the sorted rows are checkpointed before they are counted. Rows with equal order are
    numbered in any order.
    """
    start = tracked.agg(F.coalesce(F.max(number_of(F.col(id_col))), F.lit(0)).alias("start")).first()["start"]
    ordered = new.drop(id_col).repartitionByRange(F.col(order)).sortWithinPartitions(order)
    sorted_rows = settled(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() % (1 << 33)))
    counts = sorted_rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return sorted_rows.join(F.broadcast(before), "_part").withColumn(id_col, format_id(F.lit(start + 1) + F.col("_before") + F.col("_at"))).drop("_part", "_at", "_before")
