"""Connected components of a table of links, by contraction in random orders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Links a file of a round, so that the last rounds don't write a file for each shuffle partition.
ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share. Where none is set, as in tests, a new local one, but only if the master is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master or "").split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the session's checkpoint folder; Spark clears it there where spark.cleaner.referenceTracking.cleanCheckpoints says so."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """node and comp for each node of the links (a, b): equal comp, one of the nodes, for nodes that links join.

    In each round every node points to the one, of itself and its neighbours, that a new random order puts first; links are
    redrawn between what their ends point to. A constant share of the nodes goes each round whatever the shape of the graph,
    so long chains take few rounds. Only how many links are left goes to the driver. Rounds are written as Parquet into the shared
    folder, and the files go at the end: a checkpoint would keep the planner's guess of its size, the product of the sizes of
    all that was joined before, and that number's digits double each round. No links give no rows; a link of a node to itself joins nothing.
    """
    spark = edges.sparkSession
    folder = f"{shared_folder(spark)}/components-{uuid.uuid4()}"

    def kept(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        (df if rows is None else df.coalesce(rows // ROWS + 1)).write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    try:
        links = kept(edges.select("a", "b"), "links")
        label = None
        for turn in range(rounds):
            n = links.count()
            if not n:
                break
            both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            ranked = both.select(F.col("a").alias("node"), F.struct(F.xxhash64("b", F.lit(turn)).alias("o"), F.col("b").alias("v")).alias("other"), F.struct(F.xxhash64("a", F.lit(turn)).alias("o"), F.col("a").alias("v")).alias("own"))
            points = kept(ranked.groupBy("node").agg(F.least(F.min("other"), F.min("own")).getField("v").alias("to")), f"points-{turn}", n)
            step = points.select(F.col("node").alias("was"), "to")
            label = points.withColumnRenamed("to", "comp") if label is None else kept(label.join(step, label["comp"] == step["was"], "left").select("node", F.coalesce("to", "comp").alias("comp")), f"label-{turn}")
            ends = links.join(step.select(F.col("was").alias("a"), F.col("to").alias("ta")), "a").join(step.select(F.col("was").alias("b"), F.col("to").alias("tb")), "b")
            links = kept(ends.filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), f"links-{turn}", n)
        else:
            raise RuntimeError(f"links are left after {rounds} rounds")
        return settled(label if label is not None else links.select(F.col("a").alias("node"), F.col("b").alias("comp")))
    finally:
        remove(spark, folder)
