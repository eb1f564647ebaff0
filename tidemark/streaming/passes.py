"""Passes as a stream of landed pages: each micro-batch is a pass over a snapshot that is swapped when it is whole."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators import messages
from tidemark.operators.components import remove, settled
from tidemark.plans.passes import PENDING, Pass, Settings, full_pass, mark_sent, outgoing
from tidemark.schemas import NOTICE, PLAN
from tidemark.sources.landing import LANDED


class Snapshots:
    """Versions of the tracked table under a folder of the shared store, one for each batch of a stream.

    Versions are numbered by the store, not by the stream: a stream that has lost its checkpoint starts its batches at 0 again and
    goes on from the newest version. A batch that is run again, because the driver or an executor was lost, has the day that
    it had, reads the version that it read, and writes its own anew. Of older versions the last `keep` stay.
    """

    LOG = "version long, stream string, batch long, day date, whole boolean"

    def __init__(self, spark: SparkSession, path: str, keep: int = 3):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def log(self) -> list[Row]:
        """What has begun and what is whole, a few bytes a batch."""
        try:
            return self.spark.read.schema(self.LOG).parquet(f"{self.path}/log").collect()
        except AnalysisException:  # nothing has begun yet
            return []

    def _note(self, *values) -> None:
        self.spark.createDataFrame([values], self.LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def begin(self, stream: str, batch: int, day: date) -> tuple[int, date]:
        """The version that a batch writes and its day: those that it had if it has begun before."""
        log = self.log()
        mine = [r for r in log if (r["stream"], r["batch"]) == (stream, batch)]
        if mine:
            return mine[0]["version"], mine[0]["day"]
        version = max((r["version"] for r in log), default=-1) + 1
        self._note(version, stream, batch, day, False)
        return version, day

    def before(self, version: int) -> DataFrame:
        """The newest whole version before this one; an empty table if there is none."""
        found = max((r["version"] for r in self.log() if r["whole"] and r["version"] < version), default=None)
        return self.spark.createDataFrame([], NOTICE) if found is None else self.spark.read.schema(NOTICE).parquet(f"{self.path}/version={found}")

    def write(self, notices: DataFrame, version: int, stream: str, batch: int, day: date) -> None:
        notices.write.mode("overwrite").parquet(f"{self.path}/version={version}")
        whole = {r["version"] for r in self.log() if r["whole"]}
        if version not in whole:
            self._note(version, stream, batch, day, True)
        for old in sorted(v for v in whole if v < version)[: -self.keep]:
            remove(self.spark, f"{self.path}/version={old}")

    def side(self, name: str, version: int, schema: StructType) -> DataFrame | None:
        """Another table of the newest whole version before this one; none if it has no rows or wasn't kept then."""
        found = max((r["version"] for r in self.log() if r["whole"] and r["version"] < version), default=None)
        if found is None:
            return None
        try:
            held = self.spark.read.schema(schema).parquet(f"{self.path}/{name}/version={found}")
            return None if held.isEmpty() else held
        except AnalysisException:
            return None

    def latest(self) -> DataFrame:
        return self.before(1 << 62)


Deliver = Callable[[DataFrame], None]


class Outbox:
    """Messages under the snapshot store, a folder for each channel and version. A message is named by version, channel, kind, id and part.

    A batch that is run again finds what it has written: a folder that is whole is not written again, so no second message appears,
    and a folder that is not whole is written anew. A channel's rows are marked as sent only when its folder is whole.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/outbox"

    def folder(self, channel: str, version: int) -> str:
        return f"{self.path}/channel={channel}/version={version}"

    def whole(self, channel: str, version: int) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder(channel, version)}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def put(self, messages: DataFrame, channel: str, version: int, deliver: Deliver | None = None) -> bool:
        """Writes a channel's messages, if they aren't there, and hands them to `deliver`, which may see a message again after a loss and knows it by its name.

        False if the channel fails: then nothing of it stays in the outbox and nothing is marked; other channels go on.
        """
        if self.whole(channel, version):
            return True
        rows = messages.filter(F.col("channel") == channel).drop("channel")
        try:
            if deliver:
                deliver(rows.withColumn("version", F.lit(version)))
            rows.write.mode("overwrite").parquet(self.folder(channel, version))
        except Exception:
            logging.getLogger(__name__).exception("channel %s of version %d", channel, version)
            remove(self.spark, self.folder(channel, version))
            return False
        return True

    def read(self) -> DataFrame:
        """All messages: channel, version and the columns of a message."""
        return self.spark.read.schema(f"{messages.MESSAGE}, version int").parquet(self.path)


def step(store: Snapshots, landed: DataFrame, sources: DataFrame, version: int, day: date, settings: Settings, deliver: dict[str, Deliver]) -> Pass:
    """One pass with its messages: notices are marked for the channels whose messages are all written."""
    done = full_pass(store.before(version), landed, sources, day, settings, pending=store.side("pending", version, PENDING), plans=store.side("plans", version, PLAN))
    done.notices = settled(done.notices)
    said, marks = outgoing(done.notices, settings)
    outbox, notices = Outbox(store.spark, store.path), done.notices
    for channel, _ in settings.sending.caps:
        if outbox.put(said, channel, version, deliver.get(channel)):
            notices = mark_sent(notices, marks, channel)
    done.notices = notices
    for name, table in (("pending", done.pending), ("plans", done.plans), ("log", done.log)):
        table.write.mode("overwrite").parquet(f"{store.path}/{'notes' if name == 'log' else name}/version={version}")
    return done


def start(spark: SparkSession, landing: str, snapshots: str, checkpoint: str, sources: DataFrame, as_of: Callable[[], date], settings: Settings | None = None, deliver: dict[str, Deliver] | None = None):
    """A query that takes all pages that have landed since it last ran, as one pass or several, and then ends.

    deliver: what hands a channel's messages on, by channel; without, they stay in the outbox.
    """
    store = Snapshots(spark, snapshots)

    def one(batch: DataFrame, number: int) -> None:
        stream = json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]
        version, day = store.begin(stream, number, as_of())
        done = step(store, settled(batch), sources, version, day, settings or Settings(), deliver or {})
        store.write(done.notices.drop("outcome"), version, stream, number, day)

    stream = spark.readStream.schema(LANDED).parquet(landing)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
