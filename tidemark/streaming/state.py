"""State by key across micro-batches: which pages have changed since they were last seen, and how many calls a day has had."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGED = "source_id string, url string, seen timestamp, content string, changed boolean"
COUNTED = "day string, call string, at timestamp, nth long, allowed boolean"

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state(spark: SparkSession) -> None:
    """Keyed state with timers lives in RocksDB, whose files go to the stream's checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Changes(StatefulProcessor):
    """Per page: the newest content seen and when. A page seen first counts as changed; one that is older than what is known, or equally old, says nothing."""

    def __init__(self, keep: timedelta):
        self.keep = int(keep.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seen timestamp, content string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.last.get() if self.last.exists() else None
        seen, content = held if held is not None else (None, None)
        out = []
        for r in pd.concat(list(rows)).sort_values(["seen", "content"], kind="stable").itertuples(index=False):
            at = r.seen.to_pydatetime()
            if seen is not None and at <= seen:
                continue
            out.append((*key, at, r.content, content is None or r.content != content))
            seen, content = at, r.content
        if out:
            self.last.update((seen, content))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(seen.timestamp() * 1000) + self.keep)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGED.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """A page that nobody has seen for long is forgotten; if it comes again it counts as changed."""
        self.last.clear()
        yield pd.DataFrame(columns=[c.split()[0] for c in CHANGED.split(", ")])

    def close(self) -> None:
        pass


def page_changes(pages: DataFrame, *, keep: timedelta = timedelta(days=60), late: str = "7 days") -> DataFrame:
    """A stream of pages (source_id, url, seen, content: a hash or text) as a stream of those that are newer than what was known, with `changed`.

    Each page's row comes once whatever is landed again. Rows later than `late` behind the newest are dropped by the watermark; state goes `keep` after a page was last seen.
    """
    marked = pages.withWatermark("seen", late)
    return marked.groupBy("source_id", "url").transformWithStateInPandas(Changes(keep), CHANGED, "Append", "EventTime")


class Calls(StatefulProcessor):
    """Per day: how many calls were made and which. A call that comes again, as after a loss, is the call that it was."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.n = handle.getValueState("n", "n long")
        self.known = handle.getMapState("known", "call string", "nth long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n = self.n.get()[0] if self.n.exists() else 0
        out = []
        for part in rows:
            for r in part.sort_values(["at", "call"], kind="stable").itertuples(index=False):
                if self.known.containsKey((r.call,)):
                    continue
                n += 1
                self.known.updateValue((r.call,), (n,))
                out.append((key[0], r.call, r.at.to_pydatetime(), n, n <= self.most))
        if out:
            self.n.update((n,))
            if not list(self.handle.listTimers()):
                self.handle.registerTimer(int((pd.Timestamp(key[0], tz="UTC") + pd.Timedelta(days=2)).timestamp() * 1000))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in COUNTED.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """A day that is over is forgotten."""
        self.n.clear()
        self.known.clear()
        yield pd.DataFrame(columns=[c.split()[0] for c in COUNTED.split(", ")])

    def close(self) -> None:
        pass


def daily_calls(calls: DataFrame, most: int = 100) -> DataFrame:
    """A stream of calls (call: its name, at) with nth, its place in its day, and whether the day's cap allows it. The cap is the model's contract, so calls of a day are few."""
    dated = calls.withWatermark("at", "1 day").withColumn("day", F.date_format("at", "yyyy-MM-dd"))
    return dated.groupBy("day").transformWithStateInPandas(Calls(most), COUNTED, "Append", "EventTime")
