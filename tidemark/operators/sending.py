"""What a pass sends: one digest for many new notices, then notices by relevance under each channel's cap."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.classify import notifiable
from tidemark.operators import notify

KINDS = ("new", "j7", "j3", "j1", "expired")


@dataclass(frozen=True)
class Sending:
    """Rules of messages, messages for each channel in a pass (0: no cap), which relevance is worth one, and from how many new ones a digest is sent."""

    rules: notify.Rules = field(default_factory=notify.Rules)
    caps: tuple[tuple[str, int], ...] = (("email", 20), ("telegram", 0))
    relevance: str | None = None
    digest_over: int = 5


def place(relevance: Column, days: Column, row_id: Column) -> Column:
    """A text that sorts as messages go out: relevance down, then days up with none last, then the id."""
    rank = F.translate(F.substring(F.coalesce(relevance, F.lit("")), 1, 1), "0123456789", "9876543210")
    return F.concat(F.when(rank == "", "~").otherwise(rank), F.lpad((F.coalesce(days, F.lit(9999)) + 100_000).cast("string"), 7, "0"), row_id)


def plan(notices: DataFrame, is_new: Column, sending: Sending) -> tuple[bool, DataFrame]:
    """(whether a digest goes out, rows): channel, id, place, send, mark, needs, passes.

    More than `digest_over` new notices worth a message make a digest, which costs one message on each channel whose cap is
    not 0 messages; the new-notice message of each is then covered. Rows that have something to say go by place, each if all of
    its messages fit under what is left of the cap. What doesn't pass is not marked and comes again; nor is what isn't worth a message.
    notices: id (unique), days_left, followed, relevance and sent_* marks.
    """
    worth = notices.filter(notifiable(F.col("relevance"), sending.relevance))
    digest = sending.rules.new and worth.filter(is_new).limit(sending.digest_over + 1).count() > sending.digest_over
    marks = {k: F.col(f"sent_{k}") for k in KINDS}
    out = None
    for channel, cap in sending.caps:
        due = notify.due(F.col("days_left"), F.col("followed"), marks, sending.rules, channel)
        told = worth.select("id", place(F.col("relevance"), F.col("days_left"), F.col("id")).alias("place"), due.alias("d")).filter(F.size("d.mark") > 0)
        send = F.filter(F.col("d.send"), lambda k: k != "new") if digest else F.col("d.send")
        rows = told.select(F.lit(channel).alias("channel"), "id", "place", send.alias("send"), F.col("d.mark").alias("mark")).withColumn("needs", F.size("send"))
        left = cap - digest if cap else 0
        passed = rows.withColumn("passes", F.col("needs") == 0) if cap and not left else notify.under_cap(rows, "channel", "needs", "place", left)
        out = passed.select("channel", "id", "place", "send", "mark", "needs", "passes") if out is None else out.unionByName(passed.select(*out.columns))
    return digest, out


def recap(planned: DataFrame, days: Column, *, alone_upto: int = 1, over: int = 5) -> DataFrame:
    """planned with `in_recap`: reminders of more than `alone_upto` days go in one message, if there are more than `over` of them on a channel."""
    later = F.exists(F.col("send"), lambda k: k != "new") & F.coalesce(days > alone_upto, F.lit(True))
    counts = planned.filter(later).groupBy("channel").agg(F.count(F.lit(1)).alias("_later"))
    return planned.withColumn("_is_later", later).join(counts, "channel", "left").withColumn("in_recap", F.col("_is_later") & F.coalesce(F.col("_later") > over, F.lit(False))).drop("_later", "_is_later")


def chat_digest(notices: DataFrame, order: str, most: int = 10) -> DataFrame:
    """text: the first `most` titles in order, a line each, and how many others there are. The limit is the message's."""
    n = notices.count()
    others = F.lit(f"\n... et {n - most} autre(s)" if n > most else "")
    first = notices.orderBy(order).limit(most).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("title")))).alias("t"))
    return first.select(F.concat(F.array_join(F.transform("t", lambda x: F.concat(F.lit("- "), x["title"])), "\n"), others).alias("text"))
