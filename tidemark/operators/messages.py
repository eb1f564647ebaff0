"""Messages: what a plan of sending says, one by one, as a recap of reminders or as a digest, each under its channel's length."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vocabulary as v
from tidemark.functions.text import blank, escape_html, trimmed
from tidemark.operators import notify

#: kind: of one notice (new, j7, ...), recap or digest; id: the notice, null for messages of many; part: from 0, of messages cut in several.
MESSAGE = "channel string, kind string, id string, part int, n int, subject string, body string"

# The longest chat message, lines of a chat recap, and the words around them.
CHAT_LENGTH, CHAT_LINES = 4096, 10
#: A mail of many rows is cut far below what mail hosts take.
MAIL_LENGTH = 200_000


def cut(lines: DataFrame, keys: list[str], order: list[str], text: str, most: Column | int, *, number: bool = False) -> DataFrame:
    """keys, part, n, body: the lines of each key in order, as many in a message as fit under `most` characters, joined by newlines.

    No line is lost or split between messages; one that is longer than a message is cut at its end. `number` puts each line's number in front.
    Lines stream through a task in order and a message at a time is held, so memory is bounded by `most`. Keys are texts.
    """
    names = [*keys, "part", "n", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size, part, seen = None, [], 0, 0, 0
        for b in batches:
            out = []
            for *key, line, limit in zip(*(b.column(k).to_pylist() for k in range(len(keys) + 2)), strict=True):
                if key != at:
                    if held:
                        out.append((*at, part, len(held), "\n".join(held)))
                    at, held, size, part, seen = key, [], 0, 0, 0
                seen += 1
                line = (f"{seen}. {line}" if number else line or "")[:limit]
                if held and size + 1 + len(line) > limit:
                    out.append((*at, part, len(held), "\n".join(held)))
                    held, size, part = [], 0, part + 1
                size += len(line) + bool(held)
                held.append(line)
            yield _batch(out, names, len(keys))
        if held:
            yield _batch([(*at, part, len(held), "\n".join(held))], names, len(keys))

    dealt = lines.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, F.coalesce(text, F.lit("")).alias("line"), F.lit(most).cast("int").alias("limit") if isinstance(most, int) else most.cast("int").alias("limit"))
    return dealt.mapInArrow(run, ", ".join(f"`{k}` string" for k in keys) + ", part int, n int, body string")


def _batch(rows: list[tuple], names: list[str], texts: int) -> pa.RecordBatch:
    kinds = [pa.string()] * texts + [pa.int32(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=names)


def _told(o: dict[str, Column]) -> Column:
    """The two or three lines of a notice in a message of many."""
    dash = lambda c: F.when(blank(c.cast("string")), "-").otherwise(c)
    who = F.concat(F.lit("   Organisation : "), dash(o["organisation"]), F.lit(" | Pays : "), dash(o["country"]), F.lit(" | Deadline : "), F.coalesce(o["deadline"].cast("string"), F.lit("a verifier")))
    return F.concat(who, F.when(blank(o["link"]), "").otherwise(F.concat(F.lit("\n   "), o["link"])), F.lit("\n"))


def when(days: Column) -> Column:
    """How long there is, as a recap says it."""
    return F.when(days.isNull(), "echeance a verifier").when(days < 0, "echeance passee").when(days == 0, "dernier jour").otherwise(F.concat(F.lit("dans "), days.cast("string"), F.when(days > 1, " jours").otherwise(" jour")))


def _counted(messages: DataFrame, rows: DataFrame, head: Column, subject: Column, foot: str) -> DataFrame:
    """Messages with a head in the first and a foot in the last. head and subject may name n, the number of rows on the channel."""
    totals = rows.groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
    last = messages.groupBy("channel").agg(F.max("part").alias("last"))
    whole = messages.withColumnRenamed("n", "lines").join(totals, "channel").join(last, "channel")
    body = F.concat(F.when(F.col("part") == 0, F.concat(head, F.lit("\n\n"))).otherwise(""), F.col("body"), F.when(F.col("part") == F.col("last"), F.lit(f"\n{foot}")).otherwise(""))
    return whole.select("channel", "part", F.col("lines").alias("n"), subject.alias("subject"), body.alias("body"))


def recap(rows: DataFrame, prefix: str = "[tidemark]") -> DataFrame:
    """Messages of the reminders that go together. rows: channel, place and the notice's fields.

    A mail lists all; a chat message names the first ten and says how many others there are.
    """
    o = {c: F.col(c) for c in ("title", "organisation", "country", "deadline", "link")}
    n = F.col("n").cast("string")
    mails, chats = rows.filter("channel <> 'telegram'"), rows.filter("channel = 'telegram'")
    lines = mails.withColumn("line", F.concat(o["title"], F.lit("  ["), when(F.col("days_left")), F.lit("]\n"), _told(o)))
    mail = _counted(cut(lines, ["channel"], ["place"], "line", MAIL_LENGTH, number=True), mails, F.concat(F.lit("Echeances a surveiller : "), n), F.concat(F.lit(f"{prefix} "), n, F.lit(" echeance(s) a surveiller")), notify.ADVICE)
    short = chats.withColumn("line", F.concat(escape_html(F.coalesce("title", F.lit(""))), F.when(F.col("deadline").isNotNull(), F.concat(F.lit(" - "), F.col("deadline").cast("string"))).otherwise("")))
    chat = first_lines(short, "line", F.concat(F.lit("<b>"), n, F.lit(" echeances a surveiller</b>")), number=True)
    return mail.unionByName(chat).withColumn("kind", F.lit("recap")).withColumn("id", F.lit(None).cast("string"))


def first_lines(rows: DataFrame, line: str, head: Column, most: int = CHAT_LINES, *, number: bool = False) -> DataFrame:
    """One chat message for each channel: a head, the first `most` lines by place, and how many others there are. The limit is the message's.

    Of each task no more than `most` rows reach the shuffle; the count is made beside.
    """
    from pyspark.sql.window import Window

    totals = rows.groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy("channel").orderBy("place"))
    first = rows.withColumn("_nth", nth).filter(F.col("_nth") <= most)
    said = F.concat(F.col("_nth").cast("string"), F.lit(". "), F.col(line)) if number else F.concat(F.lit("- "), F.col(line))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_nth", said.alias("t")))), lambda x: x["t"]), "\n")
    joined = first.groupBy("channel").agg(body.alias("lines")).join(totals, "channel")
    others = F.when(F.col("n") > most, F.concat(F.lit("\n\n... et "), (F.col("n") - most).cast("string"), F.lit(" autres."))).otherwise("")
    room = F.lit(CHAT_LENGTH) - F.length(head) - F.length(others) - 2
    return joined.select("channel", F.lit(0).alias("part"), F.col("n").cast("int").alias("n"), F.lit("").alias("subject"), F.concat(head, F.lit("\n\n"), F.substring("lines", F.lit(1), room), others).alias("body"))


def digest(rows: DataFrame, group: str | None = None, prefix: str = "[tidemark]") -> DataFrame:
    """Messages for many new notices at once: groups in the order in which the list first names them, each under its name and size.

    rows: channel, place and the notice's fields. A mail holds all; a chat message the first ten titles.
    """
    n, o = F.col("n").cast("string"), {c: F.col(c) for c in ("organisation", "country", "deadline", "link")}
    mails, chats = rows.filter("channel <> 'telegram'"), rows.filter("channel = 'telegram'")
    name = F.coalesce(F.when(~blank(F.col(group)), trimmed(F.col(group))), F.lit(v.UNKNOWN_SECTOR)) if group else F.lit("")
    named = mails.withColumn("_group", name)
    sizes = named.groupBy("channel", "_group").agg(F.count(F.lit(1)).alias("_n"), F.min("place").alias("_first"))
    title = F.concat(F.col("title"), F.when(blank(F.col("relevance")), "").otherwise(F.concat(F.lit("  ["), F.col("relevance"), F.lit("]"))), F.lit("\n"), _told(o))
    heads = sizes.filter("_group <> ''").select("channel", "_first", "_group", F.lit("").alias("place"), F.concat(F.lit("== "), F.upper("_group"), F.lit(" ("), F.col("_n").cast("string"), F.lit(") ==\n")).alias("line"))
    lines = named.join(sizes, ["channel", "_group"]).select("channel", "_first", "_group", "place", title.alias("line")).unionByName(heads)
    mail = _counted(cut(lines, ["channel"], ["_first", "_group", "place"], "line", MAIL_LENGTH), mails, F.concat(F.lit("Nouvelles opportunites detectees : "), n), F.concat(F.lit(f"{prefix} "), n, F.lit(" nouvelles opportunites detectees")), notify.ADVICE)
    chat = first_lines(chats.withColumn("line", escape_html(F.coalesce("title", F.lit("")))), "line", F.concat(F.lit("<b>"), n, F.lit(" nouvelles opportunites</b>")))
    return mail.unionByName(chat).withColumn("kind", F.lit("digest")).withColumn("id", F.lit(None).cast("string"))


def singles(rows: DataFrame, prefix: str = "[tidemark]") -> DataFrame:
    """A message for each kind that each row sends. rows: channel, id, send and the notice's fields."""
    o = {c: F.col(c) for c in ("title", "organisation", "country", "type", "relevance", "budget", "sector", "published", "deadline", "days_left", "link", "summary")}
    each = rows.withColumn("kind", F.explode("send"))
    mailed = notify.mail(F.col("kind"), o, prefix)
    chat = F.col("channel") == "telegram"
    return each.select("channel", "kind", "id", F.lit(0).alias("part"), F.lit(1).alias("n"), F.when(chat, "").otherwise(mailed["subject"]).alias("subject"), F.when(chat, notify.chat(F.col("kind"), o)).otherwise(mailed["body"]).alias("body"))


def compose(notices: DataFrame, planned: DataFrame, is_digest: bool, is_new: Column, *, group: str | None = None) -> DataFrame:
    """All messages of a plan (columns of MESSAGE). planned: sending.recap() of sending.plan(); notices: what it was made from, with `id`.

    Rows that pass are told one by one, but for reminders that go in the recap; new notices are in the digest if there is one.
    """
    names = [f.split()[0] for f in MESSAGE.split(", ")]
    passing = planned.filter("passes").select("channel", "id", "place", "send", "in_recap")
    told = passing.join(notices, "id")
    alone = told.withColumn("send", F.when(F.col("in_recap"), F.filter("send", lambda k: k == "new")).otherwise(F.col("send")))
    out = singles(alone).select(*names).unionByName(recap(told.filter("in_recap")).select(*names))
    if is_digest:
        listed = planned.filter(F.array_contains("mark", "new")).select("channel", "id", "place").join(notices.filter(is_new), "id")
        out = out.unionByName(digest(listed, group).select(*names))
    return out
