"""Notifications: what to send and mark on each channel, messages, and caps."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import blank, escape_html, truthy

# Channels in their order, and reminders from the most urgent with the days up to which each holds.
CHANNELS = ("email", "telegram")
REMINDERS = (("expired", None), ("j1", 1), ("j3", 3), ("j7", 7))
ADVICE = "Consultez toujours la source officielle avant de candidater."
HEADS = {"new": "Nouvelle opportunite", "j7": "Echeance dans 7 jours", "j3": "URGENT - echeance proche", "j1": "DERNIER RAPPEL - echeance demain", "expired": "Opportunite expiree"}


@dataclass(frozen=True)
class Rules:
    """Which messages are on, and whether reminders are kept for followed notices."""

    new: bool = True
    j7: bool = True
    j3: bool = True
    j1: bool = True
    expired: bool = False
    followed_only: bool = False


def channels_of(mark: Column) -> Column:
    """The channels that a mark names; an old mark that says yes means all of them."""
    named = F.filter(F.transform(F.split(F.lower(F.coalesce(mark.cast("string"), F.lit(""))), ","), lambda x: F.trim(x)), lambda c: c.isin(*CHANNELS))
    return F.when(truthy(mark), F.array(*map(F.lit, CHANNELS))).otherwise(named)


def was_sent(mark: Column, channel: str) -> Column:
    return F.array_contains(channels_of(mark), channel)


def add_channel(mark: Column, channel: str) -> Column:
    """The mark with one channel more, always in the same order."""
    held = channels_of(mark)
    return F.array_join(F.filter(F.array(*map(F.lit, CHANNELS)), lambda c: (c == channel) | F.array_contains(held, c)), ",")


def due(days: Column, followed: Column, marks: dict[str, Column], rules: Rules, channel: str) -> Column:
    """struct<send, mark>: what goes out on a channel now, and what is marked as sent there.

    The new-notice message and the most urgent reminder that is due are sent; wider reminders that are due are marked with
    it, so that they don't follow later. Reminders kept for followed notices are neither sent nor marked for others.
    """
    allowed = truthy(followed) if rules.followed_only else F.lit(True)

    def open_for(name: str, upto: int | None) -> Column:
        if not getattr(rules, name):
            return F.lit(False)
        held = F.coalesce(days < 0 if upto is None else days.between(0, upto), F.lit(False))
        return held & allowed & ~was_sent(marks[name], channel)

    first = F.lit(bool(rules.new)) & ~was_sent(marks["new"], channel)
    candidates = [(name, open_for(name, upto)) for name, upto in REMINDERS]
    urgent = F.when(F.lit(False), "")
    for name, held in candidates:
        urgent = urgent.when(held, name)
    order = {"j7": 0, "j3": 1, "j1": 2, "expired": 3}
    marked = [F.when(held, name) for name, held in sorted(candidates, key=lambda x: order[x[0]])]
    return F.struct(F.array_compact(F.array(F.when(first, "new"), urgent)).alias("send"), F.array_compact(F.array(*marked, F.when(first, "new"))).alias("mark"))


def _line(label: str, c: Column) -> Column:
    return F.when(~blank(c.cast("string")), F.concat(F.lit(f"{label} : "), c.cast("string")))


def detail(o: dict[str, Column]) -> Column:
    """The lines of a notice, those without a value left out."""
    lines = [
        F.concat(F.lit("Titre : "), o["title"]), _line("Organisation", o["organisation"]), _line("Pays", o["country"]), _line("Type", o["type"]), _line("Pertinence", o["relevance"]), _line("Budget", o["budget"]),
        _line("Secteur", o["sector"]), _line("Date de publication", o["published"]), F.concat(F.lit("Deadline : "), F.coalesce(o["deadline"].cast("string"), F.lit("a verifier"))),
        F.concat(F.lit("Jours restants : "), F.coalesce(o["days_left"].cast("string"), F.lit("inconnu"))), _line("Lien officiel", o["link"]), F.when(~blank(o["summary"]), F.concat(F.lit("\nResume :\n"), o["summary"])),
    ]
    return F.concat_ws("\n", *lines)


def mail(kind: Column, o: dict[str, Column], prefix: str = "[tidemark]") -> Column:
    """struct<subject, body> of an email."""
    title, days = o["title"], o["days_left"].cast("string")
    tail = F.concat(F.lit("\n\n"), detail(o), F.lit(f"\n\n{ADVICE}"))
    subject = (
        F.when(kind == "new", F.concat(F.lit("Nouvelle opportunite - "), F.coalesce(o["organisation"], F.lit("source")), F.lit(" - "), title))
        .when(kind == "j7", F.concat(F.lit("Deadline dans 7 jours - "), title))
        .when(kind == "j3", F.concat(F.lit("URGENT - "), days, F.lit(" jours restants - "), title))
        .when(kind == "j1", F.concat(F.lit("DERNIER RAPPEL - Deadline demain - "), title))
        .otherwise(F.concat(F.lit("Opportunite expiree - "), title))
    )
    body = (
        F.when(kind == "new", F.concat(F.lit("Nouvelle opportunite detectee."), tail))
        .when(kind == "j7", F.concat(F.lit("Cette opportunite arrive bientot a echeance."), tail))
        .when(kind == "j3", F.concat(F.lit("Il ne reste que "), days, F.lit(" jour(s)."), tail))
        .when(kind == "j1", F.concat(F.lit("Dernier rappel avant echeance."), tail))
        .otherwise(F.concat(F.lit("La deadline est passee.\n\nTitre : "), title, F.lit("\nDeadline : "), F.coalesce(o["deadline"].cast("string"), F.lit(""))))
    )
    return F.struct(F.concat(F.lit(f"{prefix} "), subject).alias("subject"), body.alias("body"))


def chat(kind: Column, o: dict[str, Column], most: int = 4096) -> Column:
    """The text of a chat message, with the little markup that it may have, cut at `most` characters."""
    days = o["days_left"]
    left = F.when(days.isNull(), "").when(days < 0, " (passee)").when(days == 0, " (aujourd'hui)").otherwise(F.concat(F.lit(" (dans "), days.cast("string"), F.when(days > 1, " jours)").otherwise(" jour)")))
    heads = F.create_map(*(F.lit(x) for pair in HEADS.items() for x in pair))
    when = F.when(o["deadline"].isNull(), "Echeance : a verifier sur la source").otherwise(F.concat(F.lit("Echeance : "), o["deadline"].cast("string"), left))
    who = F.concat_ws(" - ", *(F.when(~blank(o[c]), escape_html(o[c])) for c in ("organisation", "country")))
    lines = F.concat_ws("\n", F.concat(F.lit("<b>"), F.try_element_at(heads, kind), F.lit("</b>")), escape_html(o["title"]), F.when(who != "", who), when, F.when(~blank(o["link"]), escape_html(o["link"])))
    return F.substring(lines, 1, most)


def recipients(setting: Column) -> Column:
    """Addresses of a list: the parts with an @ that isn't their first character."""
    return F.filter(F.transform(F.split(F.coalesce(setting, F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda a: F.locate("@", a) > 1)


def calendar_days(setting: Column) -> Column:
    """Days before the deadline on which a calendar reminds: whole numbers from 0 to 28."""
    return F.filter(F.transform(F.split(F.coalesce(setting, F.lit("")), "[;,]"), lambda p: F.trim(p).try_cast("int")), lambda n: n.between(0, 28))


def under_cap(outbox: DataFrame, channel: str, needs: str, order: str, cap: int) -> DataFrame:
    """outbox with `passes`: per channel and in order (unique in a channel), a row goes if all its messages still fit under the cap (0: no cap).

    A row that doesn't fit is passed over, and a later one that needs less may still go, so a running sum is no substitute.
    What goes depends on at most `cap` rows of each need: only the first `cap` rows of one message and of two can fit, so
    each channel's fold sees a bounded number of rows.
    """
    from pyspark.sql.window import Window

    if cap <= 0:
        return outbox.withColumn("passes", F.lit(True))
    nth = F.row_number().over(Window.partitionBy(channel, needs).orderBy(order))
    could = outbox.withColumn("_nth", nth).filter((F.col("_nth") <= cap) & (F.col(needs) > 0)).select(channel, order, needs)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        sent, passes = 0, []
        for need in rows.sort_values(order)[needs]:
            passes.append(sent + need <= cap)
            sent += need * passes[-1]
        return rows.sort_values(order)[[channel, order]].assign(passes=passes)

    kinds = dict(outbox.dtypes)
    told = could.groupBy(channel).applyInPandas(fold, f"`{channel}` {kinds[channel]}, `{order}` {kinds[order]}, passes boolean")
    return outbox.join(told, [channel, order], "left").withColumn("passes", F.coalesce("passes", F.col(needs) == 0))
