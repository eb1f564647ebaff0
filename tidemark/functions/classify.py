"""Sector, type, status and relevance of a notice, by rules over closed vocabularies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import vocabulary as v
from tidemark.functions.text import blank, has_words, let, listed, matches_any, normalize, text, trimmed


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def infer_sector(title: Column) -> Column:
    """The first sector with a term in the title, "" if none has: a term of several words anywhere in the normalized text, one of one word at the start of a word."""
    return let(normalize(title), lambda n: let(F.concat(F.lit(" "), n, F.lit(" ")), sector_of))


def sector_of(padded: Column) -> Column:
    """The same of a title that is normalized already and has a blank at either end. Where many titles are read, make that a
    column by itself first, so that Spark compiles the rules."""
    out = F.when(F.lit(False), "")
    for sector, terms in v.SECTOR_TERMS.items():
        out = out.when(_any([padded.contains(t if " " in t else f" {t}") for t in terms]), sector)
    return out.otherwise("")


def normalize_type(c: Column) -> Column:
    """The common name of a type. An unknown label stays as it is, unless it is over 40 characters or has three digits in a row: then it is no type, and ""."""
    known = F.create_map(*(F.lit(x) for name, labels in v.TYPE_LABELS.items() for label in labels for x in (label, name)))
    return let(trimmed(text(c)), lambda raw: F.when(raw == "", "").otherwise(F.coalesce(F.try_element_at(known, normalize(raw)), F.when((F.length(raw) > 40) | raw.rlike(r"\d{3}"), "").otherwise(raw))))


def deadline_status(days: Column) -> Column:
    """What the days that are left mean; unknown without a deadline."""
    out = F.when(days.isNull(), v.STATUS_UNKNOWN).when(days < 0, v.STATUS_EXPIRED)
    for name, upto in v.STATUS_UP_TO:
        out = out.when(days <= upto, name)
    return out.otherwise(v.STATUS_OPEN)


def status_colour(status: Column) -> Column:
    colours = F.create_map(*(F.lit(x) for pair in v.STATUS_COLOURS.items() for x in pair))
    return F.coalesce(F.try_element_at(colours, status), F.lit(v.STATUS_COLOURS[v.STATUS_UNKNOWN]))


def names_elsewhere(title: Column, followed: list[str]) -> Column:
    """The title names a known country, and none that is followed."""
    known = listed(",".join(v.COUNTRIES))
    theirs = [c for c in known if any(f" {f} " in f" {c} " or f" {c} " in f" {f} " for f in followed)]
    return let(normalize(title), lambda n: _any([has_words(n, c) for c in known]) & ~_any([has_words(n, c) for c in theirs]))


def relevance_points(country: Column, sector: Column, title: Column, countries: str | None, sectors: str | None) -> Column:
    """0 to 4: up to two points for the country and two for the sector."""
    followed, wanted = listed(countries), listed(sectors)
    if followed:
        free = blank(country) | matches_any(country, listed(",".join(v.OPEN_PLACES)))
        place = F.when(matches_any(country, followed), 2).when(free & ~names_elsewhere(title, followed), 1).otherwise(0)
    else:
        place = F.lit(1)
    field = F.when(matches_any(sector, wanted), 2).when(blank(sector) | (sector == v.UNKNOWN_SECTOR), 1).otherwise(0) if wanted else F.lit(2)
    return place + field


def relevance(country: Column, sector: Column, title: Column, countries: str | None, sectors: str | None) -> Column:
    """The label of the points; the higher the label sorts, the more it concerns the client."""

    def label(points: Column) -> Column:
        out = F.when(F.lit(False), "")
        for name, least in v.RELEVANCE_FROM:
            out = out.when(points >= least, name)
        return out.otherwise(v.RELEVANCE_OUTSIDE)

    return let(relevance_points(country, sector, title, countries, sectors), label)


def notifiable(label: Column, wanted: str | None) -> Column:
    """The label is one of those that are worth a message, by name or by rank; all are if none is listed, and one without label is."""
    levels = listed(wanted)
    if not levels:
        return F.lit(True)
    n, rank = normalize(label), F.regexp_extract(trimmed(text(label)), r"^(\d)", 1)
    return blank(label) | _any([n.contains(w) | F.lit(w).contains(n) | (rank == w) for w in levels])


def country_rank(country: Column, countries: str | None) -> Column:
    """The country's place in the followed list, 9999 if it isn't there."""
    out = F.when(F.lit(False), 0)
    for i, name in enumerate(listed(countries)):
        out = out.when(has_words(normalize(country), name), i)
    return out.otherwise(9999)


def is_plan_title(title: Column) -> Column:
    """A procurement plan or general notice, not a call."""
    return title.rlike(r"(?i)plans? (\S+ )?de passation|avis g[eé]n[eé]ral de passation|\bAGPM\b")


def type_by_title(title: Column) -> Column:
    """The type that a notice's title gives away, or null."""
    return F.when(title.rlike(r"(?i)manifestation\s+d.?inter[eê]t|\bami\b"), "AMI").when(title.rlike(r"(?i)demande\s+de\s+(cotation|prix)|cotation"), "Demande de cotation").when(title.rlike("(?i)recrutement|consultant"), "Recrutement")


def type_by_contract(contract: Column) -> Column:
    """A job, if the contract is one, or null."""
    return F.when(contract.rlike(r"(?i)\b(CDD|CDDU|CDI|stage|alternance|apprentissage)\b"), "Recrutement")


def bucket(days: Column, status: Column, closed: tuple[str, ...]) -> Column:
    """The reminder level of a file: closed ones first, then by days."""
    return F.when(status.isin(*closed), "closed").when(days.isNull(), "none").when(days < 0, "expired").when(days <= 2, "j1").when(days <= 7, "j3").when(days <= 15, "j7").otherwise("ok")


def reminder_days(setting: str | None) -> list[int]:
    """"14;7;3;1" as days, the farthest first."""
    import re

    return sorted((int(m[1]) for p in re.split("[;,]", setting or "") if (m := re.match(r"\s*(\d+)", p))), reverse=True)


def reminds(days: Column, status: Column, on: list[int], closed: tuple[str, ...]) -> Column:
    """A reminder is due on the very day, and never for a closed file."""
    return F.coalesce(~status.isin(*closed), F.lit(True)) & F.coalesce(days.isin(*on), F.lit(False))


def watch_score(notice: dict[str, Column], watch: dict) -> tuple[Column, Column]:
    """(score, excluded): 0 and excluded for a banned word or a past deadline; else 20 country, 30 sector, 15 type, 20 keyword, 10 time left, 5 budget.

    notice: country, sector, type, haystack (normalized title, organisation and notes), days, budget. watch: lists countries,
    sectors, types, wanted, banned, and numbers min_days (7), min_budget, max_budget.
    """
    plain = lambda k: [w for x in watch.get(k, ()) for w in listed(x)]
    among = lambda c, k: normalize(c).isin(*plain(k)) if plain(k) else F.lit(False)
    worth = lambda points, held: F.when(held, points).otherwise(0)
    holds = lambda k: _any([notice["haystack"].contains(w) for w in plain(k)])
    days, budget = notice["days"], notice["budget"]
    low, high = watch.get("min_budget"), watch.get("max_budget")
    fits = budget.isNotNull() & (F.lit(True) if low is None else budget >= low) & (F.lit(True) if high is None else budget <= high)
    excluded = holds("banned") | F.coalesce(days < 0, F.lit(False))
    total = worth(20, among(notice["country"], "countries")) + worth(30, among(notice["sector"], "sectors")) + worth(15, among(notice["type"], "types"))
    total = total + worth(20, holds("wanted")) + worth(10, F.coalesce(days >= watch.get("min_days", 7), F.lit(False))) + worth(5, fits)
    return F.when(excluded, 0).otherwise(F.least(total, F.lit(100))), excluded


def watch_label(score: Column) -> Column:
    return F.when(score >= 80, "Tres pertinent").when(score >= 60, "A analyser").when(score >= 40, "Faible priorite").otherwise("Ignorer")
