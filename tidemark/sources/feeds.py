"""RSS 2.0, RSS 1.0 and Atom by patterns: feeds are malformed too often for an XML reader."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.dates import extract_deadline, feed_date
from tidemark.functions.text import let, or_null, strip_tags, tag_content, truncate
from tidemark.functions.urls import clean_link, entry_link
from tidemark.sources.entries import each, entry


def is_feed(body: Column) -> Column:
    """The body says near its start that it is a feed, be it an empty one."""
    return F.coalesce(F.substring(body, 1, 4000).rlike(r"(?i)<(rss|feed|rdf:RDF)\b"), F.lit(False))


def author(block: Column) -> Column:
    """Who publishes: an address alone names nobody, a name in brackets after an address counts, other text is the name."""
    named = r"^[^\s@]+@[^\s@]+\s*\(([^)]+)\)$"
    return let(strip_tags(tag_content(block, "author")), lambda said: F.when(said.rlike(named), F.trim(F.regexp_extract(said, named, 1))).when(said.rlike(r"^[^\s@]+@[^\s@]+$"), "").otherwise(said))


def _first(block: Column, *tags: str) -> Column:
    return F.coalesce(*(or_null(tag_content(block, t)) for t in tags), F.lit(""))


def read_feed(body: Column) -> Column:
    """Entries of a feed in order; titles that are all alike are for operators.resolve.identical_titles()."""

    def one(block: Column) -> Column:
        title, summary = strip_tags(tag_content(block, "title")), strip_tags(_first(block, "description", "summary", "content"))
        return entry(
            title=title, link=clean_link(entry_link(block)), published=feed_date(_first(block, "pubDate", "published", "updated", "dc:date")), summary=truncate(summary),
            deadline=extract_deadline(F.concat_ws(" ", title, summary)), organisation=or_null(author(block)),
        )

    return each(F.regexp_extract_all(body, F.lit(r"(?is)<(item|entry)\b.*?</\1>"), F.lit(0)), one)
